"""The photo catalogue: one normalised record per photo, and photos told apart by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shootlake.functions import text as T


# The twelve tags read from each photo, in order.
TAGS = ["lens", "lens_model", "lens_type", "lens_id", "rating", "xmp_rating",
        "date_original", "date_created", "model", "iso", "f_number", "shutter"]


def usable_tags(exif_raw: DataFrame) -> DataFrame:
    clean = exif_raw.select("photo_id", *[T.trimmed(F.col(t)).alias(t) for t in TAGS])
    return clean.select("photo_id", *[T.usable(F.col(t)).alias(t) for t in TAGS])


def records(exif_raw: DataFrame) -> DataFrame:
    """Lens, rating, time and summary of each photo: projections only, no shuffle.

    Tags are cleaned in a step of their own, so each cleaned value is computed once.
    """
    c = F.col
    dated = usable_tags(exif_raw).withColumns(
        {"_first": T.digits(c("date_original")), "_second": T.digits(c("date_created"))})
    return dated.select(
        "photo_id",
        F.coalesce("lens", "lens_model", "lens_type").alias("lens_description"),
        F.coalesce("lens_type", "lens_id").alias("lens_name"),
        T.star_rating(c("rating"), c("xmp_rating")).alias("rating"),
        T.timestamp_token(F.coalesce("_first", "_second")).alias("timestamp_token"),
        F.coalesce(T.capture_seconds(c("_first")), T.capture_seconds(c("_second"))).alias("seconds"),
        T.capture_summary(c("model"), c("iso"), c("f_number"), c("shutter")).alias("summary"))


def content_key(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def same_content(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct content: its key, the first path, and how many paths carry it.

    Each file shrinks to (key, path) before the shuffle, and copies combine map-side, so a photo
    copied a billion times reaches its reducer as one row per map task.
    """
    return files.select(content_key(F.col(content)).alias("content_key"), "path", "length").groupBy("content_key").agg(
        F.min("path").alias("path"), F.first("length").alias("length"), F.count(F.lit(1)).alias("copies"))


def trusted(files: DataFrame, now: Column) -> DataFrame:
    """Files left alone for two seconds: a younger one may still be being written."""
    return files.where(F.col("modificationTime") <= now - F.expr("INTERVAL 2 SECONDS"))


def changed_since(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, length, time) has not been keyed before."""
    return files.join(known, ["path", "length", "modificationTime"], "left_anti")


# How long and how much the preview cache keeps.
MAX_AGE_SECONDS = 45 * 86400
MAX_BYTES = 4 * 1024 ** 3
SLICE = 1 << 20


def retained(files: DataFrame, now: Column | int, max_age: int = MAX_AGE_SECONDS, max_bytes: int = MAX_BYTES,
             key: str = "file_id", width: int = SLICE) -> DataFrame:
    """Files kept: none older than `max_age`, then the newest whose running size fits `max_bytes`.

    `key` is an integer that breaks ties. A running total over every file would sort them all in one
    task, so sizes are totalled per day (at most `max_age` in days of them) and per slice of `width`
    keys inside a day; only slices the limit cuts through are scanned row by row.
    """
    now = F.lit(now) if isinstance(now, int) else now
    young = files.where(F.col("written") >= now - max_age)
    staged = young.withColumn("_day", F.floor(F.col("written") / 86400)).withColumn(
        "_second", F.col("written")).withColumn("_slice", F.floor(F.col(key) / width))
    days = staged.groupBy("_day").agg(F.sum("size").alias("_total"))
    newest = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select("_day", (F.sum("_total").over(newest)).alias("_upto"), "_total").select(
        "_day", (F.col("_upto") - F.col("_total")).alias("_before"), F.col("_upto"))
    tagged = staged.join(F.broadcast(days), "_day")  # one row per day of the retention period
    inside = tagged.where(F.col("_upto") <= max_bytes)
    cut = tagged.where((F.col("_upto") > max_bytes) & (F.col("_before") < max_bytes))
    # the single day that is cut: totals per second and slice, then rows of the slice that is cut
    slices = cut.groupBy("_day", "_second", "_slice").agg(F.sum("size").alias("_part"), F.first("_before").alias("_before"))
    down = Window.partitionBy("_day").orderBy(F.col("_second").desc(), F.col("_slice")).rowsBetween(
        Window.unboundedPreceding, 0)
    slices = slices.withColumn("_end", F.col("_before") + F.sum("_part").over(down)).select(
        "_day", "_second", "_slice", (F.col("_end") - F.col("_part")).alias("_start"), "_end")
    rows = cut.join(slices, ["_day", "_second", "_slice"])
    each = Window.partitionBy("_day", "_second", "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.where(F.col("_end") <= max_bytes)
    partly = rows.where((F.col("_end") > max_bytes) & (F.col("_start") < max_bytes)).withColumn(
        "_run", F.col("_start") + F.sum("size").over(each)).where(F.col("_run") <= max_bytes)
    return inside.select(*files.columns).unionByName(whole.select(*files.columns)).unionByName(
        partly.select(*files.columns))
