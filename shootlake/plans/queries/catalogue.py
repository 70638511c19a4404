"""Registered queries: metadata records, content, focus verdicts and cache retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.operators import catalogue as C
from shootlake.operators import focus as FO
from shootlake.plans import fixtures as fx
from shootlake.plans.registry import query

_TRIM = "trim({0}, e' \\t\\r')"


def _usable(c):
    t = _TRIM.format(c)
    return f"CASE WHEN {t} <> '' AND {t} <> '-' AND lower({t}) <> 'none' AND instr(lower({t}), 'unknown') = 0 THEN {t} END"


_USABLE = "SELECT photo_id, " + ", ".join(f"{_usable(c)} AS {c}" for c in fx.EXIF_COLUMNS) + " FROM exif_raw"


def _rating(c):
    n = f"TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"
    return f"CASE WHEN {n} BETWEEN 1 AND 5 THEN {n} END"


def _digits(c):
    return f"CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 14 THEN regexp_replace({c}, '[^0-9]', '', 'g') END"


_DIGITS = f"SELECT photo_id, {_digits('date_original')} AS d1, {_digits('date_created')} AS d2 FROM usable"


def _seconds(d):
    part = lambda a, n: f"TRY_CAST(substr({d}, {a}, {n}) AS BIGINT)"
    y, mo, da, h, mi, s = part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2)
    return (f"CASE WHEN {y} >= 1900 AND {mo} BETWEEN 1 AND 12 AND {da} BETWEEN 1 AND 31 AND {h} < 24 AND {mi} < 60 AND {s} < 60"
            f" THEN CAST(epoch(make_date({y}, {mo}, 1)) AS BIGINT) + ({da} - 1) * 86400 + {h} * 3600 + {mi} * 60 + {s} + 2208988800 END")


_ALSO = {"usable": _USABLE, "digits": _DIGITS}


@query("usable_values", fx.sql("SELECT * FROM usable", "exif_raw", also={"usable": _USABLE}))
def usable_values(spark, sf):
    return C.usable_tags(fx.exif_raw(spark, sf))


@query("lens_names", fx.sql("""
  SELECT photo_id, coalesce(lens, lens_model, lens_type) AS lens_description, coalesce(lens_type, lens_id) AS lens_name
  FROM usable""", "exif_raw", also=_ALSO))
def lens_names(spark, sf):
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", "lens_description", "lens_name")


@query("star_ratings", fx.sql(f"SELECT photo_id, coalesce({_rating('rating')}, {_rating('xmp_rating')}) AS rating FROM usable",
                              "exif_raw", also=_ALSO))
def star_ratings(spark, sf):
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", "rating")


@query("timestamp_tokens", fx.sql("""
  SELECT photo_id, substr(coalesce(d1, d2), 1, 8) || '-' || substr(coalesce(d1, d2), 9, 6) AS timestamp_token FROM digits""",
                                  "exif_raw", also=_ALSO))
def timestamp_tokens(spark, sf):
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", "timestamp_token")


@query("capture_seconds", fx.sql(f"SELECT photo_id, coalesce({_seconds('d1')}, {_seconds('d2')}) AS seconds FROM digits",
                                 "exif_raw", also=_ALSO))
def capture_seconds(spark, sf):
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", "seconds")


_SUMMARY = "nullif(concat_ws(' | ', model, 'ISO ' || iso, 'f/' || f_number, shutter), '')"


@query("capture_summaries", fx.sql(f"SELECT photo_id, {_SUMMARY} AS summary FROM usable", "exif_raw", also=_ALSO))
def capture_summaries(spark, sf):
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", "summary")


@query("catalogue_records", fx.sql(f"""
  SELECT photo_id, coalesce(lens, lens_model, lens_type) AS lens_description, coalesce(lens_type, lens_id) AS lens_name,
         coalesce({_rating('rating')}, {_rating('xmp_rating')}) AS rating,
         substr(coalesce(d1, d2), 1, 8) || '-' || substr(coalesce(d1, d2), 9, 6) AS timestamp_token,
         coalesce({_seconds('d1')}, {_seconds('d2')}) AS seconds, {_SUMMARY} AS summary
  FROM usable JOIN digits USING (photo_id)""", "exif_raw", also=_ALSO))
def catalogue_records(spark, sf):
    return C.records(fx.exif_raw(spark, sf))


_VERDICT = "CASE WHEN blur IS NULL OR coalesce(judgeable, 0) < {j} THEN 'unknown' WHEN blur > {t} THEN 'soft' ELSE 'sharp' END"


@query("focus_verdicts", fx.sql(f"""
  SELECT project_id, photo_id, {_VERDICT.format(j=0.08, t=1.1)} AS verdict, {_VERDICT.format(j=0.02, t=0.5)} AS strict
  FROM focus""", "focus"))
def focus_verdicts(spark, sf):
    return FO.with_verdicts(fx.focus(spark, sf)).select(
        "project_id", "photo_id", "verdict", FO.verdict(F.col("blur"), F.col("judgeable"), 0.5, 0.02).alias("strict"))


@query("focus_descriptions", fx.sql(f"""
  SELECT project_id, photo_id, CASE WHEN blur IS NOT NULL OR judgeable IS NOT NULL THEN
    CASE {_VERDICT.format(j=0.08, t=1.1)} WHEN 'unknown' THEN 'focus unclear'
         WHEN 'soft' THEN format('soft · blur {{:.1f}} px', blur) ELSE format('sharp · blur {{:.2f}} px', blur) END END AS phrase
  FROM focus""", "focus"))
def focus_descriptions(spark, sf):
    measured = F.col("blur").isNotNull() | F.col("judgeable").isNotNull()
    return fx.focus(spark, sf).select("project_id", "photo_id", FO.description(
        F.col("blur"), F.col("judgeable"), measured).alias("phrase"))


@query("soft_photos", fx.sql(f"SELECT project_id, photo_id, blur FROM focus WHERE {_VERDICT.format(j=0.08, t=1.1)} = 'soft'", "focus"))
def soft_photos(spark, sf):
    return FO.soft(fx.focus(spark, sf)).select("project_id", "photo_id", "blur")


@query("soft_counts", fx.sql(f"""
  SELECT project_id, count(*) AS photos, count(blur) AS measured,
         count(*) FILTER ({_VERDICT.format(j=0.08, t=1.1)} = 'soft') AS soft FROM focus GROUP BY 1""", "focus"))
def soft_counts(spark, sf):
    return FO.counts(fx.focus(spark, sf), ["project_id"])


@query("content_keys", fx.sql("SELECT path, length, sha256(text) AS content_key FROM files", "files"))
def content_keys(spark, sf):
    return fx.files(spark, sf).select("path", F.col("length").cast("long").alias("length"),
                                      C.content_key(F.col("text")).alias("content_key"))


@query("content_dedupe", fx.sql("""
  SELECT sha256(text) AS content_key, min(path) AS path, min(length) AS length, count(*) AS copies
  FROM files GROUP BY 1""", "files"))
def content_dedupe(spark, sf):
    out = C.same_content(fx.files(spark, sf), "text")
    return out.withColumn("length", F.col("length").cast("long"))


_NOW = "(SELECT max(written) FROM cache_files)"


@query("cache_retention", fx.sql(f"""
  SELECT file_id, size, written FROM (
    SELECT *, sum(size) OVER (ORDER BY written DESC, file_id ROWS UNBOUNDED PRECEDING) AS total
    FROM cache_files WHERE written >= {_NOW} - 45 * 86400) WHERE total <= 4294967296""", "cache_files"))
def cache_retention(spark, sf):
    files = fx.cache_files(spark, sf)
    return C.retained(files, int(files.agg(F.max("written")).first()[0]))


@query("oldest_first", fx.sql("""
  SELECT file_id, written, strftime(make_timestamp(written * 1000000), '%Y-%m-%d') AS day FROM cache_files""", "cache_files"))
def oldest_first(spark, sf):
    return fx.cache_files(spark, sf).orderBy("written", "file_id").select(
        "file_id", "written", F.date_format(F.timestamp_seconds("written"), "yyyy-MM-dd").alias("day"))
