"""Grouping captures into bursts: close in time and alike, compared with the frame before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shootlake.operators import ordered

# Defaults for the longest gap and the most differing signature bits of one burst.
WITHIN_SECONDS = 3
SIGNATURE_DISTANCE = 12

CHUNK = ordered.CHUNK


def signature_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures; a missing one is no evidence and reads as zero."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(0))


def _parts(within: int, distance: int, now: Column, before: Column) -> tuple[Column, Column]:
    """(bits apart, starts a burst) for two captures given as structs of seconds and signature."""
    bits = signature_distance(now["signature"], before["signature"])
    apart = F.coalesce(F.abs(now["seconds"] - before["seconds"]) > within, F.lit(True))
    return F.when(before.isNotNull(), bits), before.isNotNull() & (apart | (bits > distance))


def index(captures: DataFrame, within: int = WITHIN_SECONDS, distance: int = SIGNATURE_DISTANCE,
          width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Add `burst` (from 0, input order), `place` (from 0), `size`, `boundary` and `distance`.

    A project is cut into chunks of at most `width` sequence numbers; one summary row per chunk carries
    the state on, so no project is a single task.
    """
    numbered = number(captures, within, distance, width)
    sizes = numbered.groupBy("project_id", "burst").agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(sizes, ["project_id", "burst"])


def number(captures: DataFrame, within: int = WITHIN_SECONDS, distance: int = SIGNATURE_DISTANCE,
           width: int = ordered.DEFAULT_WIDTH, seeds: DataFrame | None = None) -> DataFrame:
    """`index` without sizes. `seeds` holds the last numbered capture of projects (project_id, seconds,
    signature, burst, place, seq), from where counting goes on; captures that begin before it open a burst.
    """
    inside = Window.partitionBy("project_id", CHUNK).orderBy("seq")
    frame = F.struct("seconds", "signature")
    bits, starts = _parts(within, distance, frame, F.col("_before"))
    local = (ordered.with_chunk(captures, "seq", width)
             .withColumn("_before", F.lag(frame).over(inside))
             .withColumn("_bits", bits).withColumn("_starts", starts)
             .withColumn("_n", F.row_number().over(inside).cast("long"))
             .withColumn("_opened", F.sum(F.col("_starts").cast("long")).over(inside))
             .withColumn("_at", F.max(F.when(F.col("_starts"), F.col("_n"))).over(inside)))
    # one row per chunk: how it begins and ends, its rows, and the bursts opened inside it
    summary = local.groupBy("project_id", CHUNK).agg(
        F.min_by(frame, "seq").alias("_first"), F.max_by(frame, "seq").alias("_last"),
        F.max("_n").alias("_rows"), F.max("_opened").alias("_inner"), F.max("_at").alias("_last_at"), F.min("seq").alias("_from"))
    chunks = Window.partitionBy("project_id").orderBy(CHUNK)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    tail, late, opened, bursts_before = F.lag("_last").over(chunks), F.lit(False), F.lit(None).cast("long"), F.lit(0)
    if seeds is not None:
        seed = F.struct("seconds", "signature", "burst", "place", "seq")
        summary = summary.join(seeds.select("project_id", seed.alias("_seed")), "project_id", "left")
        follows = F.col("_seed").isNotNull() & (F.row_number().over(chunks) == 1)
        tail = F.coalesce(tail, F.when(follows, F.struct("_seed.seconds", "_seed.signature")))
        summary = summary.withColumn("_follows", follows)
        late = F.coalesce(F.col("_follows") & (F.col("_from") < F.col("_seed.seq")), F.lit(False))
        opened, bursts_before = F.when(F.col("_follows"), -F.col("_seed.place")), F.coalesce("_seed.burst", F.lit(0))
    summary = summary.withColumn("_tail", tail)
    edge_bits, edge_starts = _parts(within, distance, F.col("_first"), F.col("_tail"))
    edge_starts = edge_starts | late
    summary = (summary.withColumn("_edge_bits", edge_bits).withColumn("_edge", edge_starts)
               .withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
               .withColumn("_bursts", bursts_before + F.coalesce(
                   F.sum(F.col("_inner") + F.col("_edge").cast("long")).over(earlier), F.lit(0)))
               .withColumn("_start", F.when(F.col("_edge") | F.col("_tail").isNull(), F.col("_base") + 1).otherwise(opened))
               .withColumn("_final", F.coalesce(F.col("_base") + F.col("_last_at"), F.col("_start")))
               .withColumn("_carried", F.last("_final", ignorenulls=True).over(earlier)))
    carried = summary.select("project_id", CHUNK, "_edge_bits", "_edge", "_base", "_bursts", "_start", "_carried")
    at = F.coalesce(F.col("_base") + F.col("_at"), F.col("_start"), F.col("_carried"))
    return (local.join(carried, ["project_id", CHUNK])
            .withColumn("distance", F.when(F.col("_n") == 1, F.col("_edge_bits")).otherwise(F.col("_bits")))
            .withColumn("boundary", F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_starts")))
            .withColumn("burst", F.col("_bursts") + F.col("_edge").cast("long") + F.col("_opened"))
            .withColumn("place", F.col("_base") + F.col("_n") - at)
            .select(*captures.columns, "distance", "boundary", "burst", "place"))


def summarise(index: DataFrame) -> DataFrame:
    """One row per burst: leader, first and last time, size. Combines map-side."""
    return index.groupBy("project_id", "burst").agg(
        F.min_by("key", "seq").alias("leader"),
        F.min_by("seconds", "seq").alias("first_seconds"),
        F.max_by("seconds", "seq").alias("last_seconds"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("size"))


def strip(index: DataFrame, expanded: DataFrame) -> DataFrame:
    """Filmstrip rows: the leader stands for a folded burst of two or more, others stand alone.

    `expanded` holds the (project_id, burst) keys a viewer has unfolded.
    """
    marks = expanded.select("project_id", "burst", F.lit(True).alias("_expanded"))
    tagged = index.join(marks, ["project_id", "burst"], "left")
    folded = (F.col("size") > 1) & F.col("_expanded").isNull()
    shown = tagged.withColumn("_folded", folded).where(~F.col("_folded") | (F.col("place") == 0))
    return shown.withColumn("stands_for", F.when(F.col("_folded"), F.col("size")).otherwise(F.lit(1))).drop(
        "_folded", "_expanded")


def with_selected(index: DataFrame, selected: DataFrame) -> DataFrame:
    """Bursts holding a selected capture, by (project_id, key)."""
    hits = index.join(selected.select("project_id", "key"), ["project_id", "key"], "left_semi")
    return hits.select("project_id", "burst").distinct()


def outward(captures: DataFrame, chosen: int) -> DataFrame:
    """Order outward from the chosen position, earlier first on a tie; a range-partitioned sort."""
    return captures.orderBy("project_id", F.abs(F.col("seq") - chosen), "seq")
