"""Registered queries: bursts, strips and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.operators import bursts as B
from shootlake.plans import fixtures as fx
from shootlake.plans.registry import query

# Capture gaps in the given data are minutes and unrelated signatures differ by about 32 bits.
WITHIN, DISTANCE = 3600, 32
WIDTH = 1 << 20


def _index(spark, sf, within=WITHIN, distance=DISTANCE):
    return B.index(fx.captures(spark, sf), within, distance, WIDTH)


def _marked_sql(within=WITHIN, distance=DISTANCE):
    return f"""
      SELECT *, coalesce(psec IS NULL OR seconds IS NULL OR abs(seconds - psec) > {within}
             OR coalesce(bit_count(xor(signature, psig)), 0) > {distance}, true) AND rn > 1 AS boundary
      FROM (SELECT *, lag(seconds) OVER w AS psec, lag(signature) OVER w AS psig, row_number() OVER w AS rn
            FROM captures WINDOW w AS (PARTITION BY project_id ORDER BY seq))"""


_NUMBERED = """
  SELECT *, row_number() OVER (PARTITION BY project_id, burst ORDER BY seq) - 1 AS place,
         count(*) OVER (PARTITION BY project_id, burst) AS size
  FROM (SELECT *, CAST(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY seq) AS BIGINT) AS burst FROM marked)"""


def _sql(body, within=WITHIN, distance=DISTANCE, extra=None):
    return fx.sql(body, "captures", also={"marked": _marked_sql(within, distance), "numbered": _NUMBERED, **(extra or {})})


_INDEX_SQL = "SELECT project_id, seq, key, burst, place, size FROM numbered"


@query("burst_index", _sql(_INDEX_SQL))
def burst_index(spark, sf):
    return _index(spark, sf).select("project_id", "seq", "key", "burst", "place", "size")


@query("burst_index_defaults", _sql(_INDEX_SQL, 3, 12))
def burst_index_defaults(spark, sf):
    return _index(spark, sf, B.WITHIN_SECONDS, B.SIGNATURE_DISTANCE).select(
        "project_id", "seq", "key", "burst", "place", "size")


@query("burst_boundaries", _sql("SELECT project_id, seq, boundary FROM marked"))
def burst_boundaries(spark, sf):
    return _index(spark, sf).select("project_id", "seq", "boundary")


@query("burst_summary", _sql("""
  SELECT project_id, burst, arg_min(key, seq) AS leader, min(seq) AS first_seq, max(seq) AS last_seq,
         max(CASE WHEN place = 0 THEN seconds END) AS first_seconds,
         max(CASE WHEN place = size - 1 THEN seconds END) AS last_seconds, count(*) AS size
  FROM numbered GROUP BY 1, 2"""))
def burst_summary(spark, sf):
    return B.summarise(_index(spark, sf))


@query("signature_distance", _sql("""
  SELECT project_id, seq, CASE WHEN rn > 1 THEN CAST(coalesce(bit_count(xor(signature, psig)), 0) AS BIGINT) END AS distance
  FROM marked"""))
def signature_distance(spark, sf):
    return _index(spark, sf).select("project_id", "seq", F.col("distance").cast("long").alias("distance"))


@query("collapsed_strip", _sql("""
  SELECT project_id, seq, key, burst, CASE WHEN size > 1 AND burst % 2 = 0 THEN size ELSE 1 END AS stands_for
  FROM numbered WHERE place = 0 OR NOT (size > 1 AND burst % 2 = 0)"""))
def collapsed_strip(spark, sf):
    index = _index(spark, sf)
    return B.strip(index, B.summarise(index).where("burst % 2 = 1")).select("project_id", "seq", "key", "burst", "stands_for")


@query("bursts_with_selected", _sql("""
  SELECT DISTINCT project_id, burst FROM numbered
  WHERE seq IN (SELECT event_id FROM events WHERE event_type = 'error')"""))
def bursts_with_selected(spark, sf):
    chosen = fx.table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "user_id AS project_id", "concat('cap-', event_id) AS key")
    return B.with_selected(_index(spark, sf), chosen)


@query("outward_order", fx.sql("SELECT project_id, seq, abs(seq - 500) AS steps FROM captures", "captures"))
def outward_order(spark, sf):
    ordered_rows = B.outward(fx.captures(spark, sf), 500)
    return ordered_rows.select("project_id", "seq", F.abs(F.col("seq") - 500).alias("steps"))
