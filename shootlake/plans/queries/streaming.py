"""Registered queries: what the streams deliver when run to the end of the given tables.

Each runs a stream over the events with an available-now trigger into a table below the checkpoint
folder and returns that table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shootlake.plans import fixtures as fx
from shootlake.plans.queries.bursts import DISTANCE, WITHIN, _sql
from shootlake.plans.registry import query
from shootlake.session import ensure_checkpoint_dir
from shootlake.streaming import captures as ST


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _place(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark, stream, sink=None, out=None):
    place = _place(spark)
    out = out or f"{place}/table"
    writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    run = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)).start()
    run.awaitTermination()
    return out


@query("streamed_bursts", _sql("SELECT project_id, seq, burst, place FROM numbered"))
def streamed_bursts(spark, sf):
    signs = fx.signatures(spark, sf)
    ev = _events(spark, sf).selectExpr(
        "user_id AS project_id", "event_id AS seq", "concat('cap-', event_id) AS key",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) END AS seconds",
        "event_id", "event_id % 13 = 0 AS unsigned", "cast(ts as timestamp) AS taken").withColumn(
        "vec_id", F.col("event_id") % fx.rows_of(spark, sf, "embeddings")).drop("event_id")
    rows = ev.join(signs, "vec_id", "left").selectExpr(
        "project_id", "seq", "key", "seconds", "CASE WHEN unsigned THEN NULL ELSE signature END AS signature", "taken")
    out = f"{_place(spark)}/bursts"
    _run(spark, rows, ST.keep_bursts(out, WITHIN, DISTANCE), out)
    return ST.read_bursts(spark, out).select("project_id", "seq", "burst", "place")


@query("streamed_verdicts", """
  SELECT event_id AS photo_id, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN value / 10 > 1.1 THEN 'soft' ELSE 'sharp' END AS verdict FROM events""")
def streamed_verdicts(spark, sf):
    r = _events(spark, sf).selectExpr("event_id AS photo_id", "value / 10 AS blur", "CASE WHEN event_id % 10 = 0 THEN 0.05D ELSE 0.5D END AS judgeable",
                                      "cast(ts as timestamp) AS measured", "explode(array(1, 2)) AS sent")
    out = _run(spark, ST.streamed_verdicts(r))
    return spark.read.parquet(out).select("photo_id", "verdict")


@query("streamed_unique", "SELECT DISTINCT sha256(props) AS content_key FROM events")
def streamed_unique(spark, sf):
    r = _events(spark, sf).selectExpr("cast(event_id as string) AS path", "props AS content", "cast(ts as timestamp) AS arrived")
    out = _run(spark, ST.streamed_unique(r, "60 days"))
    return spark.read.parquet(out).select("content_key")


@query("latest_results", """
  SELECT user_id AS photo_id, event_type AS kind, max(event_id) AS generation, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def latest_results(spark, sf):
    r = _events(spark, sf).selectExpr("user_id AS photo_id", "event_type AS kind", "event_id AS generation", "value")
    out = f"{_place(spark)}/latest"
    _run(spark, r, ST.keep_latest(out, ["photo_id", "kind"], 8), out)
    return ST.read_latest(spark, out).select("photo_id", "kind", "generation", "value")
