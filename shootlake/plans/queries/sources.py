"""Registered queries: tables written with the library's writers, or as users' files, and read back by its readers.

The files lie below the checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shootlake.operators import geometry as GE
from shootlake.operators import store as ST
from shootlake.plans import fixtures as fx
from shootlake.plans.queries.pixels import out, rounded
from shootlake.plans.registry import query
from shootlake.session import ensure_checkpoint_dir
from shootlake.sources import tables as T


def _place(spark, label):
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("exif_read", fx.sql("SELECT photo_id, lens_model, rating, iso, model FROM exif_raw", "exif_raw"))
def exif_read(spark, sf):
    path = _place(spark, "exif")
    fx.exif_raw(spark, sf).write.json(path)
    return T.read_exif(spark, path, "json").select("photo_id", "lens_model", "rating", "iso", "model")


@query("pixels_read", fx.sql(rounded("SELECT image_id, y, x, r, g, b FROM pixels"), "pixels"))
def pixels_read(spark, sf):
    path = _place(spark, "pixels")
    T.write_pixels(fx.pixels(spark, sf), path, 8)
    return out(T.read_pixels(spark, path))


@query("region_read", fx.sql(rounded("""
  SELECT image_id, y, x, r, g, b FROM pixels JOIN frames USING (image_id)
  WHERE x >= floor(0.3 * width) - 16 AND x < ceil(0.55 * width) + 16 AND y >= floor(0.4 * height) - 16 AND y < ceil(0.6 * height) + 16"""), "pixels", "frames"))
def region_read(spark, sf):
    """A window with its halo out of stored pixels; its bounds prune the scan."""
    path = _place(spark, "pixels")
    T.write_pixels(fx.pixels(spark, sf), path, 8)
    halo = GE.halo_of(["crop", "noise_reduction", "optics", "tone", "sharpen"])
    return out(T.read_regions(spark, path, GE.bounds(fx.frames(spark, sf), (0.3, 0.4, 0.25, 0.2), halo), 8))


@query("results_written", "SELECT c_custkey AS project_id, c_name AS name, c_acctbal AS balance FROM customer")
def results_written(spark, sf):
    path = _place(spark, "results")
    ST.write_results(fx.table(spark, sf, "customer").selectExpr("c_custkey AS project_id", "c_name AS name", "c_acctbal AS balance"), path)
    return spark.read.parquet(path).select("project_id", "name", "balance")


def _project_lines(spark, sf):
    """One JSON line per customer; every fifth has a version from the future, every seventh a key nobody knows,
    every eleventh is cut off."""
    whole = F.to_json(F.struct(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 5 == 0, 9).otherwise(F.col("c_custkey") % 4 + 1).cast("int").alias("version"),
        F.concat(F.lit("out/"), F.col("c_custkey").cast("string")).alias("output_dir"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("blue")).alias("mood"),
        F.array(F.struct(F.col("c_custkey").alias("photo_id"), F.col("c_name").alias("input"))).alias("photos")))
    line = F.when(F.col("c_custkey") % 11 == 0, F.left(whole, F.lit(20))).otherwise(whole)
    path = _place(spark, "projects")
    fx.table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return path


@query("projects_read", """
  SELECT c_custkey AS project_id, 'out/' || c_custkey AS output_dir, 'jpeg' AS format, 92::BIGINT AS quality, c_name AS input
  FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0""")
def projects_read(spark, sf):
    projects, photos = T.read_projects(spark, _project_lines(spark, sf))
    return projects.join(photos, "project_id").select("project_id", "output_dir", F.col("export.format").alias("format"),
                                                      F.col("export.quality").cast("long").alias("quality"), "input")


@query("project_violations", """
  SELECT problem, count(*) AS lines FROM (
    SELECT unnest(CASE WHEN c_custkey % 11 = 0 THEN ['malformed'] ELSE list_filter([
      CASE WHEN c_custkey % 5 = 0 THEN 'version' END, CASE WHEN c_custkey % 7 = 0 THEN 'unknown key mood' END], lambda x: x IS NOT NULL) END) AS problem
    FROM customer) GROUP BY 1""")
def project_violations(spark, sf):
    return T.project_violations(spark, _project_lines(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))
