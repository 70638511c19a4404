"""Fixed schemas of the tables a photo archive keeps; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shootlake.operators.catalogue import TAGS

SETTING = "struct<num:double,flag:boolean,text:string>"
SETTINGS = f"map<string,{SETTING}>"
KIND_STATES = "array<struct<kind:string,params:map<string,double>,opacity:double,second_input:int>>"
NODE = ("struct<id:int,kind:string,params:map<string,double>,points:map<string,array<double>>,lut:string,"
        f"opacity:double,inputs:array<int>,bypassed:boolean,kind_states:{KIND_STATES}>")
RECIPE = f"array<{NODE}>"
EXPORT = ("struct<format:string,quality:int,max_width:int,max_height:int,"
          "keep_metadata:boolean,timestamp_names:boolean>")

EXIF_RAW = T.StructType([T.StructField("photo_id", T.LongType())] + [T.StructField(t, T.StringType()) for t in TAGS])
PIXELS = "image_id long, y int, x int, r double, g double, b double"
PHOTOS = (f"project_id long, seq long, photo_id long, input string, output string, overrides {SETTINGS}, "
          f"disabled array<string>, recipe {RECIPE}, recipe_output int")
PROJECTS = f"project_id long, version int, output_dir string, defaults {SETTINGS}, export {EXPORT}"


def read_exif(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(EXIF_RAW).format(form).load(path)


#: Rows of a frame that are stored together.
BAND = 256


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels partitioned by `image_bucket` and `row_band`; filter on them, or on image, row and column, to prune."""
    return spark.read.schema(PIXELS + ", image_bucket int, row_band int").parquet(path)


def _bucket(buckets: int):
    return F.pmod("image_id", F.lit(buckets)).cast("int")


def write_pixels(pixels: DataFrame, path: str, buckets: int = 256) -> None:
    """Rows of one frame land together, sorted, so row groups carry tight image, row and column ranges."""
    # the row band keeps one huge frame from becoming one huge task and file, and lets windows skip the rest of it
    placed = pixels.withColumns({"image_bucket": _bucket(buckets), "row_band": F.floor(F.col("y") / BAND).cast("int")})
    (placed.repartition("image_bucket", "image_id", "row_band")
     .sortWithinPartitions("image_bucket", "row_band", "image_id", "y", "x")
     .write.mode("overwrite").partitionBy("image_bucket", "row_band").parquet(path))


def read_regions(spark: SparkSession, path: str, regions: DataFrame, buckets: int = 256) -> DataFrame:
    """Stored pixels inside each frame's rectangle (image_id, x0, y0, x1, y1; the ends are not in it).

    `buckets` is that of the writing. The rectangles become one row per band of rows, and the join with them prunes buckets
    and bands of the scan while they are few enough for Spark to broadcast; beyond that it is a plain join.
    """
    bands = regions.where("x1 > x0 AND y1 > y0").select(
        "image_id", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], _bucket(buckets).alias("image_bucket"),
        F.explode(F.sequence(F.floor(F.col("y0") / BAND).cast("int"), F.floor((F.col("y1") - 1) / BAND).cast("int"))).alias("row_band"))
    met = read_pixels(spark, path).join(bands, ["image_bucket", "row_band", "image_id"])
    return met.where("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1").select("image_id", "y", "x", "r", "g", "b")


PROJECT_KEYS = ("project_id", "version", "output_dir", "defaults", "export", "photos")


def project_violations(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem) of what `read_projects` leaves out: lines that are no JSON object, versions it does
    not know, and keys without a meaning."""
    lines = spark.read.text(path).where(F.btrim("value") != "").select(F.col("value").alias("line"), F.json_object_keys("value").alias("keys"))
    version = F.get_json_object("line", "$.version").try_cast("int")
    strange = F.array_sort(F.array_except("keys", F.array(*[F.lit(k) for k in PROJECT_KEYS])))
    problems = F.when(F.col("keys").isNull(), F.array(F.lit("malformed"))).otherwise(F.concat(
        F.when(F.coalesce(version.between(1, 4), F.lit(False)), F.array()).otherwise(F.array(F.lit("version"))),
        F.transform(strange, lambda k: F.concat(F.lit("unknown key "), k))))
    return lines.select("line", F.explode(problems).alias("problem"))


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(projects, photos) from JSON lines of versions 1 to 4; fields added later take their defaults.

    `project_violations` tells of all lines and keys left out.
    """
    schema = (f"project_id long, version int, output_dir string, defaults {SETTINGS}, export {EXPORT}, "
              f"photos array<struct<photo_id:long,input:string,output:string,overrides:{SETTINGS},"
              f"disabled:array<string>,recipe:{RECIPE},recipe_output:int>>")
    raw = spark.read.schema(schema).json(path).where(F.col("version").between(1, 4))
    export = F.struct(
        F.coalesce("export.format", F.lit("jpeg")).alias("format"),
        F.coalesce("export.quality", F.lit(92)).alias("quality"),
        F.col("export.max_width").alias("max_width"), F.col("export.max_height").alias("max_height"),
        F.coalesce("export.keep_metadata", F.lit(True)).alias("keep_metadata"),
        F.coalesce("export.timestamp_names", F.lit(False)).alias("timestamp_names"))
    projects = raw.select("project_id", "version", "output_dir", "defaults", export.alias("export"))
    photos = raw.select("project_id", F.posexplode("photos").alias("seq", "p")).select(
        "project_id", F.col("seq").cast("long").alias("seq"), "p.photo_id", "p.input", "p.output",
        F.coalesce("p.overrides", F.expr(f"cast(map() as {SETTINGS})")).alias("overrides"),
        F.coalesce("p.disabled", F.expr("cast(array() as array<string>)")).alias("disabled"),
        "p.recipe", "p.recipe_output")
    return projects, photos
