"""Output names, the still gallery, interned files and render reports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shootlake.functions import text as T
from shootlake.operators import ordered
from shootlake.session import ensure_checkpoint_dir

# File endings by export format.
ENDINGS = {"jpeg": "jpg", "tiff": "tif"}
# Folders of render results, and the column that names them.
RESULT_BUCKETS, BUCKET = 64, "project_bucket"


def add_unique(project: DataFrame, batch: DataFrame) -> DataFrame:
    """Photos of `batch` (project_id, seq, input) not in the project yet, each path once, first kept."""
    fresh = batch.join(project.select("project_id", "input"), ["project_id", "input"], "left_anti")
    return fresh.groupBy("project_id", "input").agg(F.min("seq").alias("seq"))


def remove(project: DataFrame, selected: DataFrame) -> DataFrame:
    return project.join(selected.select("photo_id"), "photo_id", "left_anti")


def output_path(output: Column, stem: Column, form: Column, folder: Column) -> Column:
    ending = F.when(form == "tiff", ENDINGS["tiff"]).otherwise(ENDINGS["jpeg"])
    named = F.concat(folder, F.lit("/"), stem, F.lit("."), ending)
    return F.when(output.startswith("/"), output).when(output.isNotNull(), F.concat(folder, F.lit("/"), output)).otherwise(named)


def automatic_stem(photos: DataFrame) -> DataFrame:
    """Add `auto_stem`: the input's stem, behind its timestamp where that is asked for and known."""
    base = T.stem(F.col("input"))
    return photos.withColumn("auto_stem", F.when(F.col("timestamp_names") & F.col("timestamp_token").isNotNull(), F.concat(
        F.col("timestamp_token"), F.lit("-"), base)).otherwise(base))


def free_stems(photos: DataFrame, width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Add `final_stem`: repeats of a stem get -2, -3 ... in project order, never a name already given.

    Only photos without an explicit output in projects naming by timestamp take part. A photo's rank
    among those of its stem is counted in chunks of the project, so one stem repeated without end is no
    single task, and mostly the rank is the number. Choices depend on each other only where a literal
    "-n" stem meets its parent stem, and there only up to the largest such n: those photos alone are
    settled one by one, and later ones of the stem follow by a fixed shift.
    """
    plays = F.col("timestamp_names") & F.col("output").isNull()
    idle = photos.where(~plays).withColumn("final_stem", F.col("auto_stem"))
    keys = ["project_id", "auto_stem"]
    active = ordered.with_chunk(photos.where(plays), "seq", width)
    per_chunk = active.groupBy(*keys, ordered.CHUNK).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy(ordered.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy(*keys, ordered.CHUNK).orderBy("seq")) + F.col("_before")
    ranked = active.join(before, [*keys, ordered.CHUNK]).withColumn("_rank", place)

    stems = per_chunk.select(*keys).distinct()
    children = stems.select("project_id", F.col("auto_stem").alias("_child"), F.regexp_replace("auto_stem", r"-\d+$", "").alias("auto_stem"),
                            F.regexp_extract("auto_stem", r"-([1-9]\d{0,17})$", 1).try_cast("long").alias("_number"))
    met = children.where("_child <> auto_stem").join(stems, keys, "left_semi")
    family = F.regexp_replace("auto_stem", r"(-\d+)+$", "")
    reach = met.groupBy(*keys).agg(F.coalesce(F.max("_number"), F.lit(1)).alias("_reach"))
    involved = reach.unionByName(met.select("project_id", F.col("_child").alias("auto_stem"), F.lit(1).cast("long").alias("_reach")))
    involved = involved.groupBy(*keys).agg(F.greatest(F.max("_reach"), F.lit(1)).alias("_reach"))
    contested = ranked.join(involved, keys).where(F.col("_rank") <= F.col("_reach"))
    settled = contested.select("project_id", family.alias("_family"), "seq", "auto_stem", "_rank").groupBy("project_id", "_family").applyInPandas(
        _first_free, "project_id long, seq long, auto_stem string, _rank long, _settled long")
    shifts = settled.groupBy(*keys).agg(F.max_by(F.col("_settled") - F.col("_rank"), "_rank").alias("_shift"))
    numbered = (ranked.join(settled.select("project_id", "seq", "_settled"), ["project_id", "seq"], "left").join(shifts, keys, "left")
                .withColumn("_number", F.coalesce(F.col("_settled"), F.col("_rank") + F.coalesce("_shift", F.lit(0)))))
    final = F.when(F.col("_number") == 1, F.col("auto_stem")).otherwise(F.concat("auto_stem", F.lit("-"), F.col("_number").cast("string")))
    return idle.unionByName(numbered.withColumn("final_stem", final).select(*photos.columns, "final_stem"))


def _first_free(rows: pd.DataFrame) -> pd.DataFrame:
    """The number each photo's stem ends up with; 1 is the bare stem."""
    rows = rows.sort_values("seq")
    taken: set[str] = set()
    upto: dict[str, int] = {}
    numbers = []
    for stem in rows["auto_stem"]:
        n = upto.get(stem, 0) + 1
        while (stem if n == 1 else f"{stem}-{n}") in taken:
            n += 1
        taken.add(stem if n == 1 else f"{stem}-{n}")
        upto[stem] = n
        numbers.append(n)
    return rows.drop(columns="_family").assign(_settled=numbers)[["project_id", "seq", "auto_stem", "_rank", "_settled"]]


def next_still_name(photos: DataFrame, presets: DataFrame) -> DataFrame:
    """(project_id, photo_id, still): the first unused "Still 001 (photo)" of each photo's project.

    Used numbers are read from the names; the first gap is the smallest n + 1 whose successor is not
    used, so a gallery of any length needs no list of candidates.
    """
    used = presets.select("project_id", F.lower("name").alias("_n")).distinct()
    parts = used.select("project_id", F.regexp_extract("_n", r"^still (\d{3,}) \((.*)\)$", 1).alias("_d"),
                        F.regexp_extract("_n", r"^still (\d{3,}) \((.*)\)$", 2).alias("_stem")).where(
        (F.col("_d") != "") & ((F.length("_d") == 3) | ~F.col("_d").startswith("0")))
    numbers = parts.select("project_id", "_stem", F.col("_d").cast("long").alias("_i")).where(F.col("_i") > 0)
    stems = photos.select("project_id", "photo_id", T.stem(F.col("input")).alias("_src")).withColumn("_stem", F.lower("_src"))
    # 0 counts as used, so that the first free number is always one past a used one
    start = stems.select("project_id", "_stem", F.lit(0).cast("long").alias("_i")).distinct()
    taken = numbers.unionByName(start)
    free = taken.withColumn("_next", F.col("_i") + 1).join(
        numbers.select("project_id", "_stem", F.col("_i").alias("_next")), ["project_id", "_stem", "_next"], "left_anti")
    first = free.groupBy("project_id", "_stem").agg(F.min("_next").alias("_i"))
    return stems.join(first, ["project_id", "_stem"]).select(
        "project_id", "photo_id", F.concat(F.lit("Still "), F.when(F.col("_i") < 1000, F.lpad(F.col("_i").cast("string"), 3, "0")).otherwise(
            F.col("_i").cast("string")), F.lit(" ("), F.col("_src"), F.lit(")")).alias("still"))


def still_id(name: Column) -> Column:
    return F.sha2(name.cast("binary"), 256)


def upsert_stills(store: DataFrame, batch: DataFrame, replace: bool = True) -> DataFrame:
    """The gallery after writing `batch` (name, written, ...): one row per exact name, newest kept.

    With `replace` off, names already in the gallery keep their row and the batch's are dropped; see
    `refused_stills`.
    """
    newest = batch.groupBy("name").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "name"]), F.struct(
        "written", *[c for c in batch.columns if c not in ("name", "written")])).alias("_r")).select("name", "_r.*")
    if not replace:
        return store.unionByName(newest.join(store, "name", "left_anti").select(*store.columns))
    return store.join(newest, "name", "left_anti").unionByName(newest.select(*store.columns))


def refused_stills(store: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(store, "name", "left_semi").select("name").distinct()


def rename_stills(store: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename by (name, new_name); a rename onto a name that exists is left undone."""
    free = renames.where(F.col("name") != F.col("new_name")).join(
        store.select(F.col("name").alias("new_name")), "new_name", "left_anti").groupBy("new_name").agg(F.min("name").alias("name"))
    return store.join(free, "name", "left").withColumn("name", F.coalesce("new_name", "name")).select(*store.columns)


def delete_stills(store: DataFrame, names: DataFrame) -> DataFrame:
    """The gallery without the named stills; names it does not hold change nothing."""
    return store.join(names.select("name"), "name", "left_anti").select(*store.columns)


def gallery(project: DataFrame, local: DataFrame) -> DataFrame:
    """Project and local stills with where they come from, oldest first among the local ones."""
    both = project.withColumn("origin", F.lit("project")).unionByName(local.withColumn("origin", F.lit("local")))
    return both.withColumn("still_id", still_id(F.col("name")))


def interned_path(path: Column, content_key: Column, folder: str) -> Column:
    ending = T.extension(path)
    return F.concat(F.lit(folder + "/"), F.substring(content_key, 1, 12), F.lit("-"), T.stem(path),
                    F.when(ending == "", F.lit("")).otherwise(F.concat(F.lit("."), ending)))


def is_interned(path: Column, folder: str) -> Column:
    return path.startswith(folder + "/") & ~F.contains(F.substring(path, len(folder) + 2, 1 << 30), F.lit("/"))


def intern_plan(files: DataFrame, present: DataFrame, folder: str) -> DataFrame:
    """(path, target, copy) per file: where it will live and whether it must be copied.

    `files` has path and content_key, `present` the targets already there. Running the plan and
    planning again copies nothing.
    """
    placed = files.select("path", F.when(is_interned(F.col("path"), folder), F.col("path")).otherwise(
        interned_path(F.col("path"), F.col("content_key"), folder)).alias("target"))
    there = present.select(F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
    first = placed.groupBy("target").agg(F.min("path").alias("_first"))
    joined = placed.join(there, "target", "left").join(first, "target")
    must = F.col("_there").isNull() & (F.col("path") != F.col("target")) & (F.col("path") == F.col("_first"))
    return joined.select("path", "target", must.alias("copy"))


def resolved(path: Column, base: str) -> Column:
    """Relative paths lie beside the project file; absolute and missing ones stay."""
    return F.when(path.startswith("/"), path).when(path.isNotNull(), F.concat(F.lit(base + "/"), path))


def resolve_paths(photos: DataFrame, base: str) -> DataFrame:
    """Inputs, override LUTs and recipe LUTs of photos, made absolute."""
    lut = F.transform_values("overrides", lambda k, v: F.when((k == "lut_path") & v["text"].isNotNull(), v.withField(
        "text", resolved(v["text"], base))).otherwise(v))
    nodes = F.transform("recipe", lambda n: n.withField("lut", resolved(n["lut"], base)))
    return photos.withColumns({"input": resolved(F.col("input"), base), "overrides": lut, "recipe": nodes})


def report(photos: DataFrame, go_on: bool = True) -> DataFrame:
    """Per project: photos completed and failed, and the first failure in order.

    `photos` has (project_id, seq, cause), a null cause meaning success. With `go_on` off a project
    stops at its first failure, and the rest are neither. Counts combine map-side.
    """
    first = photos.where("cause IS NOT NULL").groupBy("project_id").agg(F.min("seq").alias("_stop"))
    reached = photos.join(first, "project_id", "left")
    if not go_on:
        reached = reached.where(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop")))
    return reached.groupBy("project_id").agg(
        F.count_if(F.col("cause").isNull()).alias("completed"), F.count_if(F.col("cause").isNotNull()).alias("failed"),
        F.min_by("cause", F.when(F.col("cause").isNotNull(), F.col("seq"))).alias("first_cause"))


def write_results(results: DataFrame, path: str, replace: bool = False) -> None:
    """Render results in folders by hash of the project, so that their number does not grow with the projects.

    Without `replace` an existing output is refused; with it only the projects present in `results` are replaced: the
    results are written below the checkpoint folder first, then the folders of their projects anew, with the rows
    of other projects in them. A folder is split into files by its size, so one large project is no single task.
    """
    placed = results.withColumn(BUCKET, F.pmod(F.hash("project_id"), F.lit(RESULT_BUCKETS)))
    if not replace:
        placed.hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
        return
    spark = results.sparkSession
    fresh = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    placed.write.parquet(fresh)
    new = spark.read.schema(placed.schema).parquet(fresh)
    try:
        old = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        whole = new
    else:
        if BUCKET not in old.columns:
            raise ValueError(f"{path} is in folders by project; write it anew")
        gone = new.select(F.col("project_id").alias("_gone")).distinct()
        kept = old.join(new.select(BUCKET).distinct(), BUCKET, "left_semi").join(gone, F.col("project_id").eqNullSafe(F.col("_gone")), "left_anti")
        whole = new.unionByName(kept, allowMissingColumns=True)
    whole.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
