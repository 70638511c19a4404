"""Reading `.cube` look-up tables as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sizes a lattice may have, and the longest line.
SIZES, LINE_MAX = (2, 65), 4096


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: `lut_id` (its path) and its whole text. A file is at most some 10 MB."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("lut_id"), F.col("value").alias("text"))


def cube_lines(cubes: DataFrame) -> DataFrame:
    """Meaningful lines of each file with their words; comments, titles and blanks fall away."""
    raw = cubes.select("lut_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    text = F.btrim(F.split_part("raw", F.lit("#"), F.lit(1)), F.lit(" \t\r"))
    return raw.select("lut_id", "line", F.length("raw").alias("chars"), text.alias("text")).where(
        (F.col("text") != "") & ~F.col("text").startswith("TITLE")).withColumn("words", F.split("text", r"\s+"))


def _number(word: Column) -> Column:
    v = word.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _item(key: int | str) -> Callable[[Column], Column]:
    return lambda v: v[key]


def _triplet(words: Column, start: int) -> Column:
    return F.array(*[_number(F.get(words, F.lit(start + i))) for i in range(3)])


def parse(cubes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(luts, bad): `luts` as (lut_id, size, dmin, dmax, lut_r, lut_g, lut_b), red fastest; `bad` as
    (lut_id, problems) for files that break a rule.

    Lines of one file meet again by its id; a lattice is at most 65 cubed triplets.
    """
    lines = cube_lines(cubes)
    words, first = F.col("words"), F.get("words", F.lit(0))
    kind = (F.when(first == "LUT_3D_SIZE", "size").when(first == "DOMAIN_MIN", "min").when(first == "DOMAIN_MAX", "max")
            .when(first.rlike("^[A-Za-z]"), "unknown").otherwise("entry"))
    typed = lines.withColumn("kind", kind)
    size = F.get(words, F.lit(1)).try_cast("int")
    whole = lambda v: F.forall(v, lambda x: x.isNotNull())
    entry, domain = _triplet(words, 0), _triplet(words, 1)
    typed = typed.withColumns({
        "size": F.when((F.col("kind") == "size") & (F.size(words) == 2) & size.between(*SIZES), size),
        "v": F.when((F.col("kind") == "entry") & (F.size(words) == 3) & whole(entry), entry)
              .when(F.col("kind").isin("min", "max") & (F.size(words) == 4) & whole(domain), domain)})
    flawed = (F.col("kind") == "unknown") | ((F.col("kind") == "size") & F.col("size").isNull()) | (
        F.col("kind").isin("entry", "min", "max") & F.col("v").isNull()) | (F.col("chars") > LINE_MAX)
    entries = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "entry", F.struct("line", "v")))), lambda s: s["v"])
    files = typed.groupBy("lut_id").agg(
        F.count_if(F.col("kind") == "size").alias("sizes"), F.max("size").alias("size"), F.count_if(flawed).alias("flaws"),
        F.min(F.when(F.col("kind") == "entry", F.col("line"))).alias("first_entry"), F.min(F.when(F.col("kind") == "size", F.col("line"))).alias("size_line"),
        F.max_by("v", F.when(F.col("kind") == "min", F.col("line"))).alias("dmin"),
        F.max_by("v", F.when(F.col("kind") == "max", F.col("line"))).alias("dmax"), entries.alias("values"))
    files = cubes.select("lut_id").join(files, "lut_id", "left").withColumns({
        "dmin": F.coalesce("dmin", F.array(*[F.lit(0.0)] * 3)), "dmax": F.coalesce("dmax", F.array(*[F.lit(1.0)] * 3))})
    n = F.col("size") * F.col("size") * F.col("size")
    problems = F.array_compact(F.array(
        F.when(F.coalesce("flaws", F.lit(0)) > 0, F.lit("line")), F.when(F.coalesce("sizes", F.lit(0)) != 1, F.lit("size")),
        F.when(F.col("first_entry") < F.col("size_line"), F.lit("order")),
        F.when(F.coalesce(F.size("values") != n, F.lit(True)), F.lit("count")),
        F.when(F.exists(F.zip_with("dmin", "dmax", lambda a, b: b <= a), lambda x: x), F.lit("domain"))))
    judged = files.withColumn("problems", problems)
    good = judged.where(F.size("problems") == 0).select("lut_id", "size", "dmin", "dmax", *[
        F.transform("values", _item(i)).alias(f"lut_{c}") for i, c in enumerate("rgb")])
    return good, judged.where(F.size("problems") > 0).select("lut_id", "problems")


def lattice(luts: DataFrame) -> DataFrame:
    """(lut_id, ri, gi, bi, r, g, b): one row per lattice point."""
    flat = luts.select("lut_id", "size", F.posexplode(F.arrays_zip("lut_r", "lut_g", "lut_b")).alias("n", "v"))
    s = F.col("size")
    return flat.select("lut_id", (F.col("n") % s).alias("ri"), (F.floor(F.col("n") / s) % s).cast("int").alias("gi"),
                       F.floor(F.col("n") / (s * s)).cast("int").alias("bi"), F.col("v.lut_r").alias("r"), F.col("v.lut_g").alias("g"), F.col("v.lut_b").alias("b"))


def from_lattice(points: DataFrame, domains: DataFrame) -> DataFrame:
    """LUT rows from lattice points and (lut_id, size, dmin, dmax); at most 65 cubed points each."""
    packed = points.groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("bi", "gi", "ri", "r", "g", "b"))).alias("p"))
    return packed.join(domains, "lut_id").select("lut_id", "size", "dmin", "dmax", *[
        F.transform("p", _item(c)).alias(f"lut_{c}") for c in "rgb"])
