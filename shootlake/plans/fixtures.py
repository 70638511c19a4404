"""Photo-shoot tables derived from the given tables, in Spark and as matching DuckDB text.

Every derivation is a projection, an explode or one aggregate: none sorts or ranks a whole key, so
the inputs of the registered queries scale with the tables they come from.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shootlake.operators import catalogue

EDGE = 64  # consecutive embedding vectors that make one frame, and the elements of one vector


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").selectExpr(
        f"vec_id div {EDGE} AS image_id", f"cast(vec_id % {EDGE} AS int) AS y", "embedding",
        "posexplode(embedding) AS (x, v)")
    at = "least(greatest(cast(element_at(embedding, cast((x + {0}) % 64 as int) + 1) as double) + 0.5D, 0D), 1D)"
    return e.selectExpr("image_id", "y", "x", "least(greatest(cast(v as double) + 0.5D, 0D), 1D) AS r",
                        at.format(21) + " AS g", at.format(42) + " AS b")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").groupBy(F.expr(f"vec_id div {EDGE}").alias("image_id")).agg(
        F.max(F.size("embedding")).cast("int").alias("width"),
        (F.max(F.col("vec_id") % EDGE) + 1).cast("int").alias("height"))
    return e.selectExpr("image_id", "width", "height", "4L * width * height AS full_pixels",
                        "cast(image_id % 8 + 1 as int) AS orientation",
                        "cast(4000 + 100 * (image_id % 60) as double) AS as_shot_kelvin")


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, signature): bit i is set when element i is positive; the top bit makes it negative."""
    bits = ("aggregate(sequence(0, 63), 0L, (acc, i) -> "
            "acc | if(element_at(embedding, i + 1) > 0, shiftleft(1L, i), 0L))")
    return table(spark, sf, "embeddings").selectExpr("vec_id", f"{bits} AS signature")


def rows_of(spark: SparkSession, sf: str, name: str) -> Column:
    """The row count of a table, as a scalar subquery of the query that uses it."""
    return table(spark, sf, name).agg(F.count(F.lit(1))).scalar()


def captures(spark: SparkSession, sf: str) -> DataFrame:
    signs = signatures(spark, sf)
    ev = table(spark, sf, "events").selectExpr(
        "user_id AS project_id", "event_id AS seq", "concat('cap-', event_id) AS key",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) END AS seconds",
        "event_id", "event_id % 13 = 0 AS unsigned").withColumn("vec_id", F.col("event_id") % rows_of(spark, sf, "embeddings")).drop("event_id")
    return ev.join(signs, "vec_id", "left").selectExpr(
        "project_id", "seq", "key", "seconds", "CASE WHEN unsigned THEN NULL ELSE signature END AS signature")


EXIF_COLUMNS = catalogue.TAGS

_EXIF = {
    "lens": "CASE WHEN o_orderkey % 5 = 0 THEN '-' WHEN o_orderkey % 5 = 1 THEN 'None' WHEN o_orderkey % 5 = 2 THEN concat('Unknown (', cast(o_orderkey as {s}), ')') WHEN o_orderkey % 5 = 3 THEN '' ELSE concat(c_mktsegment, ' 50mm') END",
    "lens_model": "CASE WHEN o_orderkey % 7 < 3 THEN NULL WHEN o_orderkey % 7 = 3 THEN '-' ELSE concat(c_mktsegment, ' zoom') END",
    "lens_type": "CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE concat('Type ', cast(o_custkey % 9 as {s})) END",
    "lens_id": "CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE concat('ID ', cast(o_custkey % 17 as {s})) END",
    "rating": "CASE WHEN o_orderkey % 10 = 0 THEN '-' WHEN o_orderkey % 3 = 0 THEN concat(cast(o_orderkey % 8 as {s}), ' stars') ELSE cast(o_orderkey % 8 as {s}) END",
    "xmp_rating": "CASE WHEN o_orderkey % 6 = 0 THEN '4' WHEN o_orderkey % 6 = 1 THEN 'four' WHEN o_orderkey % 6 = 2 THEN '-2' ELSE NULL END",
    "model": "CASE WHEN o_orderkey % 19 = 0 THEN '-' ELSE concat('Body ', cast(o_custkey % 25 as {s})) END",
    "iso": "CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 21 = 0 THEN '-' ELSE cast(100 * (1 + o_custkey % 64) as {s}) END",
    "f_number": "CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 23 = 0 THEN 'unknown' ELSE concat(cast(1 + o_custkey % 8 as {s}), '.4') END",
    "shutter": "CASE WHEN o_orderkey % 19 = 0 THEN 'none' ELSE concat('1/', cast(o_orderkey % 500 + 1 as {s})) END",
}
_DATES = {
    "date_original": "CASE WHEN o_orderkey % 9 = 0 THEN '-' WHEN o_orderkey % 11 = 0 THEN '2024:13:40 10:00:00' WHEN o_orderkey % 13 = 0 THEN '2024:05' ELSE concat({day}, ' ', lpad(cast(o_orderkey % 24 as {s}), 2, '0'), ':', lpad(cast(o_orderkey % 60 as {s}), 2, '0'), ':', lpad(cast(o_orderkey % 59 as {s}), 2, '0')) END",
    "date_created": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN '2023:02:31 08:00:00' ELSE concat({day}, ' 12:00:00') END",
}


def exif_raw(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"), "left")
    exprs = {**{k: v.format(s="string") for k, v in _EXIF.items()},
             **{k: v.format(s="string", day="date_format(o_orderdate, 'yyyy:MM:dd')") for k, v in _DATES.items()}}
    return joined.selectExpr("o_orderkey AS photo_id", *[f"{exprs[c]} AS {c}" for c in EXIF_COLUMNS])


def focus(spark: SparkSession, sf: str) -> DataFrame:
    """Focus reports: one per order line; a few frames were never measured."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS project_id", "l_partkey * 100000000L + l_suppkey * 1000L + cast(l_quantity as bigint) AS photo_id",
        "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 25 END AS blur",
        "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 25 * 2 END AS typical",
        "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_discount END AS judgeable")


def cache_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS file_id", "cast(floor(o_totalprice * 1000) as bigint) AS size",
        "cast(unix_seconds(cast(o_orderdate as timestamp)) as bigint) AS written")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('/card/', source, '/', doc_id, '.raw') AS path", "text", "octet_length(text) AS length")


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "pixels": ((), f"""
      SELECT vec_id // {EDGE} AS image_id, vec_id % {EDGE} AS y, x,
             least(greatest(CAST(embedding[x + 1] AS DOUBLE) + 0.5, 0), 1) AS r,
             least(greatest(CAST(embedding[(x + 21) % 64 + 1] AS DOUBLE) + 0.5, 0), 1) AS g,
             least(greatest(CAST(embedding[(x + 42) % 64 + 1] AS DOUBLE) + 0.5, 0), 1) AS b
      FROM embeddings, range(0, {EDGE}) t(x)"""),
    "frames": ((), f"""
      SELECT image_id, width, height, 4 * width * height AS full_pixels, image_id % 8 + 1 AS orientation,
             CAST(4000 + 100 * (image_id % 60) AS DOUBLE) AS as_shot_kelvin
      FROM (SELECT vec_id // {EDGE} AS image_id, max(len(embedding)) AS width, max(vec_id % {EDGE}) + 1 AS height
            FROM embeddings GROUP BY 1)"""),
    "signatures": ((), """
      SELECT vec_id, CAST(sum(CASE WHEN embedding[i + 1] > 0 THEN
               CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE CAST(power(2, i) AS HUGEINT) END
               ELSE 0 END) AS BIGINT) AS signature
      FROM embeddings, range(0, 64) t(i) GROUP BY vec_id"""),
    "captures": (("signatures",), """
      SELECT user_id AS project_id, event_id AS seq, concat('cap-', event_id) AS key,
             CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS seconds,
             CASE WHEN event_id % 13 = 0 THEN NULL ELSE signature END AS signature
      FROM events LEFT JOIN signatures ON vec_id = event_id % (SELECT count(*) FROM embeddings)"""),
    "exif_raw": ((), "SELECT o_orderkey AS photo_id, " + ", ".join(
        ({**{k: v.format(s="varchar") for k, v in _EXIF.items()},
          **{k: v.format(s="varchar", day="strftime(o_orderdate, '%Y:%m:%d')") for k, v in _DATES.items()}}[c]
         + f" AS {c}") for c in EXIF_COLUMNS)
        + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "focus": ((), """
      SELECT l_orderkey AS project_id, l_partkey * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS photo_id,
             CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 25 END AS blur,
             CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 25 * 2 END AS typical,
             CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_discount END AS judgeable FROM lineitem"""),
    "cache_files": ((), """
      SELECT o_orderkey AS file_id, CAST(floor(o_totalprice * 1000) AS BIGINT) AS size,
             CAST(epoch(o_orderdate) AS BIGINT) AS written FROM orders"""),
    "files": ((), """
      SELECT doc_id, concat('/card/', source, '/', doc_id, '.raw') AS path, text,
             octet_length(encode(text)) AS length FROM documents"""),
}


def sql(body: str, *names: str, also: dict[str, str] | None = None) -> str:
    """Prefix `body` with the named derived tables (and their own inputs) as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        deps, _ = SQL[name]
        for d in deps:
            need(d)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    ctes = [f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in order]
    ctes += [f"{n} AS MATERIALIZED ({text})" for n, text in (also or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# Override rules by key: when the key is present, and its value; both dialects read this text.
OVERRIDES = {
    "exposure": ("o_orderkey % 3 = 0", "o_orderkey % 9 / 2 - 2"),
    "white_balance_temperature": ("o_orderkey % 3 = 0", "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 21 = 0 THEN 900 ELSE 3000 + o_orderkey % 5000 END"),
    "lut_path": ("o_orderkey % 12 = 0", "CASE WHEN o_orderkey % 24 = 0 THEN '/luts/abs.cube' ELSE 'luts/film.cube' END"),
    "lut_strength": ("o_orderkey % 12 = 0", "o_orderkey % 11 / 10"),
    "tone_shadows": ("o_orderkey % 5 = 1", "CASE WHEN o_orderkey % 35 = 1 THEN 2.5 ELSE o_orderkey % 25 / 8 - 1.5 END"),
    "grain_amount": ("o_orderkey % 5 = 1", "o_orderkey % 3 / 4"),
    "lens_correction": ("o_orderkey % 7 = 2", "o_orderkey % 2 = 0"),
    "lens_correction_strength": ("o_orderkey % 7 = 2", "o_orderkey % 30 / 10"),
    "neural_noise_reduction": ("o_orderkey % 7 = 3", "o_orderkey % 13 / 10"),
}
# Project defaults that differ from the standard ones.
PROJECT_DEFAULTS = {
    "exposure": "project_id % 5 / 10",
    "lut_path": "CASE WHEN project_id % 4 = 0 THEN 'luts/base.cube' END",
    "grain_size": "1 + project_id % 3 / 2",
}
_PHOTO = {
    "project_id": "o_custkey % 20",
    "stem": "concat('PB', lpad(cast(o_orderkey % 300 as {s}), 4, '0'), CASE WHEN o_orderkey % 50 = 7 THEN '-2' ELSE '' END)",
    "output": "CASE WHEN o_orderkey % 20 = 3 THEN concat('/exports/', cast(o_orderkey as {s}), '.tif') WHEN o_orderkey % 20 = 13 THEN concat('final/', cast(o_orderkey as {s}), '.jpg') END",
}
_PHOTO["input"] = "concat(CASE WHEN o_orderkey % 6 = 5 THEN 'inbox/' ELSE '/card/' END, cast(o_orderkey % 4 as {s}), '/', " + _PHOTO["stem"] + ", '.ORF')"
_DISABLED = {"2-HIGH": ["tone"], "3-MEDIUM": ["optics", "film"], "4-NOT SPECIFIED": ["white_balance"], "5-LOW": ["noise_reduction"]}


def photos(spark: SparkSession, sf: str) -> DataFrame:
    from shootlake.operators import settings as S
    from shootlake.sources.tables import RECIPE, SETTINGS
    o = table(spark, sf, "orders")
    kept = F.filter(F.array(*[
        F.when(F.expr(when), F.struct(F.lit(k).alias("key"), S.setting(k, F.expr(v)).alias("value")))
        for k, (when, v) in OVERRIDES.items()]), lambda e: e.isNotNull())
    off = F.expr("cast(array() as array<string>)")
    for priority, stages in _DISABLED.items():
        off = F.when(F.col("o_orderpriority") == priority, F.array(*[F.lit(s) for s in stages])).otherwise(off)
    return o.select(
        F.expr(_PHOTO["project_id"]).alias("project_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").alias("photo_id"), F.expr(_PHOTO["input"].format(s="string")).alias("input"),
        F.expr(_PHOTO["output"].format(s="string")).alias("output"),
        F.map_from_entries(kept).cast(SETTINGS).alias("overrides"), off.alias("disabled"),
        F.lit(None).cast(RECIPE).alias("recipe"), F.lit(None).cast("int").alias("recipe_output"),
        (F.col("o_orderstatus") == "F").alias("selected"))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    from shootlake.operators import settings as S
    from shootlake.sources.tables import EXPORT
    p = table(spark, sf, "orders").select(F.expr(_PHOTO["project_id"]).alias("project_id")).distinct()
    export = F.struct(
        F.expr("CASE WHEN project_id % 7 = 3 THEN 'png' WHEN project_id % 2 = 0 THEN 'jpeg' ELSE 'tiff' END").alias("format"),
        F.expr("CASE WHEN project_id % 9 = 4 THEN 101 ELSE 92 END").alias("quality"),
        F.expr("CASE WHEN project_id % 6 = 2 THEN 0 WHEN project_id % 2 = 1 THEN 2048 END").alias("max_width"),
        F.lit(None).alias("max_height"), F.lit(True).alias("keep_metadata"),
        F.expr("project_id % 2 = 0").alias("timestamp_names")).cast(EXPORT)
    return p.select("project_id", F.expr("concat('out/p', project_id)").alias("output_dir"),
                    S.defaults(**{k: F.expr(v) for k, v in PROJECT_DEFAULTS.items()}).alias("defaults"),
                    export.alias("export"))


def presets(spark: SparkSession, sf: str) -> DataFrame:
    from shootlake.operators import settings as S
    p = table(spark, sf, "part")
    changed = {"exposure": F.expr("p_size / 25 - 1"), "noise_reduction": F.expr("p_partkey % 10 / 10"),
               "lut_path": F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'luts/preset.cube' END")}
    by_recipe = F.col("p_partkey") % 5 == 0
    return p.select(
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'project' ELSE 'local' END").alias("origin"),
        F.expr("p_partkey % 20").alias("project_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"),
        F.expr("cast(floor(p_retailprice) as bigint)").alias("written"), S.defaults(**changed).alias("settings"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN array('tone') ELSE cast(array() as array<string>) END").alias("disabled"),
        F.when(by_recipe, S.default_recipe()).alias("recipe"), F.when(by_recipe, F.lit(2)).alias("recipe_output"))


def _photo_sql() -> dict[str, tuple[tuple[str, ...], str]]:
    from shootlake.functions.settings_keys import DEFAULTS, FLAGS, KEYS, TEXTS

    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{float(v)}::DOUBLE"

    def typed(k, text):
        return text if k in FLAGS | TEXTS else f"CAST({text} AS DOUBLE)"

    off = "CASE o_orderpriority " + " ".join(
        f"WHEN '{p}' THEN [{', '.join(repr(s) for s in stages)}]" for p, stages in _DISABLED.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    has = ", ".join(f"{w} AS has_{k}, {typed(k, v)} AS ov_{k}" for k, (w, v) in OVERRIDES.items())
    base = ", ".join(f"{typed(k, PROJECT_DEFAULTS.get(k, lit(DEFAULTS.get(k, 0.0))))} AS df_{k}" for k in KEYS)
    e = ", ".join((f"CASE WHEN has_{k} THEN ov_{k} ELSE df_{k} END" if k in OVERRIDES else f"df_{k}") + f" AS {k}" for k in KEYS)
    pid, inp, out, stem = (_PHOTO[k].format(s="varchar") for k in ("project_id", "input", "output", "stem"))
    return {
        "photos": ((), f"SELECT {pid} AS project_id, o_orderkey AS seq, o_orderkey AS photo_id, {inp} AS input, {stem} AS stem, {out} AS output, "
                       f"{off} AS disabled, o_orderstatus = 'F' AS selected, {has} FROM orders"),
        "projects": ((), f"SELECT project_id, concat('out/p', project_id) AS output_dir, "
                         "CASE WHEN project_id % 7 = 3 THEN 'png' WHEN project_id % 2 = 0 THEN 'jpeg' ELSE 'tiff' END AS format, "
                         "CASE WHEN project_id % 9 = 4 THEN 101 ELSE 92 END AS quality, "
                         "CASE WHEN project_id % 6 = 2 THEN 0 WHEN project_id % 2 = 1 THEN 2048 END AS max_width, "
                         f"project_id % 2 = 0 AS timestamp_names, {base} FROM (SELECT DISTINCT {pid} AS project_id FROM orders)"),
        "effective": (("photos", "projects"), f"SELECT photo_id, project_id, disabled, selected, {e} FROM photos JOIN projects USING (project_id)"),
        "presets": ((), """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'project' ELSE 'local' END AS origin, p_partkey % 20 AS project_id,
            p_partkey AS seq, p_name AS name, CAST(floor(p_retailprice) AS BIGINT) AS written, p_size / 25 - 1 AS exposure,
            p_partkey % 10 / 10 AS noise_reduction, CASE WHEN p_partkey % 3 = 0 THEN 'luts/preset.cube' END AS lut_path,
            p_size % 2 = 0 AS tone_off, p_partkey % 5 = 0 AS by_recipe FROM part"""),
    }


SQL.update(_photo_sql())


KIND_BY_PART = ["white_balance", "exposure", "noise_reduction", "tone", "optics", "film", "blend",
                "color_subtract", "contrast", "sharpen", "crop", "rotate", "curves"]
# Parameters by kind, read from one order line; both dialects read this text.
_NODE_PARAMS = {
    "white_balance": {"white_balance_temperature": "3000 + 100 * q", "white_balance_tint": "d * 100 - 5"},
    "exposure": {"exposure": "d * 20 - 1"}, "noise_reduction": {"noise_reduction": "d * 5"}, "tone": {"tone_shadows": "t * 10"},
    "optics": {"lens_correction": "q % 2", "lens_correction_strength": "d * 10"},
    "film": {"lut_strength": "d * 10", "grain_amount": "t * 5"}, "color_subtract": {"red": "t * 20", "blue": "d"},
    "contrast": {"contrast": "0.5 + d * 10"}, "sharpen": {"amount": "d * 10", "radius": "1 + t * 10"},
    "crop": {"left": "d", "top": "t", "width": "0.5 + t", "height": "0.5"}, "rotate": {"quarter_turns": "q % 4"},
}


_LINE = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
_PARTS = 256  # consecutive part keys that make one chunk of an order too large to gather


def _order_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The lines, and the number of lines of each order."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", *_LINE)
    return lines, lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


#: A line with its place as `id`, its `kind` and how it is `broken`, from `l`, `i` and `recipe_id`; then the node made of it, read from `m`.
_PLACED = f"""named_struct('l', l, 'id', i + 1, 'bypassed', l.l_returnflag = 'R',
    'kind', CASE WHEN l.l_suppkey % 17 = 0 THEN 'node' ELSE array({", ".join(f"'{k}'" for k in KIND_BY_PART)})[cast(l.l_partkey % 13 as int)] END,
    'broken', CASE WHEN recipe_id % 7 = 0 AND i = 0 THEN cast(recipe_id div 7 % 6 as int) ELSE -1 END)"""


def _node_text() -> str:
    from shootlake.sources.tables import KIND_STATES
    at = lambda e: re.sub(r"\b([qdt])\b", lambda v: "m.l." + {"q": "l_quantity", "d": "l_discount", "t": "l_tax"}[v[1]], e)
    params = "CASE m.kind " + " ".join(
        f"WHEN '{k}' THEN map(" + ", ".join(f"'{p}', cast({at(e)} as double)" for p, e in ps.items()) + ")" for k, ps in _NODE_PARAMS.items()
    ) + " ELSE cast(map() as map<string,double>) END"
    return f"""named_struct(
        'id', CASE WHEN m.broken = 0 THEN 0 ELSE m.id END, 'kind', CASE WHEN m.broken = 4 THEN 'mystery' ELSE m.kind END,
        'params', CASE WHEN m.broken = 3 THEN map('bogus', 1D) ELSE {params} END,
        'points', CASE WHEN m.kind = 'curves' AND m.broken <> 4 THEN map('red', array(0D, 0D, 0.5D, 0.5D + m.l.l_discount, 1D, 1D)) ELSE cast(map() as map<string,array<double>>) END,
        'lut', CASE WHEN m.kind = 'film' AND m.l.l_quantity % 2 = 0 THEN 'luts/film.cube' END, 'opacity', CASE WHEN m.kind = 'blend' THEN m.l.l_discount * 10 ELSE 1D END,
        'inputs', CASE WHEN m.broken = 2 THEN cast(array() as array<int>) WHEN m.broken = 1 THEN array(5000) WHEN m.kind = 'blend' THEN array(m.id - 1, 0) ELSE array(m.id - 1) END,
        'bypassed', m.bypassed, 'kind_states', cast(null as {KIND_STATES}))"""


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    """(recipe_id, recipe, recipe_output): the lines of an order as a chain of nodes.

    Only orders of at most 64 lines are gathered into a recipe, counted beforehand, so one giant order
    never meets in one task; the others are in `oversized`, and their nodes row by row in `recipe_nodes`. Lines are
    gathered once, as they are, and become nodes in their array.
    """
    from shootlake.sources.tables import RECIPE
    lines = _order_lines(spark, sf)[0].where("l_orderkey IS NOT NULL")
    small = lines.join(oversized(spark, sf).select(F.col("recipe_id").alias("l_orderkey")), "l_orderkey", "left_anti")
    struct = f"struct({', '.join(_LINE)})"
    # within the aggregate, so that no filter on the recipe makes it anew
    return small.withColumnRenamed("l_orderkey", "recipe_id").groupBy("recipe_id").agg(
        F.expr(f"cast(transform(transform(array_sort(collect_list({struct})), (l, i) -> {_PLACED}), m -> {_node_text()}) as {RECIPE})").alias("recipe"),
        F.expr("cast(CASE WHEN recipe_id % 7 = 0 AND recipe_id div 7 % 6 = 5 THEN 9999 WHEN recipe_id % 5 = 0 AND count(1) > 1 THEN count(1) - 1 ELSE count(1) END as int)").alias("recipe_output"))


def oversized(spark: SparkSession, sf: str) -> DataFrame:
    """(recipe_id, n): the orders of more lines than a recipe holds, from their counts alone."""
    from shootlake.functions.recipe_kinds import MAX_NODES
    return _order_lines(spark, sf)[1].where(F.col("n") > MAX_NODES).withColumnRenamed("l_orderkey", "recipe_id")


def recipe_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(recipe_id, n): every node `n` of every order, whatever its size.

    Lines of oversized orders are numbered by chunks of part keys: the lines within a chunk, and the chunks by
    one summary row each.
    """
    from shootlake.functions.recipe_kinds import MAX_NODES
    from shootlake.sources.tables import NODE
    gathered = recipes(spark, sf).select("recipe_id", F.explode("recipe").alias("n"))
    lines = _order_lines(spark, sf)[0].withColumn("chunk", F.expr(f"coalesce(l_partkey div {_PARTS}, {-1 << 62})"))
    order = Window.partitionBy("l_orderkey")
    chunks = lines.groupBy("l_orderkey", "chunk").agg(F.count(F.lit(1)).alias("held")).select(
        "l_orderkey", "chunk", F.sum("held").over(order).alias("n"),
        (F.sum("held").over(order.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    placed = lines.join(chunks.where(F.col("n") > MAX_NODES), ["l_orderkey", "chunk"]).select(
        F.col("l_orderkey").alias("recipe_id"), F.struct(*_LINE).alias("l"),
        (F.col("before") + F.row_number().over(Window.partitionBy("l_orderkey", "chunk").orderBy(*_LINE)) - 1).cast("int").alias("i"))
    large = placed.selectExpr("recipe_id", f"{_PLACED} AS m").selectExpr("recipe_id", f"{_node_text()} AS n")
    return gathered.unionByName(large.select("recipe_id", F.col("n").cast(NODE)))


def _recipe_sql() -> dict[str, tuple[tuple[str, ...], str]]:
    kinds = "[" + ", ".join(f"'{k}'" for k in KIND_BY_PART) + "]"
    return {
        "nodes": ((), f"""
          SELECT *, CASE WHEN broken IN (1, 2) THEN NULL WHEN broken = 0 THEN 0 ELSE rid - 1 END AS in1, CASE WHEN kind0 = 'blend' AND broken NOT IN (1, 2) THEN 0 END AS in2,
                 CASE WHEN kind0 = 'blend' THEN d * 10 ELSE 1 END AS opacity FROM (
            SELECT *, CASE WHEN broken = 4 THEN 'mystery' ELSE kind0 END AS kind, CASE WHEN broken = 0 THEN 0 ELSE rid END AS id,
                   CASE WHEN recipe_id % 5 = 0 AND n > 1 THEN n - 1 ELSE n END AS output FROM (
              SELECT l_orderkey AS recipe_id, rid, n, l_quantity AS q, l_discount AS d, l_tax AS t, l_returnflag = 'R' AS bypassed,
                     CASE WHEN l_suppkey % 17 = 0 THEN 'node' ELSE {kinds}[l_partkey % 13 + 1] END AS kind0,
                     CASE WHEN l_orderkey % 7 = 0 AND rid = 1 THEN l_orderkey // 7 % 6 ELSE -1 END AS broken FROM (
                SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag) AS rid,
                       count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)))"""),
    }


SQL.update(_recipe_sql())
