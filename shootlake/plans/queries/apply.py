"""Registered queries: recipes and settings applied to pixels, LUTs, negatives."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from shootlake.operators import grading as G
from shootlake.operators import measure as M
from shootlake.operators import recipes as RE
from shootlake.operators import settings as S
from shootlake.plans import apply as A
from shootlake.plans import fixtures as fx
from shootlake.plans import window as W
from shootlake.plans.queries import geometry as QG
from shootlake.plans.queries import measure as QM
from shootlake.plans.queries.pixels import LUM, RGB, dec, display_sql, each, out, rounded
from shootlake.plans.registry import query
from shootlake.session import ensure_checkpoint_dir
from shootlake.sources import luts as L
from shootlake.sources import tables as T
from shootlake.sources.tables import RECIPE


def frames(spark, sf):
    return fx.frames(spark, sf).withColumn("grain_seed", F.expr("image_id * 7919L + 17"))


def _map(**kv):
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.expr(f"cast({v} as double)"))])


def _chain(*nodes):
    return F.array(*[RE.node(kind, F.array(*[F.lit(i) for i in ins]), params, opacity, F.lit(n)) for n, (kind, ins, params, opacity) in enumerate(nodes, 1)]).cast(RECIPE)


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), [df for _, df in parts])


# Frames with an even number blend back into the source, the others only change contrast: two shapes.
_EV, _SLOPE = "image_id % 4 / 4", "0.8 + image_id % 3 / 10"


@query("recipe_render", fx.sql(rounded(display_sql("""
  SELECT image_id, CASE WHEN o IN (3, 4) THEN height - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN width - 1 - x ELSE y END AS y,
         CASE WHEN o IN (2, 3) THEN width - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN height - 1 - y ELSE x END AS x, """ + ", ".join(
    f"CASE WHEN image_id % 2 = 0 THEN k{c} + ({c} - k{c}) * 0.25 ELSE k{c} END AS {c}" for c in RGB) + f"""
  FROM (SELECT *, orientation AS o, {", ".join(f"CASE WHEN {c} > 0 THEN pv * power({c} * power(2, {_EV}) / pv, {_SLOPE}) ELSE {c} END AS k{c}" for c in RGB)}
        FROM (SELECT *, {dec('0.435')} AS pv FROM pixels JOIN frames USING (image_id)))"""), 5), "pixels", "frames"))
def recipe_render(spark, sf):
    f = frames(spark, sf)
    graded = [("exposure", [0], _map(exposure=_EV), 1.0), ("contrast", [1], _map(contrast=_SLOPE), 1.0)]
    recipe = F.when(F.col("image_id") % 2 == 0, _chain(*graded, ("blend", [2, 0], None, 0.25))).otherwise(_chain(*graded))
    recipes = f.select("image_id", recipe.alias("recipe")).withColumn("recipe_output", F.size("recipe"))
    return out(_union(A.render_by_skeleton(fx.pixels(spark, sf), f, recipes)), 5)


_ASKED = (0.3, 0.4, 0.25, 0.2)
_LIT = [f"{v}::DOUBLE" for v in _ASKED]


@query("window_render", fx.sql(rounded(display_sql(f"""
  SELECT image_id, CAST(y - y0 AS BIGINT) AS y, CAST(x - x0 AS BIGINT) AS x, r, g, b FROM (
    SELECT *, greatest(1, least(floor(w * wide + 0.5), wide - x0)) AS cw, greatest(1, least(floor(h * high + 0.5), high - y0)) AS ch FROM (
      SELECT *, least(floor(l * wide + 0.5), wide - 1) AS x0, least(floor(t * high + 0.5), high - 1) AS y0 FROM (
        SELECT image_id, CASE WHEN o IN (3, 4) THEN height - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN width - 1 - x ELSE y END AS y,
               CASE WHEN o IN (2, 3) THEN width - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN height - 1 - y ELSE x END AS x,
               CASE WHEN o > 4 THEN height ELSE width END AS wide, CASE WHEN o > 4 THEN width ELSE height END AS high,
               0.1::DOUBLE + image_id % 3 / 10 AS l, image_id % 4 / 8 AS t, 0.4::DOUBLE + image_id % 2 / 10 AS w, 0.45::DOUBLE AS h,
               {", ".join(f"CASE WHEN image_id % 2 = 0 THEN k{c} + ({c} - k{c}) * 0.25 ELSE k{c} END AS {c}" for c in RGB)}
        FROM (SELECT *, orientation AS o, {", ".join(f"CASE WHEN {c} > 0 THEN pv * power({c} * power(2, {_EV}) / pv, {_SLOPE}) ELSE {c} END AS k{c}" for c in RGB)}
              FROM (SELECT *, {dec('0.435')} AS pv FROM pixels JOIN frames USING (image_id))))))
  WHERE x - x0 >= floor({_LIT[0]} * cw) AND x - x0 < ceil(({_LIT[0]} + {_LIT[2]}) * cw) AND y - y0 >= floor({_LIT[1]} * ch) AND y - y0 < ceil(({_LIT[1]} + {_LIT[3]}) * ch)"""), 5),
    "pixels", "frames"))
def window_render(spark, sf):
    """A window of each cropped frame, out of stored pixels: only what its recipe reads for it is scanned."""
    path = f"{ensure_checkpoint_dir(spark)}/pixels-{uuid.uuid4().hex}"
    T.write_pixels(fx.pixels(spark, sf), path, 8)
    f = frames(spark, sf)
    cut = lambda at: ("crop", [at], _map(left="0.1D + image_id % 3 / 10", top="image_id % 4 / 8", width="0.4D + image_id % 2 / 10", height="0.45"), 1.0)
    graded = [("exposure", [0], _map(exposure=_EV), 1.0), ("contrast", [1], _map(contrast=_SLOPE), 1.0)]
    recipe = F.when(F.col("image_id") % 2 == 0, _chain(*graded, ("blend", [2, 0], None, 0.25), cut(3))).otherwise(_chain(*graded, cut(2)))
    recipes = f.select("image_id", recipe.alias("recipe")).withColumn("recipe_output", F.size("recipe"))
    asked = f.select("image_id", *[F.lit(v).alias(c) for v, c in zip(_ASKED, ("left", "top", "wide", "high"))])
    return out(_union(W.render(partial(T.read_regions, spark, path, buckets=8), f, recipes, asked)), 5)


# Every kind of node. Three frames in four fork into another contrast and blend; the others grade twice. One frame in two is cropped turned.
def _full_recipes(f):
    grades = F.when(F.col("image_id") % 2 == 0, F.lit("tone")).otherwise(F.lit("contrast"))
    one = F.when(grades == "tone", _map(tone_shadows=0.4, tone_midtones=-0.2)).otherwise(_map(contrast=1.2, pivot=0.4))
    head = [("optics", [0], _map(lens_correction=1, lens_correction_strength="0.4 + image_id % 3 / 10"), 1.0),
            ("white_balance", [1], _map(white_balance_temperature="4500 + 100 * (image_id % 5)", white_balance_tint=4), 1.0),
            ("exposure", [2], _map(exposure="image_id % 4 / 8"), 1.0),
            ("noise_reduction", [3], _map(noise_reduction="image_id % 3 / 4"), 1.0)]
    middle = RE.node(grades, F.array(F.lit(4)), one, 1.0, F.lit(5))
    curve = RE.node("curves", F.array(F.lit(5)), None, 1.0, F.lit(6)).withField(
        "points", F.expr("map('red', array(0D, 0D, 0.5D, 0.55D, 1D, 1D), 'master', array(0D, 0.02D, 0.4D, 0.38D, 1D, 0.98D))"))
    tail = [("sharpen", [6], _map(amount="image_id % 3 / 2", radius=1, threshold=0.5), 1.0),
            ("crop", [7], _map(left=0.1, top=0.05, width=0.8, height=0.75, angle="(image_id % 2) * 3"), 1.0),
            ("color_subtract", [8], _map(red=1.5, green=1.4, blue=1.3), 1.0)]
    ends = [[("contrast", [8], _map(contrast=1.3, pivot=0.5), 1.0), ("blend", [9, 10], None, 0.3)],
            [("exposure", [9], _map(exposure=0.25), 1.0), ("contrast", [10], _map(contrast=0.9, pivot=0.45), 1.0)]]
    last = [("rotate", [11], _map(quarter_turns="image_id % 4"), 1.0), ("film", [12], _map(grain_amount=0.6, grain_size=1), 1.0)]
    nodes = lambda chain, start: [RE.node(kind, F.array(*[F.lit(i) for i in ins]), params, opacity, F.lit(n))
                                  for n, (kind, ins, params, opacity) in enumerate(chain, start)]
    whole = [F.array(*nodes(head, 1), middle, curve, *nodes(tail, 7), *nodes(end, 10), *nodes(last, 12)).cast(RECIPE) for end in ends]
    recipe = F.when(F.col("image_id") % 4 == 1, whole[1]).otherwise(whole[0])
    return f.select("image_id", recipe.alias("recipe"), F.lit(13).alias("recipe_output"))


@query("full_recipe_render")
def full_recipe_render(spark, sf):
    """No SQL: all thirteen kinds in one recipe; the tests hold it against the nodes' own operators, one after another."""
    f = frames(spark, sf)
    return out(_union(A.render_by_skeleton(fx.pixels(spark, sf), f, _full_recipes(f), lens_map=QG.lens_map(spark, sf))), 5)


_SMALL = """SELECT image_id, CAST(j AS BIGINT) AS y, CAST(i AS BIGINT) AS x, sum(r * w) / sum(w) AS r, sum(g * w) / sum(w) AS g, sum(b * w) / sum(w) AS b FROM (
    SELECT p.image_id, i, j, r, g, b, (least(x + 1, (i + 1) * width / tw) - greatest(x, i * width / tw)) * (least(y + 1, (j + 1) * height / th) - greatest(y, j * height / th)) AS w
    FROM pixels p JOIN sizes USING (image_id), range(0, 24) a(i), range(0, 24) c(j)
    WHERE i < tw AND j < th AND x + 1 > i * width / tw AND x < (i + 1) * width / tw AND y + 1 > j * height / th AND y < (j + 1) * height / th) GROUP BY 1, 2, 3"""


@query("settings_render", fx.sql(rounded(display_sql(f"""
  SELECT image_id, CASE WHEN o IN (3, 4) THEN th - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN tw - 1 - x ELSE y END AS y,
         CASE WHEN o IN (2, 3) THEN tw - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN th - 1 - y ELSE x END AS x, {each('{c} * power(2, ev)')} FROM (
    SELECT *, CASE WHEN e BETWEEN -2 AND 2 THEN 0.5 * CASE WHEN e < 0 THEN power((e + 2) / 2, 2) * (3 - (e + 2)) ELSE 1 - power(e / 2, 2) * (3 - e) END ELSE 0 END AS ev FROM (
      SELECT *, CASE WHEN {LUM} > 0 THEN least(greatest(log2({LUM} / 0.18), -6), 6) END AS e FROM (
        SELECT image_id, y, x, CAST(tw AS BIGINT) AS tw, CAST(th AS BIGINT) AS th, orientation AS o, {each('{c} * power(2, 0.25)')} FROM small JOIN sizes USING (image_id))))"""), 5),
    "pixels", "frames", also={"sizes": QG._SIZES, "small": _SMALL}))
def settings_render(spark, sf):
    f = frames(spark, sf)
    chosen = S.identity()
    chosen = S.overlay(chosen, F.create_map(F.lit("exposure"), S.setting("exposure", 0.25), F.lit("tone_midtones"), S.setting("tone_midtones", 0.5)))
    settings = f.select("image_id", chosen.alias("effective"), F.expr("cast(array() as array<string>)").alias("disabled"))
    return out(_union(A.flat_settings(fx.pixels(spark, sf), f, settings, 20, 24)), 5)


# 125 consecutive parts make one 5x5x5 lattice, its domain a little wider than 0..1; a last block of fewer is no LUT.
_BLOCKS = "SELECT *, CAST(p_partkey // 125 AS VARCHAR) AS lut_id, p_partkey % 125 AS n, count(*) OVER (PARTITION BY p_partkey // 125) AS parts FROM part"
_LATTICE = f"SELECT lut_id, n % 5 AS ri, n // 5 % 5 AS gi, n // 25 AS bi, p_size / 50 AS r, (p_retailprice - 900) / 100 AS g, n / 124 AS b FROM ({_BLOCKS}) WHERE parts = 125"


def lut_parts(spark, sf):
    block = F.expr("p_partkey div 125")
    return fx.table(spark, sf, "part").select("p_size", "p_retailprice", block.cast("string").alias("lut_id"), F.expr("p_partkey % 125 AS n"),
                                              F.count(F.lit(1)).over(Window.partitionBy(block)).alias("parts"))


def lut_rows(spark, sf):
    pts = lut_parts(spark, sf).where("parts = 125").selectExpr(
        "lut_id", "n % 5 AS ri", "n div 5 % 5 AS gi", "n div 25 AS bi", "p_size / 50 AS r", "(p_retailprice - 900) / 100 AS g", "n / 124 AS b")
    domains = pts.select("lut_id").distinct().selectExpr("lut_id", "5 AS size", "array(0D, -0.1D, 0D) AS dmin", "array(1D, 1D, 1.2D) AS dmax")
    return L.from_lattice(pts, domains)


_CORNERS = "(VALUES (0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)) k(dr, dg, db)"


@query("film_lut", fx.sql(rounded(f"""
  SELECT image_id, y, x, {each('least(greatest({c} + (t{c} - {c}) * 0.7, 0), 1)')} FROM (
    SELECT image_id, y, x, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, sum(l.r * w) AS tr, sum(l.g * w) AS tg, sum(l.b * w) AS tb FROM (
      SELECT *, CASE dr WHEN 0 THEN 1 - fr ELSE fr END * CASE dg WHEN 0 THEN 1 - fg ELSE fg END * CASE db WHEN 0 THEN 1 - fb ELSE fb END AS w FROM (
        SELECT *, nr - ir AS fr, ng - ig AS fg, nb - ib AS fb FROM (
          SELECT *, CAST(least(floor(nr), 3) AS BIGINT) AS ir, CAST(least(floor(ng), 3) AS BIGINT) AS ig, CAST(least(floor(nb), 3) AS BIGINT) AS ib FROM (
            SELECT *, least(greatest(r, 0), 1) * 4 AS nr, least(greatest((g + 0.1) / 1.1, 0), 1) * 4 AS ng, least(greatest(b / 1.2, 0), 1) * 4 AS nb FROM pixels))), {_CORNERS}) p
    JOIN lattice l ON l.lut_id = CAST(image_id % (SELECT count(*) // 125 FROM part) AS VARCHAR) AND l.ri = ir + dr AND l.gi = ig + dg AND l.bi = ib + db GROUP BY 1, 2, 3)"""), "pixels", also={"lattice": _LATTICE}))
def film_lut(spark, sf):
    luts = F.floor(fx.rows_of(spark, sf, "part") / 125)
    px = fx.pixels(spark, sf).withColumn("lut_id", (F.col("image_id") % luts).cast("string"))
    return out(G.film_lut(px, lut_rows(spark, sf), F.lit(0.7)))


@query("lut_lattice", fx.sql("SELECT lut_id, ri, gi, bi, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM lattice", also={"lattice": _LATTICE}))
def lut_lattice(spark, sf):
    """`.cube` texts written from the lattices read back as the same lattices."""
    good, _ = L.parse(lut_cubes(spark, sf))
    return L.lattice(good).select("lut_id", *[F.col(c).cast("long").alias(c) for c in ("ri", "gi", "bi")], *[F.round(c, 6).alias(c) for c in RGB])


def lut_cubes(spark, sf):
    pts = lut_parts(spark, sf).selectExpr("lut_id", "n", "concat_ws(' ', p_size / 50, (p_retailprice - 900) / 100, n / 124) AS entry")
    body = pts.groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("rows"))
    return body.select("lut_id", F.concat(F.lit("# from parts\nTITLE \"parts\"\nLUT_3D_SIZE 5\n"), F.array_join(
        F.transform("rows", lambda r: r["entry"]), "\n"), F.lit("\n")).alias("text"))


@query("lut_problems", fx.sql("SELECT DISTINCT lut_id, 'count' AS problems FROM blocks WHERE parts < 125", also={"blocks": _BLOCKS}))
def lut_problems(spark, sf):
    """The block of parts too short to fill a lattice is told as such."""
    _, bad = L.parse(lut_cubes(spark, sf))
    return bad.select("lut_id", F.array_join("problems", ",").alias("problems"))


@query("absent_luts", fx.sql("SELECT image_id, 'lut ' || CAST(image_id AS VARCHAR) AS cause FROM frames WHERE image_id NOT IN (SELECT CAST(lut_id AS BIGINT) FROM lattice)",
                             "frames", also={"lattice": _LATTICE}))
def absent_luts(spark, sf):
    """Photos whose film node names a LUT that no block of parts makes are refused with the cause."""
    f = frames(spark, sf)
    film = RE.node("film", F.array(F.lit(0)), _map(lut_strength="1"), 1.0, F.lit(1)).withField("lut", F.col("image_id").cast("string"))
    recipes = f.select("image_id", F.array(film).cast(RECIPE).alias("recipe"), F.lit(1).alias("recipe_output"))
    return A.refused(A.prepared(recipes), lut_rows(spark, sf))


@query("negative_recipes", fx.sql(QM.negative_frames_sql("""
  SELECT image_id, round(rect_left, 6) AS crop_left, round(rect_width, 6) AS crop_width, round(least(greatest(base_r, 0), 4), 6) AS red, round(least(greatest(base_b, 0), 4), 6) AS blue"""),
    "pixels", "frames", also=QM._NEGATIVE))
def negative_recipes(spark, sf):
    px, f = fx.pixels(spark, sf), fx.frames(spark, sf)
    blank = f.select("image_id", _chain(("crop", [0], None, 1.0), ("color_subtract", [1], None, 1.0)).alias("recipe"), F.lit(2).alias("recipe_output"))
    r = A.negative_recipe(blank, M.negative_frames(px, f), 1, 2)
    p = lambda n, k: F.round(F.element_at(F.col("recipe")[n]["params"], k), 6)
    return r.select("image_id", p(0, "left").alias("crop_left"), p(0, "width").alias("crop_width"), p(1, "red").alias("red"), p(1, "blue").alias("blue"))
