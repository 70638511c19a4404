"""Registered queries: turning, cropping, resampling, regions and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.operators import geometry as GE
from shootlake.operators import grading as G
from shootlake.plans import fixtures as fx
from shootlake.plans.queries.pixels import out, rounded
from shootlake.plans.registry import query

_SIZED = "SELECT p.*, width, height, orientation FROM pixels p JOIN frames USING (image_id)"
_X = "CASE WHEN o IN (2, 3) THEN width - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN height - 1 - y ELSE x END"
_Y = "CASE WHEN o IN (3, 4) THEN height - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN width - 1 - x ELSE y END"


def _turned(code):
    return rounded(f"SELECT image_id, {_Y} AS y, {_X} AS x, r, g, b FROM (SELECT *, {code} AS o FROM sized)")


@query("orient_frames", fx.sql(_turned("orientation"), "pixels", "frames", also={"sized": _SIZED}))
def orient_frames(spark, sf):
    return out(GE.orient(fx.pixels(spark, sf), fx.frames(spark, sf)))


@query("rotate_frames", fx.sql(_turned("[1, 6, 3, 8][image_id % 4 + 1]"), "pixels", "frames", also={"sized": _SIZED}))
def rotate_frames(spark, sf):
    return out(GE.rotate(fx.pixels(spark, sf), fx.frames(spark, sf), F.col("image_id") % 4))


_WINDOWS = """
  SELECT *, greatest(1, least(floor(w * width + 0.5), width - x0)) AS cw, greatest(1, least(floor(h * height + 0.5), height - y0)) AS ch FROM (
  SELECT *, least(floor(l * width + 0.5), width - 1) AS x0, least(floor(t * height + 0.5), height - 1) AS y0 FROM (
  SELECT *, 0.1 + image_id % 3 / 10 AS l, image_id % 4 / 8 AS t, 0.4 + image_id % 2 / 10 AS w, 0.45 AS h FROM frames))"""


def _windows(spark, sf):
    return GE.crop_window(fx.frames(spark, sf), F.expr("0.1D + image_id % 3 / 10"), F.expr("image_id % 4 / 8"),
                          F.expr("0.4D + image_id % 2 / 10"), F.lit(0.45))


@query("crop_frames", fx.sql(rounded("""
  SELECT image_id, CAST(y - y0 AS BIGINT) AS y, CAST(x - x0 AS BIGINT) AS x, r, g, b FROM pixels JOIN windows USING (image_id)
  WHERE x >= x0 AND x < x0 + cw AND y >= y0 AND y < y0 + ch"""), "pixels", "frames", also={"windows": _WINDOWS}))
def crop_frames(spark, sf):
    return out(GE.crop(fx.pixels(spark, sf), _windows(spark, sf)))


def gather_sql(points, source, cols=("r", "g", "b")):
    """Bilinear samples by joining the four corners one by one."""
    corners = "SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dx, dy)"
    weight = "(CASE WHEN dx = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) * (CASE WHEN dy = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END)"
    return f"""
      SELECT q.image_id, q.y, q.x, {", ".join(f"coalesce(sum(s.{c} * wt), 0) AS {c}" for c in cols)} FROM (
        SELECT pt.*, CAST(floor(sx) AS BIGINT) + dx AS nx, CAST(floor(sy) AS BIGINT) + dy AS ny, {weight} AS wt,
               sx >= 0 AND sy >= 0 AND sx <= width - 1 AND sy <= height - 1 AS inside FROM {points} pt, ({corners})) q
      LEFT JOIN {source} s ON s.image_id = q.image_id AND s.x = q.nx AND s.y = q.ny AND inside GROUP BY 1, 2, 3"""


_TURNED = {
    "windows": _WINDOWS,
    "places": """SELECT w.*, CAST(gy.y AS BIGINT) AS y, CAST(gx.x AS BIGINT) AS x, radians((image_id % 5 - 2) * 6) AS a FROM windows w, range(0, 64) gy(y), range(0, 64) gx(x) WHERE y < ch AND x < cw""",
    "points": """SELECT image_id, y, x, width, height, x0 + cw * 0.5 + cos(a) * (x + 0.5 - cw * 0.5) + sin(a) * (y + 0.5 - ch * 0.5) - 0.5 AS sx,
                        y0 + ch * 0.5 - sin(a) * (x + 0.5 - cw * 0.5) + cos(a) * (y + 0.5 - ch * 0.5) - 0.5 AS sy FROM places""",
}


@query("crop_turned", fx.sql(rounded(gather_sql("points", "pixels")), "pixels", "frames", also=_TURNED))
def crop_turned(spark, sf):
    return out(GE.crop_turned(fx.pixels(spark, sf), _windows(spark, sf), F.expr("(image_id % 5 - 2) * 6")))


# A lens map that pulls places outwards, stronger in some frames.
_MX, _MY = ("{0} + 6 * ({0} - 32) / 32".format(c) for c in ("x", "y"))
_STRENGTH = "image_id % 3 / 2"
_REMAP = {
    "lensmap": f"SELECT image_id, y, x, width, height, x + ({_MX} - x) * ({_STRENGTH}) AS gx, y + ({_MY} - y) * ({_STRENGTH}) AS gy FROM pixels JOIN frames USING (image_id)",
    "zooms": """SELECT image_id, CASE WHEN n < 1 THEN 1.005 / greatest(n, 0.5) ELSE 1 END AS zoom FROM (
        SELECT image_id, coalesce(min(CASE WHEN NOT (gx >= 0 AND gy >= 0 AND gx <= width - 1 AND gy <= height - 1) THEN
          greatest(abs(x - (width - 1) / 2) / ((width - 1) / 2), abs(y - (height - 1) / 2) / ((height - 1) / 2)) END), 1) AS n
        FROM lensmap WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY 1)""",
    "asked": "SELECT image_id, y, x, width, height, (width - 1) / 2 + (x - (width - 1) / 2) / zoom AS sx, (height - 1) / 2 + (y - (height - 1) / 2) / zoom AS sy FROM lensmap JOIN zooms USING (image_id)",
    "mapped": gather_sql("asked", "lensmap", ("gx", "gy")),
    "points": "SELECT m.image_id, m.y, m.x, width, height, gx AS sx, gy AS sy FROM mapped m JOIN frames USING (image_id)",
}


def lens_map(spark, sf):
    return fx.pixels(spark, sf).select("image_id", "y", "x", F.expr(_MX).alias("mx"), F.expr(_MY).alias("my"))


@query("optics_zoom", fx.sql("SELECT image_id, round(zoom, 6) AS zoom FROM zooms", "pixels", "frames", also={k: _REMAP[k] for k in ("lensmap", "zooms")}))
def optics_zoom(spark, sf):
    f = fx.frames(spark, sf).select("image_id", "width", "height", F.expr(_STRENGTH).alias("s"))
    m = lens_map(spark, sf).join(f, "image_id").withColumns(
        {"gx": F.expr("x + (mx - x) * s"), "gy": F.expr("y + (my - y) * s")})
    return GE.zoom_to_fill(m).select("image_id", F.round("zoom", 6).alias("zoom"))


@query("optics_remap", fx.sql(rounded(gather_sql("points", "pixels"), 5), "pixels", "frames", also=_REMAP))
def optics_remap(spark, sf):
    return out(GE.remap(fx.pixels(spark, sf), lens_map(spark, sf), fx.frames(spark, sf), F.expr(_STRENGTH)), 5)


_SIZES = """SELECT *, greatest(1, floor(width * s + 0.5)) AS tw, greatest(1, floor(height * s + 0.5)) AS th FROM (
  SELECT *, least(CASE WHEN orientation BETWEEN 5 AND 8 THEN 24 ELSE 20 END / width, CASE WHEN orientation BETWEEN 5 AND 8 THEN 20 ELSE 24 END / height, 1) AS s FROM frames)"""


@query("downscale", fx.sql(rounded("""
  SELECT image_id, CAST(j AS BIGINT) AS y, CAST(i AS BIGINT) AS x, sum(r * w) / sum(w) AS r, sum(g * w) / sum(w) AS g, sum(b * w) / sum(w) AS b FROM (
    SELECT p.image_id, i, j, r, g, b,
           (least(x + 1, (i + 1) * width / tw) - greatest(x, i * width / tw)) * (least(y + 1, (j + 1) * height / th) - greatest(y, j * height / th)) AS w
    FROM pixels p JOIN sizes USING (image_id), range(0, 24) a(i), range(0, 24) c(j)
    WHERE i < tw AND j < th AND x + 1 > i * width / tw AND x < (i + 1) * width / tw AND y + 1 > j * height / th AND y < (j + 1) * height / th)
  GROUP BY 1, 2, 3"""), "pixels", "frames", also={"sizes": _SIZES}))
def downscale(spark, sf):
    sizes = GE.target_size(fx.frames(spark, sf), F.lit(20), F.lit(24))
    return out(GE.downscale(fx.pixels(spark, sf), sizes))


@query("region_with_halo", fx.sql(rounded("""
  SELECT image_id, y, x, r, g, b FROM pixels JOIN frames USING (image_id)
  WHERE x >= floor(0.3 * width) - 16 AND x < ceil(0.55 * width) + 16 AND y >= floor(0.4 * height) - 16 AND y < ceil(0.6 * height) + 16"""), "pixels", "frames"))
def region_with_halo(spark, sf):
    halo = GE.halo_of(["crop", "noise_reduction", "optics", "tone", "sharpen"])
    return out(GE.region(fx.pixels(spark, sf), fx.frames(spark, sf), (0.3, 0.4, 0.25, 0.2), halo))


_RECT = "0.1 AS l, 0.2 AS t, 0.3 + image_id % 3 / 10 AS w, 0.25 AS h"


def rect_sql(code):
    r, b = "1 - l - w", "1 - t - h"
    table = {1: ("l", "t", "w", "h"), 2: (r, "t", "w", "h"), 3: (r, b, "w", "h"), 4: ("l", b, "w", "h"), 5: ("t", "l", "h", "w"),
             6: (b, "l", "h", "w"), 7: (b, r, "h", "w"), 8: ("t", r, "h", "w")}
    return [f"CASE {code} " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in table.items()) + " END" for i in range(4)]


_NAMES = ("rect_left", "rect_top", "rect_width", "rect_height")


@query("rect_to_display", fx.sql("SELECT image_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for e, n in zip(rect_sql("orientation"), _NAMES))
                                 + f" FROM (SELECT *, {_RECT} FROM frames)", "frames"))
def rect_to_display(spark, sf):
    r = [F.lit(0.1), F.lit(0.2), F.expr("0.3D + image_id % 3 / 10"), F.lit(0.25)]
    return fx.frames(spark, sf).select("image_id", *[F.round(e, 6).alias(n) for e, n in zip(GE.to_display_rect(F.col("orientation"), *r), _NAMES)])


@query("rect_to_sensor", fx.sql("SELECT image_id, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 6) AS {n}" for e, n in zip(rect_sql("[1, 2, 3, 4, 5, 8, 7, 6][orientation]"), _NAMES))
    + f", CAST(CASE WHEN orientation IN (2, 4, 5, 7) THEN -1.5 ELSE 1.5 END AS DOUBLE) AS angle FROM (SELECT *, {_RECT} FROM frames)", "frames"))
def rect_to_sensor(spark, sf):
    r = [F.lit(0.1), F.lit(0.2), F.expr("0.3D + image_id % 3 / 10"), F.lit(0.25)]
    return fx.frames(spark, sf).select("image_id", *[F.round(e, 6).alias(n) for e, n in zip(GE.to_sensor_rect(F.col("orientation"), *r), _NAMES)],
                                       GE.display_angle(F.col("orientation"), F.lit(1.5)).alias("angle"))


@query("crop_to_ratio", fx.sql("""
  SELECT image_id, round(least(1 - nw, greatest(0, 0.1 + w / 2 - nw / 2)), 6) AS rect_left, round(least(1 - nh, greatest(0, 0.2 + h / 2 - nh / 2)), 6) AS rect_top,
         round(nw, 6) AS rect_width, round(nh, 6) AS rect_height FROM (
    SELECT *, least(w * width, h * height * q) / width AS nw, least(w * width, h * height * q) / q / height AS nh FROM (
      SELECT *, 0.7::DOUBLE AS w, 0.6::DOUBLE AS h, [1.5, 1.0, 0.8, 1.7778][image_id % 4 + 1]::DOUBLE AS q FROM frames))""", "frames"))
def crop_to_ratio(spark, sf):
    q = F.element_at(F.array(F.lit(1.5), F.lit(1.0), F.lit(0.8), F.lit(1.7778)), (F.col("image_id") % 4 + 1).cast("int"))
    rect = GE.fit_ratio(F.lit(0.1), F.lit(0.2), F.lit(0.7), F.lit(0.6), F.col("width"), F.col("height"), q)
    return fx.frames(spark, sf).select("image_id", *[F.round(e, 6).alias(n) for e, n in zip(rect, _NAMES)])


@query("linear_sample", fx.sql("""
  SELECT p.image_id, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM pixels p JOIN (
    SELECT image_id, floor(sx * (width - 1) + 0.5) AS cx, floor(sy * (height - 1) + 0.5) AS cy, floor(0.1 * least(width, height)) AS rad FROM (
      SELECT *, CASE orientation WHEN 1 THEN px WHEN 2 THEN 1 - px WHEN 3 THEN 1 - px WHEN 4 THEN px WHEN 5 THEN py WHEN 6 THEN py WHEN 7 THEN 1 - py ELSE 1 - py END AS sx,
                CASE orientation WHEN 1 THEN py WHEN 2 THEN py WHEN 3 THEN 1 - py WHEN 4 THEN 1 - py WHEN 5 THEN px WHEN 6 THEN 1 - px WHEN 7 THEN 1 - px ELSE px END AS sy
      FROM (SELECT *, 0.05 + image_id % 9 / 10 AS px, 0.3 AS py FROM frames))) c USING (image_id)
  WHERE abs(x - cx) <= rad AND abs(y - cy) <= rad GROUP BY 1""", "pixels", "frames"))
def linear_sample(spark, sf):
    points = fx.frames(spark, sf).withColumns({"px": F.expr("0.05D + image_id % 9 / 10"), "py": F.lit(0.3), "radius": F.lit(0.1)})
    return GE.sample(fx.pixels(spark, sf), points).select("image_id", *[F.round(c, 6).alias(c) for c in G.RGB])
