"""Registered queries: scopes, noise, focus, signatures, negatives and neighbourhood filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.functions import colour as K
from shootlake.operators import filters as FI
from shootlake.operators import measure as M
from shootlake.operators import scopes as SC
from shootlake.operators import tiles
from shootlake.plans import fixtures as fx
from shootlake.plans.queries.geometry import rect_sql
from shootlake.plans.queries.pixels import LUM_R, RGB, enc, out, rounded
from shootlake.plans.registry import query


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


_LEVELS = " UNION ALL ".join(
    f"SELECT image_id, y, x, '{c}' AS channel, CAST(floor(least(greatest({c}, 0), 1) * 255 + 0.5) AS BIGINT) AS v FROM pixels" for c in RGB)


@query("level_histogram", fx.sql("""
  SELECT f.image_id, c.channel, b.bin, coalesce(n, 0) AS n FROM frames f, (VALUES ('r'), ('g'), ('b')) c(channel), range(0, 64) b(bin)
  LEFT JOIN (SELECT image_id, channel, v * 64 // 256 AS bin, count(*) AS n FROM levels GROUP BY 1, 2, 3) h
    ON h.image_id = f.image_id AND h.channel = c.channel AND h.bin = b.bin""", "pixels", "frames", also={"levels": _LEVELS}))
def level_histogram(spark, sf):
    return _long(SC.histogram(fx.pixels(spark, sf)), "bin", "n")


_TRACE = "SELECT image_id, channel, 31 - v * 32 // 256 AS row, x * 16 // width AS col, count(*) AS n FROM levels JOIN frames USING (image_id) GROUP BY 1, 2, 3, 4"


@query("waveform", fx.sql("SELECT * FROM trace", "pixels", "frames", also={"levels": _LEVELS, "trace": _TRACE}))
def waveform(spark, sf):
    return _long(SC.waveform(fx.pixels(spark, sf), fx.frames(spark, sf), 16, 32), "row", "col", "n")


@query("waveform_shading", fx.sql("""
  SELECT image_id, channel, row, col, n, CAST(round(255 * power(least(1, n / greatest(1, least(peak, greatest(1, height * width / 16 / 8)))), 0.6)) AS BIGINT) AS shade
  FROM (SELECT *, max(n) OVER (PARTITION BY image_id, channel) AS peak FROM trace) JOIN frames USING (image_id)""",
    "pixels", "frames", also={"levels": _LEVELS, "trace": _TRACE}))
def waveform_shading(spark, sf):
    f = fx.frames(spark, sf)
    return _long(SC.shade(SC.waveform(fx.pixels(spark, sf), f, 16, 32), f, 16), "row", "col", "n", "shade")


_LUMA = f"SELECT image_id, y, x, width, height, {LUM_R} AS l FROM pixels JOIN frames USING (image_id)"
_LAPLACE = """
  SELECT image_id, CAST(least(floor(sqrt(least(greatest(l, 0), 1)) * 8), 7) AS BIGINT) AS bin, abs(l - (w + e + n + s) / 4) AS magnitude FROM (
    SELECT *, lag(l) OVER wx AS w, lead(l) OVER wx AS e, lag(l) OVER wy AS n, lead(l) OVER wy AS s FROM luma
    WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))
  WHERE w IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL"""
_PROFILE = {
    "luma": _LUMA, "samples": _LAPLACE,
    "quart": "SELECT image_id, bin, magnitude / 0.3186 / 1.118034 AS d FROM (SELECT *, row_number() OVER (PARTITION BY image_id, bin ORDER BY magnitude) - 1 AS k, count(*) OVER (PARTITION BY image_id, bin) AS n FROM samples) WHERE n >= 32 AND k = n // 4",
    "profile": "SELECT f.image_id, b.bin, (SELECT arg_min(q.d, abs(q.bin - b.bin) * 100 + q.bin) FROM quart q WHERE q.image_id = f.image_id) AS d FROM frames f, range(0, 8) b(bin)",
}


@query("noise_samples", fx.sql("SELECT image_id, bin, count(*) AS n, round(max(magnitude), 6) AS largest, round(sum(magnitude), 4) AS total FROM samples GROUP BY 1, 2",
                               "pixels", "frames", also={"luma": _LUMA, "samples": _LAPLACE}))
def noise_samples(spark, sf):
    s = M.noise_samples(fx.pixels(spark, sf), fx.frames(spark, sf))
    return s.groupBy("image_id", F.col("bin").cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("magnitude"), 6).alias("largest"), F.round(F.sum("magnitude"), 4).alias("total"))


@query("noise_profile", fx.sql("SELECT image_id, bin, round(d, 6) AS deviation FROM profile", "pixels", "frames", also=_PROFILE))
def noise_profile(spark, sf):
    p = M.noise_profile(fx.pixels(spark, sf), fx.frames(spark, sf))
    return p.select("image_id", F.posexplode("deviations").alias("bin", "d")).select(
        "image_id", F.col("bin").cast("long").alias("bin"), F.round("d", 6).alias("deviation"))


def _diff(axis, line):
    return ", ".join(f"lead(p, {k}) OVER w{axis} - lag(p, {k}) OVER w{axis} AS {axis}{k}" for k in (1, 2, 3))


_EDGES = {
    "plane": f"SELECT image_id, y, x, width, height, CASE WHEN l > 0 THEN {enc('l')} ELSE 0 END AS p FROM luma",
    "diffs": f"SELECT *, {_diff('x', 'y')}, {_diff('y', 'x')} FROM plane WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)",
    "wides": "SELECT *, CASE WHEN x >= 3 AND x < width - 3 THEN x1 + 2 * x2 + 2 * x3 ELSE 0 END AS wide_x, CASE WHEN y >= 3 AND y < height - 3 THEN y1 + 2 * y2 + 2 * y3 ELSE 0 END AS wide_y FROM diffs",
    "located": "SELECT *, CASE WHEN y >= 2 AND y < height - 2 THEN sum(wide_x) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE 0 END AS across, CASE WHEN x >= 2 AND x < width - 2 THEN sum(wide_y) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE 0 END AS down FROM wides",
    "peaks": "SELECT *, inner_ AND abs(across) >= abs(lag(across) OVER wx) AND abs(across) > abs(lead(across) OVER wx) AS across_peak, inner_ AND abs(down) >= abs(lag(down) OVER wy) AND abs(down) > abs(lead(down) OVER wy) AS down_peak FROM (SELECT *, x >= 5 AND x < width - 5 AND y >= 5 AND y < height - 5 AS inner_ FROM located) WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)",
}


@query("edge_locator", fx.sql("""
  SELECT image_id, y, x, round(across, 5) AS across, round(down, 5) AS down, inner_ AND across_peak AS across_peak, inner_ AND down_peak AS down_peak FROM peaks""",
                              "pixels", "frames", also={"luma": _LUMA, **_EDGES}))
def edge_locator(spark, sf):
    e = M.edge_map(M.focus_plane(fx.pixels(spark, sf)), fx.frames(spark, sf))
    return _long(e, "y", "x").select("image_id", "y", "x", F.round("across", 5).alias("across"), F.round("down", 5).alias("down"),
                                     F.coalesce("across_peak", F.lit(False)).alias("across_peak"), F.coalesce("down_peak", F.lit(False)).alias("down_peak"))


_NOISE = {"grid": "SELECT image_id, abs(x1) AS d FROM diffs WHERE x % 3 = 1 AND y % 3 = 1 AND x < width - 1 AND y < height - 1",
          "noise": "SELECT image_id, d * 1.4826 / sqrt(2) AS noise FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM grid) WHERE k = n // 2"}


@query("focus_noise", fx.sql("SELECT image_id, round(noise, 6) AS noise FROM noise", "pixels", "frames", also={"luma": _LUMA, **_EDGES, **_NOISE}))
def focus_noise(spark, sf):
    f = fx.frames(spark, sf)
    return M.focus_noise(M.edge_map(M.focus_plane(fx.pixels(spark, sf)), f), f).select("image_id", F.round("noise", 6).alias("noise"))


def _erf(v):
    t = f"(1 / (1 + 0.3275911 * {v}))"
    return f"(1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{v} * {v}))"


def _ratio(s):
    return f"({_erf(f'(2 / (sqrt(2) * {s}))')} / {_erf(f'(1 / (sqrt(2) * {s}))')})"


def _invert(source):
    q = f"SELECT *, 0::DOUBLE AS lo, 8::DOUBLE AS hi FROM ({source})"
    for _ in range(24):
        q = (f"SELECT image_id, patch_y, patch_x, ratio, CASE WHEN up THEN mid ELSE lo END AS lo, CASE WHEN up THEN hi ELSE mid END AS hi "
             f"FROM (SELECT *, {_ratio('mid')} < ratio AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM ({q})))")
    return f"SELECT image_id, patch_y, patch_x, CASE WHEN ratio <= 1 THEN 0 WHEN ratio >= {_ratio('8')} THEN 8 ELSE (lo + hi) / 2 END AS blur FROM ({q})"


# Frames of pure noise have no edge past the usual margin, so these queries lower it and the patch size.
_PATCH, _MARGIN, _LEAST = 16, 0.4, 6
_BLURS = {
    "sums": f"""SELECT image_id, y // {_PATCH} AS patch_y, x // {_PATCH} AS patch_x, """ + ", ".join(
        f"sum(CASE WHEN {e}_peak AND abs({e}) > lim THEN {a}1 * sign({e}) END) AS {a}d1, sum(CASE WHEN {e}_peak AND abs({e}) > lim THEN {a}2 * sign({e}) END) AS {a}d2, count(*) FILTER ({e}_peak AND abs({e}) > lim) AS {a}n"
        for e, a in (("across", "x"), ("down", "y"))) + f""" FROM (SELECT *, greatest({_MARGIN} * sqrt(90) * noise, 0.5) AS lim FROM peaks JOIN noise USING (image_id)) GROUP BY 1, 2, 3""",
    "ratios": "SELECT image_id, patch_y, patch_x, greatest(xr, yr) AS ratio FROM (SELECT *, " + ", ".join(
        f"CASE WHEN {a}n >= {_LEAST} AND {a}d1 > 0 AND {a}d2 / {a}d1 > 0.95 THEN {a}d2 / {a}d1 END AS {a}r" for a in "xy") + " FROM sums) WHERE greatest(xr, yr) IS NOT NULL",
    "blurs": _invert("SELECT * FROM ratios"),
}
_FOCUS = {"luma": _LUMA, **_EDGES, **_NOISE, **_BLURS}


@query("focus_patches", fx.sql("SELECT image_id, patch_y, patch_x, round(blur, 4) AS blur FROM blurs", "pixels", "frames", also=_FOCUS))
def focus_patches(spark, sf):
    f = fx.frames(spark, sf)
    e = M.edge_map(M.focus_plane(fx.pixels(spark, sf)), f)
    b = M.patch_blurs(e, M.focus_noise(e, f), _PATCH, _MARGIN, least=_LEAST)
    return _long(b, "patch_y", "patch_x").withColumn("blur", F.round("blur", 4))


@query("focus_reports", fx.sql(f"""
  SELECT f.image_id, round(coalesce(max(CASE WHEN k = least(3, n - 1) THEN blur END) * 1600 / greatest(width, height), 8), 3) AS blur,
         round(coalesce(max(CASE WHEN k = n // 2 THEN blur END) * 1600 / greatest(width, height), 8), 3) AS typical,
         round(coalesce(max(n), 0) / (ceil(width / {_PATCH}) * ceil(height / {_PATCH})), 6) AS judgeable
  FROM frames f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY blur) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM blurs) b
    ON b.image_id = f.image_id GROUP BY f.image_id, width, height""", "pixels", "frames", also=_FOCUS))
def focus_reports(spark, sf):
    r = M.measure_focus(fx.pixels(spark, sf), fx.frames(spark, sf), _PATCH, _MARGIN, least=_LEAST)
    return r.select("image_id", F.round("blur", 3).alias("blur"), F.round("typical", 3).alias("typical"), F.round("judgeable", 6).alias("judgeable"))


@query("perceptual_signatures", fx.sql("""
  SELECT image_id, CAST(sum(CASE WHEN l8 > r8 THEN CASE WHEN j * 8 + i = 63 THEN -9223372036854775808::HUGEINT ELSE CAST(power(2, j * 8 + i) AS HUGEINT) END ELSE 0 END) AS BIGINT) AS signature
  FROM (SELECT *, lead(l8) OVER (PARTITION BY image_id, j ORDER BY i) AS r8 FROM (
    SELECT image_id, i, j, CAST(floor(least(greatest(sum(l * w) / sum(w), 0), 1) * 255 + 0.5) AS BIGINT) AS l8 FROM (
      SELECT image_id, i, j, l, (least(x + 1, (i + 1) * width / 9) - greatest(x, i * width / 9)) * (least(y + 1, (j + 1) * height / 8) - greatest(y, j * height / 8)) AS w
      FROM luma, range(0, 9) a(i), range(0, 8) c(j)
      WHERE x + 1 > i * width / 9 AND x < (i + 1) * width / 9 AND y + 1 > j * height / 8 AND y < (j + 1) * height / 8) GROUP BY 1, 2, 3)) WHERE r8 IS NOT NULL
  GROUP BY 1""", "pixels", "frames", also={"luma": _LUMA}))
def perceptual_signatures(spark, sf):
    return M.signature(fx.pixels(spark, sf), fx.frames(spark, sf))


_RING = "SELECT p.image_id, r, g, b FROM pixels p JOIN frames USING (image_id) WHERE y < greatest(floor(height * 0.03), 2) OR y >= height - greatest(floor(height * 0.03), 2) OR x < greatest(floor(width * 0.03), 2) OR x >= width - greatest(floor(width * 0.03), 2)"


def _upper_median(c):
    return f"SELECT image_id, {c} AS base_{c} FROM (SELECT image_id, {c}, row_number() OVER (PARTITION BY image_id ORDER BY {c}) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM ring) WHERE k = n // 2"


_NEGATIVE = {
    "ring": _RING, **{f"med_{c}": _upper_median(c) for c in RGB},
    "base": "SELECT * FROM med_r JOIN med_g USING (image_id) JOIN med_b USING (image_id)",
    "liked": "SELECT image_id, y, x, width, height, orientation, " + " AND ".join(f"abs({c} - base_{c}) / greatest(base_{c}, 0.02) < 0.3" for c in RGB) + " AS alike FROM pixels JOIN base USING (image_id) JOIN frames USING (image_id)",
    "lines": "SELECT image_id, 'row' AS axis, y AS line, avg(alike::INT) > 0.55 AS border FROM liked GROUP BY ALL UNION ALL SELECT image_id, 'column', x, avg(alike::INT) > 0.55 FROM liked GROUP BY ALL",
    "runs": "SELECT image_id, axis, min(line) AS start, count(*) AS length, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY image_id, axis) AS n, line - row_number() OVER (PARTITION BY image_id, axis, border ORDER BY line) AS grp FROM lines) WHERE NOT border GROUP BY image_id, axis, grp",
    "spans": "SELECT image_id, axis, start, length, n AS lines FROM (SELECT *, row_number() OVER (PARTITION BY image_id, axis ORDER BY (start <= n // 2 AND n // 2 < start + length) DESC, length DESC, start DESC) AS k FROM runs) WHERE k = 1",
    "boxes": """SELECT f.*, r.start AS rs, r.length AS rl, c.start AS cs, c.length AS cl, coalesce(r.length / f.height > 0.2 AND c.length / f.width > 0.2, false) AS ok
        FROM frames f LEFT JOIN spans r ON r.image_id = f.image_id AND r.axis = 'row' LEFT JOIN spans c ON c.image_id = f.image_id AND c.axis = 'column'""",
    "probe": """SELECT b.image_id, y, min(x) FILTER (x >= cs - mg AND x < cs + mg) AS lx, max(x) FILTER (x >= cs + cl - mg AND x < cs + cl + mg) AS rx
        FROM (SELECT *, greatest(rl // 10, 2) AS ins, greatest(cl // 4, 4) AS mg FROM boxes WHERE ok) b JOIN liked l ON l.image_id = b.image_id
        WHERE NOT alike AND y >= rs + ins AND y < rs + rl - ins AND rs + rl - ins > rs + ins + 8 GROUP BY 1, 2""",
    "slopes": "SELECT image_id, CASE WHEN count(lx) >= 8 THEN regr_slope(lx, y) END AS a, CASE WHEN count(rx) >= 8 THEN regr_slope(rx, y) END AS b FROM probe GROUP BY 1",
    "tilts": "SELECT image_id, CASE WHEN abs(deg) < 0.3 THEN 0 ELSE deg END AS tilt FROM (SELECT image_id, least(greatest(degrees(atan(CASE WHEN abs(a - b) > 0.03 THEN 0 ELSE coalesce((a + b) / 2, a, b, 0) END)), -7), 7) AS deg FROM slopes)",
}


@query("border_base", fx.sql("SELECT image_id, " + ", ".join(f"round(base_{c}, 6) AS base_{c}" for c in RGB) + " FROM base", "pixels", "frames",
                             also={k: _NEGATIVE[k] for k in ("ring", "med_r", "med_g", "med_b", "base")}))
def border_base(spark, sf):
    b = M.border_base(fx.pixels(spark, sf), fx.frames(spark, sf))
    return b.select("image_id", *[F.round(f"base_{c}", 6).alias(f"base_{c}") for c in RGB])


@query("border_lines", fx.sql("SELECT image_id, axis, line, border FROM lines", "pixels", "frames", also=_NEGATIVE))
def border_lines(spark, sf):
    px = fx.pixels(spark, sf)
    return _long(M.border_lines(M.base_like(px, M.border_base(px, fx.frames(spark, sf)))), "line")


@query("content_spans", fx.sql("SELECT image_id, axis, start, length, lines FROM spans", "pixels", "frames", also=_NEGATIVE))
def content_spans(spark, sf):
    px = fx.pixels(spark, sf)
    return _long(M.content_spans(M.border_lines(M.base_like(px, M.border_base(px, fx.frames(spark, sf))))), "start", "length", "lines")


def negative_frames_sql(select):
    """`select` over the detected frames, whose rectangle is in display fractions."""
    rect = ", ".join(f"{e} AS {n}" for e, n in zip(rect_sql("orientation"), ("rect_left", "rect_top", "rect_width", "rect_height")))
    return f"""{select} FROM (SELECT *, {rect} FROM (
      SELECT *, CASE WHEN ok THEN least(greatest(cl / width - 0.03, 0.05), 1 - l) ELSE 1 END AS w, CASE WHEN ok THEN least(greatest(rl / height - 0.03, 0.05), 1 - t) ELSE 1 END AS h FROM (
        SELECT *, CASE WHEN ok THEN least(greatest(cs / width + 0.015, 0), 0.95) ELSE 0 END AS l, CASE WHEN ok THEN least(greatest(rs / height + 0.015, 0), 0.95) ELSE 0 END AS t FROM boxes))
      JOIN base USING (image_id) LEFT JOIN tilts USING (image_id))"""


@query("negative_frames", fx.sql(negative_frames_sql("SELECT image_id, " + ", ".join(f"round(base_{c}, 6) AS base_{c}" for c in RGB)
    + ", round(CASE WHEN orientation IN (2, 4, 5, 7) THEN -coalesce(tilt, 0) ELSE coalesce(tilt, 0) END + 0, 5) AS angle, "
    + ", ".join(f"round(rect_{n}, 6) AS rect_{n}" for n in ("left", "top", "width", "height"))), "pixels", "frames", also=_NEGATIVE))
def negative_frames(spark, sf):
    n = M.negative_frames(fx.pixels(spark, sf), fx.frames(spark, sf))
    return n.select("image_id", *[F.round(c, 6).alias(c) for c in n.columns if c.startswith(("base", "rect"))],
                    F.round(F.col("angle") + 0.0, 5).alias("angle"))


# Blurs and medians by joining each pixel with the clamped places around it.
def _blur_sql(source, step, axis, guide="l", value="v"):
    edge, other = ("width", "y") if axis == "x" else ("height", "x")
    return f"""SELECT c.image_id, c.y, c.x, c.width, c.height, c.{guide}, sum(k.w / (1 + power((t.{guide} - c.{guide}) / (0.012 + 0.055 * sqrt(greatest(c.{guide}, 0))), 2)) * t.{value})
        / sum(k.w / (1 + power((t.{guide} - c.{guide}) / (0.012 + 0.055 * sqrt(greatest(c.{guide}, 0))), 2))) AS {value}
      FROM {source} c, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(o, w), {source} t
      WHERE t.image_id = c.image_id AND t.{other} = c.{other} AND t.{axis} = least(greatest(c.{axis} + k.o * {step}, 0), c.{edge} - 1) GROUP BY ALL"""


@query("guided_blur", fx.sql("SELECT image_id, y, x, round(v, 6) AS v FROM twice", "pixels", "frames", also={"luma": _LUMA, "start": "SELECT *, l AS v FROM luma", "rows_": _blur_sql("start", 2, "x"), "twice": _blur_sql("rows_", 2, "y")}))
def guided_blur(spark, sf):
    cut = tiles.split(fx.pixels(spark, sf).withColumn("l", K.luminance(*[F.col(c) for c in RGB], K.LUMA_ROUNDED)), 4)
    return _long(tiles.trim(FI.guided_blur(cut, {"v": "l"}, "l", 2)), "y", "x").select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("median_3x3", fx.sql("""
  SELECT c.image_id, c.y, c.x, round(c.r + (list_sort(list(t.r))[5] - c.r) * 0.75, 6) AS r FROM sized c, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), sized t
  WHERE t.image_id = c.image_id AND t.y = least(greatest(c.y + dy, 0), c.height - 1) AND t.x = least(greatest(c.x + dx, 0), c.width - 1) GROUP BY c.image_id, c.y, c.x, c.r""",
    "pixels", "frames", also={"sized": "SELECT image_id, y, x, r, width, height FROM pixels JOIN frames USING (image_id)"}))
def median_3x3(spark, sf):
    cut = tiles.split(fx.pixels(spark, sf), 2)
    return _long(tiles.trim(FI.median_3x3(cut, ["r"], F.lit(0.75))), "y", "x").select("image_id", "y", "x", F.round("r", 6).alias("r"))


_SHARP = {
    **_PROFILE,
    "roots": "SELECT *, sqrt(greatest(l, 0)) AS e FROM luma",
    "kern": "SELECT image_id, o, exp(-o * o / (2 * rad * rad)) AS k FROM (SELECT image_id, 0.6 + image_id % 3 / 2 AS rad FROM frames), range(-16, 17) q(o) WHERE abs(o) <= least(greatest(ceil(3 * rad), 1), 16)",
    "kernel": "SELECT image_id, o, k / sum(k) OVER (PARTITION BY image_id) AS k FROM kern",
    "taps": "SELECT c.image_id, c.y, c.x, c.height, c.width, c.l, c.e, k, least(greatest(c.x + o, 0), c.width - 1) AS tx, o FROM roots c JOIN kernel q ON q.image_id = c.image_id",
    "hb": "SELECT c.image_id, c.y, c.x, c.height, c.width, c.l, c.e, sum(t.e * k) AS v FROM taps c JOIN roots t ON t.image_id = c.image_id AND t.y = c.y AND t.x = c.tx GROUP BY ALL",
    "taps2": "SELECT c.*, k, least(greatest(c.y + o, 0), c.height - 1) AS ty FROM hb c JOIN kernel q ON q.image_id = c.image_id",
    "vb": "SELECT c.image_id, c.y, c.x, c.l, c.e, sum(t.v * k) AS v FROM taps2 c JOIN hb t ON t.image_id = c.image_id AND t.x = c.x AND t.y = c.ty GROUP BY ALL",
    "det": "SELECT vb.*, e - v AS d, 0.5 * p.d / (2 * greatest(e, 0.001)) AS lim FROM vb JOIN profile p ON p.image_id = vb.image_id AND p.bin = least(floor(sqrt(least(greatest(l, 0), 1)) * 8), 7)",
    "gain": "SELECT image_id, y, x, CASE WHEN l <= 1e-5 THEN 1 ELSE power(greatest(e + 1.5 * CASE WHEN lim <= 0 THEN d WHEN abs(d) <= lim THEN 0 ELSE d * (1 - power(lim / d, 2)) END, 0), 2) / l END AS k FROM det",
}


@query("sharpen", fx.sql(rounded("SELECT image_id, y, x, r * k AS r, g * k AS g, b * k AS b FROM pixels JOIN gain USING (image_id, y, x)", 5), "pixels", "frames", also=_SHARP))
def sharpen(spark, sf):
    px, f = fx.pixels(spark, sf), fx.frames(spark, sf)
    s = M.noise_profile(px, f).withColumns({"amount": F.lit(1.5), "radius": F.expr("0.6D + image_id % 3 / 2"), "threshold": F.lit(0.5)})
    return out(FI.sharpen(px, s), 5)


# Noise reduction at strength 0.5: guided blurs of luma at two steps, colour differences at half size, back between half-size samples.
def _guided(source, step, axis, guide, values):
    edge, other = ("width", "y") if axis == "x" else ("height", "x")
    w = f"k.w / (1 + power((t.{guide} - c.{guide}) / (0.012 + 0.055 * sqrt(greatest(c.{guide}, 0))), 2))"
    return f"""SELECT c.image_id, c.y, c.x, c.width, c.height, c.{guide}, {", ".join(f"sum({w} * t.{v}) / sum({w}) AS {v}" for v in values)}
      FROM {source} c, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(o, w), {source} t
      WHERE t.image_id = c.image_id AND t.{other} = c.{other} AND t.{axis} = least(greatest(c.{axis} + k.o * {step}, 0), c.{edge} - 1) GROUP BY ALL"""


def _shrunk(detail, limit):
    return f"CASE WHEN {limit} <= 0 THEN {detail} WHEN abs({detail}) <= {limit} THEN 0 ELSE ({detail}) * (1 - power({limit} / ({detail}), 2)) END"


_CHROMA = ("cb", "cr")
_DENOISE = {
    **_PROFILE, "lit": "SELECT *, l AS v FROM luma",
    "one_": _guided("lit", 1, "x", "l", ["v"]), "one": _guided("one_", 1, "y", "l", ["v"]),
    "two_": _guided("one", 2, "x", "l", ["v"]), "two": _guided("two_", 2, "y", "l", ["v"]),
    "clean": f"""SELECT *, b2 + {_shrunk("b1 - b2", "n * 0.5")} + {_shrunk("l - b1", "n * 2.25")} AS c FROM (
      SELECT one.*, one.v AS b1, two.v AS b2, p.d * 0.5 AS n FROM one JOIN two USING (image_id, y, x)
      JOIN profile p ON p.image_id = one.image_id AND p.bin = least(floor(sqrt(least(greatest(one.l, 0), 1)) * 8), 7))""",
    "half": """SELECT c.image_id, c.y // 2 AS y, c.x // 2 AS x, (c.width + 1) // 2 AS width, (c.height + 1) // 2 AS height, avg(p.b - c.l) AS cb, avg(p.r - c.l) AS cr, avg(c.c) AS g
      FROM clean c JOIN pixels p USING (image_id, y, x) GROUP BY ALL""",
    "h0": "SELECT c.image_id, c.y, c.x, c.width, c.height, c.g, " + ", ".join(f"c.{v} + (list_sort(list(t.{v}))[5] - c.{v}) * 0.75 AS {v}" for v in _CHROMA) + """
      FROM half c, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), half t
      WHERE t.image_id = c.image_id AND t.y = least(greatest(c.y + dy, 0), c.height - 1) AND t.x = least(greatest(c.x + dx, 0), c.width - 1)
      GROUP BY c.image_id, c.y, c.x, c.width, c.height, c.g, c.cb, c.cr""",
}
for _k, (_step, _amount) in enumerate(((1, 0.9), (2, 0.625), (4, 0.375)), 1):
    _DENOISE[f"h{_k}r"] = _guided(f"h{_k - 1}", _step, "x", "g", _CHROMA)
    _DENOISE[f"h{_k}c"] = _guided(f"h{_k}r", _step, "y", "g", _CHROMA)
    _DENOISE[f"h{_k}"] = (f"SELECT s.* EXCLUDE (cb, cr), " + ", ".join(f"s.{v} + (b.{v} - s.{v}) * {_amount} AS {v}" for v in _CHROMA)
                          + f" FROM h{_k - 1} s JOIN h{_k}c b USING (image_id, y, x)")
_DENOISE["up"] = "SELECT c.image_id, c.y, c.x, c.c, " + ", ".join(f"sum(t.{v} * wy * wx) AS {v}" for v in _CHROMA) + """
  FROM clean c, (VALUES (0, 0.75), (1, 0.25)) a(sy, wy), (VALUES (0, 0.75), (1, 0.25)) b(sx, wx), h3 t
  WHERE t.image_id = c.image_id AND t.y = least(greatest(c.y // 2 + sy * (c.y % 2 * 2 - 1), 0), t.height - 1)
    AND t.x = least(greatest(c.x // 2 + sx * (c.x % 2 * 2 - 1), 0), t.width - 1) GROUP BY c.image_id, c.y, c.x, c.c"""


@query("noise_reduction", fx.sql(rounded(
    "SELECT image_id, y, x, c + cr AS r, (c - 0.2126 * (c + cr) - 0.0722 * (c + cb)) / 0.7152 AS g, c + cb AS b FROM up", 5), "pixels", "frames", also=_DENOISE))
def noise_reduction(spark, sf):
    px, f = fx.pixels(spark, sf), fx.frames(spark, sf)
    return out(FI.noise_reduction(px, M.noise_profile(px, f).withColumn("strength", F.lit(0.5))), 5)
