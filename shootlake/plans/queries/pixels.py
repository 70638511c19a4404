"""Registered queries: point grading over pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.functions import colour as K
from shootlake.operators import grading as G
from shootlake.plans import fixtures as fx
from shootlake.plans.registry import query

RGB = G.RGB
LUM = "(0.2126729 * r + 0.7151522 * g + 0.072175 * b)"
LUM_R = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def enc(v):
    return f"(CASE WHEN {v} <= 0.0031308 THEN 12.92 * {v} ELSE 1.055 * power({v}, 1 / 2.4) - 0.055 END)"


def dec(v):
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE power(({v} + 0.055) / 1.055, 2.4) END)"


def rounded(source, places=6, cols=RGB, keys="image_id, y, x"):
    return f"SELECT {keys}, " + ", ".join(f"round({c}, {places}) AS {c}" for c in cols) + f" FROM ({source})"


def out(df, places=6, cols=RGB, keys=("image_id", "y", "x")):
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.round(c, places).alias(c) for c in cols])


def each(expr):
    """The same SQL expression over r, g and b; `{c}` is the channel."""
    return ", ".join(f"{expr.format(c=c)} AS {c}" for c in RGB)


@query("frame_extents", fx.sql("SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY 1", "pixels"))
def frame_extents(spark, sf):
    return G.extents(fx.pixels(spark, sf)).select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query("exposure", fx.sql(rounded("SELECT image_id, y, x, " + each("{c} * power(2, image_id % 5 / 2 - 1)") + " FROM pixels"), "pixels"))
def exposure(spark, sf):
    return out(G.exposure(fx.pixels(spark, sf), F.expr("image_id % 5 / 2 - 1")))


_KELVIN = "CASE image_id % 4 WHEN 0 THEN 0 WHEN 1 THEN as_shot_kelvin WHEN 2 THEN 2000 + 100 * (image_id % 3) ELSE 9000 END"
_TINT = "(image_id % 3 - 1) * 5"


def _poly(t, c):
    return f"((({c[0]} * {t} + {c[1]}) * {t} + {c[2]}) * {t} + {c[3]})"


def _kx(k):
    return f"CASE WHEN {k} <= 4000 THEN -0.2661239e9 / power({k}, 3) - 0.234358e6 / power({k}, 2) + 0.8776956e3 / {k} + 0.179910 ELSE -3.0258469e9 / power({k}, 3) + 2.1070379e6 / power({k}, 2) + 0.2226347e3 / {k} + 0.240390 END"


def _ky(k, x):
    return f"CASE WHEN {k} <= 2222 THEN {_poly(x, (-1.1063814, -1.34811020, 2.18555832, -0.20219683))} WHEN {k} <= 4000 THEN {_poly(x, (-0.9549476, -1.37418593, 2.09137015, -0.16748867))} ELSE {_poly(x, (3.0817580, -5.8733867, 3.75112997, -0.37001483))} END"


def _mat(m, v):
    return [" + ".join(f"({m[i][j]} * {v[j]})" for j in range(3)) for i in range(3)]


_WB_PARAMS = {
    "asked": f"SELECT image_id, as_shot_kelvin, CAST({_KELVIN} AS DOUBLE) AS k, CAST({_TINT} AS DOUBLE) AS t FROM frames",
    "chroma": f"SELECT *, CASE WHEN k = 0 THEN 0.3127 ELSE {_kx('nullif(k, 0)')} END AS cx, {_kx('as_shot_kelvin')} AS ax FROM asked",
    "chroma2": f"SELECT *, least(greatest((CASE WHEN k = 0 THEN 0.3290 ELSE {_ky('k', 'cx')} END) * power(2, t * 0.025), 0.05), 0.9) AS cy, {_ky('as_shot_kelvin', 'ax')} AS ay FROM chroma",
    "whites": "SELECT *, cx / cy AS sx, (1 - cx - cy) / cy AS sz, ax / ay AS dx, (1 - ax - ay) / ay AS dz FROM chroma2",
    "ratios": "SELECT *, " + ", ".join(f"({d}) / ({s}) AS q{i}" for i, (d, s) in enumerate(zip(_mat(K.BRADFORD, ("dx", "1", "dz")), _mat(K.BRADFORD, ("sx", "1", "sz"))))) + " FROM whites",
}


def _cols(m, v, names):
    return ", ".join(f"{e} AS {n}" for e, n in zip(_mat(m, v), names))


@query("white_balance", fx.sql(rounded(f"""
  SELECT image_id, y, x, CASE WHEN k = 0 AND t = 0 THEN r ELSE r2 END AS r, CASE WHEN k = 0 AND t = 0 THEN g ELSE g2 END AS g,
         CASE WHEN k = 0 AND t = 0 THEN b ELSE b2 END AS b FROM (
  SELECT *, {_cols(K.XYZ_TO_RGB, ('u0', 'u1', 'u2'), ('r2', 'g2', 'b2'))} FROM (
  SELECT *, {_cols(K.BRADFORD_INVERSE, ('l0 * q0', 'l1 * q1', 'l2 * q2'), ('u0', 'u1', 'u2'))} FROM (
  SELECT *, {_cols(K.BRADFORD, ('x0', 'x1', 'x2'), ('l0', 'l1', 'l2'))} FROM (
  SELECT *, {_cols(K.RGB_TO_XYZ, ('r', 'g', 'b'), ('x0', 'x1', 'x2'))} FROM pixels JOIN ratios USING (image_id)))))"""),
    "pixels", "frames", also=_WB_PARAMS))
def white_balance(spark, sf):
    p = fx.frames(spark, sf).select("image_id", "as_shot_kelvin", F.expr(f"cast({_KELVIN} as double)").alias("kelvin"),
                                    F.expr(f"cast({_TINT} as double)").alias("tint"))
    m = G.white_matrix(p).drop("as_shot_kelvin", "kelvin", "tint")
    return out(G.apply_matrix(fx.pixels(spark, sf).join(m, "image_id")))


@query("kelvin_chromaticity", fx.sql("SELECT image_id, round(ax, 6) AS cx, round(ay, 6) AS cy FROM chroma2", "frames", also=_WB_PARAMS))
def kelvin_chromaticity(spark, sf):
    f = fx.frames(spark, sf).withColumn("cx", K.kelvin_x(F.col("as_shot_kelvin")))
    return f.select("image_id", F.round("cx", 6).alias("cx"), F.round(K.kelvin_y(F.col("as_shot_kelvin"), F.col("cx")), 6).alias("cy"))


_BANDS = "[-1.5, -0.5, 0.25, image_id % 4 / 2, 0.75, -0.25, 1.0]"


@query("tone", fx.sql(rounded(f"""
  SELECT image_id, y, x, {each('{c} * power(2, coalesce(bands[i + 1] * (1 - s) + bands[i + 2] * s, 0))')} FROM (
  SELECT *, p * p * (3 - 2 * p) AS s FROM (
  SELECT *, (e + 6) / 2 - i AS p FROM (
  SELECT *, CAST(least(floor((e + 6) / 2), 5) AS BIGINT) AS i FROM (
  SELECT *, CASE WHEN {LUM} > 0 THEN least(greatest(log2({LUM} / 0.18), -6), 6) END AS e, CAST({_BANDS} AS DOUBLE[]) AS bands FROM pixels))))"""), "pixels"))
def tone(spark, sf):
    bands = F.array(*[F.expr(f"cast({v} as double)") for v in _BANDS.strip("[]").split(", ")])
    return out(G.tone(fx.pixels(spark, sf), bands))


_PIVOT = "0.3 + image_id % 4 / 10"


@query("contrast", fx.sql(rounded(f"SELECT image_id, y, x, " + each(
    f"CASE WHEN {{c}} > 0 AND image_id % 3 <> 2 THEN p * power({{c}} / p, 0.5 + image_id % 3 / 4) ELSE {{c}} END")
    + f" FROM (SELECT *, greatest({dec(f'({_PIVOT})')}, 1e-4) AS p FROM pixels)"), "pixels"))
def contrast(spark, sf):
    slope = F.expr("CASE WHEN image_id % 3 = 2 THEN 1D ELSE 0.5D + image_id % 3 / 4 END")
    return out(G.contrast(fx.pixels(spark, sf), slope, F.expr(_PIVOT)))


@query("color_subtract", fx.sql(rounded("SELECT image_id, y, x, 0.9 - r AS r, image_id % 5 / 4 - g AS g, 1.1 - b AS b FROM pixels"), "pixels"))
def color_subtract(spark, sf):
    return out(G.color_subtract(fx.pixels(spark, sf), (F.lit(0.9), F.expr("image_id % 5 / 4"), F.lit(1.1))))


# Curve points by channel, as flat x y lists; both sides read them.
_CURVES = {"r": [0.0, 0.0, 0.25, 0.2, 0.5, 0.55, 0.75, 0.6, 1.0, 1.0], "g": [0.1, 0.0, 0.8, 1.0],
           "b": [0.0, 0.1, 0.4, 0.5, 0.6, 0.3, 1.0, 0.9], "m": [0.0, 0.0, 0.5, 0.6, 1.0, 1.0]}


def _segments(name):
    pts = _CURVES[name]
    return (f"SELECT '{name}' AS ch, i, xs, w, y0, y1, "
            "CASE WHEN pl IS NULL THEN sl WHEN pl * sl <= 0 THEN 0 ELSE 3 * (pw + w) / ((2 * w + pw) / pl + (w + 2 * pw) / sl) END AS m0, "
            "CASE WHEN nl IS NULL THEN sl WHEN nl * sl <= 0 THEN 0 ELSE 3 * (w + nw) / ((2 * nw + w) / sl + (nw + 2 * w) / nl) END AS m1 FROM ("
            "SELECT *, lag(sl) OVER (ORDER BY i) AS pl, lag(w) OVER (ORDER BY i) AS pw, lead(sl) OVER (ORDER BY i) AS nl, lead(w) OVER (ORDER BY i) AS nw FROM ("
            f"SELECT i, p[2 * i - 1] AS xs, p[2 * i + 1] - p[2 * i - 1] AS w, p[2 * i] AS y0, p[2 * i + 2] AS y1, (p[2 * i + 2] - p[2 * i]) / (p[2 * i + 1] - p[2 * i - 1]) AS sl "
            f"FROM (SELECT CAST({pts} AS DOUBLE[]) AS p), range(1, {len(pts) // 2}) t(i)))")


def _eval(v):
    """Hermite form, from the segment columns joined in."""
    t = f"((least(greatest({v}, xs), xs + w) - xs) / w)"
    return (f"least(greatest((2 * power({t}, 3) - 3 * power({t}, 2) + 1) * y0 + (power({t}, 3) - 2 * power({t}, 2) + {t}) * w * m0 "
            f"+ (3 * power({t}, 2) - 2 * power({t}, 3)) * y1 + (power({t}, 3) - power({t}, 2)) * w * m1, 0), 1)")


def _ends(name):
    pts = _CURVES[name]
    return pts[0], pts[-2], len(pts) // 2 - 1


_CHAN = {
    "segments": " UNION ALL ".join(_segments(n) for n in _CURVES),
    "flat": " UNION ALL ".join(f"SELECT image_id, y, x, '{c}' AS ch, {c} AS v, least(greatest({c}, 0), 1) AS c FROM pixels" for c in RGB),
    "once": f"SELECT f.*, {dec('(' + _eval(enc('f.c')) + ')')} AS u FROM flat f JOIN segments s ON s.ch = f.ch "
            f"AND (({enc('f.c')} >= xs OR i = 1) AND ({enc('f.c')} < xs + w OR i = (SELECT max(i) FROM segments z WHERE z.ch = s.ch)))",
    "twice": f"SELECT o.image_id, o.y, o.x, o.ch, {dec('(' + _eval(enc('o.u')) + ')')} + v - c AS v FROM once o JOIN segments s ON s.ch = 'm' "
             f"AND (({enc('o.u')} >= xs OR i = 1) AND ({enc('o.u')} < xs + w OR i = (SELECT max(i) FROM segments z WHERE z.ch = 'm')))",
}


@query("curves", fx.sql("SELECT image_id, y, x, " + ", ".join(
        f"round(max(CASE WHEN ch = '{c}' THEN v END), 5) AS {c}" for c in RGB) + " FROM twice GROUP BY 1, 2, 3", "pixels", also=_CHAN))
def curves(spark, sf):
    points = {f"curve_{k}": F.array(*[F.lit(v) for v in vs]) for k, vs in _CURVES.items()}
    tables = G.curve_tables(fx.frames(spark, sf).select("image_id"), points)
    return out(G.curves(fx.pixels(spark, sf).join(tables, "image_id"), ("curve_r", "curve_g", "curve_b"), "curve_m"), 5)


@query("srgb_transfer", fx.sql(f"SELECT image_id, y, x, round({enc('r')}, 6) AS encoded, round({dec('g')}, 6) AS decoded FROM pixels", "pixels"))
def srgb_transfer(spark, sf):
    return fx.pixels(spark, sf).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"),
                                       F.round(K.encode(F.col("r")), 6).alias("encoded"), F.round(K.decode(F.col("g")), 6).alias("decoded"))


def display_sql(source, transfer=True):
    v = "least(greatest(t + s * (({c} * t / l) - t), -1), 2)"
    body = f"""
      SELECT image_id, y, x, {each('CASE WHEN l > 0 THEN ' + v + ' ELSE 0 END')} FROM (
      SELECT *, greatest(least(1, {", ".join(f"CASE WHEN {c} * t / l > t THEN (1 - t) / ({c} * t / l - t) WHEN {c} * t / l < t THEN t / (t - {c} * t / l) ELSE 1 END" for c in RGB)}), 0) AS s FROM (
      SELECT *, 1.6 * greatest(l, 0) * (1 + 8.75 * 1.6 * greatest(l, 0)) / (1 + 1.46 * 1.6 * greatest(l, 0) + 8.75 * power(1.6 * greatest(l, 0), 2)) AS t FROM (
      SELECT *, CASE WHEN {LUM} > 0 THEN {LUM} END AS l FROM ({source}))))"""
    if not transfer:
        return body
    return f"SELECT image_id, y, x, {each('CASE WHEN {c} > 0 THEN ' + enc('{c}') + ' ELSE 0 END')} FROM ({body})"


@query("display_tone", fx.sql(rounded(display_sql("SELECT image_id, y, x, r * 2 AS r, g - 0.3 AS g, b FROM pixels", False)), "pixels"))
def display_tone(spark, sf):
    px = fx.pixels(spark, sf).withColumns({"r": F.col("r") * 2, "g": F.col("g") - 0.3})
    return out(G.display_tone(px))


@query("display_encoded", fx.sql(rounded(display_sql("SELECT * FROM pixels"), 5), "pixels"))
def display_encoded(spark, sf):
    return out(G.to_display(fx.pixels(spark, sf)), 5)


@query("quantised_export", fx.sql("SELECT image_id, y, x, " + ", ".join(
    f"CAST(floor(least(greatest({c} * 1.2 - 0.1, 0), 1) * 255 + 0.5) AS BIGINT) AS {c}8, CAST(floor(least(greatest({c} * 1.2 - 0.1, 0), 1) * 65535 + 0.5) AS BIGINT) AS {c}16" for c in RGB) + " FROM pixels", "pixels"))
def quantised_export(spark, sf):
    px = fx.pixels(spark, sf)
    return px.select(*[F.col(k).cast("long").alias(k) for k in ("image_id", "y", "x")],
                     *[K.quantised(F.col(c) * 1.2 - 0.1, n).cast("long").alias(f"{c}{n}") for c in RGB for n in (8, 16)])


_U = "18446744073709551616::UHUGEINT"


def _mul(v, k):
    return f"CAST((CAST({v} AS UHUGEINT) * {k}::UHUGEINT) % {_U} AS UBIGINT)"


def _grain_sql(source, seed, k=""):
    """Steps of the grain hash over the pixels of `source`; the last has the noise as n."""
    return {
        f"cells{k}": f"SELECT *, {_mul('floor(y / 1.5)', 0x6EED0E9DA4D94A4F)} AS gy, {_mul('floor(x / 1.5)', 0x517CC1B727220A95)} AS gx, CAST({seed} AS UBIGINT) AS seed FROM {source}",
        f"h0{k}": f"SELECT *, CAST((CAST(xor(xor(seed, gy), gx) AS UHUGEINT) + {0x9E3779B97F4A7C15}::UHUGEINT) % {_U} AS UBIGINT) AS h FROM cells{k}",
        f"h1{k}": f"SELECT * REPLACE ({_mul('xor(h, h >> 30)', 0xBF58476D1CE4E5B9)} AS h) FROM h0{k}",
        f"h2{k}": f"SELECT * REPLACE ({_mul('xor(h, h >> 27)', 0x94D049BB133111EB)} AS h) FROM h1{k}",
        f"h3{k}": f"SELECT *, ((xor(h, h >> 31) >> 40) / 16777215.0 - 0.5) * 0.6 * 0.16 * (0.35 + 0.65 * (1 - {LUM_R})) AS n FROM h2{k}",
    }


_GRAIN = _grain_sql("pixels", "image_id * 7919 + 17")
_GRAINY = each("least(greatest({c} + n, 0), 1)")


@query("film_grain", fx.sql(rounded(f"SELECT image_id, y, x, {_GRAINY} FROM h3"), "pixels", also=_GRAIN))
def film_grain(spark, sf):
    return out(G.grain(fx.pixels(spark, sf), F.lit(0.6), F.lit(1.5), F.expr("image_id * 7919L + 17")))


@query("film_grain_twice", fx.sql(rounded(f"SELECT image_id, y, x, {_GRAINY} FROM h3b"), "pixels", also={
    **_GRAIN, "once": f"SELECT image_id, y, x, {_GRAINY} FROM h3", **_grain_sql("once", "xor(image_id * 7919 + 17, 2654435769)", "b")}))
def film_grain_twice(spark, sf):
    """A recipe's second grainy film node takes the seed with its ordinal mixed in."""
    seed = F.expr("image_id * 7919L + 17")
    once = G.grain(fx.pixels(spark, sf), F.lit(0.6), F.lit(1.5), G.film_seed(seed, 0))
    return out(G.grain(once, F.lit(0.6), F.lit(1.5), G.film_seed(seed, 1)))


@query("blend", fx.sql(rounded("""
  SELECT image_id, y, x, """ + each("{c} * 2 + ((1 - {c}) - {c} * 2) * (image_id % 4 / 4)") + " FROM pixels"), "pixels"))
def blend(spark, sf):
    px = fx.pixels(spark, sf)
    a, b = G.exposure(px, F.lit(1.0)), G.color_subtract(px, (F.lit(1.0),) * 3)
    return out(G.blend(a, b, F.expr("image_id % 4 / 4")))


@query("mismatched_branches", fx.sql("""
  SELECT image_id, width, height, height - CASE WHEN image_id % 2 = 0 AND height > 8 THEN 8 ELSE 0 END AS height_b FROM frames WHERE image_id % 2 = 0 AND height > 8""", "frames"))
def mismatched_branches(spark, sf):
    px = fx.pixels(spark, sf)
    tall = G.extents(px).select("image_id", "height")
    short = px.join(tall, "image_id").where("image_id % 2 = 1 OR height <= 8 OR y < height - 8")
    return G.mismatched_extents(px, short).select("image_id", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "height_b")])


@query("quality_psnr", fx.sql("""
  SELECT image_id, round(10 * log10(1 / avg((power(r * 0.1, 2) + power(g * 0.1, 2) + power(b * 0.1, 2)) / 3)), 5) AS psnr FROM pixels GROUP BY 1""", "pixels"))
def quality_psnr(spark, sf):
    px = fx.pixels(spark, sf)
    dim = px.withColumns({c: F.col(c) * 0.9 for c in RGB})
    return G.quality_against(dim, px).select("image_id", F.round("psnr", 5).alias("psnr"))


@query("quality_flat_field", fx.sql(f"""
  SELECT image_id, round(stddev_pop(l), 6) AS luma, round(stddev_pop(r - l), 6) AS chroma
  FROM (SELECT image_id, r, {LUM_R} AS l FROM pixels JOIN frames USING (image_id) WHERE y >= 2 AND y < height // 4 - 2 AND x >= 2 AND x < width - 2)
  GROUP BY 1""", "pixels", "frames"))
def quality_flat_field(spark, sf):
    q = G.flat_deviation(fx.pixels(spark, sf), fx.frames(spark, sf), 2)
    return q.select("image_id", F.round("luma", 6).alias("luma"), F.round("chroma", 6).alias("chroma"))


@query("quality_edge_height", fx.sql("""
  SELECT a.image_id, round(avg(abs(b.r - a.r)), 6) AS edge_height
  FROM pixels a JOIN pixels b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 8 JOIN frames f ON f.image_id = a.image_id
  WHERE a.y = height * 5 // 8 AND (a.x + 4) % 15 = 0 AND a.x + 4 >= 15 AND a.x + 8 < width GROUP BY 1""", "pixels", "frames"))
def quality_edge_height(spark, sf):
    q = G.edge_height(fx.pixels(spark, sf), fx.frames(spark, sf), 15)
    return q.select("image_id", F.round("edge_height", 6).alias("edge_height"))


# One camera per frame: a plausible D65 matrix, bent a little by the frame number; every fifth is degenerate.
_XYZ_CAM = [0.8, -0.25, -0.08, -0.45, 1.25, 0.2, -0.1, 0.2, 0.6]


def _cam(i):
    if i in (0, 4, 8):
        return f"({_XYZ_CAM[i]} + image_id % 7 / 100)"
    return f"{_XYZ_CAM[i]}"


_GAINS = ("1.5 + image_id % 10 / 10", "CAST(1 AS DOUBLE)", "1.2 + image_id % 6 / 10")


def cameras(spark, sf):
    degenerate = F.expr("image_id % 5 = 4")
    m = F.array(*[F.when(degenerate & F.lit(i < 3), F.lit(0.0)).otherwise(F.expr(f"cast({_cam(i)} as double)")) for i in range(9)])
    return fx.frames(spark, sf).select("image_id", m.alias("xyz_to_camera"),
                                       *[F.expr(f"cast({g} as double)").alias(f"gain_{c}") for g, c in zip(_GAINS, RGB)])


def _inverse_sql(p, out):
    def e(i, j):
        return f"{p}{i % 3}{j % 3}"
    det = f"nullif({e(0,0)} * ({e(1,1)} * {e(2,2)} - {e(1,2)} * {e(2,1)}) - {e(0,1)} * ({e(1,0)} * {e(2,2)} - {e(1,2)} * {e(2,0)}) + {e(0,2)} * ({e(1,0)} * {e(2,1)} - {e(1,1)} * {e(2,0)}), 0)"
    return ", ".join(f"({e(j+1,i+1)} * {e(j+2,i+2)} - {e(j+1,i+2)} * {e(j+2,i+1)}) / {det} AS {out}{i}{j}" for i in range(3) for j in range(3))


_CAMERA = {
    "cam": "SELECT image_id, image_id % 5 <> 4 AS ok, " + ", ".join(
        f"CAST({('CASE WHEN image_id % 5 = 4 THEN 0 ELSE ' + _cam(i) + ' END') if i < 3 else _cam(i)} AS DOUBLE) AS e{i // 3}{i % 3}" for i in range(9))
        + ", " + ", ".join(f"CAST({g} AS DOUBLE) AS gain_{c}" for g, c in zip(_GAINS, RGB)) + " FROM frames",
    "prod": "SELECT *, " + ", ".join(f"e{i}0 * {K.RGB_TO_XYZ[0][j]} + e{i}1 * {K.RGB_TO_XYZ[1][j]} + e{i}2 * {K.RGB_TO_XYZ[2][j]} AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM cam",
    "norm": "SELECT * REPLACE (" + ", ".join(f"p{i}{j} / nullif(p{i}0 + p{i}1 + p{i}2, 0) AS p{i}{j}" for i in range(3) for j in range(3)) + ") FROM prod",
    "inv": f"SELECT *, {_inverse_sql('p', 'c')} FROM norm",
}


@query("camera_matrices", fx.sql("SELECT image_id, ok AS matrix_ok, " + ", ".join(
    f"round(c{i}{j}, 6) AS c{i}{j}" for i in range(3) for j in range(3)) + " FROM inv", "frames", also=_CAMERA))
def camera_matrices(spark, sf):
    m = G.camera_matrix(cameras(spark, sf))
    return m.select("image_id", "matrix_ok", *[F.round(f"c{i}{j}", 6).alias(f"c{i}{j}") for i in range(3) for j in range(3)])


@query("camera_to_linear", fx.sql(rounded(f"""
  SELECT image_id, y, x, {", ".join(f"c{i}0 * br + c{i}1 * bg + c{i}2 * bb AS {c}" for i, c in enumerate(RGB))} FROM (
  SELECT * REPLACE ({", ".join(f"b{c} + least(greatest(({c} - 0.97) / 0.03, 0), 1) * greatest(peak - b{c}, 0) AS b{c}" for c in RGB)}) FROM (
  SELECT *, greatest(br, bg, bb) AS peak FROM (
  SELECT image_id, y, x, {", ".join(f"p.{c} * 1.1 AS {c}, p.{c} * 1.1 * gain_{c} AS b{c}" for c in RGB)}, {", ".join(f"c{i}{j}" for i in range(3) for j in range(3))}
  FROM pixels p JOIN inv USING (image_id) WHERE ok)))"""), "pixels", "frames", also=_CAMERA))
def camera_to_linear(spark, sf):
    px = fx.pixels(spark, sf).withColumns({c: F.col(c) * 1.1 for c in RGB})
    m = G.camera_matrix(cameras(spark, sf)).where("matrix_ok").drop("xyz_to_camera")
    return out(G.camera_to_linear(px.join(m, "image_id")))


@query("as_shot_kelvin", fx.sql(f"""
  SELECT image_id, CASE WHEN k BETWEEN 1500 AND 25000 THEN round(k, 4) END AS kelvin FROM (
  SELECT image_id, 449 * power(n, 3) + 3525 * n * n + 6823.3 * n + 5520.33 AS k FROM (
  SELECT image_id, (x0 / s - 0.3320) / nullif(0.1858 - x1 / s, 0) AS n FROM (
  SELECT *, x0 + x1 + x2 AS s FROM (
  SELECT image_id, {", ".join(f"v{i}0 / gain_r + v{i}1 / gain_g + v{i}2 / gain_b AS x{i}" for i in range(3))} FROM (
  SELECT *, {_inverse_sql('e', 'v')} FROM cam)))))""", "frames", also=_CAMERA))
def as_shot_kelvin(spark, sf):
    return G.as_shot_kelvin(cameras(spark, sf)).select("image_id", F.round("kelvin", 4).alias("kelvin"))


@query("scale_factors", fx.sql("""
  SELECT image_id, round(sqrt(width * height / full_pixels), 6) AS scale,
         round(0.35 * least(greatest(2 * sqrt(width * height / full_pixels) - 1, 0), 1), 6) AS strength FROM (
    SELECT * REPLACE (full_pixels * (1 + image_id % 3) // 4 AS full_pixels) FROM frames)""", "frames"))
def scale_factors(spark, sf):
    from shootlake.operators import filters
    f = fx.frames(spark, sf).withColumn("full_pixels", F.expr("full_pixels * (1 + image_id % 3) div 4"))
    scale = filters.scale_ratio(F.col("width") * F.col("height"), F.col("full_pixels"))
    return f.select("image_id", F.round(scale, 6).alias("scale"),
                    F.round(filters.scaled_strength(F.lit(0.35), scale), 6).alias("strength"))
