"""Point grading: every operator maps `r, g, b` of a pixel row to new ones without a shuffle.

Parameters are Columns: literals where one recipe serves all photos, joined columns where each photo
has its own. Shared parts of a formula get a column of their own, so they are computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.functions import bits
from shootlake.functions import colour as K
from shootlake.functions.binding import let

RGB = ("r", "g", "b")


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def exposure(px: DataFrame, ev: Column) -> DataFrame:
    return px.withColumn("_k", F.pow(F.lit(2.0), ev)).withColumns({c: F.col(c) * F.col("_k") for c in RGB}).drop("_k")


def white_matrix(params: DataFrame, kelvin: str = "kelvin", tint: str = "tint", as_shot: str = "as_shot_kelvin") -> DataFrame:
    """Nine columns `w00`..`w22` per row: adaptation from the chosen white to the frame's own neutral.

    A kelvin of 0 or null means as shot; with a tint of 0 too the matrix is the identity.
    """
    k, t = F.coalesce(F.col(kelvin), F.lit(0.0)), F.coalesce(F.col(tint), F.lit(0.0))
    base = params.withColumns({"_k": k, "_t": t})
    base = base.withColumn("_x", F.when(F.col("_k") == 0, F.lit(K.D65_XY[0])).otherwise(
        K.kelvin_x(F.when(F.col("_k") != 0, F.col("_k")))))
    base = base.withColumn("_y", K.clamp(
        F.when(F.col("_k") == 0, F.lit(K.D65_XY[1])).otherwise(K.kelvin_y(F.col("_k"), F.col("_x")))
        * F.pow(F.lit(2.0), F.col("_t") * 0.025), 0.05, 0.9))
    base = base.withColumn("_ax", K.kelvin_x(F.col(as_shot)))
    base = base.withColumn("_ay", K.kelvin_y(F.col(as_shot), F.col("_ax")))

    def xyz(x: Column, y: Column) -> list[Column]:
        return [x / y, F.lit(1.0), (F.lit(1.0) - x - y) / y]

    source = xyz(F.col("_x"), F.col("_y"))
    target = [F.when(F.col("_ax").isNull(), F.lit(d)).otherwise(v)
              for d, v in zip(K.D65_XYZ, xyz(F.col("_ax"), F.col("_ay")))]
    base = base.withColumns({f"_s{i}": K.dot(row, target) / K.dot(row, source) for i, row in enumerate(K.BRADFORD)})
    # fixed 3x3 products on either side of the diagonal of cone ratios
    before = [[sum(K.BRADFORD[i][k] * K.RGB_TO_XYZ[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    after = [[sum(K.XYZ_TO_RGB[i][k] * K.BRADFORD_INVERSE[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    none = (F.col("_k") == 0) & (F.col("_t") == 0)
    base = base.withColumns({
        f"w{i}{j}": F.when(none, F.lit(1.0 if i == j else 0.0)).otherwise(
            K.dot([after[i][m] * before[m][j] for m in range(3)], [F.col(f"_s{m}") for m in range(3)]))
        for i in range(3) for j in range(3)})
    return base.drop("_k", "_t", "_x", "_y", "_ax", "_ay", "_s0", "_s1", "_s2")


def apply_matrix(px: DataFrame, prefix: str = "w") -> DataFrame:
    r, g, b = _rgb()
    rows = {c: r * F.col(f"{prefix}{i}0") + g * F.col(f"{prefix}{i}1") + b * F.col(f"{prefix}{i}2") for i, c in enumerate(RGB)}
    return px.withColumns(rows).drop(*[f"{prefix}{i}{j}" for i in range(3) for j in range(3)])


def tone(px: DataFrame, bands: Column) -> DataFrame:
    """Seven-band equaliser; a luminance of 0 or less is left alone."""
    lit = px.withColumn("_y", K.luminance(*_rgb())).withColumn("_k", F.pow(F.lit(2.0), K.tone_ev(F.col("_y"), bands)))
    return lit.withColumns({c: F.col(c) * F.col("_k") for c in RGB}).drop("_y", "_k")


def contrast(px: DataFrame, slope: Column, pivot: Column) -> DataFrame:
    return px.withColumns({c: K.contrast(F.col(c), slope, pivot) for c in RGB})


def color_subtract(px: DataFrame, picked: tuple[Column, Column, Column]) -> DataFrame:
    return px.withColumns({c: p - F.col(c) for c, p in zip(RGB, picked)})


def curve_tables(params: DataFrame, points: dict[str, Column]) -> DataFrame:
    """Add, per parameter row, each curve's segments as an array of (x, w, y0, y1, m0, m1).

    A curve's points are one flat array x0 y0 x1 y1 ... Tangents are the monotone cubic's, worked
    out here once per photo and not once per pixel.
    """
    df = params
    for name, flat in points.items():
        df = df.withColumn("_p", flat).withColumn("_n", F.floor(F.size("_p") / 2).cast("int"))
        df = df.withColumns({
            "_x": F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.element_at("_p", i * 2 - 1)),
            "_y": F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.element_at("_p", i * 2))})
        inner = F.sequence(F.lit(1), F.col("_n") - 1)
        df = df.withColumns({
            "_w": F.transform(inner, lambda i: F.element_at("_x", i + 1) - F.element_at("_x", i)),
            "_r": F.transform(inner, lambda i: F.element_at("_y", i + 1) - F.element_at("_y", i))})
        df = df.withColumn("_s", F.zip_with("_r", "_w", lambda r, w: r / F.greatest(w, F.lit(1e-4))))
        df = df.withColumn("_m", F.transform(F.sequence(F.lit(1), F.col("_n")), _tangent))
        df = df.withColumn(name, F.transform(inner, lambda i: F.struct(
            F.element_at("_x", i).alias("x"), F.greatest(F.element_at("_w", i), F.lit(1e-4)).alias("w"),
            F.element_at("_y", i).alias("y0"), F.element_at("_y", i + 1).alias("y1"),
            F.element_at("_m", i).alias("m0"), F.element_at("_m", i + 1).alias("m1"))))
    return df.drop("_p", "_n", "_x", "_y", "_w", "_r", "_s", "_m")


def _tangent(i: Column) -> Column:
    """End slopes at the ends; inside, the weighted harmonic mean, or flat at a turning point."""
    before, after = F.get("_s", i - 2), F.get("_s", i - 1)
    wide, near = F.get("_w", i - 2), F.get("_w", i - 1)
    mean = (wide + near) * 3 / ((near * 2 + wide) / F.nullif(before, F.lit(0.0)) + (near + wide * 2) / F.nullif(after, F.lit(0.0)))
    return F.when(before.isNull(), after).when(after.isNull(), before).when(before * after <= 0, F.lit(0.0)).otherwise(mean)


def _through(px: DataFrame, value: str, table: str) -> DataFrame:
    """`value`, linear in 0..1, through one curve on its encoded signal; flat outside the points."""
    px = px.withColumn("_e", K.encode(F.col(value)))
    px = px.withColumn("_at", F.greatest(F.size(F.filter(F.col(table), lambda s: s["x"] <= F.col("_e"))), F.lit(1)))
    px = px.withColumn("_g", F.element_at(F.col(table), F.col("_at")))
    px = px.withColumn("_u", K.clamp((F.col("_e") - F.col("_g.x")) / F.col("_g.w"), 0.0, 1.0))
    u, g = F.col("_u"), lambda f: F.col(f"_g.{f}")
    rise = u * u * (F.lit(3.0) - u * 2)
    bend = g("w") * u * (F.lit(1.0) - u) * ((F.lit(1.0) - u) * g("m0") - u * g("m1"))
    px = px.withColumn("_e", K.clamp(g("y0") + (g("y1") - g("y0")) * rise + bend, 0.0, 1.0))
    return px.withColumn(value, K.decode(F.col("_e"))).drop("_e", "_at", "_g", "_u")


def curves(px: DataFrame, tables: tuple[str, str, str], master: str) -> DataFrame:
    """Monotone curves per channel, then one over all; what lies below 0 or above 1 rides along.

    `tables` and `master` name columns made by `curve_tables`.
    """
    for c, table in zip(RGB, tables):
        px = px.withColumn("_v", K.clamp(F.col(c), 0.0, 1.0)).withColumn("_o", F.col(c) - F.col("_v"))
        px = _through(_through(px, "_v", table), "_v", master)
        px = px.withColumn(c, F.col("_v") + F.col("_o")).drop("_v", "_o")
    return px


def display_tone(px: DataFrame) -> DataFrame:
    """Scene to display light: lift the luminance, then desaturate only as far as 0..1 asks."""
    lit = px.withColumn("_y", K.luminance(*_rgb()))
    lit = lit.withColumn("_t", K.display_curve(F.col("_y"))).withColumn("_k", F.col("_t") / F.when(F.col("_y") > 0, F.col("_y")))
    lit = lit.withColumns({f"_d{c}": F.col(c) * F.col("_k") - F.col("_t") for c in RGB})

    def room(d: Column) -> Column:
        return F.when(d > 0, (F.lit(1.0) - F.col("_t")) / d).when(d < 0, F.col("_t") / -d).otherwise(F.lit(1.0))

    lit = lit.withColumn("_s", F.greatest(F.least(F.lit(1.0), *[room(F.col(f"_d{c}")) for c in RGB]), F.lit(0.0)))
    return lit.withColumns({c: F.coalesce(F.col("_t") + F.col("_s") * F.col(f"_d{c}"), F.lit(0.0)) for c in RGB}).drop(
        "_y", "_t", "_k", "_s", "_dr", "_dg", "_db")


def to_display(px: DataFrame) -> DataFrame:
    return display_tone(px).withColumns({c: K.encode_display(F.col(c)) for c in RGB})


def quantise(px: DataFrame, bits_per_channel: int = 8) -> DataFrame:
    return px.withColumns({c: K.quantised(F.col(c), bits_per_channel) for c in RGB})


def film_lut(px: DataFrame, luts: DataFrame, strength: Column, lut_id: str = "lut_id") -> DataFrame:
    """Trilinear look-up mixed in by strength; `luts` has one row per LUT with its lattice as arrays.

    A lattice is at most 65 cubed triplets, so a LUT is one small row. The join carries it to the
    pixels, by broadcast while all LUTs together are small, and no pixel row is multiplied. Pixels that
    name no LUT stay as they are; those that name an absent one are refused (see `absent_luts`).
    """
    joined = px.join(luts, lut_id, "left").where(F.col(lut_id).isNull() | F.col("size").isNotNull())
    for i, c in enumerate(RGB):
        lo, hi = F.element_at("dmin", i + 1), F.element_at("dmax", i + 1)
        joined = joined.withColumn(f"_n{c}", K.clamp((F.col(c) - lo) / (hi - lo), 0.0, 1.0) * (F.col("size") - 1))
        joined = joined.withColumn(f"_i{c}", F.least(F.floor(F.col(f"_n{c}")), F.col("size") - 2).cast("int"))
        joined = joined.withColumn(f"_f{c}", F.col(f"_n{c}") - F.col(f"_i{c}"))
    joined = joined.withColumn("_at", (F.col("_ib") * F.col("size") + F.col("_ig")) * F.col("size") + F.col("_ir") + 1)
    near = {0: lambda c: F.lit(1.0) - F.col(f"_f{c}"), 1: lambda c: F.col(f"_f{c}")}
    corners = [(dr, dg, db) for db in (0, 1) for dg in (0, 1) for dr in (0, 1)]
    joined = joined.withColumns({f"_w{dr}{dg}{db}": near[dr]("r") * near[dg]("g") * near[db]("b") for dr, dg, db in corners})
    out = {}
    for i, c in enumerate(RGB):
        total = None
        for dr, dg, db in corners:
            at = F.col("_at") + (F.lit(db) * F.col("size") + dg) * F.col("size") + dr
            term = F.element_at(f"lut_{c}", at.cast("int")) * F.col(f"_w{dr}{dg}{db}")
            total = term if total is None else total + term
        out[c] = F.when(F.col("size").isNull(), F.col(c)).otherwise(
            K.clamp(F.col(c) + (total - F.col(c)) * strength, 0.0, 1.0))
    return joined.withColumns(out).select(*[c for c in px.columns])


def absent_luts(asked: DataFrame, luts: DataFrame, lut_id: str = "lut_id") -> DataFrame:
    """Rows of `asked` that name a LUT which is not there."""
    return asked.where(F.col(lut_id).isNotNull()).join(luts.select(lut_id), lut_id, "left_anti")


# Row and column multipliers of the grain hash, and the strongest grain.
GRAIN_ROW, GRAIN_COLUMN, GRAIN_DEPTH = 0x6EED0E9DA4D94A4F, 0x517CC1B727220A95, 0.16
# Fixed value: what a film node's ordinal is multiplied by before it is mixed into the seed.
GRAIN_ORDINAL = 0x9E3779B9


def grain(px: DataFrame, amount: Column, size: Column, seed: Column) -> DataFrame:
    """Film grain from each pixel's place in the whole frame, so a window shows its frame's grain.

    `seed` is the frame's BIGINT seed; a later film node mixes in its ordinal first.
    """
    cells = px.withColumns({"_gy": F.floor(F.col("y") / size).cast("long"), "_gx": F.floor(F.col("x") / size).cast("long")})
    cells = bits.times(bits.times(cells, "_gy", "_gy", GRAIN_ROW), "_gx", "_gx", GRAIN_COLUMN)
    cells = bits.splitmix64(cells.withColumn("_h", seed.bitwiseXOR(F.col("_gy")).bitwiseXOR(F.col("_gx"))), "_h", "_h")
    noise = (F.shiftrightunsigned(F.col("_h"), 40) / 16777215.0 - 0.5) * amount * GRAIN_DEPTH
    shaped = cells.withColumn("_n", noise * (F.lit(0.35) + (F.lit(1.0) - K.luminance(*_rgb(), K.LUMA_ROUNDED)) * 0.65))
    return shaped.withColumns({c: F.when(amount == 0, F.col(c)).otherwise(K.clamp(F.col(c) + F.col("_n"), 0.0, 1.0))
                               for c in RGB}).drop("_gy", "_gx", "_h", "_n")


def film_seed(seed: Column, ordinal: int) -> Column:
    """The seed of the n-th grainy film node of a recipe, counted from 0 in execution order."""
    return seed.bitwiseXOR(F.lit(bits.signed(ordinal * GRAIN_ORDINAL)).cast("long"))


def blend(a: DataFrame, b: DataFrame, opacity: Column | float) -> DataFrame:
    """Mix two branches pixel by pixel; both must cover the same frame (see `mismatched_extents`)."""
    other = b.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in RGB])
    share = opacity if isinstance(opacity, Column) else F.lit(opacity)
    return a.join(other, ["image_id", "y", "x"]).withColumns(
        {c: F.col(c) + (F.col(f"_{c}") - F.col(c)) * share for c in RGB}).select(*a.columns)


def extents(px: DataFrame) -> DataFrame:
    """Width and height per frame: maxima combine map-side."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def mismatched_extents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames whose two branches differ in size, which a blend must refuse."""
    left, right = extents(a), extents(b).toDF("image_id", "width_b", "height_b")
    return left.join(right, "image_id", "full").where(
        ~(F.col("width").eqNullSafe(F.col("width_b")) & F.col("height").eqNullSafe(F.col("height_b"))))


# Camera values to linear light.
# Fixed value: a camera channel at or above this share of full scale counts as clipped.
CLIPPED = 0.97


def quality_against(px: DataFrame, clean: DataFrame) -> DataFrame:
    """Peak signal-to-noise ratio per frame against a clean version of it."""
    other = clean.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in RGB])
    square = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in RGB), F.lit(0.0)) / 3
    return px.join(other, ["image_id", "y", "x"]).groupBy("image_id").agg(F.avg(square).alias("mse")).select(
        "image_id", F.when(F.col("mse") > 0, F.log10(F.lit(1.0) / F.col("mse")) * 10).alias("psnr"))


def flat_deviation(px: DataFrame, frames: DataFrame, margin: int = 8) -> DataFrame:
    """Noise left in the flat top quarter of each frame: deviation of luma and of red minus luma."""
    y = K.luminance(*_rgb(), K.LUMA_ROUNDED)
    field = px.join(frames.select("image_id", "width", "height"), "image_id").where(
        (F.col("y") >= margin) & (F.col("y") < F.floor(F.col("height") / 4) - margin)
        & (F.col("x") >= margin) & (F.col("x") < F.col("width") - margin))
    return field.withColumn("_y", y).groupBy("image_id").agg(
        F.stddev_pop("_y").alias("luma"), F.stddev_pop(F.col("r") - F.col("_y")).alias("chroma"))


def edge_height(px: DataFrame, frames: DataFrame, spacing: int = 37, reach: int = 4) -> DataFrame:
    """Mean height of red steps every `spacing` pixels along one row, five eighths down the frame.

    Only that row survives the filter; each step collects its two sides in one grouped sum.
    """
    at = F.floor((F.col("x") + reach) / spacing).cast("int")
    side = F.col("x") - at * spacing
    row = px.join(frames.select("image_id", "width", "height"), "image_id").where(
        F.col("y") == F.floor(F.col("height") * 5 / 8)).withColumns({"_at": at, "_side": side}).where(
        (F.abs("_side") == reach) & (F.col("_at") >= 1) & (F.col("_at") * spacing + reach < F.col("width")))
    steps = row.groupBy("image_id", "_at").agg(F.abs(F.sum(F.signum("_side") * F.col("r"))).alias("_step"))
    return steps.groupBy("image_id").agg(F.avg("_step").alias("edge_height"))


def camera_matrix(cameras: DataFrame, m: str = "xyz_to_camera") -> DataFrame:
    """Add `c00`..`c22`, camera to linear sRGB, and `matrix_ok`, from a nine-number D65 matrix.

    Rows are scaled to map white to white before inverting. A matrix of the wrong length, with a
    number that is not finite, with a row summing to nothing, or without an inverse is not ok.
    """
    whole = (F.size(m) == 9) & F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def scaled(e: Column) -> Column:
        rows = [[K.dot([K.RGB_TO_XYZ[k][j] for k in range(3)], [e[i * 3 + k] for k in range(3)]) for j in range(3)] for i in range(3)]
        return F.array(*[rows[i][j] / _over(rows[i][0] + rows[i][1] + rows[i][2], 1e-7) for i in range(3) for j in range(3)])

    inverse = let(let(F.when(whole, F.col(m)), scaled), _inverse)
    df = cameras.withColumn("_inverse", inverse)
    return df.select(*cameras.columns, *[F.col("_inverse")[i * 3 + j].alias(f"c{i}{j}") for i in range(3) for j in range(3)],
                     F.coalesce(F.forall("_inverse", lambda v: v.isNotNull()), F.lit(False)).alias("matrix_ok"))


def _over(v: Column, least: float) -> Column:
    return F.when(F.abs(v) > least, v)


def _inverse(e: Column) -> Column:
    """Inverse of a 3x3 matrix held as nine numbers; nulls when it has none."""
    def at(i: int, j: int) -> Column:
        return e[(i % 3) * 3 + j % 3]

    def cofactor(i: int, j: int) -> Column:
        return at(i + 1, j + 1) * at(i + 2, j + 2) - at(i + 1, j + 2) * at(i + 2, j + 1)

    adjugate = F.array(*[cofactor(j, i) for i in range(3) for j in range(3)])
    return let(F.struct(adjugate.alias("a"), _over(sum((at(0, k) * cofactor(0, k) for k in range(3)), F.lit(0.0)), 1e-9).alias("d")),
                lambda s: F.transform(s["a"], lambda v: v / s["d"]))


def camera_to_linear(px: DataFrame) -> DataFrame:
    """Balance, lift clipped channels toward the brightest balanced one, then the camera matrix.

    Rows carry gains `gain_r, gain_g, gain_b` and the columns of `camera_matrix`.
    """
    bal = px.withColumns({f"_b{c}": F.col(c) * F.coalesce(F.col(f"gain_{c}"), F.lit(1.0)) for c in RGB})
    bal = bal.withColumn("_peak", F.greatest("_br", "_bg", "_bb"))
    bal = bal.withColumns({f"_b{c}": F.col(f"_b{c}") + K.clamp((F.col(c) - CLIPPED) / (1 - CLIPPED), 0.0, 1.0)
                           * F.greatest(F.col("_peak") - F.col(f"_b{c}"), F.lit(0.0)) for c in RGB})
    rows = {c: K.dot([F.col(f"c{i}{j}") for j in range(3)], [F.col(f"_b{d}") for d in RGB]) for i, c in enumerate(RGB)}
    return bal.withColumns(rows).drop("_br", "_bg", "_bb", "_peak", "gain_r", "gain_g", "gain_b", "matrix_ok",
                                      *[f"c{i}{j}" for i in range(3) for j in range(3)])


# McCamy's cubic, its epicentre, and the temperatures believed.
MCCAMY, MCCAMY_X, MCCAMY_Y = (449.0, 3525.0, 6823.3, 5520.33), 0.3320, 0.1858
KELVIN_BELIEVED = (1500.0, 25000.0)


def as_shot_kelvin(cameras: DataFrame, m: str = "xyz_to_camera") -> DataFrame:
    """Add `kelvin`, the temperature the camera balanced for, or null when it cannot be told."""
    gains = [F.col(f"gain_{c}") for c in RGB]
    usable = (gains[0] > 0) & (gains[1] > 0) & (gains[2] > 0) & (F.size(m) == 9)
    df = cameras.withColumn("_i", let(F.when(usable, F.col(m)), _inverse))
    df = df.withColumns({f"_x{i}": sum((F.col("_i")[i * 3 + j] / gains[j] for j in range(3)), F.lit(0.0)) for i in range(3)})
    df = df.withColumn("_sum", F.col("_x0") + F.col("_x1") + F.col("_x2"))
    df = df.withColumn("_sum", F.when(F.col("_sum") > 0, F.col("_sum")))
    df = df.withColumn("_den", F.lit(MCCAMY_Y) - F.col("_x1") / F.col("_sum"))
    df = df.withColumn("_n", (F.col("_x0") / F.col("_sum") - MCCAMY_X) / F.when(F.abs("_den") >= 1e-6, F.col("_den")))
    a, b, c, d = MCCAMY
    n = F.col("_n")
    df = df.withColumn("_k", ((n * a + b) * n + c) * n + d)
    return df.withColumn("kelvin", F.when(F.col("_k").between(*KELVIN_BELIEVED), F.col("_k"))).drop(
        "_i", "_sum", "_den", "_n", "_k", "_x0", "_x1", "_x2")
