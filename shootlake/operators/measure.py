"""Measuring frames: noise, focus, likeness and the border of a photographed negative."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shootlake.functions import colour as K
from shootlake.operators import geometry, ordered, tiles

RGB = ("r", "g", "b")


# --- noise ---------------------------------------------------------------------------------------
# Brightness bins, the quantile read as noise and its size in deviations, what the
# five-tap Laplacian does to white noise, samples wanted per frame and needed per bin.
NOISE_BINS, NOISE_QUANTILE, NOISE_QUANTILE_SIGMA = 8, 0.25, 0.3186
LAPLACIAN_GAIN, NOISE_SAMPLES, NOISE_BIN_MINIMUM = 1.118034, 131072, 32


def noise_samples(px: DataFrame, frames: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Laplacian magnitude and brightness bin on a grid of inner pixels, about 131 072 per frame.

    Each pixel adds its share to the grid points whose stencil covers it, combined before the shuffle; pixels that none
    covers never move, so what is shuffled does not grow with the frame.
    """
    stride = F.greatest(F.floor(F.sqrt(F.floor(F.col("width").cast("long") * F.col("height") / NOISE_SAMPLES))), F.lit(1))
    sized = px.join(frames.select("image_id", "width", "height", stride.alias("_st")), "image_id").withColumn(
        "_l", K.luminance(*[F.col(c) for c in RGB], K.LUMA_ROUNDED))

    def kept(at: Column, edge: str) -> Column:
        return (at >= 1) & (at < F.col(edge) - 1) & ((at - 1) % F.col("_st") == 0)

    def share(dy: int, dx: int) -> Column:
        cy, cx = F.col("y") + dy, F.col("x") + dx
        return F.when(kept(cy, "height") & kept(cx, "width"), F.struct(
            cy.alias("cy"), cx.alias("cx"), (F.col("_l") * (0.25 if dy or dx else 0.0)).alias("around"),
            (F.lit(None).cast("double") if dy or dx else F.col("_l")).alias("centre")))
    shares = F.array(*[share(dy, dx) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    # a pixel far from the grid has no share at all
    near = (F.pmod(F.col("y"), F.col("_st")) <= 2) | (F.col("_st") <= 3) | (F.pmod(F.col("y"), F.col("_st")) >= F.col("_st") - 1)
    spread = sized.where(near).select("image_id", F.explode(F.filter(shares, lambda s: s.isNotNull())).alias("s"))
    points = spread.groupBy("image_id", "s.cy", "s.cx").agg(F.sum("s.around").alias("around"), F.max("s.centre").alias("centre"))
    return points.select("image_id", K.noise_bin(F.col("centre")).alias("bin"), F.abs(F.col("centre") - F.col("around")).alias("magnitude"))


def noise_profile(px: DataFrame, frames: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """(image_id, deviations): noise per brightness bin, 0 darkest.

    A bin with too few samples borrows from the nearest that has enough, the lower on a tie; a frame
    with none is measured whole. A frame has at most four times NOISE_SAMPLES samples however large it is, so its ranks are
    taken where its samples meet, by bin and over all.
    """
    scale = NOISE_QUANTILE_SIGMA * LAPLACIAN_GAIN
    samples = noise_samples(px, frames, tile).repartition("image_id")

    def quartile(*keys: str) -> Column:
        """The magnitude, where it has the quartile's rank in its group and the group is large enough."""
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("magnitude")) - 1
        return F.when((n >= NOISE_BIN_MINIMUM) & (rank == F.floor(n * NOISE_QUANTILE)), F.col("magnitude") / scale)
    ranked = samples.withColumn("_d", quartile("image_id", "bin")).withColumn("_whole", quartile("image_id"))
    found = ranked.where("_d IS NOT NULL OR _whole IS NOT NULL").groupBy("image_id").agg(
        F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("bin", F.col("_d").alias("d")))).alias("_known"), F.max("_whole").alias("_whole"))
    near = F.transform(F.sequence(F.lit(0), F.lit(NOISE_BINS - 1)), lambda b: F.array_min(F.transform(
        F.col("_known"), lambda k: F.struct(F.abs(k["bin"] - b).alias("far"), k["bin"].alias("bin"), k["d"].alias("d"))))["d"])
    flat = F.array_repeat(F.coalesce("_whole", F.lit(0.0)), NOISE_BINS)
    return frames.select("image_id").join(found, "image_id", "left").select(
        "image_id", F.when(F.coalesce(F.size("_known"), F.lit(0)) <= 0, flat).otherwise(near).alias("deviations"))


# --- focus ---------------------------------------------------------------------------------------
# Locator weights by reach, lines summed on either side, its margin over the noise, the
# least step, patch edge, edges a patch needs, the widest blur, and the long edge blur is quoted at.
LOCATOR_WEIGHTS, LOCATOR_SPAN, LOCATOR_MARGIN, MINIMUM_STEP = (1.0, 2.0, 2.0), 2, 3.0, 0.02
PATCH, MINIMUM_EDGES, WIDEST_BLUR, QUOTED_EDGE, SPEAKING_RANK, MINIMUM_RATIO = 64, 12, 8.0, 1600.0, 3, 0.95
LOCATOR_GAIN = math.sqrt(2 * sum(w * w for w in LOCATOR_WEIGHTS) * (2 * LOCATOR_SPAN + 1))
LOCATOR_STEP = sum(LOCATOR_WEIGHTS) * (2 * LOCATOR_SPAN + 1)
# The error function as one over a polynomial in t, highest power first.
ERF_P, ERF = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def erf(v: Column) -> Column:
    """Error function of a value that is not negative."""
    t = F.lit(1.0) / (v * ERF_P + 1)
    poly = F.lit(0.0)
    for c in ERF:
        poly = (poly + c) * t
    return F.lit(1.0) - poly * F.exp(-v * v)


def ratio_of_blur(sigma: Column) -> Column:
    """How much wider differences grow over twice the reach, for an edge blurred by sigma."""
    return erf(F.lit(math.sqrt(2)) / sigma) / erf(F.lit(math.sqrt(0.5)) / sigma)


def blur_of_ratio(ratio: Column) -> Column:
    """The blur whose ratio this is, by halving 0..8 twenty-four times; once per patch."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(WIDEST_BLUR).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, lambda s, _: F.struct(
        F.when(ratio_of_blur((s["lo"] + s["hi"]) / 2) < ratio, (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"),
        F.when(ratio_of_blur((s["lo"] + s["hi"]) / 2) < ratio, s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi")),
        lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(ratio <= 1, F.lit(0.0)).when(ratio >= ratio_of_blur(F.lit(WIDEST_BLUR)), F.lit(WIDEST_BLUR)).otherwise(found)


def focus_plane(px: DataFrame) -> DataFrame:
    return px.select("image_id", "y", "x", K.encode_display(K.luminance(*[F.col(c) for c in RGB], K.LUMA_ROUNDED)).alias("p"))


def edge_map(plane: DataFrame, frames: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Per pixel: edge strength across and down, whether each peaks there, and differences at reach 1 and 2.

    One shuffle into tiles; the four changes of direction are sorts inside a tile.
    """
    sized = plane.join(frames.select("image_id", "width", "height"), "image_id")
    cut = tiles.split(sized, 8, tile)

    def differences(axis: str) -> dict[str, Column]:
        w = tiles.along(axis)
        return {f"_{axis}{k}": F.lead("p", k).over(w) - F.lag("p", k).over(w) for k in (1, 2, 3)}

    def wide(axis: str, edge: str) -> Column:
        at = (F.col(axis) >= 3) & (F.col(axis) < F.col(edge) - 3)
        return F.when(at, K.dot(LOCATOR_WEIGHTS, [F.col(f"_{axis}{k}") for k in (1, 2, 3)])).otherwise(F.lit(0.0))

    def lines(value: str, axis: str, edge: str) -> Column:
        at = (F.col(axis) >= LOCATOR_SPAN) & (F.col(axis) < F.col(edge) - LOCATOR_SPAN)
        total = F.sum(value).over(tiles.along(axis).rowsBetween(-LOCATOR_SPAN, LOCATOR_SPAN))
        return F.when(at, total).otherwise(F.lit(0.0))

    def peak(value: str, axis: str) -> Column:
        w = tiles.along(axis)
        return (F.abs(value) >= F.abs(F.lag(value).over(w))) & (F.abs(value) > F.abs(F.lead(value).over(w)))

    cut = cut.withColumns(differences("x")).withColumn("_wx", wide("x", "width"))
    cut = cut.withColumns({**differences("y"), "across": lines("_wx", "y", "height")}).withColumn("_wy", wide("y", "height"))
    cut = cut.withColumns({"down": lines("_wy", "x", "width"), "across_peak": peak("across", "x")})
    cut = cut.withColumn("down_peak", peak("down", "y"))
    margin = len(LOCATOR_WEIGHTS) + LOCATOR_SPAN
    inner = ((F.col("x") >= margin) & (F.col("x") < F.col("width") - margin)
             & (F.col("y") >= margin) & (F.col("y") < F.col("height") - margin))
    return tiles.trim(cut, tile).select(
        "image_id", "y", "x", "p", "width", "height", "across", "down", (inner & F.col("across_peak")).alias("across_peak"),
        (inner & F.col("down_peak")).alias("down_peak"), F.col("_x1").alias("x1"), F.col("_x2").alias("x2"),
        F.col("_y1").alias("y1"), F.col("_y2").alias("y2"))


def focus_noise(edges: DataFrame, frames: DataFrame) -> DataFrame:
    """Noise of each frame's plane: median difference across every third inner pixel."""
    grid = edges.where((F.col("x") % 3 == 1) & (F.col("y") % 3 == 1) & (F.col("x") < F.col("width") - 1)
                       & (F.col("y") < F.col("height") - 1)).select("image_id", F.abs("x1").alias("d"))
    median = ordered.pick_rank(grid, ["image_id"], "d", F.floor(F.col("n") / 2))
    return frames.select("image_id").join(median, "image_id", "left").select(
        "image_id", (F.coalesce("picked", F.lit(0.0)) * (1.4826 / math.sqrt(2))).alias("noise"))


def patch_blurs(edges: DataFrame, noise: DataFrame, patch: int = PATCH, margin: float = LOCATOR_MARGIN,
                step: float = MINIMUM_STEP, least: int = MINIMUM_EDGES) -> DataFrame:
    """Blur of each patch that has edges enough, the worse of its two directions. Sums combine map-side."""
    floor = F.greatest(F.col("noise") * margin * LOCATOR_GAIN, F.lit(step * LOCATOR_STEP))
    near = edges.join(noise, "image_id").withColumn("_floor", floor)

    def sums(edge: str, axis: str) -> list[Column]:
        at = F.col(f"{edge}_peak") & (F.abs(edge) > F.col("_floor"))
        return [F.sum(F.when(at, F.col(f"{axis}1") * F.signum(edge))).alias(f"_{axis}d1"),
                F.sum(F.when(at, F.col(f"{axis}2") * F.signum(edge))).alias(f"_{axis}d2"), F.count_if(at).alias(f"_{axis}n")]

    patches = near.groupBy("image_id", F.floor(F.col("y") / patch).cast("int").alias("patch_y"),
                           F.floor(F.col("x") / patch).cast("int").alias("patch_x")).agg(*sums("across", "x"), *sums("down", "y"))

    def ratio(axis: str) -> Column:
        r = F.col(f"_{axis}d2") / F.when(F.col(f"_{axis}d1") > 0, F.col(f"_{axis}d1"))
        return F.when((F.col(f"_{axis}n") >= least) & (r > MINIMUM_RATIO), r)

    # the blur grows with the ratio, so the worse direction is the larger ratio
    rated = patches.withColumn("_ratio", F.greatest(ratio("x"), ratio("y"))).where("_ratio IS NOT NULL")
    return rated.select("image_id", "patch_y", "patch_x", blur_of_ratio(F.col("_ratio")).alias("blur"))


def focus_report(blurs: DataFrame, frames: DataFrame, patch: int = PATCH) -> DataFrame:
    """(blur, typical, judgeable) per frame at a 1600-pixel long edge.

    Ranks run over patches, a four-thousandth of a frame's pixels.
    """
    w = Window.partitionBy("image_id")
    ranked = blurs.withColumn("_r", F.row_number().over(w.orderBy("blur", "patch_y", "patch_x")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w))
    picked = ranked.groupBy("image_id").agg(
        F.max(F.when(F.col("_r") == F.least(F.lit(SPEAKING_RANK), F.col("_n") - 1), F.col("blur"))).alias("_best"),
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col("blur"))).alias("_middle"), F.max("_n").alias("_judged"))
    scale = F.lit(QUOTED_EDGE) / F.greatest("width", "height")
    patches = F.ceil(F.col("width") / patch) * F.ceil(F.col("height") / patch)
    none = F.col("_best").isNull() | (F.col("width") < 8) | (F.col("height") < 8)
    return frames.select("image_id", "width", "height").join(picked, "image_id", "left").select(
        "image_id", F.when(none, F.lit(WIDEST_BLUR)).otherwise(F.col("_best") * scale).alias("blur"),
        F.when(none, F.lit(WIDEST_BLUR)).otherwise(F.col("_middle") * scale).alias("typical"),
        F.when(none, F.lit(0.0)).otherwise(F.col("_judged") / patches).alias("judgeable"))


def measure_focus(px: DataFrame, frames: DataFrame, patch: int = PATCH, margin: float = LOCATOR_MARGIN,
                  step: float = MINIMUM_STEP, least: int = MINIMUM_EDGES, tile: int = tiles.TILE) -> DataFrame:
    edges = edge_map(focus_plane(px), frames, tile)
    return focus_report(patch_blurs(edges, focus_noise(edges, frames), patch, margin, step, least), frames, patch)


# --- likeness ------------------------------------------------------------------------------------
# The grid a frame is reduced to for its signature.
SIGNATURE_COLUMNS, SIGNATURE_ROWS = 9, 8


def signature(px: DataFrame, frames: DataFrame) -> DataFrame:
    """64 bits per frame: bit 8·row + column is set where a cell outshines its right neighbour.

    Cells are area averages. Frames shrink to 72 cells before the second shuffle.
    """
    luma = px.select("image_id", "y", "x", K.luminance(*[F.col(c) for c in RGB], K.LUMA_ROUNDED).alias("l"))
    sizes = frames.select("image_id", "width", "height", F.lit(SIGNATURE_COLUMNS).alias("tw"), F.lit(SIGNATURE_ROWS).alias("th"))
    cells = geometry.downscale(luma, sizes, ("l",)).withColumn("l8", K.quantised(F.col("l")))
    right = F.lead("l8").over(Window.partitionBy("image_id", "y").orderBy("x"))
    bit = F.when(F.col("l8") > F.col("_right"), F.expr("shiftleft(1L, cast(y * 8 + x as int))")).otherwise(F.lit(0).cast("long"))
    return cells.withColumn("_right", right).where("_right IS NOT NULL").groupBy("image_id").agg(F.bit_or(bit).alias("signature"))


# --- negatives -----------------------------------------------------------------------------------
# Longest edge analysed, border ring, likeness to the base, its least level, share of a
# border line, least frame share, inset, and the tilts believed.
ANALYSIS_EDGE, RING, LIKENESS, BASE_FLOOR, BORDER_SHARE, FRAME_SHARE, INSET = 512, 0.03, 0.3, 0.02, 0.55, 0.2, 0.015
TILT_MAX, TILT_MIN, TILT_AGREE, TILT_POINTS = 7.0, 0.3, Decimal("0.03"), 8


def border_base(px: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, base_r, base_g, base_b): the upper median of each channel over the border ring."""
    ring = {e: F.greatest(F.floor(F.col(e) * RING), F.lit(2)) for e in ("width", "height")}
    edge = px.join(frames.select("image_id", "width", "height"), "image_id").where(
        (F.col("y") < ring["height"]) | (F.col("y") >= F.col("height") - ring["height"])
        | (F.col("x") < ring["width"]) | (F.col("x") >= F.col("width") - ring["width"]))
    flat = edge.select("image_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in RGB])).alias("s")).select("image_id", "s.channel", "s.v")
    median = ordered.pick_rank(flat, ["image_id", "channel"], "v", F.floor(F.col("n") / 2))
    return median.groupBy("image_id").agg(*[
        F.max(F.when(F.col("channel") == c, F.col("picked"))).alias(f"base_{c}") for c in RGB])


def base_like(px: DataFrame, base: DataFrame) -> DataFrame:
    """Add `like`: every channel lies within 30 % of the border base."""
    test = F.lit(True)
    for c in RGB:
        test = test & (F.abs(F.col(c) - F.col(f"base_{c}")) / F.greatest(F.col(f"base_{c}"), F.lit(BASE_FLOOR)) < LIKENESS)
    return px.join(base, "image_id").select("image_id", "y", "x", test.alias("like"))


def border_lines(liked: DataFrame) -> DataFrame:
    """(image_id, axis, line, border) for each row and column: is more than 55 % of it base?"""
    lines = liked.select("image_id", "like", F.explode(F.array(
        F.struct(F.lit("row").alias("axis"), F.col("y").alias("line")),
        F.struct(F.lit("column").alias("axis"), F.col("x").alias("line")))).alias("s"))
    return lines.groupBy("image_id", "s.axis", "s.line").agg(
        (F.avg(F.col("like").cast("double")) > BORDER_SHARE).alias("border"))


def content_spans(lines: DataFrame) -> DataFrame:
    """Per frame and axis, the run of lines off the border: the one over the middle, else the longest.

    Windows run over the lines of one frame, at most its width or height.
    """
    by_line = Window.partitionBy("image_id", "axis").orderBy("line")
    whole = Window.partitionBy("image_id", "axis")
    runs = lines.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_run", F.col("line") - F.row_number().over(Window.partitionBy("image_id", "axis", "border").orderBy("line"))).where(~F.col("border"))
    runs = runs.groupBy("image_id", "axis", "_run").agg(
        F.min("line").alias("start"), F.count(F.lit(1)).alias("length"), F.max("_n").alias("lines"))
    middle = F.floor(F.col("lines") / 2)
    over = (F.col("start") <= middle) & (middle < F.col("start") + F.col("length"))
    return runs.groupBy("image_id", "axis").agg(F.max_by(F.struct("start", "length", "lines"), F.struct(
        over.alias("over"), "length", "start")).alias("s")).select("image_id", "axis", "s.start", "s.length", "s.lines")


def tilt(liked: DataFrame, spans: DataFrame) -> DataFrame:
    """Degrees that straighten the frame, from the slopes of its left and right edges; 0 when unsure.

    Places are whole numbers, so slopes are compared as fractions: edges apart by just TILT_AGREE agree, in whatever order
    their rows are summed. `spans` has (image_id, width, row_start, row_length, column_start, column_length).
    """
    inset = F.greatest(F.floor(F.col("row_length") / 10), F.lit(2))
    margin = F.greatest(F.floor(F.col("column_length") / 4), F.lit(4))
    s = spans.withColumns({"_from": F.col("row_start") + inset, "_to": F.col("row_start") + F.col("row_length") - inset,
                           "_margin": margin, "_right": F.col("column_start") + F.col("column_length")})
    near = liked.join(s.where(F.col("_to") > F.col("_from") + 8), "image_id").where(
        ~F.col("like") & (F.col("y") >= F.col("_from")) & (F.col("y") < F.col("_to")))
    x = F.col("x")
    left = F.when((x >= F.col("column_start") - F.col("_margin")) & (x < F.col("column_start") + F.col("_margin")), x)
    right = F.when((x >= F.col("_right") - F.col("_margin")) & (x < F.col("_right") + F.col("_margin")), x)
    rows = near.groupBy("image_id", "y").agg(F.min(left).cast("long").alias("_l"), F.max(right).cast("long").alias("_r"))
    y = F.col("y").cast("long")

    def fit(e: str) -> list[Column]:
        """Rise and run of the line through an edge, whole numbers; no run where its points are too few."""
        at = F.when(F.col(e).isNotNull(), y)
        n, sy, se = F.count(e), F.sum(at), F.sum(e)
        rise, run = n * F.sum(at * F.col(e)) - sy * se, n * F.sum(at * at) - sy * sy
        return [F.when(n >= TILT_POINTS, v).cast("decimal(18,0)").alias(k + e) for k, v in (("_rise", rise), ("_run", run))]
    fits = rows.groupBy("image_id").agg(*fit("_l"), *fit("_r"))
    a, b = (F.col("_rise" + e).cast("double") / F.col("_run" + e).cast("double") for e in ("_l", "_r"))
    apart = F.abs(F.col("_rise_l") * F.col("_run_r") - F.col("_rise_r") * F.col("_run_l")) > F.col("_run_l") * F.col("_run_r") * F.lit(TILT_AGREE)
    slope = F.when(apart, F.lit(0.0)).otherwise(F.coalesce((a + b) / 2, a, b, F.lit(0.0)))
    degrees = K.clamp(F.degrees(F.atan(slope)), -TILT_MAX, TILT_MAX)
    return fits.select("image_id", F.when(F.abs(degrees) < TILT_MIN, F.lit(0.0)).otherwise(degrees).alias("tilt"))


def negative_frames(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Crop rectangle in display fractions, film base and straightening angle of each frame.

    A frame without a plausible tile gets the whole picture.
    """
    sizes = geometry.target_size(frames, F.lit(ANALYSIS_EDGE), F.lit(ANALYSIS_EDGE), by_orientation=False)
    small = geometry.downscale(px, sizes)
    reduced = sizes.select("image_id", F.col("tw").alias("width"), F.col("th").alias("height"), "orientation")
    base = border_base(small, reduced)
    liked = base_like(small, base)
    spans = content_spans(border_lines(liked)).groupBy("image_id").agg(*[
        F.max(F.when(F.col("axis") == a, F.col(f))).alias(f"{a}_{f}") for a in ("row", "column") for f in ("start", "length")])
    sized = reduced.join(spans, "image_id", "left")
    plausible = F.coalesce((F.col("row_length") / F.col("height") > FRAME_SHARE)
                           & (F.col("column_length") / F.col("width") > FRAME_SHARE), F.lit(False))
    sized = sized.withColumn("_ok", plausible)
    angles = tilt(liked, sized.where("_ok").select("image_id", "width", "row_start", "row_length", "column_start", "column_length"))
    joined = sized.join(angles, "image_id", "left").join(base, "image_id", "left")

    def side(start: str, length: str, edge: str) -> tuple[Column, Column]:
        at = K.clamp(F.col(start) / F.col(edge) + INSET, 0.0, 0.95)
        return at, F.least(F.greatest(F.col(length) / F.col(edge) - 2 * INSET, F.lit(0.05)), F.lit(1.0) - at)

    left, width = side("column_start", "column_length", "width")
    top, height = side("row_start", "row_length", "height")
    rect = [F.when(F.col("_ok"), v).otherwise(F.lit(d)) for v, d in zip((left, top, width, height), (0.0, 0.0, 1.0, 1.0))]
    shown = geometry.to_display_rect(F.col("orientation"), *rect)
    return joined.select("image_id", *[v.alias(n) for v, n in zip(shown, ("rect_left", "rect_top", "rect_width", "rect_height"))],
                         "base_r", "base_g", "base_b",
                         geometry.display_angle(F.col("orientation"), F.coalesce("tilt", F.lit(0.0))).alias("angle"))
