"""Turning, cropping, resampling and reducing frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.operators import tiles

RGB = ("r", "g", "b")
#: Columns of a rectangle of whole pixels; the ends are not in it.
BOUNDS = ("x0", "y0", "x1", "y1")


def _half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def _placed(px: DataFrame, turn: Column) -> DataFrame:
    """Move pixels of a frame of `width` by `height` as an orientation code 1..8 asks."""
    right, bottom = F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    x = (F.when(turn.isin(2, 3), right).when(turn.isin(5, 8), F.col("y"))
         .when(turn.isin(6, 7), bottom).otherwise(F.col("x")))
    y = (F.when(turn.isin(3, 4), bottom).when(turn.isin(5, 6), F.col("x"))
         .when(turn.isin(7, 8), right).otherwise(F.col("y")))
    return px.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def orient(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Sensor to display orientation: a projection after joining each frame's size and code."""
    sized = px.join(frames.select("image_id", "width", "height", "orientation"), "image_id")
    return _placed(sized, F.col("orientation")).select(*px.columns)


def rotate(px: DataFrame, frames: DataFrame, turns: Column) -> DataFrame:
    """Whole quarter turns clockwise; `turns` may read columns of `frames`."""
    sized = px.join(frames.select("image_id", "width", "height", turns.alias("_turns")), "image_id")
    code = F.element_at(F.array(F.lit(1), F.lit(6), F.lit(3), F.lit(8)), F.pmod(F.col("_turns"), F.lit(4)).cast("int") + 1)
    return _placed(sized, code).select(*px.columns)


def crop_window(frames: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """Whole-pixel crop `x0, y0, cw, ch` of each frame from fractions of it."""
    def span(at: Column, size: Column, edge: str) -> tuple[Column, Column]:
        start = F.least(_half_up(at * F.col(edge)), F.col(edge) - 1).cast("int")
        return start, F.least(F.greatest(_half_up(size * F.col(edge)), F.lit(1)), F.col(edge) - start).cast("int")

    x0, cw = span(left, width, "width")
    y0, ch = span(top, height, "height")
    return frames.withColumns({"x0": x0, "cw": cw, "y0": y0, "ch": ch})


def crop(px: DataFrame, windows: DataFrame) -> DataFrame:
    """Keep each frame's window and move its corner to the origin."""
    w = px.join(windows.select("image_id", "x0", "y0", "cw", "ch"), "image_id").where(
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("cw"))
        & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("ch")))
    return w.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).select(*px.columns)


def gather(points: DataFrame, source: DataFrame, cols: tuple[str, ...] = RGB, tile: int = tiles.TILE) -> DataFrame:
    """Bilinear samples of `source` at (`sx`, `sy`) of each point; 0 outside the frame.

    Every source pixel first takes its right, lower and diagonal neighbours along, so a point meets
    all four corners in one join instead of four. Points need `image_id`, `width`, `height`.
    """
    here = F.struct(*cols)
    cells = tiles.split(source.select("image_id", "y", "x", *cols), 1, tile).withColumn("_a", here)
    cells = cells.withColumn("_b", F.coalesce(F.lead("_a").over(tiles.along("x")), F.col("_a")))
    below = F.lead(F.struct("_a", "_b")).over(tiles.along("y"))
    cells = cells.withColumn("_v", F.coalesce(below, F.struct("_a", "_b")))
    cells = tiles.trim(cells, tile).select("image_id", F.col("y").alias("_y0"), F.col("x").alias("_x0"), "_a", "_b", "_v")
    inside = ((F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= F.col("width") - 1) & (F.col("sy") <= F.col("height") - 1))
    at = points.withColumns({"_x0": F.when(inside, F.floor("sx")).cast("int"), "_y0": F.when(inside, F.floor("sy")).cast("int")})
    met = at.join(cells, ["image_id", "_y0", "_x0"], "left").withColumns(
        {"_fx": F.col("sx") - F.col("_x0"), "_fy": F.col("sy") - F.col("_y0")})

    def mix(c: str) -> Column:
        top = F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * F.col("_fx")
        low = F.col(f"_v._a.{c}") + (F.col(f"_v._b.{c}") - F.col(f"_v._a.{c}")) * F.col("_fx")
        return F.coalesce(top + (low - top) * F.col("_fy"), F.lit(0.0))

    return met.select(*points.columns, *[mix(c).alias(c) for c in cols])


def grid(frames: DataFrame, width: str = "width", height: str = "height", places: DataFrame | None = None) -> DataFrame:
    """One row per pixel place of each frame; rows first, so a huge frame spreads before it widens.

    With `places` (image_id, x0, y0, x1, y1; the ends are not in it) only those of each frame's rectangle.
    """
    first, last = {"x": F.lit(0), "y": F.lit(0)}, {"x": F.col(width) - 1, "y": F.col(height) - 1}
    columns = [F.col(c) for c in frames.columns]
    if places is not None:
        bounds = places.where("x1 > x0 AND y1 > y0").select("image_id", *[F.col(c).alias(f"_g{c}") for c in BOUNDS])
        frames = frames.join(bounds, "image_id")
        first = {a: F.col(f"_g{a}0") for a in "xy"}
        last = {a: F.col(f"_g{a}1") - 1 for a in "xy"}
    rows = frames.withColumn("y", F.explode(F.sequence(first["y"], last["y"].cast("int"))))
    wide = rows.repartition("image_id", "y").withColumn("x", F.explode(F.sequence(first["x"], last["x"].cast("int"))))
    return wide.select(*columns, "y", "x")


def crop_turned(px: DataFrame, windows: DataFrame, angle: Column, tile: int = tiles.TILE, places: DataFrame | None = None) -> DataFrame:
    """Crop after turning the frame by `angle` degrees about the crop's centre; one bilinear pass.

    With `places` only those of the crop's pixels are made (see `grid`).
    """
    w = windows.withColumn("_rad", F.radians(angle)).withColumns(
        {"_cx": F.col("x0") + F.col("cw") * 0.5, "_cy": F.col("y0") + F.col("ch") * 0.5,
         "_cos": F.cos("_rad"), "_sin": F.sin("_rad")})
    cells = grid(w, "cw", "ch", places)
    dx, dy = F.col("x0") + F.col("x") + 0.5 - F.col("_cx"), F.col("y0") + F.col("y") + 0.5 - F.col("_cy")
    points = cells.select("image_id", "y", "x", "width", "height",
                          (F.col("_cx") + F.col("_cos") * dx + F.col("_sin") * dy - 0.5).alias("sx"),
                          (F.col("_cy") - F.col("_sin") * dx + F.col("_cos") * dy - 0.5).alias("sy"))
    return gather(points, px, tile=tile).select("image_id", "y", "x", *RGB)


def zoom_to_fill(mapped: DataFrame, step: int = 4) -> DataFrame:
    """Per frame, the zoom that pushes samples falling outside it off the edge.

    `mapped` has (image_id, y, x, width, height, gx, gy); every `step`-th place is asked.
    """
    cx, cy = (F.col("width") - 1) * 0.5, (F.col("height") - 1) * 0.5
    valid = (F.col("gx") >= 0) & (F.col("gy") >= 0) & (F.col("gx") <= F.col("width") - 1) & (F.col("gy") <= F.col("height") - 1)
    far = F.greatest(F.when(cx > 0, F.abs(F.col("x") - cx) / cx).otherwise(F.lit(0.0)),
                     F.when(cy > 0, F.abs(F.col("y") - cy) / cy).otherwise(F.lit(0.0)))
    nearest = mapped.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).groupBy("image_id").agg(
        F.coalesce(F.min(F.when(~valid, far)), F.lit(1.0)).alias("_n"))
    return nearest.select("image_id", F.when(F.col("_n") < 1, F.lit(1.005) / F.greatest(F.col("_n"), F.lit(0.5)))
                          .otherwise(F.lit(1.0)).alias("zoom"))


def _blended(lens_map: DataFrame, frames: DataFrame, strength: Column) -> DataFrame:
    """The map with `gx, gy`: places blended between themselves and the map by strength."""
    sized = lens_map.join(frames.select("image_id", "width", "height", strength.alias("_s")), "image_id")
    return sized.withColumns({"gx": F.col("x") + (F.col("mx") - F.col("x")) * F.col("_s"),
                              "gy": F.col("y") + (F.col("my") - F.col("y")) * F.col("_s")})


def _zoomed(at: Column, size: str) -> Column:
    """Where a place lies before the zoom."""
    middle = (F.col(size) - 1) * 0.5
    return middle + (at - middle) / F.col("zoom")


def remap(px: DataFrame, lens_map: DataFrame, frames: DataFrame, strength: Column, tile: int = tiles.TILE,
          places: DataFrame | None = None) -> DataFrame:
    """Lens correction from a map of source places (image_id, y, x, mx, my).

    `strength` blends between leaving places alone and the map, a zoom hides the border it cannot
    fill, and zoomed places read the map itself bilinearly. Channels with their own map are one
    call each. Frames the map says nothing about keep their pixels; `without_map` lists them.
    With `places` only those of each corrected frame are made (see `grid`).
    """
    mapped = _blended(lens_map, frames, strength)
    zoomed = frames.select("image_id", "width", "height").join(zoom_to_fill(mapped), "image_id")
    asked = grid(zoomed, places=places).withColumns({"sx": _zoomed(F.col("x"), "width"), "sy": _zoomed(F.col("y"), "height")})
    cells = mapped if places is None else _within(mapped, _map_cells(zoomed, places))
    found = gather(asked.select("image_id", "y", "x", "width", "height", "sx", "sy"), cells, ("gx", "gy"), tile)
    points = found.drop("sx", "sy").withColumnsRenamed({"gx": "sx", "gy": "sy"})
    corrected = gather(points, px, tile=tile).select("image_id", "y", "x", *RGB)
    plain = px.join(without_map(frames, lens_map), "image_id", "left_semi")
    return corrected.unionByName(plain.select(*corrected.columns))


def _within(df: DataFrame, rects: DataFrame) -> DataFrame:
    """Rows of `df` (image_id, y, x and more) inside each frame's rectangle."""
    bounds = rects.select("image_id", *[F.col(c).alias(f"_w{c}") for c in BOUNDS])
    return df.join(bounds, "image_id").where(
        "x >= _wx0 AND x < _wx1 AND y >= _wy0 AND y < _wy1").select(*df.columns)


def cut(px: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels inside each frame's rectangle (image_id, x0, y0, x1, y1; the ends are not in it); coordinates stay the frame's."""
    return _within(px, rects)


def _map_cells(zoomed: DataFrame, places: DataFrame) -> DataFrame:
    """The rectangle of a lens map that the places of a corrected frame read."""
    at = zoomed.join(places.select("image_id", *BOUNDS), "image_id")
    first = lambda a, size: F.floor(_zoomed(F.col(f"{a}0"), size)).cast("int")
    end = lambda a, size: F.least(F.floor(_zoomed(F.col(f"{a}1") - 1, size)).cast("int") + 2, F.col(size))
    return at.select("image_id", first("x", "width").alias("x0"), first("y", "height").alias("y0"),
                     end("x", "width").alias("x1"), end("y", "height").alias("y1"))


def remap_sources(lens_map: DataFrame, frames: DataFrame, strength: Column, places: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1): the pixels that the places of a corrected frame are sampled from.

    A frame whose map lacks some of the cells asked for is read whole; frames without a map give no row.
    """
    mapped = _blended(lens_map, frames, strength)
    zoomed = frames.select("image_id", "width", "height").join(zoom_to_fill(mapped), "image_id")
    cells = _map_cells(zoomed, places)
    met = mapped.join(cells, "image_id").where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").groupBy("image_id").agg(
        F.min("gx").alias("_lx"), F.max("gx").alias("_hx"), F.min("gy").alias("_ly"), F.max("gy").alias("_hy"),
        F.count(F.col("gx") + F.col("gy")).alias("_n"))
    found = zoomed.join(cells, "image_id").join(met, "image_id", "left")
    whole = F.coalesce(F.col("_n"), F.lit(0)) != (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))
    low = lambda c: F.when(whole, F.lit(0)).otherwise(F.floor(c)).cast("int")
    high = lambda c, size: F.when(whole, F.col(size)).otherwise(F.floor(c) + 2).cast("int")
    return found.select("image_id", low("_lx").alias("x0"), low("_ly").alias("y0"),
                        high("_hx", "width").alias("x1"), high("_hy", "height").alias("y1"))


def without_map(frames: DataFrame, lens_map: DataFrame) -> DataFrame:
    """(image_id) of frames that a lens map has no place for."""
    return frames.select("image_id").join(lens_map.select("image_id").distinct(), "image_id", "left_anti")


def target_size(frames: DataFrame, max_width: Column, max_height: Column, by_orientation: bool = True) -> DataFrame:
    """Add `tw, th`: the size after fitting both bounds; 0 leaves a side free, nothing is enlarged."""
    swapped = F.col("orientation").between(5, 8) if by_orientation else F.lit(False)
    w, h = F.when(swapped, max_height).otherwise(max_width), F.when(swapped, max_width).otherwise(max_height)
    scale = F.least(F.when(w == 0, F.lit(1.0)).otherwise(w / F.col("width")),
                    F.when(h == 0, F.lit(1.0)).otherwise(h / F.col("height")), F.lit(1.0))
    return frames.withColumns({"tw": F.greatest(_half_up(F.col("width") * scale), F.lit(1)),
                               "th": F.greatest(_half_up(F.col("height") * scale), F.lit(1))})


def downscale(px: DataFrame, sizes: DataFrame, cols: tuple[str, ...] = RGB) -> DataFrame:
    """Area averages at `tw` by `th`: each pixel feeds the one or two cells per axis it overlaps.

    Sums combine map-side, so about one row per output pixel and map task is shuffled.
    """
    sized = px.join(sizes.select("image_id", "width", "height", "tw", "th"), "image_id")

    def shares(at: str, size: str, target: str) -> Column:
        ratio = F.col(size) / F.col(target)
        last = F.least(F.ceil((F.col(at) + 1) / ratio) - 1, F.col(target) - 1)
        return F.transform(F.sequence(F.floor(F.col(at) / ratio).cast("int"), last.cast("int")), lambda t: F.struct(
            t.alias("t"), ((F.least(F.col(at) + 1.0, (t + 1) * ratio) - F.greatest(F.col(at) * 1.0, t * ratio)) / ratio).alias("w")))

    spread = (sized.withColumn("_sx", F.explode(shares("x", "width", "tw")))
              .withColumn("_sy", F.explode(shares("y", "height", "th")))
              .withColumn("_w", F.col("_sx.w") * F.col("_sy.w")).where("_w > 0"))
    return spread.groupBy("image_id", F.col("_sy.t").alias("y"), F.col("_sx.t").alias("x")).agg(
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in cols])


# Rectangles of a frame as fractions (left, top, width, height), between sensor and display.

def _rect_case(code: Column, table: dict[int, tuple[Column, ...]], same: tuple[Column, ...]) -> list[Column]:
    out = []
    for i in range(4):
        e = same[i]
        for k, cols in table.items():
            e = F.when(code == k, cols[i]).otherwise(e)
        out.append(e)
    return out


def to_display_rect(code: Column, l: Column, t: Column, w: Column, h: Column) -> list[Column]:  # noqa: E741
    r, b = F.lit(1.0) - l - w, F.lit(1.0) - t - h
    return _rect_case(code, {2: (r, t, w, h), 3: (r, b, w, h), 4: (l, b, w, h), 5: (t, l, h, w),
                             6: (b, l, h, w), 7: (b, r, h, w), 8: (t, r, h, w)}, (l, t, w, h))


def to_sensor_rect(code: Column, l: Column, t: Column, w: Column, h: Column) -> list[Column]:  # noqa: E741
    """The inverse: codes 6 and 8 trade places, the others undo themselves."""
    swapped = F.when(code == 6, F.lit(8)).when(code == 8, F.lit(6)).otherwise(code)
    return to_display_rect(swapped, l, t, w, h)


def display_angle(code: Column, angle: Column) -> Column:
    return F.when(code.isin(2, 4, 5, 7), -angle).otherwise(angle)


def fit_ratio(l: Column, t: Column, w: Column, h: Column, fw: Column, fh: Column, ratio: Column) -> list[Column]:  # noqa: E741
    """Shrink a rectangle about its centre to a width-to-height ratio in frame pixels."""
    across = F.least(w * fw, h * fh * ratio)
    nw, nh = across / fw, across / ratio / fh
    return [F.least(F.lit(1.0) - nw, F.greatest(F.lit(0.0), l + w / 2 - nw / 2)),
            F.least(F.lit(1.0) - nh, F.greatest(F.lit(0.0), t + h / 2 - nh / 2)), nw, nh]


# How far a node reads its neighbours.
REACH = {"noise_reduction": 48, "sharpen": 16}
GEOMETRIC = ("optics", "crop", "rotate", "blend")


def halo_of(kinds: list[str]) -> int:
    """Pixels a window must carry so that the nodes after the last geometric one come out whole."""
    last = max((i for i, k in enumerate(kinds) if k in GEOMETRIC), default=-1)
    return sum(REACH.get(k, 0) for k in kinds[last + 1:])


def bounds(frames: DataFrame, rect: tuple[float, float, float, float], halo: int = 0) -> DataFrame:
    """(image_id, x0, y0, x1, y1) of a fractional window and its halo, rounded outwards and held within the frame."""
    left, top, width, height = rect

    def span(at: float, size: float, edge: str) -> tuple[Column, Column]:
        return (F.greatest(F.floor(F.lit(at) * F.col(edge)) - halo, F.lit(0)).cast("int"),
                F.least(F.ceil(F.lit(at + size) * F.col(edge)) + halo, F.col(edge)).cast("int"))
    (x0, x1), (y0, y1) = span(left, width, "width"), span(top, height, "height")
    return frames.select("image_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def region(px: DataFrame, frames: DataFrame, rect: tuple[float, float, float, float], halo: int = 0) -> DataFrame:
    """Pixels of a fractional window and its halo; coordinates stay the frame's. Of stored pixels `tables.read_regions` reads less."""
    return cut(px, bounds(frames, rect, halo))


def sample(px: DataFrame, points: DataFrame) -> DataFrame:
    """Mean colour in a square around an oriented point of each frame.

    `points` has (image_id, width, height, orientation, px, py, radius); a point or radius out of
    range, or a square holding no pixel, gives no row.
    """
    ok = points.where(F.col("px").between(0, 1) & F.col("py").between(0, 1) & F.col("radius").between(0, 0.25))
    zero = F.lit(0.0)
    sx, sy, _, _ = to_sensor_rect(F.col("orientation"), F.col("px"), F.col("py"), zero, zero)
    at = ok.select("image_id", _half_up(sx * (F.col("width") - 1)).alias("_cx"), _half_up(sy * (F.col("height") - 1)).alias("_cy"),
                   F.floor(F.col("radius") * F.least("width", "height")).cast("int").alias("_r"))
    near = px.join(at, "image_id").where((F.abs(F.col("x") - F.col("_cx")) <= F.col("_r")) & (F.abs(F.col("y") - F.col("_cy")) <= F.col("_r")))
    return near.groupBy("image_id").agg(*[F.avg(c).alias(c) for c in RGB])
