"""Windows of rendered frames, from the pixels they depend on and no others.

Regions are carried backwards through each photo's recipe: a turn turns them, a crop moves them, a turned crop takes the box
about the turned corners, a lens map the box of the places it reads, a filter grows them by its reach, and branches that meet
are joined to one box. All of it is one row per photo; the driver only walks the skeleton. Pixels keep their frame's coordinates
throughout, so grain and tiles lie as in the whole frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.operators import geometry, grading
from shootlake.plans import apply as A
from shootlake.session import ensure_checkpoint_dir

Rect = tuple[Column, Column, Column, Column]
BOUNDS = geometry.BOUNDS


def _turned(code: Column, rect: Rect, width: Column, height: Column) -> Rect:
    """A rectangle of a frame of `width` by `height` where orientation code 1..8 puts it."""
    x, y = (rect[0], rect[2]), (rect[1], rect[3])
    right, bottom = (width - rect[2], width - rect[0]), (height - rect[3], height - rect[1])
    nx = [F.when(code.isin(2, 3), r).when(code.isin(5, 8), v).when(code.isin(6, 7), b).otherwise(h) for h, v, r, b in zip(x, y, right, bottom)]
    ny = [F.when(code.isin(3, 4), b).when(code.isin(5, 6), h).when(code.isin(7, 8), r).otherwise(v) for h, v, r, b in zip(x, y, right, bottom)]
    return nx[0], ny[0], nx[1], ny[1]


def _undone(code: Column) -> Column:
    return F.when(code == 6, F.lit(8)).when(code == 8, F.lit(6)).otherwise(code)


class Regions:
    """The rectangle each hard node of a skeleton must make, as columns of a photo's row."""

    def __init__(self, group: A.Group, rows: DataFrame, frames: DataFrame, asked: DataFrame, lens_map: DataFrame | None):
        self.skeleton, self.lens_map = group.skeleton, lens_map
        sized = frames.select("image_id", "width", "height", "orientation")
        wanted = asked.select("image_id", *[F.col(c).cast("double").alias(f"_{c}") for c in ("left", "top", "wide", "high")])
        self.df = group.arranged(rows).select("image_id", "hards").join(sized, "image_id").join(wanted, "image_id")
        self.df = self.df.withColumns({"_w0": F.col("width"), "_h0": F.col("height")})
        self.own = [n for n in range(1, len(self.skeleton.kinds) + 1) if self.skeleton.base(n) == n]
        self.upright = {0: False}
        self.demands: dict[int, list[str]] = {}
        self._forward()
        self._backward()

    def _edge(self, edge: A.Edge) -> tuple[int, bool, bool]:
        """The node an edge's pixels come from, whether they stand upright at its end, and whether they are turned so on it."""
        base = self.skeleton.base(edge.source)

        def any_upright(e: A.Edge) -> bool:
            return e.upright or e.source != base and any(any_upright(x) for x in self.skeleton.inputs[e.source - 1])
        up = self.upright[base] or any_upright(edge)
        return base, up, up and not self.upright[base]

    def _size(self, edge: A.Edge) -> tuple[Column, Column]:
        base, _, turned = self._edge(edge)
        w, h = F.col(f"_w{base}"), F.col(f"_h{base}")
        if not turned:
            return w, h
        swap = F.col("orientation").between(5, 8)
        return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)

    def _p(self, node: int, i: int) -> Column:
        return F.col("hards")[node - 1]["p"][i]

    def _forward(self) -> None:
        for n in self.own:
            kind, edge = self.skeleton.kinds[n - 1], self.skeleton.inputs[n - 1][0]
            self.upright[n] = self._edge(edge)[1]
            w, h = self._size(edge)
            self.df = self.df.withColumns({f"_iw{n}": w, f"_ih{n}": h})
            w, h = F.col(f"_iw{n}"), F.col(f"_ih{n}")
            if kind == "rotate":
                swap = self._p(n, 0).cast("int") % 2 == 1
                w, h = F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)
            elif kind == "crop":
                sized = self.df.withColumns({"width": w, "height": h})
                self.df = geometry.crop_window(sized, *[self._p(n, i) for i in range(4)]).withColumnsRenamed(
                    {"x0": f"_cx{n}", "y0": f"_cy{n}", "cw": f"_cw{n}", "ch": f"_ch{n}"})
                w, h = F.col(f"_cw{n}"), F.col(f"_ch{n}")
            self.df = self.df.withColumns({f"_w{n}": w, f"_h{n}": h})

    def _rect(self, name: str) -> Rect:
        return tuple(F.col(f"{name}_{c}") for c in BOUNDS)

    def _keep(self, name: str, rect: Rect) -> Rect:
        self.df = self.df.withColumns({f"{name}_{c}": v.cast("int") for c, v in zip(BOUNDS, rect)})
        return self._rect(name)

    def _demand(self, edge: A.Edge, rect: Rect) -> None:
        base, _, turned = self._edge(edge)
        if turned:
            rect = _turned(_undone(F.col("orientation")), rect, *self._size(edge))
        name = f"_d{base}_{len(self.demands.setdefault(base, []))}"
        self._keep(name, rect)
        self.demands[base].append(name)

    def _joined(self, n: int) -> Rect:
        """The box about all that is asked of a node, within its frame."""
        rects = [self._rect(name) for name in self.demands[n]]
        size = {0: F.col(f"_w{n}"), 1: F.col(f"_h{n}")}
        low = [F.greatest(F.lit(0), *[r[i] for r in rects]) if len(rects) == 1 else F.greatest(F.lit(0), F.least(*[r[i] for r in rects])) for i in (0, 1)]
        high = [F.least(size[i], *[r[i + 2] for r in rects]) if len(rects) == 1 else F.least(size[i], F.greatest(*[r[i + 2] for r in rects])) for i in (0, 1)]
        return self._keep(f"_r{n}", (low[0], low[1], high[0], high[1]))

    def _backward(self) -> None:
        w, h = self._size(self.skeleton.output)
        whole = (F.floor(F.col("_left") * w), F.floor(F.col("_top") * h),
                 F.ceil((F.col("_left") + F.col("_wide")) * w), F.ceil((F.col("_top") + F.col("_high")) * h))
        asked = self._keep("_out", (F.greatest(whole[0], F.lit(0)), F.greatest(whole[1], F.lit(0)), F.least(whole[2], w), F.least(whole[3], h)))
        self.df = self.df.where((asked[2] > asked[0]) & (asked[3] > asked[1]))
        self._demand(self.skeleton.output, asked)
        for n in reversed([n for n in self.own if n]):
            rect = self._joined(n)
            for edge in self.skeleton.inputs[n - 1]:
                self._demand(edge, self._source(n, rect))
        self._joined(0)

    def _source(self, n: int, rect: Rect) -> Rect:
        """What a node reads to make a rectangle."""
        kind, w, h = self.skeleton.kinds[n - 1], F.col(f"_w{n}"), F.col(f"_h{n}")
        if kind in geometry.REACH:
            reach = geometry.REACH[kind]
            return rect[0] - reach, rect[1] - reach, rect[2] + reach, rect[3] + reach
        if kind == "rotate":
            code = F.element_at(F.array(F.lit(1), F.lit(8), F.lit(3), F.lit(6)), F.pmod(self._p(n, 0).cast("int"), F.lit(4)) + 1)
            return _turned(code, rect, w, h)
        if kind == "crop":
            return self._uncropped(n, rect)
        if kind == "optics" and self.lens_map is not None:
            places = self.df.select("image_id", *[v.alias(c) for c, v in zip(BOUNDS, rect)])
            frames = self.df.select("image_id", F.col(f"_iw{n}").alias("width"), F.col(f"_ih{n}").alias("height"),
                                    F.when(self._p(n, 0) != 0, self._p(n, 1)).otherwise(F.lit(0.0)).alias("_by"))
            found = geometry.remap_sources(self.lens_map, frames, F.col("_by"), places)
            self.df = self.df.join(found.select("image_id", *[F.col(c).alias(f"_m{n}_{c}") for c in BOUNDS]), "image_id", "left")
            return tuple(F.coalesce(F.col(f"_m{n}_{c}"), v) for c, v in zip(BOUNDS, rect))
        return rect

    def _uncropped(self, n: int, rect: Rect) -> Rect:
        cx, cy, cw, ch = (F.col(f"_c{k}{n}") for k in ("x", "y", "w", "h"))
        straight = (rect[0] + cx, rect[1] + cy, rect[2] + cx, rect[3] + cy)
        cos, sin = F.cos(F.radians(self._p(n, 4))), F.sin(F.radians(self._p(n, 4)))
        # centres of the first and last pixels against the crop's centre
        dx, dy = (rect[0] + 0.5 - cw * 0.5, rect[2] - 0.5 - cw * 0.5), (rect[1] + 0.5 - ch * 0.5, rect[3] - 0.5 - ch * 0.5)

        def span(a: Column, b: Column, middle: Column) -> tuple[Column, Column]:
            ends = [a * x + b * y for x in dx for y in dy]
            return F.floor(F.least(*ends) + middle - 0.5) - 1, F.floor(F.greatest(*ends) + middle - 0.5) + 3
        xs, ys = span(cos, sin, cx + cw * 0.5), span(-sin, cos, cy + ch * 0.5)
        turned = F.abs(self._p(n, 4)) >= 0.01
        return tuple(F.when(turned, t).otherwise(s) for t, s in zip((xs[0], ys[0], xs[1], ys[1]), straight))

    def table(self) -> DataFrame:
        """(image_id, out, r0, r1 ...): the window asked for and each node's rectangle, as structs; 0 is the stored frame's."""
        as_struct = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in BOUNDS])
        return self.df.select("image_id", as_struct("_out").alias("out"), *[as_struct(f"_r{n}").alias(f"r{n}") for n in (0, *self.own)])


def regions(frames: DataFrame, recipes: DataFrame, asked: DataFrame, luts: DataFrame | None = None,
            lens_map: DataFrame | None = None) -> Iterator[tuple[A.Group, DataFrame, DataFrame]]:
    """(group, prepared rows, regions) per skeleton; the regions are a written table of one row per photo.

    `asked` has (image_id, left, top, wide, high), fractions of the rendered frame, rounded outwards and held within it; photos
    without a row, and windows that hold no pixel, give nothing.
    """
    folder = ensure_checkpoint_dir(frames.sparkSession)
    rows, groups = A.groups_of(recipes, luts)
    for group in groups:
        path = f"{folder}/regions-{uuid.uuid4().hex}"
        Regions(group, rows, frames, asked, lens_map).table().write.parquet(path)
        yield group, rows, frames.sparkSession.read.parquet(path)


def _bounds(table: DataFrame, name: str) -> DataFrame:
    return table.select("image_id", *[F.col(f"{name}.{c}").alias(c) for c in BOUNDS])


def render(read: Callable[[DataFrame], DataFrame], frames: DataFrame, recipes: DataFrame, asked: DataFrame, luts: DataFrame | None = None,
           lens_map: DataFrame | None = None, profiles: DataFrame | None = None, tile: int = 512) -> Iterator[tuple[str, DataFrame]]:
    """(skeleton, display-space pixels of the windows) per distinct skeleton; coordinates stay the rendered frame's.

    `read` gives the stored pixels inside rectangles (image_id, x0, y0, x1, y1), such as `tables.read_regions` of a folder or
    `geometry.cut` of a table. The rest is as for `apply.render_by_skeleton`, and so are the pixels, but for filters: these go by
    the noise of the whole frame if `profiles` (see `apply.noise_profiles`) has it, and else by that of the window they get.
    """
    for group, rows, table in regions(frames, recipes, asked, luts, lens_map):
        # bounds that prune the scan, and a filter that tells Spark so
        source = read(_bounds(table, "r0").where("x1 > x0 AND y1 > y0")).select("image_id", "y", "x", *grading.RGB)
        held = frames.join(table.select("image_id"), "image_id").withColumn("scaled_pixels", F.col("width").cast("long") * F.col("height"))
        own = [int(c[1:]) for c in table.columns if c[0] == "r" and c != "r0"]
        plan = A.Plan(group, A.Branch(source, held), rows.join(table.select("image_id"), "image_id", "left_semi"), luts, lens_map, tile,
                      {n: _bounds(table, f"r{n}") for n in own}, profiles)
        yield group.skeleton.key, geometry.cut(plan.pixels(), _bounds(table, "out"))
