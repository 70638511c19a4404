"""Cutting frames into overlapping tiles, so neighbourhood work needs one shuffle.

A filter that looks along rows and then along columns would shuffle every pixel twice per pass. Here a
pixel is copied into each tile whose border it may influence, the tiles are hashed once, and every
later window by (frame, tile, row) or (frame, tile, column) finds its rows already together. What a
tile's cut edge spoils stays inside the halo, which `trim` drops. A huge frame is many small tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 512
KEYS = ("image_id", "_ty", "_tx")


def split(px: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Add tile columns `_ty, _tx`; rows within `halo` of a tile border appear in both tiles."""
    def reach(c: str) -> Column:
        return F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"),
                          F.floor((F.col(c) + halo) / tile).cast("int"))

    cut = px.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))
    return cut.repartition(*KEYS)


def trim(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    home = (F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx"))
    return tiled.where(home).drop("_ty", "_tx")


Planes = dict[str, np.ndarray]


def over(px: DataFrame, values: list[str], halo: int, kernel: Callable[[Planes, int, int], Planes], tile: int = TILE) -> DataFrame:
    """Apply a kernel to whole tiles: (image_id, y, x, r, g, b) after one shuffle, whatever the kernel does inside.

    The kernel gets the tile's values as planes, with the row and column of their first sample, and gives planes r, g, b. A
    task holds one tile with its halo, so memory is bounded by the tile and not by the frame.
    """
    kept = px.select("image_id", "y", "x", *values)
    schema = kept.select("image_id", "y", "x", *[F.lit(0.0).alias(c) for c in "rgb"]).schema

    def whole(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        y0, x0 = int(y.min()), int(x.min())
        shape = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
        planes = {}
        for v in values:
            planes[v] = np.full(shape, np.nan)
            planes[v][y - y0, x - x0] = table[v].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            out = kernel(planes, y0, x0)
        home = np.nonzero((y // tile == table["_ty"][0].as_py()) & (x // tile == table["_tx"][0].as_py()))[0]
        at = y[home] - y0, x[home] - x0
        rest = table.select(["image_id", "y", "x"]).take(pa.array(home))
        for c in "rgb":
            rest = rest.append_column(c, pa.array(out[c][at]))
        return rest
    return split(kept, halo, tile).groupBy(*KEYS).applyInArrow(whole, schema)


def along(axis: str):
    """A window running along `axis` inside a tile: one row of it for x, one column for y."""
    line = "y" if axis == "x" else "x"
    return Window.partitionBy(*KEYS, line).orderBy(axis)


def tap(value: str | Column, axis: str, offset: int) -> Column:
    """The value `offset` samples along the axis, the edge sample standing in beyond the edge."""
    w = along(axis)
    v = F.col(value) if isinstance(value, str) else value
    if offset == 0:
        return v
    if offset < 0:
        edge = F.first(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.coalesce(F.lag(v, -offset).over(w), edge)
    edge = F.last(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.lead(v, offset).over(w), edge)


def taps(df: DataFrame, values: dict[str, str], axis: str, offsets: list[int]) -> DataFrame:
    """Array columns holding each value's samples at `offsets` along the axis."""
    return df.withColumns({out: F.array(*[tap(v, axis, o) for o in offsets]) for out, v in values.items()})
