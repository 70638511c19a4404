"""Neighbourhood filters over tiles: denoise and sharpen.

Frames are cut into tiles with a halo, in one shuffle. The single passes (`guided_blur`, `median_3x3`) are windows inside a tile;
the whole filters chain some forty of them, each sorting and re-reading every pixel, so they go over a tile's planes at once
(`tiles.over`). What needs no neighbours, such as a pixel's noise limit, is projected beforehand.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.functions import colour as K
from shootlake.operators import geometry, tiles

RGB = ("r", "g", "b")
# The blur kernel, its range sigma, and deviations each detail band must clear.
KERNEL, SIGMA_BASE, SIGMA_SLOPE, FINE, COARSE = (1.0, 4.0, 6.0, 4.0, 1.0), 0.012, 0.055, 2.25, 0.5
# Smallest sharpening radius, its longest kernel arm, and the darkest luma sharpened.
RADIUS_MIN, ARM_MAX, LUMA_MIN = 0.6, 16, 1e-5


def scale_ratio(pixels: Column, full_pixels: Column) -> Column:
    """Linear size of a render against the whole frame; 1 for an export."""
    return F.when((full_pixels == 0) | (pixels >= full_pixels), F.lit(1.0)).otherwise(F.sqrt(pixels / full_pixels))


def scaled_strength(strength: Column, scale: Column) -> Column:
    return strength * K.clamp(scale * 2 - 1, 0.0, 1.0)


def _luma() -> Column:
    return K.luminance(*[F.col(c) for c in RGB], K.LUMA_ROUNDED)


def guided_blur(df: DataFrame, sources: dict[str, str], guide: str, step: int, amount: Column | None = None) -> DataFrame:
    """Blur each `out: source` at `step`, tap weights falling with the guide's difference: rows, then columns."""
    offsets = [step * k for k in (-2, -1, 0, 1, 2)]
    df = df.withColumns({f"_h{o}": F.col(s) for o, s in sources.items()})
    for axis in ("x", "y"):
        df = tiles.taps(df, {"_gt": guide, **{f"_t{o}": f"_h{o}" for o in sources}}, axis, offsets)
        sigma = F.lit(SIGMA_BASE) + F.sqrt(F.greatest(F.col(guide), F.lit(0.0))) * SIGMA_SLOPE
        weights = [F.lit(k) / (F.pow((F.col("_gt")[i] - F.col(guide)) / F.col("_sg"), F.lit(2.0)) + 1) for i, k in enumerate(KERNEL)]
        df = df.withColumn("_sg", sigma).withColumn("_ws", F.array(*weights))
        df = df.withColumn("_wt", sum((F.col("_ws")[i] for i in range(5)), F.lit(0.0)))
        df = df.withColumns({f"_h{o}": sum((F.col(f"_t{o}")[i] * F.col("_ws")[i] for i in range(5)), F.lit(0.0)) / F.col("_wt")
                             for o in sources})
    mixed = {o: F.col(f"_h{o}") if amount is None else F.col(s) + (F.col(f"_h{o}") - F.col(s)) * amount for o, s in sources.items()}
    return df.withColumns(mixed).drop("_gt", "_sg", "_ws", "_wt", *[f"_{p}{o}" for p in "ht" for o in sources])


def median_3x3(df: DataFrame, values: list[str], amount: Column) -> DataFrame:
    """Mix each value toward the median of its 3x3 neighbourhood, edges repeated."""
    df = tiles.taps(df, {f"_r{v}": v for v in values}, "x", [-1, 0, 1])
    df = tiles.taps(df, {f"_c{v}": f"_r{v}" for v in values}, "y", [-1, 0, 1])
    return df.withColumns({v: F.col(v) + (F.array_sort(F.flatten(F.col(f"_c{v}")))[4] - F.col(v)) * amount for v in values}).drop(
        *[f"_{p}{v}" for p in "rc" for v in values])


def _shifted(plane: np.ndarray, offset: int, axis: int) -> np.ndarray:
    """The plane's samples `offset` places on, its edge repeated."""
    n = plane.shape[axis]
    return plane.take(np.clip(np.arange(n) + offset, 0, n - 1), axis)


def _blur(planes: list[np.ndarray], guide: np.ndarray, step: int, amount: float = 1.0) -> list[np.ndarray]:
    """`guided_blur` on planes that share a guide."""
    if amount == 0:
        return planes
    scale = 1 / (SIGMA_BASE + SIGMA_SLOPE * np.sqrt(np.maximum(guide, 0)))
    held = planes
    for axis in (1, 0):
        sums, weights = [np.zeros_like(guide) for _ in planes], np.zeros_like(guide)
        for k, tap in enumerate(KERNEL):
            offset = (k - 2) * step
            away = (_shifted(guide, offset, axis) - guide) * scale
            weight = tap / (away * away + 1)
            weights += weight
            for total, plane in zip(sums, held):
                total += _shifted(plane, offset, axis) * weight
        held = [total / weights for total in sums]
    return [plane + (new - plane) * amount for plane, new in zip(planes, held)]


def _median(plane: np.ndarray) -> np.ndarray:
    rows = [_shifted(plane, o, 1) for o in (-1, 0, 1)]
    return np.partition(np.stack([_shifted(r, o, 0) for r in rows for o in (-1, 0, 1)]), 4, axis=0)[4]


def _shrink(detail: np.ndarray, limit: np.ndarray) -> np.ndarray:
    ratio = limit / detail
    return np.where(limit <= 0, detail, np.where(np.abs(detail) <= limit, 0.0, detail * (1 - ratio * ratio)))


def _half(plane: np.ndarray, y0: int, x0: int) -> np.ndarray:
    """Means of 2x2 blocks of the frame, of those samples that the tile has."""
    wide = np.pad(plane, ((y0 % 2, (plane.shape[0] + y0) % 2), (x0 % 2, (plane.shape[1] + x0) % 2)), constant_values=np.nan)
    there = ~np.isnan(wide)
    add = lambda a: a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]
    return add(np.where(there, wide, 0)) / add(there.astype(float))


def _full(plane: np.ndarray, shape: tuple[int, int], y0: int, x0: int) -> np.ndarray:
    """Back to full size: a sample lies a quarter or three quarters of the way between two half-size ones."""
    for axis, first, size in ((1, x0, shape[1]), (0, y0, shape[0])):
        at = np.arange(first, first + size)
        here = plane.take(at // 2 - first // 2, axis) * 0.75
        odd = (at % 2 == 1).reshape((1, -1) if axis else (-1, 1))
        next_, before = _shifted(plane, 1, axis), _shifted(plane, -1, axis)
        plane = here + 0.25 * np.where(odd, next_.take(at // 2 - first // 2, axis), before.take(at // 2 - first // 2, axis))
    return plane


def _denoise(p: tiles.Planes, y0: int, x0: int) -> tiles.Planes:
    """Noise reduction of a tile of planes r, g, b with each pixel's noise `_n` and the frame's strength `_s`."""
    s = float(np.clip(np.nanmax(p["_s"]), 0, 1))
    if np.nanmax(p["_s"]) == 0:
        return p
    wr, wg, wb = K.LUMA_ROUNDED
    luma = p["r"] * wr + p["g"] * wg + p["b"] * wb
    (fine,) = _blur([luma], luma, 1)
    (coarse,) = _blur([fine], luma, 2)
    clean = coarse + _shrink(fine - coarse, p["_n"] * COARSE) + _shrink(luma - fine, p["_n"] * FINE)
    guide = _half(clean, y0, x0)
    halves = [_half(p[c] - luma, y0, x0) for c in "br"]
    halves = [h + (_median(h) - h) * min(s * 1.5, 1.0) for h in halves]
    for step, amount in ((1, min(s * 1.8, 1.0)), (2, min(s * 1.25, 1.0)), (4, min(max((s - 0.2) * 1.25, 0.0), 1.0))):
        halves = _blur(halves, guide, step, amount)
    b, r = (clean + _full(h, clean.shape, y0, x0) for h in halves)
    return {"r": r, "g": (clean - r * wr - b * wb) / wg, "b": b}


def noise_reduction(px: DataFrame, settings: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Edge-aware denoise. `settings` has (image_id, strength, deviations), one row per frame.

    Brightness keeps detail that stands clear of the frame's measured noise; colour is filtered at half size.
    """
    joined = px.join(settings.select("image_id", F.col("strength").alias("_s"), "deviations"), "image_id")
    noise = F.element_at("deviations", K.noise_bin(_luma()) + 1) * K.clamp(F.col("_s"), 0.0, 1.0)
    return tiles.over(joined.withColumn("_n", noise), [*RGB, "_s", "_n"], geometry.REACH["noise_reduction"], _denoise, tile)


def _unsharp(p: tiles.Planes, y0: int, x0: int) -> tiles.Planes:
    """Sharpening of a tile of planes with each pixel's luma, limit and the frame's amount and radius."""
    amount, radius = float(np.nanmax(p["amount"])), float(np.nanmax(p["_rad"]))
    if amount <= 0:
        return p
    arm = int(min(max(np.ceil(radius * 3), 1), ARM_MAX))
    kernel = np.exp(-(np.arange(-arm, arm + 1) ** 2) / (radius * radius * 2))
    root = np.sqrt(np.maximum(p["_y"], 0))
    blur = root
    for axis in (1, 0):
        blur = sum(_shifted(blur, o, axis) * k for o, k in zip(range(-arm, arm + 1), kernel / kernel.sum()))
    detail = _shrink(root - blur, p["_lim"])
    gain = np.where(p["_y"] <= LUMA_MIN, 1.0, np.maximum(root + amount * detail, 0) ** 2 / p["_y"])
    return {c: p[c] * gain for c in RGB}


def sharpen(px: DataFrame, settings: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Unsharp mask on the root of luma, noise kept out, put back as a gain on all channels.

    `settings` has (image_id, amount, radius, threshold, deviations), one row per frame, the radius
    already scaled to the render.
    """
    base = settings.select("image_id", F.col("amount").cast("double").alias("amount"), F.greatest("radius", F.lit(RADIUS_MIN)).alias("_rad"),
                           "threshold", "deviations")
    df = px.join(base, "image_id").withColumn("_y", _luma())
    noise = F.element_at("deviations", K.noise_bin(F.col("_y")) + 1)
    limit = F.col("threshold") * noise / (F.greatest(F.sqrt(F.greatest("_y", F.lit(0.0))), F.lit(1e-3)) * 2)
    return tiles.over(df.withColumn("_lim", limit), [*RGB, "_y", "_lim", "amount", "_rad"], geometry.REACH["sharpen"], _unsharp, tile)
