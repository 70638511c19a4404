"""Colour maths as Column expressions; scene-linear unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights used by grading, and the rounded ones used by grain and focus.
LUMA = (0.2126729, 0.7151522, 0.072175)
LUMA_ROUNDED = (0.2126, 0.7152, 0.0722)
# Locus of black bodies, x from 1/T and y from x, highest power first.
KELVIN_X = {4000.0: (-0.2661239e9, -0.234358e6, 0.8776956e3, 0.179910),
            None: (-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390)}
KELVIN_Y = {2222.0: (-1.1063814, -1.3481102, 2.18555832, -0.20219683),
            4000.0: (-0.9549476, -1.37418593, 2.09137015, -0.16748867),
            None: (3.081758, -5.8733867, 3.75112997, -0.37001483)}
# Bradford cone response and its inverse, linear sRGB to XYZ and back, the D65 white.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912),
                    (-0.0085287, 0.0400428, 0.9684867))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
D65_XY = (0.3127, 0.3290)
D65_XYZ = (0.95047, 1.0, 1.08883)
# Display curve gain and coefficients, middle grey.
TONE_GAIN, TONE_TOP, TONE_SHOULDER = 1.6, 8.75, 1.46
MIDDLE_GREY = 0.18

Triple = tuple[Column, Column, Column]


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def dot(weights, values) -> Column:
    total = None
    for w, v in zip(weights, values):
        term = v * w
        total = term if total is None else total + term
    return total


def luminance(r: Column, g: Column, b: Column, weights=LUMA) -> Column:
    return dot(weights, (r, g, b))


def encode(v: Column) -> Column:
    """sRGB transfer with its linear segment; negatives stay on the segment."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def encode_display(v: Column) -> Column:
    return F.when(v > 0, encode(v)).otherwise(F.lit(0.0))


def decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow(F.greatest((v + 0.055) / 1.055, F.lit(0.0)), F.lit(2.4)))


def _cubic(t: Column, c) -> Column:
    return ((t * c[0] + c[1]) * t + c[2]) * t + c[3]


def _pieces(at: Column, t: Column, table: dict) -> Column:
    out = _cubic(t, table[None])
    for limit in sorted((k for k in table if k is not None), reverse=True):
        out = F.when(at <= limit, _cubic(t, table[limit])).otherwise(out)
    return out


def kelvin_x(kelvin: Column) -> Column:
    return _pieces(kelvin, F.lit(1.0) / kelvin, KELVIN_X)


def kelvin_y(kelvin: Column, x: Column) -> Column:
    return _pieces(kelvin, x, KELVIN_Y)


def contrast(v: Column, slope: Column, pivot: Column) -> Column:
    """A straight slope in log signal about a pivot given in display terms."""
    p = F.greatest(decode(clamp(pivot, 0.01, 0.99)), F.lit(1e-4))
    return F.when((slope == 1) | (v <= 0), v).otherwise(p * F.pow(v / p, slope))


def display_curve(y: Column) -> Column:
    v = F.greatest(y, F.lit(0.0)) * TONE_GAIN
    return v * (v * TONE_TOP + 1) / (v * v * TONE_TOP + v * TONE_SHOULDER + 1)


def tone_ev(y: Column, bands: Column) -> Column:
    """Exposure change for a luminance, from seven bands two stops apart around middle grey."""
    stops = clamp(F.log2(F.when(y > 0, y) / MIDDLE_GREY), -6.0, 6.0)
    at = F.least(F.floor((stops + 6) / 2), F.lit(5)).cast("int")
    t = (stops + 6) / 2 - at
    s = t * t * (F.lit(3.0) - t * 2)
    return F.coalesce(F.element_at(bands, at + 1) * (F.lit(1.0) - s) + F.element_at(bands, at + 2) * s, F.lit(0.0))


def quantised(v: Column, bits: int = 8) -> Column:
    top = (1 << bits) - 1
    return F.floor(clamp(v, 0.0, 1.0) * top + 0.5).cast("int")


def garrote(detail: Column, threshold: Column) -> Column:
    """Shrink detail at or below the threshold to nothing and larger detail less and less."""
    ratio = threshold / detail
    return F.when(threshold <= 0, detail).when(F.abs(detail) <= threshold, F.lit(0.0)).otherwise(
        detail * (F.lit(1.0) - ratio * ratio))


def noise_bin(v: Column) -> Column:
    return F.least(F.floor(F.sqrt(clamp(v, 0.0, 1.0)) * 8), F.lit(7)).cast("int")
