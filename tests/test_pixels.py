"""Pixel operators against brute force and against themselves cut into small tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shootlake.functions import bits
from shootlake.functions import colour as K
from shootlake.operators import filters, geometry, grading, measure

W, H = 21, 17
LUMA = np.array(K.LUMA_ROUNDED)


def image(seed=1, w=W, h=H):
    return np.random.default_rng(seed).uniform(0.05, 0.9, (h, w, 3))


def frame_of(spark, img, image_id=1):
    h, w, _ = img.shape
    rows = [(image_id, y, x, *map(float, img[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")


def frames_of(spark, w=W, h=H, orientation=1):
    return spark.createDataFrame([(1, w, h, w * h, orientation, 5000.0, 7)],
                                 "image_id long, width int, height int, full_pixels long, orientation int, as_shot_kelvin double, grain_seed long")


def array_of(df, w=W, h=H):
    out = np.full((h, w, 3), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def blurred(src, guide, step, amount=1.0):
    out = src
    for axis in (1, 0):
        n = src.shape[axis]
        total, weight = np.zeros_like(src), np.zeros_like(src)
        sigma = 0.012 + 0.055 * np.sqrt(np.maximum(guide, 0))
        for k, o in zip((1, 4, 6, 4, 1), (-2, -1, 0, 1, 2)):
            at = np.clip(np.arange(n) + o * step, 0, n - 1)
            w = k / (1 + ((np.take(guide, at, axis) - guide) / sigma) ** 2)
            total, weight = total + w * np.take(out, at, axis), weight + w
        out = total / weight
    return src + (out - src) * amount


def shrunk(d, t):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(t <= 0, d, np.where(np.abs(d) <= t, 0, d * (1 - (t / d) ** 2)))


def halved(p):
    h, w = p.shape
    p = np.pad(p, ((0, h % 2), (0, w % 2)), mode="edge")
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4


def doubled(p, w, h):
    def line(q, n, axis):
        at = (np.arange(n) - 0.5) / 2
        low = np.maximum(np.floor(at), 0).astype(int)
        high = np.minimum(low + 1, q.shape[axis] - 1)
        f = np.clip(at - low, 0, 1).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(q, low, axis) * (1 - f) + np.take(q, high, axis) * f
    return line(line(p, w, 1), h, 0)


def denoised(img, strength, deviations):
    y = img @ LUMA
    noise = np.array(deviations)[np.minimum((np.sqrt(np.clip(y, 0, 1)) * 8).astype(int), 7)] * strength
    one = blurred(y, y, 1)
    two = blurred(one, y, 2)
    clean = two + shrunk(one - two, 0.5 * noise) + shrunk(y - one, 2.25 * noise)
    guide = halved(clean)
    planes = []
    for c in (2, 0):
        p = halved(img[..., c] - y)
        padded = np.pad(p, 1, mode="edge")
        stack = [padded[i:i + p.shape[0], j:j + p.shape[1]] for i in range(3) for j in range(3)]
        p = p + (np.median(stack, axis=0) - p) * min(1.5 * strength, 1)
        for step, amount in ((1, min(1.8 * strength, 1)), (2, min(1.25 * strength, 1)), (4, np.clip((strength - .2) * 1.25, 0, 1))):
            p = blurred(p, guide, step, amount)
        planes.append(doubled(p, img.shape[1], img.shape[0]))
    blue, red = clean + planes[0], clean + planes[1]
    return np.stack([red, (clean - LUMA[0] * red - LUMA[2] * blue) / LUMA[1], blue], axis=-1)


@pytest.mark.parametrize("tile", [512, 64])
def test_noise_reduction_matches_brute_force(spark, tile):
    img = image()
    dev = [0.02, 0.03, 0.04, 0.05, 0.05, 0.06, 0.06, 0.07]
    settings = spark.createDataFrame([(1, 0.6, dev)], "image_id long, strength double, deviations array<double>")
    got = array_of(filters.noise_reduction(frame_of(spark, img), settings, tile))
    np.testing.assert_allclose(got, denoised(img, 0.6, dev), atol=1e-9)


def test_small_tiles_change_nothing(spark):
    img = image(2)
    px, fr = frame_of(spark, img), frames_of(spark)
    sharp = fr.selectExpr("image_id", "1.2D AS amount", "1.0D AS radius", "0.3D AS threshold", "array_repeat(0.02D, 8) AS deviations")
    whole = array_of(filters.sharpen(px, sharp))
    np.testing.assert_allclose(array_of(filters.sharpen(px, sharp, 20)), whole, atol=1e-12)
    lens = px.selectExpr("image_id", "y", "x", "x + 0.3 * (x - 10) AS mx", "y + 0.3 * (y - 8) AS my")
    bent = array_of(geometry.remap(px, lens, fr, F.lit(0.8)))
    np.testing.assert_allclose(array_of(geometry.remap(px, lens, fr, F.lit(0.8), 5)), bent, atol=1e-12)
    profile = measure.noise_profile(px, fr).first()["deviations"]
    assert measure.noise_profile(px, fr, 4).first()["deviations"] == profile


def test_strength_zero_leaves_pixels(spark):
    img = image(3)
    settings = spark.createDataFrame([(1, 0.0, [0.1] * 8)], "image_id long, strength double, deviations array<double>")
    np.testing.assert_array_equal(array_of(filters.noise_reduction(frame_of(spark, img), settings)), img)


def test_point_maths_invariants(spark):
    img = image(4)
    px, fr = frame_of(spark, img), frames_of(spark)
    twice = grading.contrast(grading.contrast(px, F.lit(1.5), F.lit(0.4)), F.lit(2.0), F.lit(0.4))
    np.testing.assert_allclose(array_of(twice), array_of(grading.contrast(px, F.lit(3.0), F.lit(0.4))), rtol=1e-9)
    same = fr.selectExpr("image_id", "as_shot_kelvin", "as_shot_kelvin AS kelvin", "0D AS tint")
    matrix = grading.white_matrix(same).select("image_id", *[f"w{i}{j}" for i in range(3) for j in range(3)])
    np.testing.assert_allclose(array_of(grading.apply_matrix(px.join(matrix, "image_id"))), img, atol=1e-6)
    zero = grading.tone(px, F.array(*[F.lit(0.0)] * 7))
    np.testing.assert_array_equal(array_of(zero), img)
    line = grading.curve_tables(fr.select("image_id"), {"c": F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])})
    np.testing.assert_allclose(array_of(grading.curves(px.join(line, "image_id"), ("c", "c", "c"), "c")), img, atol=1e-9)
    grey = px.withColumns({"g": F.col("r"), "b": F.col("r")})
    shown = array_of(grading.display_tone(grey))
    np.testing.assert_allclose(shown[..., 0], shown[..., 2], atol=1e-12)
    np.testing.assert_array_equal(array_of(grading.blend(px, zero, 0.5)), img)


def test_turns_lose_nothing(spark):
    img = image(5)
    px, fr = frame_of(spark, img), frames_of(spark)
    np.testing.assert_array_equal(array_of(geometry.rotate(px, fr, F.lit(1)), H, W), np.rot90(img, -1))
    np.testing.assert_array_equal(array_of(geometry.rotate(px, fr, F.lit(2))), np.rot90(img, 2))
    flat = px.withColumns({c: F.lit(0.25) for c in "rgb"})
    small = geometry.downscale(flat, geometry.target_size(fr, F.lit(6), F.lit(0)))
    rows = small.collect()
    assert len(rows) == 6 * 5 and all(abs(r["g"] - 0.25) < 1e-12 for r in rows)


def test_splitmix64(spark):
    def ref(v):
        m = (1 << 64) - 1
        v = (v + 0x9E3779B97F4A7C15) & m
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & m
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & m
        return v ^ v >> 31
    values = [0, 1, 2**63, 2**64 - 1, 0x0123456789ABCDEF]
    df = spark.createDataFrame([(bits.signed(v),) for v in values], "v long")
    assert [r["h"] for r in bits.splitmix64(df, "h", "v").collect()] == [bits.signed(ref(v)) for v in values]


def test_focus_recovers_its_blur(spark):
    """Vertical bars blurred by a known sigma read as that sigma; a featureless frame says nothing."""
    n, sigma = 160, 1.6
    from math import erf, sqrt
    x = np.arange(n)
    edge = sum((-1) ** i * np.array([0.5 * (1 + erf((v - 12.5 - 20 * i) / (sqrt(2) * sigma))) for v in x]) for i in range(7))
    level = 0.2 + 0.5 * edge
    linear = np.where(level <= 0.04045, level / 12.92, ((level + 0.055) / 1.055) ** 2.4)
    img = np.repeat(np.repeat(linear[None, :, None], 128, 0), 3, 2)
    report = measure.measure_focus(frame_of(spark, img), frames_of(spark, n, 128)).first()
    assert abs(report["blur"] / (1600 / n) - sigma) < 0.1 and report["judgeable"] > 0
    flat = measure.measure_focus(frame_of(spark, np.full((64, 64, 3), 0.3)), frames_of(spark, 64, 64)).first()
    assert (flat["blur"], flat["typical"], flat["judgeable"]) == (8.0, 8.0, 0.0)


def test_negative_tile_is_found(spark):
    img = np.full((80, 100, 3), 0.6)
    img[20:60, 30:80] = np.random.default_rng(1).uniform(0.01, 0.2, (40, 50, 3))
    found = measure.negative_frames(frame_of(spark, img), frames_of(spark, 100, 80)).first()
    assert abs(found["rect_left"] - 0.315) < 0.011 and abs(found["rect_width"] - 0.47) < 0.021
    assert abs(found["rect_top"] - 0.265) < 0.013 and abs(found["base_r"] - 0.6) < 1e-9 and found["angle"] == 0.0


def test_edges_apart_by_just_the_limit_agree(spark):
    """Over 25 rows two slopes differ by 0.03 where their rises differ by 39: the tilt is their mean, however sums are rounded."""
    rng, rows, want = np.random.default_rng(3), [], {}
    y = np.arange(2, 27)
    while len(want) < 24:
        left, right = rng.integers(4, 16, 25), rng.integers(44, 56, 25)
        a, b = ((e * (y - 14)).sum() for e in (left, right))
        if abs(a - b) == 39 and abs(a + b) > 20:
            rows += [(len(want), int(v), int(x), False) for e in (left, right) for v, x in zip(y, e)]
            want[len(want)] = np.clip(np.degrees(np.arctan((a + b) / 2 / 1300)), -7, 7)
    spans = spark.createDataFrame([(i, 64, 0, 29, 10, 40) for i in want],
                                  "image_id long, width int, row_start int, row_length int, column_start int, column_length int")
    got = {r["image_id"]: r["tilt"] for r in measure.tilt(spark.createDataFrame(rows, "image_id long, y int, x int, like boolean"), spans).collect()}
    assert got == pytest.approx(want, abs=1e-9)
