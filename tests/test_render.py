"""Recipes rendered by skeleton against their nodes' own operators, one after another."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shootlake.operators import filters, geometry, grading, measure
from shootlake.operators import recipes as RE
from shootlake.plans import apply as A
from shootlake.sources.tables import RECIPE
from tests.test_pixels import H, W, array_of, frame_of, frames_of, image


def numbers(**kv):
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(float(v)))])


def recipe(nodes):
    """A recipe from (kind, inputs, params, opacity), ids from 1."""
    return F.array(*[RE.node(kind, F.array(*[F.lit(i) for i in ins]), numbers(**params) if params else None, opacity, F.lit(n))
                     for n, (kind, ins, params, opacity) in enumerate(nodes, 1)]).cast(RECIPE)


def rendered(px, fr, nodes, **kw):
    recipes = fr.select("image_id", recipe(nodes).alias("recipe"), F.lit(len(nodes)).alias("recipe_output"))
    (_, out), = A.render_by_skeleton(px, fr, recipes, **kw)
    return out


def test_every_kind_in_one_recipe(spark):
    img = image(11)
    px, fr = frame_of(spark, img), frames_of(spark, orientation=6)
    lens = px.selectExpr("image_id", "y", "x", "x + 0.2 * (x - 10) / 4 AS mx", "y + 0.2 * (y - 8) / 4 AS my")
    nodes = [("optics", [0], {"lens_correction": 1, "lens_correction_strength": 0.7}, 1.0),
             ("white_balance", [1], {"white_balance_temperature": 4600, "white_balance_tint": 3}, 1.0),
             ("exposure", [2], {"exposure": 0.3}, 1.0),
             ("noise_reduction", [3], {"noise_reduction": 0.5}, 1.0),
             ("tone", [4], {"tone_shadows": 0.5}, 1.0),
             ("curves", [5], None, 1.0),
             ("sharpen", [6], {"amount": 0.8, "radius": 1.2, "threshold": 0.4}, 1.0),
             ("crop", [7], {"left": 0.1, "top": 0.1, "width": 0.8, "height": 0.7, "angle": 4}, 1.0),
             ("color_subtract", [8], {"red": 1.4, "green": 1.3, "blue": 1.2}, 1.0),
             ("contrast", [8], {"contrast": 1.3, "pivot": 0.5}, 1.0),
             ("blend", [9, 10], None, 0.3),
             ("rotate", [11], {"quarter_turns": 3}, 1.0),
             ("film", [12], {"grain_amount": 0.7, "grain_size": 1}, 1.0)]
    got = rendered(px, fr, nodes, lens_map=lens)

    def fixed(df):
        return spark.createDataFrame(df.collect(), "image_id long, y int, x int, r double, g double, b double")

    one = F.lit
    at = fixed(geometry.remap(px, lens, fr, one(0.7)))
    asked = fr.withColumns({"kelvin": one(4600.0), "tint": one(3.0)})
    matrix = grading.white_matrix(asked).select("image_id", *[f"w{i}{j}" for i in range(3) for j in range(3)])
    at = grading.exposure(grading.apply_matrix(at.join(matrix, "image_id")), one(0.3)).select("image_id", "y", "x", "r", "g", "b")
    at = fixed(geometry.orient(at, fr))
    up = frames_of(spark, H, W)
    at = fixed(filters.noise_reduction(at, measure.noise_profile(at, up).withColumn("strength", one(0.5))))
    at = fixed(grading.tone(at, F.array(*[one(v) for v in (0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0)])))
    flat = grading.curve_tables(fr.select("image_id"), {"line": F.array(*[one(v) for v in (0.0, 0.0, 1.0, 1.0)])})
    at = fixed(grading.curves(at.join(flat, "image_id"), ("line",) * 3, "line").select("image_id", "y", "x", "r", "g", "b"))
    at = fixed(filters.sharpen(at, measure.noise_profile(at, up).withColumns({"amount": one(0.8), "radius": one(1.2), "threshold": one(0.4)})))
    windows = geometry.crop_window(up, one(0.1), one(0.1), one(0.8), one(0.7))
    at = fixed(geometry.crop_turned(at, windows, one(4.0)))
    size = windows.first()
    at = fixed(grading.blend(grading.color_subtract(at, (one(1.4), one(1.3), one(1.2))), grading.contrast(at, one(1.3), one(0.5)), 0.3))
    at = fixed(geometry.rotate(at, frames_of(spark, size["cw"], size["ch"]), one(3)))
    at = grading.grain(grading.to_display(at), one(0.7), one(1.0), one(7).cast("long"))
    w, h = size["ch"], size["cw"]
    np.testing.assert_allclose(array_of(got, w, h), array_of(at, w, h), atol=1e-9)
    assert got.count() == w * h


def test_photos_of_one_skeleton_share_a_plan(spark):
    """Different point nodes, different numbers of them, and forks are data; a blend within a fork joins no pixels."""
    img = image(12)
    px = frame_of(spark, img, 1).unionByName(frame_of(spark, img, 2)).unionByName(frame_of(spark, img, 3))
    fr = frames_of(spark).unionByName(frames_of(spark).withColumn("image_id", F.lit(2).cast("long"))).unionByName(
        frames_of(spark).withColumn("image_id", F.lit(3).cast("long")))
    chains = {1: [("exposure", [0], {"exposure": 0.5}, 1.0), ("blend", [0, 1], None, 0.4), ("contrast", [2], {"contrast": 1.2, "pivot": 0.4}, 1.0)],
              2: [("tone", [0], {"tone_highlights": 0.3}, 1.0), ("contrast", [1], {"contrast": 0.8, "pivot": 0.4}, 1.0), ("blend", [0, 2], None, 0.4)],
              3: [("exposure", [0], {"exposure": -0.5}, 1.0), ("film", [1], {"grain_amount": 0.5, "grain_size": 1}, 1.0)]}
    cases = F.when(F.col("image_id") == 1, recipe(chains[1])).when(F.col("image_id") == 2, recipe(chains[2])).otherwise(recipe(chains[3]))
    recipes = fr.select("image_id", cases.alias("recipe")).withColumn("recipe_output", F.size("recipe"))
    parts = list(A.render_by_skeleton(px, fr, recipes))
    assert len(parts) == 2
    for key, df in parts:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert json.loads(key)[0] in (["blend"], [])
        # frames and parameters are joined by photo, never pixels with pixels
        assert not [line for line in plan.splitlines() if "Join" in line and "y#" in line], plan
    got = parts[0][1].unionByName(parts[1][1])
    for i, chain in chains.items():
        at = {0: frame_of(spark, img, i)}
        shown = False
        for n, (kind, ins, p, opacity) in enumerate(chain, 1):
            b = at[ins[0]]
            if kind == "exposure":
                at[n] = grading.exposure(b, F.lit(p["exposure"]))
            elif kind == "contrast":
                at[n] = grading.contrast(b, F.lit(p["contrast"]), F.lit(p["pivot"]))
            elif kind == "tone":
                bands = spark.range(1).select(RE.packed(RE.node("tone", F.array(F.lit(0)), numbers(**p))).alias("p")).first()["p"]
                at[n] = grading.tone(b, F.array(*[F.lit(v) for v in bands]))
            elif kind == "blend":
                at[n] = grading.blend(b, at[ins[1]], opacity)
            else:
                at[n], shown = grading.grain(grading.to_display(b), F.lit(p["grain_amount"]), F.lit(p["grain_size"]).cast("double"), F.lit(7).cast("long")), True
        want = at[len(chain)] if shown else grading.to_display(at[len(chain)])
        np.testing.assert_allclose(array_of(got.where(F.col("image_id") == i)), array_of(want), atol=1e-9)


def test_rendering_goes_on_with_missing_parts(spark, tmp_path):
    px, fr = frame_of(spark, image(13)), frames_of(spark)
    recipes = fr.select("image_id", recipe([("exposure", [0], {"exposure": 0.5}, 1.0)]).alias("recipe"), F.lit(1).alias("recipe_output"))
    first = array_of(A.render_to(str(tmp_path / "out"), px, fr, recipes))
    parts = sorted(p.name for p in (tmp_path / "out").iterdir())
    stamps = [(tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in parts]
    np.testing.assert_array_equal(array_of(A.render_to(str(tmp_path / "out"), px, fr, recipes)), first)
    assert [(tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in parts] == stamps
    (tmp_path / "out" / parts[0] / "_SUCCESS").unlink()
    np.testing.assert_array_equal(array_of(A.render_to(str(tmp_path / "out"), px, fr, recipes)), first)
    assert A.render_to(str(tmp_path / "none"), px, fr, recipes.limit(0)).count() == 0


def test_lens_correction_without_a_map_is_told(spark):
    fr = frames_of(spark)
    on = recipe([("optics", [0], {"lens_correction": 1}, 1.0)])
    off = recipe([("optics", [0], {"lens_correction": 0}, 1.0)])
    for asked, want in ((on, 1), (off, 0)):
        rows = A.prepared(fr.select("image_id", asked.alias("recipe"), F.lit(1).alias("recipe_output")))
        assert A.warnings(rows, None).count() == want
        lens = spark.createDataFrame([(1, 0, 0, 0.0, 0.0)], "image_id long, y int, x int, mx double, my double")
        assert A.warnings(rows, lens).count() == 0
        assert A.warnings(rows, lens.where("image_id = 2")).count() == want


@pytest.mark.parametrize("kinds, want", [(["exposure"], []), (["crop"], ["crop"]), (["optics", "tone", "crop"], ["optics", "crop"])])
def test_skeletons(kinds, want):
    shape = json.dumps({"nodes": [{"id": n, "kind": k, "inputs": [n - 1]} for n, k in enumerate(kinds, 1)], "output": len(kinds)})
    skeleton, runs, cut = A.skeleton_of(shape)
    assert list(skeleton.kinds) == want and len(runs) == len(cut) + 1 and runs[-1][-1] == ("display", 0)
