"""Windows against the same pixels of whole frames."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shootlake.operators import geometry
from shootlake.plans import apply as A
from shootlake.plans import window
from shootlake.sources import tables
from tests.test_pixels import array_of, frame_of, frames_of, image
from tests.test_render import recipe

WIDE, HIGH = 72, 60


def asked_of(spark, rect, image_id=1):
    return spark.createDataFrame([(image_id, *rect)], "image_id long, left double, top double, wide double, high double")


def plane(rows, width, height):
    out = np.full((height, width, 3), np.nan)
    out[rows.y, rows.x] = rows[["r", "g", "b"]]
    return out


def held_against(whole, part, rect, width, height):
    """The window holds the whole frame's pixels inside the rectangle and no others."""
    x0, y0 = int(np.floor(rect[0] * width)), int(np.floor(rect[1] * height))
    x1, y1 = min(int(np.ceil((rect[0] + rect[2]) * width)), width), min(int(np.ceil((rect[1] + rect[3]) * height)), height)
    got = plane(part, width, height)
    np.testing.assert_allclose(got[y0:y1, x0:x1], whole[y0:y1, x0:x1], atol=1e-9)
    assert len(part) == (y1 - y0) * (x1 - x0)


def recipes_of(fr, nodes):
    return fr.select("image_id", recipe(nodes).alias("recipe"), F.lit(len(nodes)).alias("recipe_output"))


POINTS = [("exposure", [0], {"exposure": 0.4}, 1.0), ("tone", [1], {"tone_shadows": 0.2}, 1.0), ("film", [2], {"grain_amount": 0.4, "grain_size": 2}, 1.0)]
PLACES = [("optics", [0], {"lens_correction": 1, "lens_correction_strength": 0.7}, 1.0), ("exposure", [1], {"exposure": 0.3}, 1.0),
          ("crop", [2], {"left": 0.1, "top": 0.05, "width": 0.8, "height": 0.75, "angle": 6}, 1.0),
          ("crop", [3], {"left": 0.05, "top": 0.1, "width": 0.9, "height": 0.85}, 1.0),
          ("contrast", [3], {"contrast": 1.2, "pivot": 0.5}, 1.0), ("crop", [5], {"left": 0.05, "top": 0.1, "width": 0.9, "height": 0.85}, 1.0),
          ("blend", [4, 6], None, 0.4), ("rotate", [7], {"quarter_turns": 3}, 1.0), ("film", [8], {"grain_amount": 0.5, "grain_size": 1}, 1.0)]
RECTS = [(0.25, 0.25, 0.5, 0.5), (0.0, 0.0, 0.2, 0.15), (0.75, 0.8, 0.25, 0.2)]


@pytest.mark.parametrize("nodes", [POINTS, PLACES], ids=["points", "places"])
def test_windows_equal_whole_frames(spark, nodes):
    """Frames of four orientations, each with a window of its own, in one plan."""
    img = image(21, WIDE, HIGH)
    turns = {1: 1, 2: 5, 3: 6, 4: 8}
    px = frame_of(spark, img).withColumn("image_id", F.explode(F.array(*[F.lit(i).cast("long") for i in turns]))).checkpoint()
    fr = frames_of(spark, WIDE, HIGH).withColumn("image_id", F.explode(F.array(*[F.lit(i).cast("long") for i in turns]))).withColumn(
        "orientation", F.element_at(F.array(*[F.lit(t) for t in turns.values()]), F.col("image_id").cast("int")))
    lens = px.where("image_id < 4").selectExpr("image_id", "y", "x", "x + 0.1 * (x - 36) / 4 AS mx", "y + 0.1 * (y - 30) / 4 AS my")
    recipes = recipes_of(fr, nodes)
    rects = dict(zip(turns, [*RECTS, RECTS[1]]))
    asked = spark.createDataFrame([(i, *r) for i, r in rects.items()], "image_id long, left double, top double, wide double, high double")
    (_, df), = A.render_by_skeleton(px, fr, recipes, lens_map=lens, tile=32)
    (_, part), = window.render(partial(geometry.cut, px), fr, recipes, asked, lens_map=lens, tile=32)
    whole, part = df.toPandas(), part.toPandas()
    for i, rect in rects.items():
        mine = whole[whole.image_id == i]
        width, height = mine.x.max() + 1, mine.y.max() + 1
        assert len(mine) == width * height
        held_against(plane(mine, width, height), part[part.image_id == i], rect, width, height)
    (_, _, table), = window.regions(fr, recipes, asked, lens_map=lens)
    for r in table.select("r0.*").collect():
        assert 0 < (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) < 0.6 * WIDE * HIGH


def test_filters_go_by_the_noise_of_the_whole_frame(spark):
    px, fr = frame_of(spark, image(22, 150, 90)), frames_of(spark, 150, 90, 6)
    nodes = [("exposure", [0], {"exposure": 0.2}, 1.0), ("noise_reduction", [1], {"noise_reduction": 0.6}, 1.0),
             ("sharpen", [2], {"amount": 0.8, "radius": 1.2, "threshold": 0.4}, 1.0), ("rotate", [3], {"quarter_turns": 1}, 1.0)]
    recipes, rect = recipes_of(fr, nodes), (0.0, 0.1, 0.2, 0.3)
    (_, df), = A.render_by_skeleton(px, fr, recipes)
    whole = array_of(df, 150, 90)
    found = list(A.noise_profiles(px, fr, recipes))
    assert len(found) == 2
    profiles = found[0].unionByName(found[1]).checkpoint()
    (_, part), = window.render(partial(geometry.cut, px), fr, recipes, asked_of(spark, rect), profiles=profiles)
    held_against(whole, part.toPandas(), rect, 150, 90)
    (_, _, table), = window.regions(fr, recipes, asked_of(spark, rect))
    r = table.first()["r0"]
    assert (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) < 150 * 90


def test_only_bands_of_the_window_are_scanned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BAND", 16)
    px, fr = frame_of(spark, image(23, 24, 64)), frames_of(spark, 24, 64)
    more = [px.withColumn("image_id", F.lit(i).cast("long")) for i in (2, 3)]
    path = str(tmp_path / "px")
    tables.write_pixels(px.unionByName(more[0]).unionByName(more[1]), path, 4)
    recipes, rect = recipes_of(fr, POINTS), (0.2, 0.1, 0.5, 0.1)
    read = partial(tables.read_regions, spark, path, buckets=4)
    (_, part), = window.render(read, fr, recipes, asked_of(spark, rect))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan.split("PartitionFilters: [", 1)[1].split("\n", 1)[0] or plan.count("dynamicpruning") >= 2, plan
    (_, df), = A.render_by_skeleton(px, fr, recipes)
    held_against(array_of(df, 24, 64), part.toPandas(), rect, 24, 64)
    (_, _, table), = window.regions(fr, recipes, asked_of(spark, rect))
    rects = table.select("image_id", "r0.*")
    found = read(rects).select("image_id", "y").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("y").alias("n")).first()
    assert (found["low"], found["high"], found["n"]) == (6, 12, 7 * 13)


def test_windows_without_pixels(spark):
    fr = frames_of(spark)
    recipes = recipes_of(fr, POINTS)
    cases = {(1.0, 0.0, 0.5, 0.5): None, (-0.5, 0.0, 0.4, 1.0): None, (-0.5, -0.5, 3.0, 3.0): (0, 0, 21, 17), (0.5, 0.5, 0.1, 0.1): (10, 8, 13, 11)}
    for rect, want in cases.items():
        (_, _, table), = window.regions(fr, recipes, asked_of(spark, rect))
        assert [tuple(r) for r in table.select("r0.*").collect()] == ([want] if want else [])
    (_, none), = window.render(partial(geometry.cut, frame_of(spark, image(24))), fr, recipes, asked_of(spark, RECTS[0], image_id=9))
    assert none.count() == 0
