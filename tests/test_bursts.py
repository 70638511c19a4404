import random

import pytest
from pyspark.sql import functions as F

from shootlake.operators import bursts as B
from shootlake.operators import ordered

BASE = 3989487541
SCHEMA = "project_id long, seq long, key string, seconds long, signature long"


def groups(spark, entries, width=ordered.DEFAULT_WIDTH, **kw):
    df = spark.createDataFrame([(1, i, k, s, g) for i, (k, s, g) in enumerate(entries)], SCHEMA)
    rows = B.index(df, width=width, **kw).orderBy("seq").collect()
    out = []
    for r in rows:
        if r["place"] == 0:
            out.append([])
        out[-1].append(r["key"])
        assert r["burst"] == len(out) - 1
        assert r["boundary"] == (r["place"] == 0 and r["burst"] > 0)
    for r in rows:
        assert r["size"] == len(out[r["burst"]])
    return out


CASES = [
    ([("a", BASE, 0), ("b", BASE + 2, 0), ("c", BASE + 4, 0)], [["a", "b", "c"]]),
    ([("a", BASE, 0), ("b", BASE + 4, 0)], [["a"], ["b"]]),
    ([("a", BASE, 0), ("b", BASE + 1, (1 << 13) - 1)], [["a"], ["b"]]),
    ([("a", BASE, 0), ("b", BASE + 1, (1 << 12) - 1)], [["a", "b"]]),
    ([("a", BASE, None), ("b", BASE + 1, -1), ("c", BASE + 2, None)], [["a", "b", "c"]]),
    ([("a", None, 0), ("b", BASE, 0), ("c", None, 0)], [["a"], ["b"], ["c"]]),
    ([("a", BASE + 2, 0), ("b", BASE, 0)], [["a", "b"]]),
]


@pytest.mark.parametrize("entries,expected", CASES)
@pytest.mark.parametrize("width", [1 << 20, 2])
def test_hand_cases(spark, entries, expected, width):
    assert groups(spark, entries, width) == expected


def test_chunks_agree_with_one_window(spark):
    rng = random.Random(7)
    rows, t = [], BASE
    for seq in range(600):
        t += rng.choice([0, 1, 2, 3, 4, 9])
        rows.append((0 if rng.random() < .7 else rng.randrange(1, 5), seq, f"k{seq}",
                     None if rng.random() < .1 else t, None if rng.random() < .1 else rng.getrandbits(20)))
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["project_id", "seq", "burst", "place", "size", "boundary", "distance"]
    whole = B.index(df, 3, 9).select(*cols).orderBy("seq").collect()
    for width in (1, 7, 64):
        assert B.index(df, 3, 9, width=width).select(*cols).orderBy("seq").collect() == whole


def test_pick_rank_is_exact(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random() * 3 - 1, 1.0, 0.25])) for g in range(3) for _ in range(101 + g)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: (r["picked"], r["n"]) for r in
           ordered.pick_rank(df, ["g"], "v", F.floor(F.col("n") / 2)).collect()}
    for g in range(3):
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == (values[len(values) // 2], len(values))


def test_strip_folds_only_real_bursts(spark):
    df = spark.createDataFrame([(1, i, k, s, 0) for i, (k, s) in enumerate(
        [("a", 0), ("b", 1), ("c", 50), ("d", 100), ("e", 101)])], SCHEMA)
    index = B.index(df)
    open_last = index.where("key = 'd'").select("project_id", "burst")
    rows = [(r["key"], r["stands_for"]) for r in B.strip(index, open_last).orderBy("seq").collect()]
    assert rows == [("a", 2), ("c", 1), ("d", 1), ("e", 1)]
