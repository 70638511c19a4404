"""Exact search, hard negatives and the Merkle manifest against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shootlake.llm import exact_top_k, hard_negatives, hyperplane_tree, merkle_manifest, queries, vectors

# further columns bear names that the operators use
SCHEMA = "vec_id long, embedding array<float>, label int, id long, row long, v string, leaf int, score int, least int, grp string"


def numbers(rng, n, length, groups):
    """Vectors around a few centres, of different lengths, with exact copies."""
    centres = rng.normal(size=(groups, length))
    out = centres[rng.integers(groups, size=n)] + rng.normal(scale=0.15, size=(n, length))
    out *= rng.choice([0.05, 0.3, 1.0, 4.0], size=(n, 1))
    out[n // 3:n // 2] = out[0]
    return out.astype(np.float32)


def odd_rows(seed, n, length=6, groups=4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], int(rng.integers(4))) for i, v in enumerate(numbers(rng, n, length, groups))]
    rows += [(n, None, 1), (n + 1, [math.nan] * length, 1), (n + 2, [math.inf] + [0.0] * (length - 1), 2), (n + 3, [None] * length, 0),
             (n + 4, [], 1), (n + 5, [1.0, 2.0], 2), (n + 6, [0.0] * length, 3), (None, rows[3][1], 1), (0, rows[0][1], 0), (0, rows[1][1], 0),
             (10, rows[2][1], None), (None, None, None), (100, rows[1][1], 1), (100, rows[1][1], 1)]
    return [(*r, 5, 6, "x", 7, 8, 9, "g") for r in rows]


def taking_part(rows, scale):
    """(id, whole numbers, label) as the contract has it."""
    out = []
    for r in rows:
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            out.append((r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def late(i):
    return (i is None, i or 0)


def top_by_force(rows, k, scale, asks):
    part, out = taking_part(rows, scale), []
    for q, (i, v, _) in enumerate(part):
        if i is not None and asks(i):
            found = sorted((-dot(v, w), late(j)) for c, (j, w, _) in enumerate(part) if c != q)[:k]
            out += [(i, n + 1, None if j[0] else j[1], -s) for n, (s, j) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, n, factor", [(1, 400, 1), (3, 5, 1e4)])
def test_top_k(spark, monkeypatch, seed, n, factor):
    monkeypatch.setattr(exact_top_k, "BUCKET", 32)
    monkeypatch.setattr(exact_top_k, "SEED", 20)
    rows = [(r[0], r[1] and [x and x * factor for x in r[1]], *r[2:]) for r in odd_rows(seed, n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_top_k.find(df, F.col("vec_id") % 10 == 0, k=7, scale=1024)
    assert sorted(map(tuple, got.collect()), key=str) == top_by_force(rows, 7, 1024, lambda i: i % 10 == 0)


def test_buckets_are_pruned_by_coordinates_and_length():
    rng = np.random.default_rng(5)
    v = np.floor(1024 * numbers(rng, 3000, 16, 40)).astype(np.int64)
    v = v[np.argsort(-(v.astype(float) ** 2).sum(axis=1), kind="stable")]
    ids = rng.permutation(len(v))
    bucket = exact_top_k.Bucket(ids, ids, v, True)
    products = v[:50] @ v.T
    for q in range(50):
        length = math.sqrt(float((v[q] ** 2).sum()))
        for cosine in (0.8, 0.95, 0.999, 1.0):
            places = set(bucket.by_coordinates(v[q], length, cosine).tolist())
            real = products[q] / (length * np.maximum(bucket.lengths, 1e-9))
            assert set(np.nonzero(real >= cosine)[0].tolist()) <= places
            assert len(places) < len(v)
    least = np.sort(products, axis=1)[:, -10]
    r, c, s = bucket.search(v[:50], np.full(50, -1), np.sqrt((v[:50].astype(float) ** 2).sum(axis=1)), least, 10)
    for q in range(50):
        want = sorted((-products[q, j], ids[j]) for j in range(len(v)))[:10]
        assert [(-a, ids[b]) for a, b in zip(s[r == q], c[r == q])] == want


def negatives_by_force(rows, asks):
    part = [(i, v, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in taking_part(rows, 256)]
    part, out = [p for p in part if p[2] is not None], []
    for q, (i, v, lab) in enumerate(part):
        if i is None or not asks(i):
            continue
        scored = sorted((-dot(v, w), late(j), other) for c, (j, w, other) in enumerate(part) if c != q)
        for s, j, _ in [x for x in scored if x[2] == lab][:5]:
            window = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, None if j[0] else j[1], n + 1, None if k[0] else k[1], -s, -t) for n, (t, k, _) in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, n, factor", [(1, 500, 1), (4, 60, 1e5)])
def test_hard_negatives(spark, monkeypatch, seed, n, factor):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    rows = [(r[0], r[1] and [x and x * factor for x in r[1]], *r[2:]) for r in odd_rows(seed, n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, label).drop("anchor_row")
    assert sorted(map(tuple, got.collect()), key=str) == negatives_by_force(rows, lambda i: i % 10 == 0)


def test_siblings_are_eliminated_only_when_they_hold_nothing():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 8))
    v = centres[rng.integers(60, size=4000)] + rng.normal(scale=0.1, size=(4000, 8))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    tree = hyperplane_tree.Tree(v[rng.permutation(len(v))[:500]], float((v.astype(float) ** 2).sum(axis=1).max()))
    leaf, ranges = tree.place(v)
    tree.learn(ranges)
    asked = v[:80]
    square = (asked.astype(float) ** 2).sum(axis=1)
    near, far = tree.reach(asked)
    scores = asked @ v.T
    low, high = np.sort(scores, axis=1)[:, -40], np.sort(scores, axis=1)[:, -10]
    annulus = tree.annulus(square, low, high)
    visited = np.stack([tree.visits(near[:, k], far[:, k], annulus) for k in range(near.shape[1])], axis=1)
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert all(visited[a, leaf[x]] for a, x in zip(*np.nonzero(inside)))
    full = np.unique(leaf)
    assert visited[:, full].mean() < 0.6  # most leaves are never looked at


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    label = F.col("label")
    assert exact_top_k.find(none, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0, label).count() == 0
    alone = spark.createDataFrame(odd_rows(1, 4)[:1], SCHEMA)
    assert exact_top_k.find(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0, label).count() == 0
    with pytest.raises(TypeError):
        exact_top_k.find(alone.withColumn("vec_id", F.lit("a")), F.lit(True))


def test_best_breaks_ties_by_id():
    scores = np.array([[5, 5, 7, 5], [vectors.OUT, 1, vectors.OUT, vectors.OUT]])
    r, c = vectors.best(scores, np.array([9, 2, 4, 3]), 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 2), (0, 1), (1, 1)]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def manifest_by_force(rows, fanout=16):
    """Rows (doc_id, text, lang, source, n_chars) to the contract's rows."""
    def leaf(r, text):
        return digest(*(framed(x) for x in (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels_of([leaf(r, r[1]) for r in groups[s]], fanout) for s in names}
    upper = levels_of([trees[s][-1][0] for s in names], fanout)
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf(r, lowered(r[1]) if low else r[1]), []
            for levels, k in ((trees[s], i), (upper, place)):
                for level in levels[:-1]:
                    start = k // fanout * fanout
                    before, after = level[start:k], level[k + 1:start + fanout]
                    node, k = digest(*before, node, *after), k // fanout
                    proof += before + after
            root = upper[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, digest(*proof), node, node == root))
    return sorted(out, key=str)


def test_manifest_query_on_odd_tables(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = queries.op12_merkle_manifest(spark, str(tmp_path / "odd")).collect()
    want = manifest_by_force([tuple(r)[:5] for r in odd.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert queries.op12_merkle_manifest(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_trees(spark, fanout):
    rows = [(i * 7 % 400 - 100, f"Text {i}", "en", None if i % 11 == 0 else f"s{i % 3 if i % 2 else i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    manifest = merkle_manifest.build(df, merkle_manifest.leaf_of(fields), F.col("source"), "doc_id", {"grp2": F.col("source")}, fanout)
    got = manifest.proofs().select(
        "id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")),
        merkle_manifest.folded(F.col("leaf"), F.col("path")).alias("again")).withColumn("same", F.col("again") == F.col("root"))
    want = [(*w[:5], w[3], True) for w in manifest_by_force(rows, fanout)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
