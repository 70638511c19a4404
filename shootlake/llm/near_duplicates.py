"""Near duplicates by SetSketch registers.

A document's set is that of its distinct word shingles, held as 64-bit hashes. Documents with equal sets form a class,
represented by its smallest id. Every class gets a SetSketch: each register keeps the largest level reached, levels being
exponentially spaced, so that sketches of parts merge by maximum and equal registers tell similar sets. An element visits
the registers in an order of its own, with values from intervals that follow one another; once a document's registers are
full, later rounds cannot change them.

Links are found in two passes, each confirmed on the full sets:
1. Bands of registers are hashed. In every bucket the members meet only the bucket's smallest member; the pairs'
   similarity is estimated by joint maximum likelihood from the registers and the known sizes, and each document verifies
   its most promising partner first. Verified links give components.
2. Buckets whose members still belong to several components are compared in blocks: members outside the bucket's
   largest component against all. Pairs whose estimate can reach the threshold are compared by their FINE smallest
   shingle hashes, which are the whole set of most documents; of pairs found equal enough that way one for each member and
   component goes on to be verified, of large sets, where that too is an estimate, all. Then components are closed again.
Nothing is capped: a bucket of any size is split into blocks of bounded size, and pairs within one component are never made.
A pair at the threshold shares no band with probability (1-0.8^ROWS)^BANDS, about 3e-6, and is estimated below a
bound of SLACK deviations with a like one; all else is exact.

Defined results: words are cut at white space and lower-cased in A-Z; a text with fewer words than a shingle is one shingle
of all its words; null, empty and blank texts have an empty set and link with nothing; rows with null id likewise; repeated
rows fall into one class; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shootlake.llm.pieces import mixed
from shootlake.llm.ragged import offsets_of
from shootlake.llm.shared import ids_and_texts, settle

REGISTERS, BASE, RATE, TOP = 251, 1.001, 20.0, 65535  # a prime number of registers
ROWS, BANDS = 6, 41
#: Deviations that an estimate may lie below the threshold and still be verified.
SLACK = 5.0
#: Members of a bucket compared at once, and hashes of each held for it.
BLOCK, FINE = 256, 600
#: Characters handled at once inside a worker.
CHUNK = 1_000_000


# --- sets

def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, as (flat, offsets)."""
    flats, counts, at = [np.zeros(0, np.uint64)], [], 0
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # bytes: only A-Z change
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (size < CHUNK or end == at):
            size += len(raw[end])
            end += 1
        data = np.frombuffer(b"\n".join(raw[at:end]) + b"\n", np.uint8)
        firsts = offsets_of(np.array([len(r) + 1 for r in raw[at:end]]))
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
        starts, ends = edge[::2], edge[1::2]
        place = np.arange(len(data), dtype=np.int64)
        base = np.zeros(len(data), np.int64)
        base[starts] = starts
        place -= np.maximum.accumulate(base)
        value = mixed(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        word = mixed(sums[ends] - sums[starts])
        bounds = np.searchsorted(starts, firsts)
        for k in range(end - at):
            w = word[bounds[k]:bounds[k + 1]]
            n = max(1, len(w) - words + 1) if len(w) else 0
            width = min(words, len(w))
            h = np.zeros(n, np.uint64)
            for j in range(width):
                h = mixed(h * np.uint64(0x100000001B3) + w[j:j + n])
            flats.append(np.unique(h))
            counts.append(len(flats[-1]))
        at = end
    return np.concatenate(flats), offsets_of(np.array(counts, np.int64))


# --- sketches

@lru_cache(maxsize=1)
def _intervals() -> np.ndarray:
    j = np.arange(REGISTERS)
    return np.append(np.log1p(j / (REGISTERS - j)) / RATE, np.inf)


def sketches(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch of every set as a row of registers."""
    n = len(offsets) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    lengths = np.diff(offsets)
    gamma, step = _intervals(), np.log(BASE)
    for low in range(0, n, 512):  # rows at once, so that memory stays bounded
        high = min(n, low + 512)
        doc = np.repeat(np.arange(high - low), lengths[low:high])
        h = flat[offsets[low]:offsets[high]]
        start = (mixed(h + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)
        stride = 1 + (mixed(h + np.uint64(2)) % np.uint64(REGISTERS - 1)).astype(np.int64)
        level = np.zeros((high - low) * REGISTERS, np.uint16)
        for j in range(REGISTERS):
            if not len(doc):
                break
            u = (mixed(h + np.uint64(1000 + j)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            reach = 1.0 if np.isinf(gamma[j + 1]) else -np.expm1(-RATE * (gamma[j + 1] - gamma[j]))
            x = gamma[j] - np.log1p(-u * reach) / RATE
            k = np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / step) + TOP // 4, 1, TOP).astype(np.uint16)
            cell = doc * REGISTERS + start
            order = np.argsort(k, kind="stable")
            cell, k = cell[order], k[order]
            better = k > level[cell]
            level[cell[better]] = k[better]  # ascending: the largest is written last
            start = (start + stride) % REGISTERS
            if j % 4 == 3 or j < 2:
                open_rows = (level.reshape(-1, REGISTERS) == 0).any(axis=1)
                keep = open_rows[doc]
                if not keep.all():
                    doc, h, start, stride = doc[keep], h[keep], start[keep], stride[keep]
        out[low:high] = level.reshape(-1, REGISTERS)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Hash of each band of registers; the band's number is part of it."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(registers), 1))
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x100000001B3) + registers[:, r:ROWS * BANDS:ROWS].astype(np.uint64) + np.uint64(7))
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity from registers and known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * scale) / np.log(BASE)

    def likelihood(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(24):  # golden section; the likelihood has one top
        c, d = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        up = likelihood(c) < likelihood(d)
        low, high = np.where(up, c, low), np.where(up, high, d)
    return (low + high) / 2


def bound(threshold: float) -> float:
    """Least estimate at which a pair is verified."""
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


# --- tables

def _sketch_rows(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, offsets = shingle_sets(part.column("text").to_pylist(), words)
                registers = sketches(flat, offsets)
                sums = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(
                    np.stack([mixed(flat + np.uint64(11)), mixed(flat + np.uint64(13))], axis=1), axis=0)))
                prints = (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(offsets)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()),
                    pa.array([r.tobytes() for r in registers], pa.binary())], ["id", "n", "print_a", "print_b", "registers"])
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, print_a long, print_b long, registers binary")


def _banded(classes: DataFrame) -> DataFrame:
    """(bucket, id) of all bands; a bucket's key is the band's hash."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = band_keys(_matrix(part.column("registers").to_pylist()))
                ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids], ["bucket", "id"])
    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "registers").mapInArrow(run, f"bucket long, id {kind}")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches the bound, with it."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                e = estimate(*(_matrix(part.column(c).to_pylist()) for c in ("ra", "rb")), na, nb)
                good = pa.array(e >= least)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(good), part.column("b").filter(good), pa.array(e[e >= least])], ["a", "b", "similar"])
    kind = classes.schema["id"].dataType.simpleString()
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, f"a {kind}, b {kind}, similar double")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold. Texts move once, to find those that the pairs name."""
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = settle(docs.join(named.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")  # one plan at all sizes
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                fa, oa = shingle_sets(part.column("ta").to_pylist(), words)
                fb, ob = shingle_sets(part.column("tb").to_pylist(), words)
                good = []
                for k in range(part.num_rows):
                    x, y = fa[oa[k]:oa[k + 1]], fb[ob[k]:ob[k + 1]]
                    both = int(np.isin(x, y, assume_unique=True).sum())
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                good = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])
    kind = docs.schema["id"].dataType.simpleString()
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): labels sink to the smallest id, over links and over labels."""
    both = settle(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "links")
    labels = settle(both.groupBy("x").agg(F.min("y").alias("y")).select(
        F.col("x").alias("id"), F.least("x", "y").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(
            F.min("component").alias("near"))
        sunk = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = settle(sunk.join(jump, "component", "left").select(
            "id", "was", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        moved = after.where("component <> was").limit(1).count()
        labels = after.select("id", "component")
        if not moved:
            return labels


def fine_hashes(flat: np.ndarray) -> np.ndarray:
    """The FINE smallest hashes of a set, all 64 bits kept: shingles equal here are equal when verified."""
    return np.unique(mixed(flat))[:FINE]


def fine_similarity(a: list[np.ndarray], b: np.ndarray, na: np.ndarray, nb: int) -> np.ndarray:
    """Similarity of sets by their FINE smallest hashes; of whole sets as verification finds it."""
    lengths = np.array([len(x) for x in a])
    pool = np.concatenate(a)
    near = np.minimum(np.searchsorted(b, pool), len(b) - 1)
    both = np.add.reduceat((b[near] == pool).astype(np.int64), offsets_of(lengths)[:-1])
    out = both / (lengths + len(b) - both)
    for k in np.flatnonzero(np.maximum(na, nb) > FINE):
        union = np.union1d(a[k], b)[:FINE]
        out[k] = np.isin(union, np.intersect1d(a[k], b, assume_unique=True), assume_unique=True).mean()
    return out


def _fine_rows(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, offsets = shingle_sets(part.column("text").to_pylist(), words)
                fine = [fine_hashes(flat[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fine, pa.binary())], ["id", "fine"])
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fine binary")


def _open_pairs(members: DataFrame, classes: DataFrame, docs: DataFrame, labels: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs across components, within buckets that hold several, that are or may be links.

    The blocks of a bucket's members outside its largest component meet the blocks of all its members; a block pair is a
    group of bounded size. Of pairs told by whole sets one for each member and component is enough.
    """
    least = bound(threshold)
    loose = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / FINE))
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = named.groupBy("bucket", "component").agg(F.count("*").alias("share"))
    most = shares.groupBy("bucket").agg(F.max(F.struct("share", "component")).alias("top"), F.sum("share").alias("size"),
                                        F.count("*").alias("parts")).where("parts > 1")
    open_ = settle(named.join(most.select("bucket", F.col("top.component").alias("main"), "size",
                                          (F.col("size") - F.col("top.share")).alias("rest")), "bucket"), "open")
    fine = settle(_fine_rows(docs.join(open_.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]), words), "fine")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    minor = open_.where("component <> main").select(
        "bucket", "id", "component", F.lit(0).alias("side"), at("rest").alias("p"),
        F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("q"))
    every = open_.select("bucket", "id", "component", F.lit(1).alias("side"), at("size").alias("q"),
                         F.explode(F.sequence(F.lit(0), blocks("rest") - 1)).alias("p"))
    laid = minor.unionByName(every).join(classes.select("id", "n", "registers").join(fine, "id"), "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        m, e = frame[frame.side == 0], frame[frame.side == 1]
        found = []
        if len(m) and len(e):
            rm, re = _matrix(m.registers.tolist()), _matrix(e.registers.tolist())
            km, ke = band_keys(rm), band_keys(re)
            bucket = int(frame.bucket.iloc[0])
            sm, se = ([np.frombuffer(x, np.uint64) for x in side.fine] for side in (m, e))
            im, ie = m.id.to_numpy(), e.id.to_numpy()
            cm, ce, nm, ne = m.component.to_numpy(), e.component.to_numpy(), m.n.to_numpy(float), e.n.to_numpy(float)
            places = []
            for k in range(len(m)):
                ok = np.flatnonzero((ce != cm[k]) & (np.minimum(ne, nm[k]) >= threshold * np.maximum(ne, nm[k]) - 1e-9))
                ok = ok[(re[ok] == rm[k]).sum(axis=1) >= (least - 0.05) * REGISTERS]
                if len(ok):  # in the first band that the two share
                    ok = ok[ke[ok, (ke[ok] == km[k]).argmax(axis=1)] == bucket]
                places.append(ok)
            row, col = np.repeat(np.arange(len(m)), [len(x) for x in places]), np.concatenate(places)
            for at in range(0, len(row), 20_000):
                i, j = row[at:at + 20_000], col[at:at + 20_000]
                good = estimate(rm[i], re[j], nm[i], ne[j]) >= least
                i, j = i[good], j[good]
                for k in np.unique(i):
                    ok = j[i == k]
                    s = fine_similarity([se[x] for x in ok], sm[k], ne[ok], int(nm[k]))
                    whole = np.maximum(ne[ok], nm[k]) <= FINE
                    told = np.flatnonzero(whole & (s >= threshold - 1e-9))
                    told = told[np.argsort(-s[told], kind="stable")]
                    _, one = np.unique(ce[ok[told]], return_index=True)
                    found += [(max(ie[x], im[k]), min(ie[x], im[k])) for x in [*ok[told[one]], *ok[~whole & (s >= loose)]]]
        return pd.DataFrame({"a": np.array([x for x, _ in found], np.int64), "b": np.array([x for _, x in found], np.int64)})

    kind = classes.schema["id"].dataType.simpleString()
    return laid.groupBy("bucket", "p", "q").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def find(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) of every row; component is the smallest id reachable over links. Ids must be integers."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold integers, it holds {df.schema[id_col].dataType.simpleString()}")
    docs = ids_and_texts(df, id_col, text_col)
    least = bound(percent / 100)
    rows = settle(_sketch_rows(docs, words), "sketches")
    full = rows.where("n > 0 and id is not null")
    firsts = settle(full.groupBy("print_a", "print_b", "n").agg(F.min("id").alias("first")), "classes")
    classes = settle(full.join(firsts.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "firsts")
    members = settle(_banded(classes), "bands")
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head")
    crowded = settle(members.join(heads, "bucket"), "crowded")
    pairs = crowded.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()

    near = _estimated(pairs, classes, least)
    best = settle(near.groupBy("a").agg(F.max_by("b", F.struct("similar", "b")).alias("b")), "pairs1")
    links = settle(_verified(best, docs, words, percent), "links1")
    labels = components(links)
    more = _open_pairs(crowded.select("bucket", "id"), classes, docs, labels, words, percent / 100)
    labels = components(links.unionByName(_verified(settle(more, "pairs2"), docs, words, percent)))

    named = firsts.join(labels.withColumnRenamed("id", "first"), "first", "left").select(
        "print_a", "print_b", "n", F.coalesce("component", "first").alias("component"))
    linked = full.select("id", "print_a", "print_b", "n").join(named, ["print_a", "print_b", "n"]).select("id", "n", "component")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component")
