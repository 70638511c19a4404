"""Hard negatives by a multiway hyperplane tree: rows of other labels that score almost as high as a positive.

An anchor's positives are its first rows of the same label; for each, the negatives are the first rows of other labels whose
score lies in a window below the positive's. Both are searches of the tree in hyperplane_tree.py: the first for scores
from a threshold up, the second for scores in the window, whose lower end rises with what is found. A leaf is visited only
by the anchors whose annulus its distance ranges meet, and there all rows are compared exactly in whole numbers. First
thresholds come from the sample that the tree was fitted on.

All rows are indexed, range-partitioned by leaf and row, so a crowded leaf spreads over many tasks. Tasks read the anchors from
the shared folder block by block and hand on, for each panel of rows, at most COUNT rows for each anchor or positive. The
sample (SAMPLE rows, fewer where vectors are very long) and the distance ranges (at most 17 * 16 * 16) pass through the driver;
nothing else does.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null id is no anchor and comes
last among ties (given back as null); of repeated rows each is an anchor and a candidate of its own, never its own positive; ties
go to the smaller id; positives with negative scores have empty windows; anchors without positives, or positives without negatives,
give no rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm.hyperplane_tree import SAMPLE, Tree
from shootlake.llm.shared import settle
from shootlake.llm.vectors import (
    BLOCK, NO_ID, OUT, PANEL, best, matrix, panels, products, read_blocks, room, spread, whole, write_blocks)

COUNT = 5
#: The window of a positive's score, in hundredths of it.
WINDOW = (80, 100)


class Rows:
    """Indexed rows a task holds, in one stretch for each leaf."""

    def __init__(self, batch: pa.RecordBatch, length: int, floats: bool):
        self.v, self.floats = matrix(batch, length), floats
        self.ids, self.rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
        self.labels, self.leaf = batch.column("label").to_numpy(), batch.column("leaf").to_numpy()
        self.starts = np.concatenate([[0], np.nonzero(np.diff(self.leaf))[0] + 1, [len(self.leaf)]])

    def stretches(self) -> Iterator[tuple[int, slice]]:
        """(leaf, rows) of stretches of at most BLOCK * 4 rows."""
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            for start in range(a, b, BLOCK * 4):
                yield int(self.leaf[a]), slice(start, min(start + BLOCK * 4, b))


class Anchors:
    """A block of anchors, with thresholds and, in the second search, their positives' scores."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.v = matrix(batch, length)
        self.square = (self.v.astype(np.float64) ** 2).sum(axis=1)
        self.rows, self.labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
        self.least = batch.column("least").to_numpy() if "least" in batch.schema.names else np.full(len(self.rows), OUT)
        # scores of the positives side by side, OUT where there are fewer
        self.tops = matrix(batch, COUNT, "tops") if "tops" in batch.schema.names else None

    def of_same_label(self, rows: Rows, at: slice, some: np.ndarray) -> np.ndarray:
        scores = products(self.v[some], rows.v[at], rows.floats)
        other = (self.labels[some, None] != rows.labels[None, at]) | (self.rows[some, None] == rows.rows[None, at])
        scores[other] = OUT
        return scores

    def of_other_labels(self, rows: Rows, at: slice, some: np.ndarray) -> np.ndarray:
        scores = products(self.v[some], rows.v[at], rows.floats)
        scores[self.labels[some, None] == rows.labels[None, at]] = OUT
        return scores


class Top:
    """The best COUNT scores so far of each of many searches."""

    def __init__(self, least: np.ndarray):
        n = len(least)
        self.scores, self.ids, self.rows = np.full((n, COUNT), OUT), np.full((n, COUNT), NO_ID), np.full((n, COUNT), -1)
        self.least = least.copy()

    def take(self, search: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Add a stretch's scores for some of the searches."""
        scores = np.where(scores >= self.least[search, None], scores, OUT)
        some = np.nonzero((scores > OUT).any(axis=1))[0]
        if not some.size:
            return
        search, scores = search[some], scores[some]
        r, c = best(scores, ids, COUNT)
        at = np.arange(r.size) - np.searchsorted(r, r)
        s, i, w = self.scores[search], self.ids[search], self.rows[search]
        more, more_ids, more_rows = np.full_like(s, OUT), np.full_like(i, NO_ID), np.full_like(w, -1)
        more[r, at], more_ids[r, at], more_rows[r, at] = scores[r, c], ids[c], rows[c]
        s, i, w = np.concatenate([s, more], 1), np.concatenate([i, more_ids], 1), np.concatenate([w, more_rows], 1)
        r, c = best(s, i, COUNT)
        at = np.arange(r.size) - np.searchsorted(r, r)
        to = search[r], at
        self.scores[search], self.ids[search], self.rows[search] = OUT, NO_ID, -1
        self.scores[to], self.ids[to], self.rows[to] = s[r, c], i[r, c], w[r, c]
        self.least[search] = np.maximum(self.least[search], self.scores[search, -1])


def find_positives(anchors: Anchors, rows: Rows, tree: Tree | None) -> Top:
    """Best rows of the same label; without a tree, all stretches are visited."""
    top = Top(anchors.least)
    reach = tree.reach(anchors.v) if tree else None
    for leaf, at in rows.stretches():
        some = np.arange(len(anchors.v))
        if tree:
            some = some[tree.visits(reach[0][:, leaf], reach[1][:, leaf], tree.annulus(anchors.square, top.least))]
        some = some[np.isin(anchors.labels[some], rows.labels[at])]
        if some.size:
            top.take(some, anchors.of_same_label(rows, at, some), rows.ids[at], rows.rows[at])
    return top


def window(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of the negatives of positives with these scores."""
    hundreds, rest = np.maximum(tops, 0) // 100, np.maximum(tops, 0) % 100  # apart, so that no product leaves 63 bits
    least, greatest = WINDOW[0] * hundreds - (-WINDOW[0] * rest) // 100, WINDOW[1] * hundreds + WINDOW[1] * rest // 100
    return np.where(tops >= 0, least, 1), np.where(tops >= 0, greatest, 0)


def find_negatives(anchors: Anchors, rows: Rows, tree: Tree | None, least: np.ndarray | None = None) -> list[Top]:
    """Best rows of other labels in the window below each positive."""
    low, high = window(np.where(anchors.tops > OUT, anchors.tops, -1))
    tops = [Top(low[:, p] if least is None else np.maximum(low[:, p], least[:, p])) for p in range(COUNT)]
    reach = tree.reach(anchors.v) if tree else None
    for leaf, at in rows.stretches():
        wanted = high >= low
        if tree:
            for p, top in enumerate(tops):
                annulus = tree.annulus(anchors.square, top.least, high[:, p])
                wanted[:, p] &= tree.visits(reach[0][:, leaf], reach[1][:, leaf], annulus)
        some = np.nonzero(wanted.any(axis=1))[0]
        if not some.size:
            continue
        scores = anchors.of_other_labels(rows, at, some)
        for p, top in enumerate(tops):
            mine = wanted[some, p]
            search = some[mine]
            if search.size:
                inside = np.where(scores[mine] <= high[search, p, None], scores[mine], OUT)
                top.take(search, inside, rows.ids[at], rows.rows[at])
    return tops


def mine(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         scale: int = 256) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score, anchor_row), rank counting from 1 for each positive."""
    asks = F.coalesce(is_anchor & F.col(f"`{id_col}`").isNotNull(), F.lit(False))
    rows, length, floats = whole(df.where(label.isNotNull()), id_col, vec_col, scale, label.cast("long").alias("label"), asks.alias("asks"))
    n_sample, n_anchors, n_rows = room(length, SAMPLE), room(length, BLOCK), room(length, PANEL)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = rows.agg(F.max(norm)).first()[0] or 0.0

    # the same rows each time: those with the smallest hashes of their places
    sampled = write_blocks(rows.orderBy(F.xxhash64("row"), "row").limit(n_sample).withColumn("leaf", F.lit(0).cast("long")), "sample")
    picked = [b for b in read_blocks(sampled, n_sample)]
    sample = np.concatenate([matrix(b, length) for b in picked]) if picked else np.empty((0, length), np.int64)
    tree = Tree(sample, most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in panels(batches, n_rows):
            leaf, _ = tree.place(matrix(batch, length))
            yield batch.append_column("leaf", pa.array(leaf))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in panels(batches, n_rows):
            found = tree.place(matrix(batch, length))[1]
            yield pa.RecordBatch.from_pydict(dict(zip(("node", "i", "j", "low", "high"), map(list, zip(*found)))))

    placed = settle(rows.select("id", "row", "label", "v").mapInArrow(
        place, "id long, row long, label long, v array<long>, leaf long"), "placed")
    tree.learn(map(tuple, rows.select("v").mapInArrow(measure, "node long, i long, j long, low double, high double")
                   .groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect()))
    indexed = settle(placed.repartitionByRange(spread(placed), "leaf", "row").sortWithinPartitions("leaf", "row"), "indexed")

    def seeds() -> Iterator[Rows]:
        for batch in panels(read_blocks(sampled, n_sample), n_sample):
            yield Rows(batch, length, floats)

    def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(seeds())
        for batch in panels(batches, n_anchors):
            anchors = Anchors(batch, length)
            for part in held:
                anchors.least = find_positives(anchors, part, None).least
            yield batch.append_column("least", pa.array(anchors.least))

    fields = "id long, row long, label long, v array<long>"
    asked = rows.where("asks").select("id", "row", "label", "v")
    anchor_blocks = write_blocks(asked.mapInArrow(first_positives, f"{fields}, least long"), "anchors")

    def search_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for panel in panels(batches, n_rows):
            part = Rows(panel, length, floats)
            for block in read_blocks(anchor_blocks, n_anchors):
                top = find_positives(Anchors(block, length), part, tree)
                a, at = np.nonzero(top.scores > OUT)
                yield pa.RecordBatch.from_pydict({
                    "anchor": block.column("id").to_numpy()[a], "row": block.column("row").to_numpy()[a],
                    "id": top.ids[a, at], "at": top.rows[a, at], "score": top.scores[a, at]})

    place_of = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id", "at"))
    positives = settle(indexed.mapInArrow(search_positives, "anchor long, row long, id long, at long, score long")
                       .withColumn("place", place_of - 1).where(F.col("place") < COUNT), "positives")

    # the anchors again, each with the scores of its positives side by side
    scores = positives.groupBy("row").agg(*(F.max(F.when(F.col("place") == p, F.col("score"))).alias(f"p{p}") for p in range(COUNT)))
    tops = F.array(*(F.coalesce(f"p{p}", F.lit(OUT)) for p in range(COUNT)))
    ready = asked.join(scores, "row").select("id", "row", "label", "v", tops.alias("tops"))

    def first_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(seeds())
        for batch in panels(batches, n_anchors):
            anchors, least = Anchors(batch, length), None
            for part in held:
                least = np.stack([t.least for t in find_negatives(anchors, part, None, least)], axis=1)
            if least is None:
                least = np.full(anchors.tops.shape, OUT)
            yield batch.append_column("bounds", pa.array(least.tolist(), pa.list_(pa.int64())))

    ready_blocks = write_blocks(ready.mapInArrow(first_negatives, f"{fields}, tops array<long>, bounds array<long>"), "anchors")

    def search_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for panel in panels(batches, n_rows):
            part = Rows(panel, length, floats)
            for block in read_blocks(ready_blocks, n_anchors):
                found = find_negatives(Anchors(block, length), part, tree, matrix(block, COUNT, "bounds"))
                for p, top in enumerate(found):
                    a, at = np.nonzero(top.scores > OUT)
                    yield pa.RecordBatch.from_pydict({
                        "row": block.column("row").to_numpy()[a], "place": np.full(a.size, p, np.int32),
                        "negative": top.ids[a, at], "negative_score": top.scores[a, at]})

    rank = F.row_number().over(W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative"))
    negatives = (indexed.mapInArrow(search_negatives, "row long, place int, negative long, negative_score long")
                 .withColumn("rank", rank).where(F.col("rank") <= COUNT))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return negatives.join(positives, ["row", "place"]).select(
        "anchor", known("id").alias("positive"), "rank", known("negative").alias("negative"),
        F.col("score").alias("positive_score"), "negative_score", F.col("row").alias("anchor_row"))
