"""Exact top-k search by inner product, over buckets of vectors of like length.

All vectors are range-partitioned from long to short, and each task cuts its range into buckets of BUCKET vectors. For a
query whose k-th best score so far is at least t, a bucket whose longest vector has length l can only hold a better one
if its cosine with the query reaches the local threshold t / (|query| * l):

- above 1 the bucket is passed over;
- from COORDINATES on, the feasible region of the cosine is small: in the query's FOCUS strongest coordinates, each
  candidate's unit vector must lie within the angle that the threshold leaves around the query's. The bucket's sorted list of
  the most selective coordinate gives the candidates, the other coordinates thin them out;
- below, only length prunes: the prefix of the bucket's vectors that are long enough.

Whatever remains is verified by exact whole-number products. The first threshold of a query is its k-th best score among
the longest SEED vectors (fewer where vectors are very long), which a task holds; it rises as a task goes on. Bounds carry a
slack of 1e-9, so that rounding never drops a candidate or a tie.

Work for queries times rows is inherent to the result; each task reads the queries block by block and hands on at most k rows
a query and panel, and only those that reach the threshold.

Defined results: vectors that are null or hold null or non-finite components take no part, and neither do queries without
id; a null id among the candidates is given back as null and comes last among ties; shorter vectors count as padded with
zeros, an empty vector scores 0; of repeated rows each is a query and a candidate of its own; ties go to the smaller id;
an empty table gives no rows. Scores are exact while they fit into 63 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm.vectors import (
    BLOCK, NO_ID, OUT, PANEL, best, matrix, panels, products, read_blocks, room, spread, whole, write_blocks)

BUCKET = 4096
SEED = 4096
FOCUS = 4
COORDINATES = 0.8
SLACK = 1e-9


class Bucket:
    """Vectors of like length, from long to short."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, floats: bool):
        self.ids, self.rows, self.v, self.floats = ids, rows, v, floats
        self.lengths = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors' coordinate f: in bucket order, sorted, and the order that sorts it."""
        if f not in self._sorted:
            x = self.v[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(x, kind="stable")
            self._sorted[f] = x, x[order], order
        return self._sorted[f]

    def by_coordinates(self, query: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Places of the vectors that may reach the cosine with the query."""
        unit = query / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, wide = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0)) + 1e-7
        low, high = np.cos(np.minimum(angle + wide, np.pi)) - SLACK, np.cos(np.maximum(angle - wide, 0)) + SLACK
        ranges = []
        for f, a, b in zip(focus, low, high):
            x, in_order, order = self.unit(int(f))
            ranges.append((np.searchsorted(in_order, a), np.searchsorted(in_order, b, "right"), order, x, a, b))
        ranges.sort(key=lambda r: r[1] - r[0])
        start, end, order = ranges[0][:3]
        places = order[start:end]
        for *_, x, a, b in ranges[1:]:
            places = places[(x[places] >= a) & (x[places] <= b)]
        return places

    def search(self, queries: np.ndarray, own: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the best k of each query that reach its threshold."""
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(least > 0, least / lengths, -np.inf)  # shortest vector that can reach the threshold
        cosine = np.where(reach > 0, reach / max(self.lengths[0], 1e-300), -1.0) * (1 - SLACK)
        prefix = np.searchsorted(-self.lengths, -reach * (1 - SLACK), "right")
        some = []
        near = np.nonzero((cosine >= COORDINATES) & (cosine <= 1))[0]
        for q in near:
            places = self.by_coordinates(queries[q], lengths[q], cosine[q])
            if places.size:
                scores = products(queries[q:q + 1], self.v[places], self.floats)
                scores[(scores < least[q]) | (self.rows[places] == own[q])[None, :]] = OUT
                _, c = best(scores, self.ids[places], k)
                some.append((np.full(c.size, q), places[c], scores[0, c]))
        far = np.nonzero((cosine < COORDINATES) & (prefix > 0))[0]
        if far.size:
            n = int(prefix[far].max())
            scores = products(queries[far], self.v[:n], self.floats)
            scores[(scores < least[far, None]) | (self.rows[None, :n] == own[far, None])] = OUT
            r, c = best(scores, self.ids[:n], k)
            some.append((far[r], c, scores[r, c]))
        if not some:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*some))


def buckets(panel: pa.RecordBatch, length: int, floats: bool) -> list[Bucket]:
    v = matrix(panel, length)
    ids, rows = panel.column("id").to_numpy(), panel.column("row").to_numpy()
    return [Bucket(ids[i:i + BUCKET], rows[i:i + BUCKET], v[i:i + BUCKET], floats) for i in range(0, len(ids), BUCKET)]


def search_all(parts: list[Bucket], queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best k over buckets, each query's threshold rising as they go."""
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    top, top_ids, least = np.full((len(queries), k), OUT), np.full((len(queries), k), NO_ID), least.copy()
    for bucket in parts:
        q, place, score = bucket.search(queries, own, lengths, least, k)
        if not q.size:
            continue
        order = np.lexsort((bucket.ids[place], -score, q))
        q, place, score = q[order], place[order], score[order]
        at = np.arange(q.size) - np.searchsorted(q, q)
        more, more_ids = np.full_like(top, OUT), np.full_like(top_ids, NO_ID)
        more[q, at], more_ids[q, at] = score, bucket.ids[place]
        both, both_ids = np.concatenate([top, more], axis=1), np.concatenate([top_ids, more_ids], axis=1)
        r, c = best(both, both_ids, k)
        at = np.arange(r.size) - np.searchsorted(r, r)
        top, top_ids = np.full_like(top, OUT), np.full_like(top_ids, NO_ID)
        top[r, at], top_ids[r, at] = both[r, c], both_ids[r, c]
        least = np.maximum(least, top[:, -1])
    r, c = np.nonzero(top > OUT)
    return r, top_ids[r, c], top[r, c]


def find(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query, rank, id, score) of each query's k highest inner products with all other rows; is_query tells the queries."""
    spark = df.sparkSession
    rows, length, floats = whole(df, id_col, vec_col, scale, F.coalesce(is_query & F.col(f"`{id_col}`").isNotNull(), F.lit(False)).alias("asks"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("norm", norm)
    n_seeds, n_queries, n_rows = room(length, SEED), room(length, BLOCK), room(length, PANEL)
    longest = write_blocks(rows.orderBy(F.desc("norm"), "row").limit(n_seeds).select("id", "row", "v", "norm"), "longest")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [x for panel in panels(read_blocks(longest, n_seeds), n_seeds) for x in buckets(panel.sort_by([("norm", "descending")]), length, floats)]
        for batch in panels(batches, n_queries):
            queries, own = matrix(batch, length), batch.column("row").to_numpy()
            q, _, score = search_all(seeds, queries, own, np.full(len(own), OUT), k)
            kth = np.nonzero(np.arange(q.size) - np.searchsorted(q, q) == k - 1)[0]
            least = np.full(len(own), OUT)
            least[q[kth]] = score[kth]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "row": batch.column("row"), "v": batch.column("v"), "least": least})

    asked = rows.where("asks").select("id", "row", "v")
    queries = write_blocks(asked.mapInArrow(first, "id long, row long, v array<long>, least long"), "queries")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for panel in panels(batches, n_rows):
            parts = buckets(panel, length, floats)
            for block in read_blocks(queries, n_queries):
                own = block.column("row").to_numpy()
                q, ids, score = search_all(parts, matrix(block, length), own, block.column("least").to_numpy(), k)
                yield pa.RecordBatch.from_pydict({
                    "query": block.column("id").to_numpy()[q], "own": own[q], "id": ids, "score": score})

    ranged = (rows.select("id", "row", "v", "norm").repartitionByRange(spread(rows), F.desc("norm"), "row")
              .sortWithinPartitions(F.desc("norm"), "row"))
    found = ranged.mapInArrow(task, "query long, own long, id long, score long")
    place = F.row_number().over(W.partitionBy("query", "own").orderBy(F.desc("score"), "id"))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return top.select("query", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "score")
