"""Whole-number vectors for the searches: who takes part, exact products, best rows of a block, blocks read by tasks.

Searches hold a query set against all rows in blocks. Queries are written to the shared folder and every task reads them
from there, BLOCK at a time, so no task and no driver ever holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.llm.shared import file_system, fresh_path, settle

#: Queries that a task holds at once.
BLOCK = 1024
#: Rows, and numbers in their vectors, that a task holds at once.
PANEL, NUMBERS = 32_768, 4_000_000
#: Score of a pair that does not count.
OUT = np.iinfo(np.int64).min
#: Stands for a missing id, so that it comes last among ties.
NO_ID = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def whole(df: DataFrame, id_col: str, vec_col: str, scale: int, *more: Column) -> tuple[DataFrame, int, bool]:
    """(row, id, v, *more) of the vectors that take part, their length, and whether floating-point products are exact.

    v holds floor(scale * x) of each component, padded with zeros to the longest vector, which leaves every product as it
    is. row tells rows apart, equal ids or not; a null id becomes the largest number. Ids must be integers.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold integers, it holds {df.schema[id_col].dataType.simpleString()}")
    vector = F.col(f"`{vec_col}`")
    numbers = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = settle(df.where(finite(vector)).select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), numbers.alias("v"), *more,
        F.monotonically_increasing_id().alias("row")), "vectors")
    largest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    least, most, top = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(largest)).first()
    most, top = most or 0, top or 0.0
    if least != most and least is not None:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("v"))))
    return rows, most, top * top * max(most, 1) < 2.0**53


def matrix(batch: pa.RecordBatch, length: int, column: str = "v") -> np.ndarray:
    """Vectors of a batch as rows of a matrix of whole numbers."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, length)


def products(a: np.ndarray, b: np.ndarray, floats: bool) -> np.ndarray:
    """All inner products of rows of a with rows of b, exact: in floating point where that is, else in 64-bit integers."""
    if floats:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ordered by row, score from high to low, smaller id first.

    ids has one id for each column, or one for each place.
    """
    rows, columns = scores.shape
    bar = np.full(rows, OUT)
    if columns > k:
        bar = np.partition(scores, columns - k, axis=1)[:, columns - k]
    r, c = np.nonzero(scores >= np.maximum(bar, OUT + 1)[:, None])
    key = ids[c] if ids.ndim == 1 else ids[r, c]
    order = np.lexsort((key, -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(r.size) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def room(length: int, rows: int) -> int:
    """So many rows, or fewer where vectors are long."""
    return max(1, min(rows, NUMBERS // max(length, 1)))


def panels(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to so many rows, fewer at the end."""
    held, n = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows - n)
            held.append(part)
            n, start = n + part.num_rows, start + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_blocks(df: DataFrame, label: str) -> str:
    """Write a table to the shared folder for tasks to read in blocks; its path."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def read_blocks(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The table in blocks of rows, in any task."""
    import pyarrow.fs as pf
    import pyarrow.parquet as pq
    system, folder = file_system(path)
    for info in sorted(system.get_file_info(pf.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet") and info.size:
            with system.open_input_file(info.path) as handle:
                yield from pq.ParquetFile(handle).iter_batches(batch_size=rows)


def spread(df: DataFrame) -> int:
    """Partitions for work that is heavy for its bytes."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
