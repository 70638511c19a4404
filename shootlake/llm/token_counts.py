"""Token counts by rank-synchronous merging.

The distinct pre-tokens of a block of texts are held as one ragged array of characters. Round by round every pre-token's
lowest-ranked pair is applied, in all of them at once, until none has a pair; the symbols left are its tokens. A text's
count is the sum over its pre-tokens. A character outside the vocabulary counts as its UTF-8 bytes.

Defined results: a null text is the empty text: no bytes, no tokens; very long texts are cut only where no piece can
cross; repeated rows repeat their result; other columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shootlake.llm.pieces import blocks, distinct_pretokens, vocabulary
from shootlake.llm.ragged import merge_all
from shootlake.llm.shared import ids_and_texts

#: Rows handed on at once inside a worker.
SLICE = 4000


class Counter:
    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.pairs = self.words.pairs()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for owners, parts in blocks(texts):
            codes, offsets, number, bounds = distinct_pretokens(self.words, parts)
            symbols = self.words.char_id[codes]
            left = np.diff(merge_all(symbols, offsets, self.pairs)[1])
            strange = np.flatnonzero(symbols < 0)
            if len(strange):  # such a character survives as one symbol and stands for its bytes
                extra = (codes[strange] > 0x7F).astype(np.int64) + (codes[strange] > 0x7FF) + (codes[strange] > 0xFFFF)
                np.add.at(left, np.searchsorted(offsets, strange, side="right") - 1, extra)
            sums = np.concatenate(([0], np.cumsum(left[number])))
            np.add.at(out, owners, np.diff(sums[bounds]))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every text."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts = counter(model).counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts)],
                                                 ["id", "n_bytes", "n_tokens"])
    source = ids_and_texts(df, id_col, text_col).withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
