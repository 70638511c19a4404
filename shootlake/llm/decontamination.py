"""Benchmark decontamination by q-gram counting and banded alignment.

An item of L characters occurs in a text if some stretch is within its edit budget e, a share of L. By the q-gram lemma
such a stretch shares at least L-Q+1-Q*e of the item's q-grams, all on diagonals (place in the text less place in the
item) no more than 2e apart. Shared q-grams are counted in diagonal bands twice that wide that overlap by half; bands that
reach the bound are aligned with the item, dynamic programming staying inside the band.

Items of fewer than Q characters have no q-grams; they match exactly, found by hashes of stretches of their own length and then
compared. Those of fewer than 2 * Q characters have no edit budget, so they match exactly too.

Texts and items are compared in lower case with all white space alike, character by character, so places are those of the
text. The benchmark lies in the shared folder; tasks read it block by block, so that one block of at most BENCHMARK_BLOCK
characters (or one longer item) and one batch of texts are held at once, and nothing passes through the driver.

Defined results: null and empty texts have no matches; null and empty items match nothing; a null item id is given as -1;
a text that holds an item several times has a match for each place, of overlapping ones that with the fewest edits, then the
first; repeated texts and items repeat their matches; very long texts are scanned whole; an empty benchmark leaves everything
clean; the table's own columns are kept beside the matches, which are put in one column, replacing one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shootlake.llm.pieces import mixed
from shootlake.llm.ragged import offsets_of
from shootlake.llm.vectors import read_blocks, write_blocks

Q, RATE = 10, 0.08
#: Characters of benchmark held at once, characters of text handled at once, shared q-grams expanded at once.
BENCHMARK_BLOCK, BLOCK, EXPANDED = 1_000_000, 1_000_000, 4_000_000
MATCHES = "array<struct<item:long,start:long,end:long,edits:long>>"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            table[c] = 32
        elif len(low := s.lower()) == 1:
            table[c] = ord(low)
    return table


def folded(text: str) -> np.ndarray:
    return _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at every place that has one."""
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[j:j + n]
    return mixed(h)


def budget(length: int) -> int:
    return max(0, min(int(RATE * length), (length - Q) // Q))


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short = _short_items([(i, folded(t)) for i, t in items if len(t) < Q])
        items = [x for x in items if len(x[1]) >= Q]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.codes = [folded(t) for _, t in items]
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(n) for n in self.lengths], np.int64)
        self.least = self.lengths - Q + 1 - Q * self.edits
        grams = [_grams(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, counts = np.unique(flat, return_counts=True)
        self.offsets = offsets_of(counts)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> np.ndarray:
        """(item, band) of bands of joined texts that share enough q-grams."""
        grams = _grams(codes)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        row = np.searchsorted(self.keys, grams[at])
        row[row == len(self.keys)] = 0
        hit = self.keys[row] == grams[at] if len(self.keys) else np.zeros(0, bool)
        at, row = at[hit], row[hit]
        counts = self.offsets[row + 1] - self.offsets[row]
        ends = np.cumsum(counts)
        keys, numbers = [], []
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + EXPANDED)))
            n = counts[low:high]
            where = np.arange(n.sum()) + np.repeat(self.offsets[row[low:high]] - offsets_of(n)[:-1], n)
            place, item = np.repeat(at[low:high], n), self.item[where]
            step = 2 * self.edits[item] + 1
            band = (place - self.place[where] + self.lengths[item]) // step  # of the doubled band that begins here
            key = (item.astype(np.int64) << 40) | band
            k, c = np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True)
            keys.append(k)
            numbers.append(c)
            low = high
        if not keys:
            return np.zeros((0, 2), np.int64)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(numbers)).astype(np.int64)
        item, band = key >> 40, key & ((1 << 40) - 1)
        good = total >= self.least[item]
        return np.stack([item[good], band[good]], axis=1)

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        brief: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for numbers, codes, firsts in _joined(texts):
            for item, band in self.regions(codes).tolist():
                step = 2 * int(self.edits[item]) + 1
                length, edits = int(self.lengths[item]), int(self.edits[item])
                low = max(0, band * step - length - edits)
                high = min(len(codes), (band + 2) * step + edits)
                k = int(np.searchsorted(firsts, max(0, min(band * step - length + step, len(codes) - 1)), side="right")) - 1
                for text in {max(k - 1, 0), k, min(k + 1, len(numbers) - 1)}:  # a band may touch a neighbour
                    a, b = max(low, int(firsts[text])), min(high, int(firsts[text + 1]) - 1)
                    stop = min(int(firsts[text + 1]) - 1, b + length)
                    if a < b and (found := aligned(self.codes[item], codes[a:stop], b - a, edits)):
                        start, end, cost = found
                        base = a - int(firsts[text])
                        out[numbers[text]].append((int(self.ids[item]), base + start, base + end, cost))
            for text, match in self.exact(codes, firsts):
                brief[numbers[text]].append(match)
        return [sorted(_distinct(m) + b, key=lambda x: (x[1], x[0])) for m, b in zip(out, brief)]

    def exact(self, codes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """(text, match) of items of fewer than Q characters; an item's matches do not overlap."""
        for length, (keys, ids, stretches) in self.short.items():
            grams = _grams(codes, length)
            row = np.searchsorted(keys, grams)
            row[row == len(keys)] = 0
            at = np.flatnonzero(keys[row] == grams)
            free: dict[tuple[int, int], int] = {}
            for place, k in zip(at.tolist(), row[at].tolist()):
                text = int(np.searchsorted(firsts, place, side="right")) - 1
                base = int(firsts[text])
                while k < len(keys) and keys[k] == grams[place]:
                    if (stretches[k] == codes[place:place + length]).all() and place >= free.get((text, k), 0):
                        free[text, k] = place + length
                        yield text, (ids[k], place - base, place - base + length, 0)
                    k += 1


def _short_items(items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, list[int], list[np.ndarray]]]:
    """By length: sorted hashes, ids and characters of items of fewer than Q characters."""
    out = {}
    for length in sorted({len(c) for _, c in items} - {0}):
        mine = [(i, c) for i, c in items if len(c) == length]
        keys = np.concatenate([_grams(c, length) for _, c in mine])
        order = np.argsort(keys, kind="stable")
        out[length] = keys[order], [int(mine[k][0]) for k in order], [mine[k][1] for k in order]
    return out


def _joined(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in blocks: their numbers, folded codes with a mark after each, first places."""
    at = 0
    while at < len(texts):
        end, size, numbers = at, 0, []
        while end < len(texts) and (size < BLOCK or not numbers):
            if texts[end]:
                numbers.append(end)
                size += len(texts[end])
            end += 1
        if numbers:
            codes = folded("\U0010ffff".join(texts[n] for n in numbers) + "\U0010ffff")
            yield numbers, codes, offsets_of(np.array([len(texts[n]) + 1 for n in numbers]))
        at = end


def aligned(item: np.ndarray, text: np.ndarray, starts: int, edits: int) -> tuple[int, int, int] | None:
    """Best stretch (start, end, edits) of the text that begins at one of its first `starts` places, within the budget."""
    width = starts + 2 * edits
    back = _last_row(item, text, width, edits, free=starts)
    if back is None:
        return None
    k = int(np.argmin(back))
    cost, end = int(back[k]), k - edits + len(item)
    if cost > edits:
        return None
    # the start: the same from the end backwards, over places near the expected one
    turned = text[max(0, end - len(item) - edits):end][::-1]
    row = _last_row(item[::-1], turned, 2 * edits + 1, edits, free=1)
    j = int(np.argmin(row))
    return max(0, end - (len(item) + j - edits)), end, cost


def _last_row(item: np.ndarray, text: np.ndarray, width: int, edits: int, free: int) -> np.ndarray | None:
    """Costs of aligning the whole item with text ending on each diagonal from -edits on; the first `free` starts cost nothing."""
    far = 1 << 20
    padded = np.concatenate([np.full(edits, far, np.int64), text.astype(np.int64), np.full(len(item) + width, far, np.int64)])
    k = np.arange(width)
    row = np.where((k >= edits) & (k < edits + free), 0, far)
    if free == 1:  # one fixed start: later diagonals skip text before the item
        row = np.where(k >= edits, k - edits, far)
    for i, c in enumerate(item):
        down = np.append(row[1:] + 1, far)
        best = np.minimum(row + (padded[i:i + width] != c), down)
        row = np.minimum.accumulate(best - k) + k
        if i % 16 == 15 and row.min() > edits:
            return None if free != 1 else row
    ends = k - edits + len(item)
    return np.where((ends >= 0) & (ends <= len(text)), row, far)


def _distinct(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches in order; of overlapping ones of an item the one with the fewest edits."""
    kept: list[tuple[int, int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (m[3], m[1])):
        if not any(m[0] == x[0] and m[1] < x[2] and x[1] < m[2] for x in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[0]))


def benchmark_blocks(path: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in lists of bounded size, read from the shared folder."""
    held, size = [], 0
    for batch in read_blocks(path, 256):
        for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
            held.append((i, t))
            size += len(t)
            if size >= BENCHMARK_BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def scan(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         into: str = "matches") -> DataFrame:
    """The table with an array `into` of (item, start, end, edits) for each text."""
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("long"), F.lit(-1)).alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    path = write_blocks(rows.where(F.length("t") > 0), "benchmark")

    @F.pandas_udf(MATCHES)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only: Index | None = None  # where the benchmark is one block, its index serves all batches
        for series in parts:
            texts = [t if isinstance(t, str) else None for t in series]
            found: list[list] = [[] for _ in texts]
            count = 0
            for index in [only] if only else map(Index, benchmark_blocks(path)):
                count += 1
                found = [x + y for x, y in zip(found, index.matches(texts))]
            only = index if count == 1 else None
            yield pd.Series([[{"item": a, "start": b, "end": c, "edits": d} for a, b, c, d in m] for m in found])
    return df.withColumn(into, find(F.col(f"`{text_col}`").cast("string")))
