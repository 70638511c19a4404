"""Ragged numpy arrays: gathers, and byte-pair merging of many sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(pool: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `index` of the ragged array (pool, offsets), as (flat, offsets)."""
    first = offsets[index]
    lengths = offsets[index + 1] - first
    out = offsets_of(lengths)
    return pool[np.arange(out[-1]) + np.repeat(first - out[:-1], lengths)], out


class PairTable:
    """(left, right) -> (rank, result), looked up for whole arrays in a hashed table with a sorted overflow."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.result = key[order], rank[order].astype(np.int64), result[order].astype(np.int64)
        self.shift = np.uint64(64 - max(10, int(len(key) * 8).bit_length()))
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slot[self._hash(self.key)[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
        held = self.slot[self._hash(self.key)] == np.arange(len(key))
        self.crowded = np.zeros(len(self.slot), bool)
        self.crowded[self._hash(self.key[~held])] = True
        # a rank may be applied at every place at once only if no pair with its result comes before it
        least = np.full(int(max(self.result.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1, NONE)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        ranks = np.unique(np.stack([self.rank, self.result]), axis=1)[0]
        shared = np.zeros(int(self.rank.max(initial=0)) + 1, np.int32)
        np.add.at(shared, ranks, 1)
        self.together = np.zeros(len(shared), bool)
        self.together[self.rank] = least[self.result] > self.rank
        self.together &= shared == 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, or -1; negative symbols are in no pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._hash(key)
        row = self.slot[at].astype(np.int64)
        bad = (row < 0) | (self.key[row] != key)
        again = np.flatnonzero(bad & self.crowded[at])
        row[bad] = -1
        if len(again):
            near = np.minimum(np.searchsorted(self.key, key[again]), len(self.key) - 1)
            row[again] = np.where(self.key[near] == key[again], near, -1)
        row[(left < 0) | (right < 0)] = -1
        return row


def merge_all(symbols: np.ndarray, offsets: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair encoding of every sequence at once, as (flat, offsets).

    Each round applies, in every sequence still active, its lowest-ranked pair: the leftmost place, or all places
    that do not overlap where no later pair could come first. Sequences without a pair leave the arrays.
    """
    n = len(offsets) - 1
    sym, seq = symbols.astype(np.int64), np.repeat(np.arange(n), np.diff(offsets))
    done_seq, done_sym = [], []
    row = _rows(sym, seq, pairs, np.arange(len(sym)))
    ranks = np.append(pairs.rank, NONE)  # row -1: no pair
    while len(sym):
        rank = ranks[row]
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        lows = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(seq))))
        over = lows == NONE
        if over.any():
            done_seq.append(seq[over])
            done_sym.append(sym[over])
            live = ~over
            sym, seq, row, rank, lows = sym[live], seq[live], row[live], rank[live], lows[live]
            if not len(sym):
                break
        here = np.flatnonzero(rank == lows)
        number = np.arange(len(here))
        run = np.concatenate(([True], here[1:] != here[:-1] + 1))
        first = np.concatenate(([True], seq[here[1:]] != seq[here[:-1]]))
        place = number - np.maximum.accumulate(np.where(run, number, 0))
        chosen = first | (pairs.together[lows[here]] & (place % 2 == 0))
        here = here[chosen]
        sym[here] = pairs.result[row[here]]
        keep = np.ones(len(sym), bool)
        keep[here + 1] = False
        touched = np.zeros(len(sym), bool)
        touched[here] = True
        sym, seq, row, touched = sym[keep], seq[keep], row[keep], touched[keep]
        touched[:-1] |= touched[1:]
        at = np.flatnonzero(touched)
        row[at] = _rows(sym, seq, pairs, at)
    if not done_seq:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
    order = np.argsort(seq, kind="stable")
    return sym[order], offsets_of(np.bincount(seq, minlength=n))


def _rows(sym: np.ndarray, seq: np.ndarray, pairs: PairTable, at: np.ndarray) -> np.ndarray:
    """Row of the pair that starts at each place, or -1."""
    out = np.full(len(at), -1, np.int64)
    inner = np.flatnonzero(at + 1 < len(sym))
    inner = inner[seq[at[inner]] == seq[at[inner] + 1]]
    out[inner] = pairs.find(sym[at[inner]], sym[at[inner] + 1])
    return out


class Memo:
    """Rows of numbers remembered by 64-bit key, in sorted order; starts anew when it is full."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.used, self.ends = np.zeros(1 << 16, np.int32), 0, np.zeros(1, np.int64)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places in `keys` (distinct, sorted) that are not remembered."""
        if len(self.keys) > self.most:
            self.forget()
        if not len(self.keys):
            return np.arange(len(keys))
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[near] != keys)

    def add(self, keys: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, len(self.ends) - 1 + np.arange(len(keys)))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(self.used + 2 * len(flat), np.int32)])
        self.pool[self.used:self.used + len(flat)] = flat
        self.ends = np.append(self.ends, self.used + offsets[1:])
        self.used += len(flat)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers of remembered keys, for gathering from (pool, ends)."""
        return self.place[np.searchsorted(self.keys, keys)]
