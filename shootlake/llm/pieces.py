"""A merge-type SentencePiece vocabulary, read through the public library, and the cutting of texts into pre-tokens.

Texts are cut where no piece of the vocabulary can cross, so that encoding the stretches one by one encodes the text.
Cutting, and finding the distinct stretches of many texts, is done on code-point arrays; equal stretches are told by
64-bit fingerprints of their characters with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from shootlake.llm.ragged import PairTable, gather, offsets_of

BLANK = "▁"
#: Characters handled at once inside a worker; longer texts are cut at a blank.
BLOCK = 2_000_000
WORD, SIGN, GAP, FEED = 1, 0, 2, 3


class Vocabulary:
    """Pieces, ranks (equal scores share one) and byte ids of a model with byte fallback and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id = [0] * 256
        self.normal = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.normal.append(i)
        self.control = {i for i in range(self.size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.id_of = {self.pieces[i]: i for i in self.normal}
        scores = sorted({sp.get_score(i) for i in self.normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank_of = {self.pieces[i]: place[sp.get_score(i)] for i in self.normal if len(self.pieces[i]) > 1}
        self.char_id = np.full(0x110000, -1, np.int64)
        for i in self.normal:
            if len(self.pieces[i]) == 1:
                self.char_id[ord(self.pieces[i])] = i
        self._classes()

    def _classes(self) -> None:
        """Classes of characters, and which cuts no piece crosses: before blanks, around line feeds, after words."""
        joined = {a + b for p in self.rank_of for a, b in zip(p, p[1:])}
        self.cut_gap = not any(x[1] == BLANK != x[0] for x in joined)
        self.cut_feed = not any("\n" in x for x in joined)
        letters = np.array([chr(c).isalpha() for c in range(0x110000)])
        kind = np.where(letters, WORD, SIGN).astype(np.uint8)
        while more := {x[0] for x in joined if kind[ord(x[0])] == WORD and kind[ord(x[1])] != WORD and x[1] != BLANK}:
            kind[[ord(c) for c in more]] = SIGN
        kind[ord(BLANK)], kind[ord("\n")] = GAP, FEED
        self.kind = kind

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short string: best score first, then leftmost."""
        parts = list(text)
        ranks = [self.rank_of.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = self.rank_of.get(parts[k] + parts[k + 1], 1 << 60)
            if k:
                ranks[k - 1] = self.rank_of.get(parts[k - 1] + parts[k], 1 << 60)
        return parts

    def pairs(self) -> PairTable:
        """Every way of making a piece of two others."""
        rows = [(self.id_of[p[:k]], self.id_of[p[k:]], rank, self.id_of[p])
                for p, rank in self.rank_of.items() for k in range(1, len(p))
                if p[:k] in self.id_of and p[k:] in self.id_of]
        return PairTable(*(np.array(c, np.int64) for c in zip(*rows)))

    def starts(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """First places of the pre-tokens in the joined texts; `texts` holds the texts' own first places."""
        kind = self.kind[codes]
        cut = np.zeros(len(codes), bool)
        before, here = kind[:-1], kind[1:]
        if self.cut_gap:
            cut[1:] |= (here == GAP) & (before != GAP)
            cut[1:] |= (before == WORD) & (here != WORD)
            if self.cut_feed:
                cut[1:] |= (here == FEED) | (before == FEED)
        cut[texts[texts < len(codes)]] = True
        return np.flatnonzero(cut)


def segments(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(text number, stretch with blanks marked), the stretches of long texts cut before a blank. Null is empty."""
    for k, text in enumerate(texts):
        if not text:
            continue
        text = BLANK + text.replace(" ", BLANK)
        at = 0
        while len(text) - at > BLOCK:
            end = text.rfind(BLANK, at + 1, at + BLOCK)
            while end > at and text[end - 1] == BLANK:
                end -= 1
            if end <= at:
                break
            yield k, text[at:end]
            at = end
        yield k, text[at:]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Segments in blocks of about BLOCK characters: (text number of each, segments)."""
    owners, held, size = [], [], 0
    for k, part in segments(texts):
        owners.append(k)
        held.append(part)
        size += len(part)
        if size >= BLOCK:
            yield np.array(owners), held
            owners, held, size = [], [], 0
    if held:
        yield np.array(owners), held


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_pretokens(words: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined segments: distinct pre-tokens (codes, offsets), each occurrence's number, occurrences by segment."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = offsets_of(np.array([len(p) for p in parts]))
    starts = words.starts(codes, firsts[:-1])
    ends = np.append(starts[1:], len(codes))
    place = np.arange(len(codes)) - np.repeat(starts, ends - starts)
    key = np.add.reduceat(mixed(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))
                                + np.uint64(0x9E3779B97F4A7C15)), starts)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    bounds = np.stack([starts[first], ends[first]])
    flat = codes[np.arange((bounds[1] - bounds[0]).sum())
                 + np.repeat(bounds[0] - offsets_of(bounds[1] - bounds[0])[:-1], bounds[1] - bounds[0])]
    return flat.astype(np.int64), offsets_of(bounds[1] - bounds[0]), number, np.searchsorted(starts, firsts)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


__all__ = ["BLANK", "Vocabulary", "vocabulary", "blocks", "distinct_pretokens", "mixed", "gather"]
