"""SentencePiece encoding and decoding (merge type).

Encoding keeps, for every prefix of a pre-token, the one token that can end its encoding. Candidates are the pieces that
an automaton finds ending at the place, longest first; the right one is the one that forms a stable pair with the last
token of the prefix before it. A pair is stable if merging the two tokens' joined text gives the two tokens back. Ids are
then read off from the end backwards. The distinct pre-tokens of a block of texts go through automaton and table
side by side, one place after another. Characters outside the vocabulary become their UTF-8 bytes.

Defined results: a null text is the empty text and has no ids; very long texts are cut only where no piece can cross;
repeated rows repeat their result; columns other than the two named are not carried. Decoding null or no ids gives the
empty text; control ids give nothing, unknown ids the library's mark, bytes that are not UTF-8 one U+FFFD each.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shootlake.llm.pieces import BLANK, Vocabulary, blocks, distinct_pretokens, vocabulary
from shootlake.llm.ragged import PairTable, gather, offsets_of
from shootlake.llm.shared import ids_and_texts

#: Slots for remembered pair tests in a worker; only speed depends on it.
SLOTS = 1 << 20
#: Rows handed on at once inside a worker.
SLICE = 1000

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PrefixTable:
    """Automaton over the pieces and the table of last tokens, for many pre-tokens side by side."""

    def __init__(self, words: Vocabulary):
        self.words = words
        ends, edges, fail, order = [-1], [{}], [0], []
        for i in words.normal:
            state = 0
            for c in words.pieces[i]:
                state = edges[state].setdefault(ord(c), len(ends))
                if state == len(ends):
                    ends.append(-1)
                    edges.append({})
                    fail.append(0)
            ends[state] = i
        level = list(edges[0].values())
        while level:
            order += level
            after = []
            for s in level:
                for c, t in edges[s].items():
                    f = fail[s]
                    while f and c not in edges[f]:
                        f = fail[f]
                    fail[t] = edges[f].get(c, 0)
                    after.append(t)
            level = after
        link = [0] * len(ends)  # next shorter piece that ends here
        for s in order:
            link[s] = fail[s] if ends[fail[s]] >= 0 else link[fail[s]]
        rows = [(s, c, t) for s, e in enumerate(edges) for c, t in e.items()]
        source, char, target = (np.array(x, np.int64) for x in zip(*rows))
        self.edges = PairTable(source, char, np.arange(len(rows)), target)
        self.ends, self.fail, self.link = np.array(ends), np.array(fail), np.array(link)
        self.lengths = np.array([len(p) for p in words.pieces])
        self.alone = np.zeros(words.size, bool)
        for i in words.normal:
            self.alone[i] = words.merge(words.pieces[i]) == [words.pieces[i]]
        self.known_key, self.known = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is how their joined text is encoded."""
        key = left * self.words.size + right
        slot = ((key * 0x9E3779B1) >> 7) & (SLOTS - 1)
        out = self.known[slot]
        fresh = np.flatnonzero(self.known_key[slot] != key)
        if len(fresh):
            pairs, back = np.unique(key[fresh], return_inverse=True)
            piece, merge = self.words.pieces, self.words.merge
            tested = np.array([merge(piece[a] + piece[b]) == [piece[a], piece[b]]
                               for a, b in zip((pairs // self.words.size).tolist(), (pairs % self.words.size).tolist())])
            out[fresh] = tested[back]
            # later of two new pairs in one slot wins both arrays; the other is tested again when it comes back
            at = ((pairs * 0x9E3779B1) >> 7) & (SLOTS - 1)
            at, one = np.unique(at, return_index=True)
            self.known_key[at], self.known[at] = pairs[one], tested[one]
        return out

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out, todo = np.zeros_like(state), np.arange(len(state))
        while len(todo):
            row = self.edges.find(state[todo], char[todo])
            hit = row >= 0
            out[todo[hit]] = self.edges.result[row[hit]]
            todo = todo[~hit & (state[todo] > 0)]
            state[todo] = self.fail[state[todo]]
        return out

    def encode(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens as (flat, offsets)."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        base, sizes = offsets[:-1][order], lengths[order]
        last = np.full(len(codes), -1, np.int64)  # -1: a character outside the vocabulary
        state = np.zeros(len(order), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = np.searchsorted(-sizes, -k, side="left")
            state = self.step(state[:n], codes[base[:n] + k])
            todo = np.arange(n)
            at = np.where(self.ends[state] >= 0, state, self.link[state])
            while True:
                live = at > 0
                todo, at = todo[live], at[live]
                if not len(todo):
                    break
                token = self.ends[at]
                before = k - self.lengths[token]
                prior = np.where(before >= 0, last[base[todo] + np.maximum(before, 0)], -1)
                fits = self.alone[token]
                paired = np.flatnonzero(prior >= 0)
                fits[paired] = self.stable(prior[paired], token[paired])
                last[base[todo[fits]] + k] = token[fits]
                todo, at = todo[~fits], self.link[at[~fits]]
        found_word, found_id = [], []
        live, at = np.arange(len(sizes)), sizes - 1
        while len(live):
            token = last[base[live] + at]
            found_word.append(order[live])
            found_id.append(np.where(token >= 0, token, -1 - codes[base[live] + at]))
            at = at - np.where(token >= 0, self.lengths[token], 1)
            live, at = live[at >= 0], at[at >= 0]
        word = np.concatenate(found_word[::-1]) if found_word else np.zeros(0, np.int64)
        ids = np.concatenate(found_id[::-1]) if found_id else np.zeros(0, np.int64)
        ids, word = ids[(place := np.argsort(word, kind="stable"))], word[place]
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            raw = [[self.words.byte_id[b] for b in chr(c).encode("utf-8", "replace")] for c in (-1 - ids[strange]).tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(r) for r in raw]
            word, ids = np.repeat(word, times), np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(raw)
        return ids, offsets_of(np.bincount(word, minlength=len(lengths)))


class Coder:
    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.table = PrefixTable(self.words)
        pieces = [b"" if i in self.words.control else " ⁇ ".encode() if i == self.words.unknown
                  else p.replace(BLANK, " ").encode() for i, p in enumerate(self.words.pieces)]
        for b, i in enumerate(self.words.byte_id):
            pieces[i] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_offsets = offsets_of(np.array([len(p) for p in pieces]))
        self.leads = np.array([p.startswith(BLANK) for p in self.words.pieces])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts as (flat, offsets)."""
        counts, flats = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        for owners, parts in blocks(texts):
            codes, offsets, number, bounds = distinct_pretokens(self.words, parts)
            ids, ends = self.table.encode(codes, offsets)
            flat, ends = gather(ids.astype(np.int32), ends, number)
            np.add.at(counts, owners, np.diff(ends[bounds]))
            flats.append(flat)
        return np.concatenate(flats), offsets_of(counts)

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        texts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ids = flat[a:b].astype(np.int64)
            text = gather(self.piece_bytes, self.piece_offsets, ids)[0].tobytes().decode("utf-8", "each_byte")
            texts.append(text[1:] if b > a and self.leads[ids[0]] else text)
        return texts


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; no begin or end ids."""
    def run(batches):
        for part in _slices(batches):
            flat, offsets = coder(model).encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], ["id", "ids"])
    source = ids_and_texts(df, id_col, text_col)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, model: str) -> DataFrame:
    """(id, ids, decoded string) of rows (id, ids)."""
    def run(batches):
        for part in _slices(batches):
            rows = part.column("ids")
            flat, lengths = rows.flatten(), rows.value_lengths().fill_null(0)
            offsets = offsets_of(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
            texts = coder(model).decode(flat.to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([part.column("id"), rows, pa.array(texts, pa.string())],
                                             ["id", "ids", "decoded"])
    return df.select("id", "ids").mapInArrow(
        run, f"id {df.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
