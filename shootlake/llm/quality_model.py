"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words. Every passage is encoded by how it is written (shares of character
classes, word lengths, repeats, function words), embedded, and weighted by gated attention: the weight of passage k is
proportional to exp(w . (tanh(V h_k) * sigmoid(U h_k))). The score is the logistic of the weighted mean embedding. All
weights are learnt together from document labels, by gradient descent over a bounded sample of labelled documents.

Scores use the text alone: neither label, language, source nor id. Sampling bounds are parameters (`documents`,
`passages`); scoring uses every passage of every text.

Defined results: null, empty and blank texts are one empty passage and get a score like any other; rows with null id are
held in, but never used for learning; labels that are null are not learnt from; of repeated labels each counts; without
any label all scores are the same, one half; other columns are not carried.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shootlake.llm.pieces import mixed
from shootlake.llm.quality_rules import STOP_WORDS
from shootlake.llm.ragged import offsets_of
from shootlake.llm.shared import ids_and_texts

PASSAGE = 100
#: Characters handled at once inside a worker.
CHUNK = 1_000_000
SMALL, LARGE, DIGIT, GAP, FEED, STOP, COMMA, BAR, CALL, SYMBOL, OTHER_SIGN, WIDE = range(12)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER_SIGN, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = SMALL, LARGE, DIGIT, WIDE
    kind[[9, 11, 12, 13, 32]], kind[10] = GAP, FEED
    for chars, k in ((".", STOP), (",;:", COMMA), ("|", BAR), ("!?", CALL), ("#*$%&<>@^~=+\\", SYMBOL)):
        kind[[ord(c) for c in chars]] = k
    return kind


CLASSES = _classes()
FEATURES = 12 + 9


def _fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base = np.zeros(len(data), np.int64)
    base[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(77)), out=sums[1:])
    return mixed(sums[ends] - sums[starts])


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    return edge[::2], edge[1::2]


def _stops() -> np.ndarray:
    data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    return np.unique(_fingerprints(data, *_bounds(data)))


STOPS = _stops()


def _again(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value has an equal one in its group."""
    key = mixed(value + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[back] > 1


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the offsets of each text's passages; every text has at least one."""
    found, counts, at = [np.zeros((0, FEATURES))], [], 0
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (size < CHUNK or end == at):
            size += len(raw[end])
            end += 1
        features, n = _block(raw[at:end])
        found.append(features)
        counts.append(n)
        at = end
    return np.concatenate(found), offsets_of(np.concatenate(counts) if counts else np.zeros(0, np.int64))


def _block(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    firsts = offsets_of(np.array([len(r) + 1 for r in raw]))
    starts, ends = _bounds(data)
    bounds = np.searchsorted(starts, firsts)
    words = np.diff(bounds)
    n_passages = np.maximum(1, -(-words // PASSAGE))
    base = offsets_of(n_passages)
    doc = np.repeat(np.arange(len(raw)), words)
    within = np.arange(len(starts)) - np.repeat(bounds[:-1], words)
    passage = base[doc] + within // PASSAGE
    total = int(base[-1])
    head = np.flatnonzero(within % PASSAGE == 0)
    edge = np.concatenate([starts[head], firsts[:-1]])
    owner = np.concatenate([passage[head], base[:-1]])
    order = np.lexsort((owner, edge))
    lengths = np.diff(np.append(edge[order], len(data)))
    of_byte = np.repeat(owner[order], lengths)
    chars = np.bincount(of_byte * 12 + CLASSES[data], minlength=total * 12).reshape(total, 12).astype(float)
    n = np.maximum(np.bincount(passage, minlength=total), 1).astype(float)
    mark = _fingerprints(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), starts, ends)
    share = lambda flag: np.bincount(passage, weights=flag, minlength=total) / n
    width = (ends - starts).astype(float)
    mean = share(width)
    beside = np.zeros(len(mark), bool)
    beside[1:] = (mark[1:] == mark[:-1]) & (doc[1:] == doc[:-1])
    four = np.zeros(len(mark), bool)
    if len(mark) > 3:
        h = mark[:-3].copy()
        for j in (1, 2, 3):
            h = mixed(h * np.uint64(0x100000001B3) + mark[j:len(mark) - 3 + j])
        inside = doc[:-3] == doc[3:]
        four[:-3] = _again(np.where(inside, doc[:-3], len(raw) + np.arange(len(h))), h)
    out = np.empty((total, FEATURES))
    out[:, :12] = chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)
    out[:, 12] = mean / 10
    out[:, 13] = np.sqrt(np.maximum(share(width ** 2) - mean ** 2, 0)) / 10
    out[:, 14] = share(np.isin(mark, STOPS))
    out[:, 15] = share(_again(passage, mark))
    out[:, 16] = share(beside)
    out[:, 17] = share(four)
    out[:, 18] = share(~((data[starts] | 32) >= 97) if len(starts) else np.zeros(0))
    out[:, 19] = share((data[starts] >= 65) & (data[starts] <= 90)) if len(starts) else 0
    out[:, 20] = np.minimum(n, PASSAGE) / PASSAGE
    return out, n_passages


class Model(NamedTuple):
    middle: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def attention(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh(((x - self.middle) / self.spread) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        lengths = np.diff(offsets)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, offsets[:-1]), lengths))
        a = e / np.repeat(np.add.reduceat(e, offsets[:-1]), lengths)
        z = np.add.reduceat(a[:, None] * h, offsets[:-1], axis=0)
        return h, t, s, a, z

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.attention(x, offsets)[-1]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights["c"] + self.weights["d"], -30, 30)))


def train(x: np.ndarray, offsets: np.ndarray, labels: np.ndarray, hidden: int = 16, rounds: int = 300, rate: float = 0.02,
          decay: float = 1e-4) -> Model:
    """Fit all weights by Adam; labels weigh by the root of their rarity."""
    rng = np.random.default_rng(7)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    w = {"W": rng.normal(0, 0.3, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, 8)),
         "U": rng.normal(0, 0.3, (hidden, 8)), "w": np.zeros(8), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    model = Model(middle, spread, w)
    share = np.array([np.mean(labels == k) for k in (0, 1)])
    weight = 1 / np.sqrt(np.maximum(share, 1e-9))[labels.astype(int)] / len(labels)
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    inputs, lengths = (x - middle) / spread, np.diff(offsets)
    for step in range(1, rounds + 1):
        h, t, s, a, z = model.attention(x, offsets)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        g = (p - labels) * weight
        gz = np.repeat(g[:, None] * w["c"], lengths, axis=0)
        along = (gz * h).sum(axis=1)
        ge = a * (along - np.repeat(np.add.reduceat(a * along, offsets[:-1]), lengths))
        gt, gs = ge[:, None] * w["w"] * s * (1 - t ** 2), ge[:, None] * w["w"] * t * s * (1 - s)
        gh = (a[:, None] * gz + gt @ w["V"].T + gs @ w["U"].T) * (1 - h ** 2)
        grads = {"c": z.T @ g, "d": np.array([g.sum()]), "w": (t * s).T @ ge, "V": h.T @ gt, "U": h.T @ gs,
                 "W": inputs.T @ gh, "b": gh.sum(axis=0)}
        for k, gk in grads.items():
            gk = gk + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.999 * v[k] + 0.001 * gk ** 2
            w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def sample_bags(docs: DataFrame, labels: DataFrame, documents: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most `documents` labelled texts, of each at most `most` passages at even distances."""
    chosen = (labels.where("id is not null and quality is not null")
              .orderBy(F.xxhash64("id"), "id", "quality").limit(documents))
    texts = docs.join(F.broadcast(chosen), "id").select("quality", "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, offsets = passages(part.column("text").to_pylist())
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    pick = np.unique(np.linspace(a, b - 1, min(most, b - a)).astype(int))
                    rows.append(x[pick].ravel().tolist())
                yield pa.RecordBatch.from_arrays([part.column("quality").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                                 ["quality", "features"])
    rows = texts.mapInArrow(run, "quality int, features array<double>").collect()
    rows.sort(key=lambda r: (r.quality, r.features))
    x = [np.array(r.features).reshape(-1, FEATURES) for r in rows]
    return (np.concatenate(x) if x else np.zeros((0, FEATURES)), offsets_of(np.array([len(b) for b in x], np.int64)),
            np.array([r.quality for r in rows]))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 6000,
          passages_of_each: int = 100) -> DataFrame:
    """(id, score) of every row, learnt from labels (id, quality)."""
    docs = ids_and_texts(df, id_col, text_col)
    x, offsets, known = sample_bags(docs, labels, documents, passages_of_each)
    model = train(x, offsets, known) if len(known) else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = model.score(*passages(part.column("text").to_pylist())) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], ["id", "score"])
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")
