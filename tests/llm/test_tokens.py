"""Encoding, counting and record output against the public libraries, byte for byte."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shootlake.llm import framed_ids, sentence_pieces, token_counts
from shootlake.llm.ragged import PairTable, merge_all, offsets_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


TEXTS = st.lists(st.text(st.one_of(st.sampled_from(" abcthe.,_<|>'▁\n\t²é😀İΣ́\x1c\x85"), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=20)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_pieces_as_the_library(pieces, texts):
    coder = sentence_pieces.coder(PIECES)
    flat, offsets = coder.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == pieces.encode(texts)
    assert coder.decode(flat, offsets) == pieces.decode(pieces.encode(texts))
    assert token_counts.counter(PIECES).counts(texts).tolist() == [len(x) for x in pieces.encode(texts)]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_as_the_library(words, texts):
    flat, offsets = framed_ids.words(WORDS).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [
        words.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 31_999), max_size=30), min_size=1, max_size=8))
def test_decoding_any_ids(pieces, ids):
    offsets = offsets_of(np.array([len(x) for x in ids]))
    flat = np.array([i for x in ids for i in x], np.int32)
    assert sentence_pieces.coder(PIECES).decode(flat, offsets) == [pieces.decode(x) for x in ids]


def test_long_texts_are_cut_at_blanks(pieces, monkeypatch):
    from shootlake.llm import pieces as module
    monkeypatch.setattr(module, "BLOCK", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  c.\n") for _ in range(rng.randint(0, 400))) for _ in range(50)]
    flat, offsets = sentence_pieces.coder(PIECES).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == pieces.encode(texts)


def test_merging_ties_takes_the_leftmost():
    # 0+0 -> 1 and 1+0 -> 2 share a rank: only one place at a time
    table = PairTable(*(np.array(c) for c in ([0, 1], [0, 0], [5, 5], [1, 2])))
    flat, offsets = merge_all(np.zeros(5, np.int64), np.array([0, 5]), table)
    assert flat.tolist() == [2, 1]
    assert merge_all(np.zeros(0, np.int64), np.zeros(1, np.int64), table)[1].tolist() == [0]


def test_odd_rows(spark, odd, none, pieces):
    for frame in (odd, none):
        texts = {(r.doc_id, r.text) for r in frame.collect()}
        got = sentence_pieces.decode(sentence_pieces.encode(frame, PIECES), PIECES).collect()
        assert len(got) == frame.count()
        assert {(r.id, tuple(r.ids)) for r in got} == {(i, tuple(pieces.encode(t or ""))) for i, t in texts}
        assert {(r.id, r.decoded) for r in got} == {(i, pieces.decode(pieces.encode(t or ""))) for i, t in texts}
        counts = token_counts.count_tokens(frame, PIECES).collect()
        assert sorted(map(str, counts)) == sorted(str(type(counts[0])(id=r.doc_id, n_bytes=len((r.text or "").encode()),
                                                  n_tokens=len(pieces.encode(r.text or "")))) for r in frame.collect()) if counts else True
        assert len(counts) == frame.count()


def test_decoding_null_ids(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, 0])], "id long, ids array<int>")
    assert {r.id: r.decoded for r in sentence_pieces.decode(frame, PIECES).collect()} == {1: "", 2: "", 3: " ⁇ "}


def slow_masked_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    rows = [bytes((7 * i + n) % 256 for i in range(n)) for n in (0, 2, 8, 254, 256, 258, 1000, 4098, 0)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    assert framed_ids.masked_crc32c(data, offsets_of(np.array([len(r) for r in rows]))).tolist() == [slow_masked_crc(r) for r in rows]


def test_records_round_trip(odd, none, words):
    folder, manifest = framed_ids.write(odd, WORDS, end_id=1)
    got = sorted(framed_ids.read(folder, framed_ids.with_starts(manifest)).collect(), key=lambda r: r.start)
    at, last = 0, None
    left = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in odd.collect())
    assert len(got) == len(left)
    assert [r.id for r in got] == [i if known else None for (known, i), _ in left]
    want = {}
    for key, text in left:
        ids = words.encode(text, add_special_tokens=False).ids + [1]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have.setdefault((r.id is not None, r.id or 0), []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    folder, manifest = framed_ids.write(none, WORDS, end_id=1)
    assert framed_ids.read(folder, framed_ids.with_starts(manifest)).count() == 0


def test_shuffled_reads_go_by_the_index(odd, none, words):
    folder, manifest = framed_ids.write(odd, WORDS, end_id=1)
    got = framed_ids.shuffled(folder, manifest, 7).collect()
    assert [r.draw for r in got] == sorted(r.draw for r in got)
    want = sorted((r.doc_id is not None, r.doc_id or 0, *words.encode(r.text or "", add_special_tokens=False).ids, 1) for r in odd.collect())
    assert sorted((r.id is not None, r.id or 0, *r.ids) for r in got) == want
    assert got == framed_ids.shuffled(folder, manifest, 7).collect()
    assert [r.id for r in got] != [r.id for r in framed_ids.shuffled(folder, manifest, 8).collect()]
    fs, base = framed_ids.file_system(folder)
    for name in {r.shard for r in manifest.collect()}:  # an index that points elsewhere is noticed
        raw = np.fromfile(f"{base}/{name}.index", "<i8")
        raw[::2] += 1
        raw.tofile(f"{base}/{name}.index")
    for broken in (framed_ids.shuffled(folder, manifest, 7), framed_ids.read(folder, framed_ids.with_starts(manifest))):
        with pytest.raises(Exception, match="damaged record"):
            broken.collect()
    folder, manifest = framed_ids.write(none, WORDS, end_id=1)
    assert framed_ids.shuffled(folder, manifest, 7).count() == 0


def test_damage_is_noticed(odd):
    folder, manifest = framed_ids.write(odd.where("doc_id = 4"), WORDS, end_id=1)
    fs, base = framed_ids.file_system(folder)
    path = f"{base}/{manifest.first().shard}"
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged record"):
        framed_ids.read(folder, framed_ids.with_starts(manifest)).collect()
