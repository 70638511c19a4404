"""Token-id output as length-delimited binary records.

`encode` gives the ids of texts with a lower-casing, byte-level vocabulary with word ends. `write` puts each document's ids
into one record of a shard file: length (8 bytes), masked CRC-32C of the length, the ids as unsigned integers, masked
CRC-32C of the ids; all numbers little-endian. Ids take 2 bytes where the vocabulary fits, else 4; the manifest tells.
Beside each shard an offset index holds (offset, length) of every record, 16 bytes each. Shards follow ascending id; the
returned manifest, one row per document, is what counts: files of failed attempts are in no manifest and never read. The
manifest knows a record by its number in its shard only: where it lies, both readers learn from the index. `read` goes in
file order, `shuffled` in a random order fixed by a seed; both check both sums of every record.

Defined results: a null text is the empty text; equal ids are ordered by text fingerprint; repeated rows become repeated
records; null ids come first; an empty table gives an empty manifest; very long texts are one record; other columns are
not carried.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm.pieces import mixed
from shootlake.llm.ragged import Memo, PairTable, gather, merge_all, offsets_of
from shootlake.llm.shared import file_system, fresh_path, ids_and_texts, settle

#: Characters handled at once, bytes of a shard after which a new one begins, words a worker remembers.
BLOCK, SHARD, REMEMBERED = 2_000_000, 256 << 20, 1_500_000
#: Bytes of neighbouring records taken in one read, records of a shuffled read held at once.
READ, DRAWN = 8 << 20, 512
LETTER, DIGIT, SPACE, SIGN, ODD = 1, 2, 3, 4, 5


# --- checksums

@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Table for two bytes at once, and for each power of two of bytes the 4x256 tables that skip so many zeros."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    both = np.arange(65536, dtype=np.uint32)
    two = table[both & 0xFF] ^ (both >> 8)
    two = table[two & 0xFF] ^ (two >> 8)
    skip = np.stack([(lambda v: table[v & 0xFF] ^ (v >> 8))(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    powers = [skip]
    for _ in range(40):
        last = powers[-1]
        powers.append(np.stack([_apply(last, row) for row in last]))
    return two, powers


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24])


def _advance(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The sums after so many zero bytes more."""
    _, powers = _crc_tables()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on = (zeros >> k) & 1 == 1
        crc[on] = _apply(powers[k], crc[on])
    return crc


def masked_crc32c(data: np.ndarray, offsets: np.ndarray, lane: int = 256) -> np.ndarray:
    """Masked CRC-32C of every row of ragged bytes (rows of even length), many lanes side by side."""
    two, _ = _crc_tables()
    lengths = np.diff(offsets)
    lanes = -(-lengths // lane)
    first = offsets_of(lanes)
    padded = np.zeros(int(first[-1]) * lane, np.uint8)  # zeros in front leave a sum of zero as it is
    shift = np.repeat(first[1:] * lane - offsets[1:], lengths)
    padded[np.arange(len(data)) + shift] = data
    words = padded.view("<u2").reshape(-1, lane // 2).T.copy()
    crc = np.zeros(int(first[-1]), np.uint32)
    for w in words:
        crc = two[(crc ^ w) & 0xFFFF] ^ (crc >> 16)
    after = np.repeat(first[1:], lanes) - 1 - np.arange(len(crc))
    crc = _advance(crc, after * lane)
    total = np.zeros(len(lengths), np.uint32)
    held = lanes > 0
    if held.any():
        total[held] = np.bitwise_xor.reduceat(crc, first[:-1][held])
    total ^= _advance(np.full(len(lengths), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)
    return ((total >> np.uint32(15)) | (total << np.uint32(17))) + np.uint32(0xA282EAD8)


# --- encoding

class Words:
    """Ids of texts. Words of plain Latin letters, digits and signs are cut and merged as arrays; white-space delimited
    stretches with anything else in them (marks, other scripts, apostrophes, special strings) go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        rows = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in vocab and b in vocab and a + b in vocab:
                rows.append((vocab[a], vocab[b], rank, vocab[a + b]))
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*rows)))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        chars = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in visible)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)])
        self.final = np.array([vocab[chars[b] + suffix] for b in range(256)])
        self.kind = np.full(0x110000, ODD, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for c in [*range(33, 127), *range(0xC0, 0x100)]:
            s = chr(c)
            self.kind[c] = LETTER if s.isalpha() else DIGIT if s.isdigit() else SIGN
            self.lower[c] = ord(s.lower())
        self.kind[[9, 10, 11, 12, 13, 32]] = SPACE
        self.kind[[ord("'"), 0xD7, 0xF7]] = ODD
        self.memo = Memo(REMEMBERED)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        flats, counts, at = [np.zeros(0, np.int32)], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BLOCK or end == at):
                size += len(texts[end] or "")
                end += 1
            flat, offsets = self._block(texts[at:end])
            flats.append(flat)
            counts.append(np.diff(offsets))
            at = end
        return np.concatenate(flats), offsets_of(np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("\n".join([t or "" for t in texts]).encode("utf-32-le"), np.uint32)
        firsts = offsets_of(np.array([len(t or "") + 1 for t in texts]))
        kind = self.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        gap = kind == SPACE
        special = np.flatnonzero((codes[:-1] == ord("<")) & (codes[1:] == ord("|"))) if len(codes) > 1 else []
        odd = kind == ODD
        odd[special] = True
        if odd.any():  # whole stretches between white space
            stretch = np.flatnonzero(np.concatenate(([True], gap[1:] != gap[:-1])))
            strange = np.logical_or.reduceat(odd, stretch)
            sizes = np.diff(np.append(stretch, len(codes)))
            inside = np.repeat(strange, sizes)
            cut[inside] = False
            cut[stretch] = True
        else:
            inside = odd
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        solid = ~gap[starts]
        starts, ends = starts[solid], ends[solid]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        low = np.where(inside, codes, self.lower[codes])
        lengths = ends - starts
        place = self._places(starts, len(codes))
        value = mixed(low.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        key = sums[ends] - sums[starts] + inside[starts].astype(np.uint64)
        keys, first, number = np.unique(key, return_index=True, return_inverse=True)
        fresh = self.memo.missing(keys)
        if len(fresh):
            self._learn(keys[fresh], low, starts[first[fresh]], lengths[first[fresh]], inside[starts[first[fresh]]])
        rows = self.memo.rows(keys)[number]
        flat, out = gather(self.memo.pool, self.memo.ends, rows)
        return flat, out[np.searchsorted(starts, firsts)]

    @staticmethod
    def _places(starts: np.ndarray, size: int) -> np.ndarray:
        """Distance of every place from the last start."""
        base = np.zeros(size, np.int64)
        base[starts] = starts
        return np.arange(size) - np.maximum.accumulate(base)

    def _learn(self, keys, low, starts, lengths, odd) -> None:
        plain = np.flatnonzero(~odd)
        chars, bounds = self._take(low, starts[plain], lengths[plain])
        wide = chars > 0x7F  # Latin letters take two bytes
        width = 1 + wide.astype(np.int64)
        at = offsets_of(width)
        symbols = np.zeros(at[-1], np.int64)
        symbols[at[:-1]] = np.where(wide, 0xC0 | (chars >> 6), chars)
        symbols[at[:-1][wide] + 1] = 0x80 | (chars[wide] & 0x3F)
        offsets = at[bounds]
        ids = self.inner[symbols]
        ids[offsets[1:] - 1] = self.final[symbols[offsets[1:] - 1]]
        flat, ends = merge_all(ids, offsets, self.pairs)
        others = np.flatnonzero(odd)
        if len(others):
            found = self.library.encode_batch_fast(
                [low[a:a + n].astype("<u4").tobytes().decode("utf-32-le") for a, n in zip(starts[others], lengths[others])],
                add_special_tokens=False)
            extra = [e.ids for e in found]
            flat = np.concatenate([flat, np.array([i for e in extra for i in e], np.int64)])
            ends = np.append(ends, ends[-1] + np.cumsum([len(e) for e in extra]))
        order = np.concatenate([plain, others])
        back = np.argsort(order)
        flat, ends = gather(flat, ends, back)
        self.memo.add(keys, flat.astype(np.int32), ends)

    @staticmethod
    def _take(pool, starts, lengths):
        bounds = offsets_of(lengths)
        return pool[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)].astype(np.int64), bounds


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


# --- files

class _Shard:
    """A record file and its index, written front to back."""

    def __init__(self, folder: str, width: int):
        self.width = width
        self.name = f"{uuid.uuid4().hex}.ids"
        fs, self.folder = file_system(folder)
        fs.create_dir(self.folder, recursive=True)
        self.file = fs.open_output_stream(f"{self.folder}/{self.name}")
        self.index = fs.open_output_stream(f"{self.folder}/{self.name}.index")
        self.size = self.count = 0

    def add(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Append a record per row; returns the number of each in this shard."""
        width = self.width
        data, sizes = flat.astype(f"<u{width}").view(np.uint8), np.diff(offsets) * width
        heads = sizes.astype("<u8").view(np.uint8)
        head_sums = masked_crc32c(heads, np.arange(len(sizes) + 1) * 8, 8)
        sums = masked_crc32c(data, offsets * width)
        at = offsets_of(sizes + 16)
        out = np.zeros(at[-1], np.uint8)
        place = at[:-1, None]
        out[place + np.arange(8)] = heads.reshape(-1, 8)
        out[place + 8 + np.arange(4)] = head_sums.astype("<u4").view(np.uint8).reshape(-1, 4)
        out[np.arange(len(data)) + np.repeat(at[:-1] + 12 - offsets[:-1] * width, sizes)] = data
        out[at[1:, None] - 4 + np.arange(4)] = sums.astype("<u4").view(np.uint8).reshape(-1, 4)
        begins = self.size + at[:-1]
        self.file.write(out.tobytes())
        self.index.write(np.stack([begins, sizes], axis=1).astype("<i8").tobytes())
        self.size += int(at[-1])
        self.count += len(sizes)
        return np.arange(self.count - len(sizes), self.count)

    def close(self) -> None:
        self.file.close()
        self.index.close()


def write(df: DataFrame, model: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all documents; (folder, manifest of id, part, place, shard, number, n_tokens, width)."""
    from pyspark import TaskContext
    spark = df.sparkSession
    folder = fresh_path(spark, "records")
    source = ids_and_texts(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        width = 2 if max(words(model).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard, place, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                flat, offsets = words(model).encode(rows.column("text").to_pylist())
                n = np.diff(offsets) + 1
                ends = offsets_of(n)
                full = np.full(ends[-1], end_id, np.int64)
                full[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n - 1)] = flat
                if shard is None or shard.size > SHARD:
                    if shard:
                        shard.close()
                    shard = _Shard(folder, width)
                numbers = shard.add(full, ends)
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(np.full(len(n), part)), pa.array(place + np.arange(len(n))),
                    pa.array([shard.name] * len(n)), pa.array(numbers), pa.array(n),
                    pa.array(np.full(len(n), width))], ["id", "part", "place", "shard", "number", "n_tokens", "width"])
                place += len(n)
        if shard:
            shard.close()
    kind = source.schema["id"].dataType.simpleString()
    manifest = ordered.mapInArrow(run, f"id {kind}, part long, place long, shard string, number long, n_tokens long, width long")
    return folder, settle(manifest, "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`: ids of all documents before. Parts are summed first, one row each."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = F.sum("n_tokens").over(W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return manifest.join(parts.select("part", "base"), "part").withColumn("start", F.col("base") + F.coalesce(before, F.lit(0)))


class _Records:
    """Records of shards by their numbers; offsets and lengths come from the shard's index."""

    def __init__(self, folder: str):
        self.fs, self.base = file_system(folder)
        self.name, self.file, self.index = None, None, None

    def open(self, shard: str) -> None:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
            self.index = self.fs.open_input_file(f"{self.base}/{shard}.index")

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.index.close()
            self.file = None

    def entries(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of `n` records from number `first` on."""
        self.index.seek(16 * first)
        raw = np.frombuffer(self.index.read(16 * n), "<i8").reshape(-1, 2)
        if len(raw) < n:
            raise ValueError(f"damaged index of {self.name}")
        return raw[:, 0], raw[:, 1]

    def fetch(self, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of ids, offsets) of neighbouring records in one read, both checksums tested."""
        self.file.seek(int(begins[0]))
        data = np.frombuffer(self.file.read(int(begins[-1] + sizes[-1] + 16 - begins[0])), np.uint8)
        local = begins - begins[0]
        if len(data) < local[-1] + sizes[-1] + 16:
            raise ValueError(f"damaged record in {self.name} near byte {begins[0]}")
        heads = data[local[:, None] + np.arange(12)]
        told = heads[:, :8].copy().view("<u8").ravel().astype(np.int64)
        head_sums = heads[:, 8:].copy().view("<u4").ravel()
        good = not (told != sizes).any() and not (
            masked_crc32c(heads[:, :8].copy().ravel(), np.arange(len(told) + 1) * 8, 8) != head_sums).any()
        if good:
            bounds = offsets_of(told)
            body = data[np.arange(bounds[-1]) + np.repeat(local + 12 - bounds[:-1], told)]
            sums = data[(local + 12 + told)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            good = not (masked_crc32c(body, bounds) != sums).any()
        if not good:
            raise ValueError(f"damaged record in {self.name} near byte {begins[0]}")
        return body, bounds

    def each(self, shards: list[str], numbers: np.ndarray):
        """(first row, end row, bytes, offsets) for stretches of rows whose records follow one another."""
        at = 0
        while at < len(shards):
            end = at + 1
            while end < len(shards) and shards[end] == shards[at] and numbers[end] == numbers[end - 1] + 1:
                end += 1
            self.open(shards[at])
            begins, sizes = self.entries(int(numbers[at]), end - at)
            while at < end:
                n = max(1, int(np.searchsorted(begins + sizes, begins[0] + READ)))
                yield (at, at + n, *self.fetch(begins[:n], sizes[:n]))
                begins, sizes, at = begins[n:], sizes[n:], at + n


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read from the files by the index, both checksums tested."""
    def run(batches):
        import zlib
        records = _Records(folder)
        for batch in batches:
            widths = batch.column("width").to_numpy()
            found = []
            for at, _, body, bounds in records.each(batch.column("shard").to_pylist(), batch.column("number").to_numpy()):
                ids = body.view(f"<u{widths[at]}").astype("<u4").tobytes()
                places = (bounds // widths[at] * 4).tolist()
                found += [((b - a) // 4, zlib.crc32(ids[a:b])) for a, b in zip(places, places[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"),
                                              pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([c for _, c in found], pa.int64())],
                                             ["id", "start", "n_tokens", "ids_crc32"])
        records.close()
    kind = manifest.schema["id"].dataType.simpleString()
    return manifest.select("id", "start", "shard", "number", "width").mapInArrow(
        run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def shuffled(folder: str, manifest: DataFrame, seed: int) -> DataFrame:
    """(draw, id, ids) of every record in a random order, the same for the same seed and files' contents.

    Rows are dealt out by ranges of `draw`, a hash of seed, part and place, and ascend by it from one partition to the next. A
    task reads a block of `DRAWN` records at once by their index entries, in file order, and gives them back in drawn order.
    """
    kind = manifest.schema["id"].dataType.simpleString()
    drawn = manifest.withColumn("draw", F.xxhash64(F.lit(seed), "part", "place")).select(
        "draw", "part", "place", "id", "shard", "number", "width")
    dealt = drawn.repartitionByRange("draw", "part", "place").sortWithinPartitions("draw", "part", "place")

    def run(batches):
        records = _Records(folder)
        for whole in batches:
            for first in range(0, whole.num_rows, DRAWN):
                batch = whole.slice(first, DRAWN)
                shards, numbers = batch.column("shard").to_pylist(), batch.column("number").to_numpy()
                order = sorted(range(len(shards)), key=lambda k: (shards[k], numbers[k]))
                widths, out = batch.column("width").to_numpy()[order], [None] * len(shards)
                for at, end, body, bounds in records.each([shards[k] for k in order], numbers[order]):
                    for k in range(at, end):
                        out[order[k]] = body[bounds[k - at]:bounds[k - at + 1]].view(f"<u{widths[k]}").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(o) for o in out])), pa.int32()), np.concatenate(out))
                yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("id"), ids], ["draw", "id", "ids"])
        records.close()
    return dealt.mapInArrow(run, f"draw long, id {kind}, ids array<int>")
