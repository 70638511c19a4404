"""WARC archives with a globally ordered capture index.

`write` puts every page into a gzip-per-record WARC file of its task and closes each file with a run file beside it: the
archive's captures sorted by (URL key, timestamp, id), in blocks of `BLOCK`. `merge` is an external merge of these runs. The
first and last key of every block give the split keys of key ranges; a task takes the stretches of at most `FAN_IN` runs in
one range and a loser tree yields their captures in order, one block of each run in memory at a time. While a range has more
stretches than that, groups of them are merged into longer runs first. Ranges follow one another, so the written index is
ordered as a whole. `read` fetches records by the index and checks their digests.

Of captures with equal payloads of `LEAST` bytes or more the one with the largest id is a response, the others are revisits
that name it by its id, URL and date; smaller payloads are all responses. A revisit keeps the response's HTTP header, with
the payload's length. The index written at the end is what counts: files of failed attempts are in no index and never read.

Record ids are made from archive name and offset, so repeated and null page ids have records of their own; the page id
travels in a field of its own. Each archive begins with a warcinfo record.

Defined results: a null payload is empty; a null URL has an empty key; a null time is dated to the epoch in the record and
stays null in the index; null ids are never referred to; repeated rows are repeated records, of which ties in the id leave
each a response; an empty table gives an empty index; payloads of any length are one record; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm.shared import file_system, fresh_path, settle

LEAST = 1000
#: Bytes of an archive after which a new one begins.
ARCHIVE = 256 << 20
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("key string, time string, id {id}, file string, at long, size long, kind string, refers {id}")
COLUMNS = [c.split()[0] for c in CAPTURE.split(", ")]
#: Captures of a block of a run, runs merged by one task, captures of a key range and the most key ranges.
BLOCK, FAN_IN, RANGE, RANGES = 1024, 64, 100_000, 2048
EPOCH = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Sortable key of a URL: host labels from the right, then path and query, lower-case, without scheme and fragment."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^www\.|:(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                    F.regexp_replace(plain, r"^[^/?]*", ""))


def with_originals(pages: DataFrame) -> DataFrame:
    """Pages with digest, kind and the id a revisit refers to. Copies are counted before anything moves."""
    p = pages.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    groups = (p.where(F.col("bytes") >= LEAST).groupBy("digest")
              .agg(F.max(F.struct("id", "url", "time")).alias("original"), F.count("id").alias("n"))
              .where(F.col("n") > 1).select("digest", "original"))
    marked = p.join(groups, "digest", "left")
    again = (F.col("bytes") >= LEAST) & F.col("id").isNotNull() & (F.col("id") != F.col("original.id"))
    return marked.withColumn("kind", F.when(F.coalesce(again, F.lit(False)), "revisit").otherwise("response")).withColumn(
        "refers", F.when(F.col("kind") == "revisit", F.col("original.id"))).withColumn(
        "refers_url", F.col("original.url")).withColumn("refers_time", F.col("original.time")).drop("original", "bytes")


def _packed(head: list[str], block: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    lines = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}\r\n\r\n"])
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_id(name: str, at: int) -> str:
    return f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{at}')}>"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _opening(name: str) -> bytes:
    return _packed(["WARC-Type: warcinfo", _record_id(name, 0), f"WARC-Date: {EPOCH}", f"WARC-Filename: {name}",
                    "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _record(name, at, time, ident, url, payload: bytes, digest: str, kind: str, refers, refers_url, refers_time) -> bytes:
    told = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", _record_id(name, at), f"WARC-Date: {time or EPOCH}", f"WARC-Target-URI: {_target(url)}",
            f"WARC-Payload-Digest: sha1:{told}", "Content-Type: application/http;msgtype=response"]
    if ident is not None:
        head.append(f"Page-Id: {ident}")
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME}", f"WARC-Refers-To-Target-URI: {_target(refers_url)}",
                 f"WARC-Refers-To-Date: {refers_time or EPOCH}", f"Refers-To-Page-Id: {refers}"]
    return _packed(head, block)


def _place(key, time, ident) -> tuple:
    """Where a capture belongs; nulls come first."""
    return key, time or "", ident is not None, ident or 0


class _Run:
    """A file of captures in order, in blocks that can be read one by one."""

    def __init__(self, fs, path: str, schema: pa.Schema, size: int):
        self.size = size
        self.file = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.file, schema)
        self.schema, self.blocks, self.held = schema, 0, []

    def add(self, capture: tuple) -> None:
        self.held.append(capture)
        if len(self.held) == self.size:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_batch(_batch(self.held, self.schema))
            self.blocks, self.held = self.blocks + 1, []

    def close(self) -> int:
        self._flush()
        self.writer.close()
        self.file.close()
        return self.blocks


def _batch(captures: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*captures), schema.types)], schema=schema)


def _run_schema(number: pa.DataType) -> pa.Schema:
    text, long = pa.string(), pa.int64()
    return pa.schema(list(zip(COLUMNS, (text, text, number, text, long, long, text, number))))


def write(df: DataFrame, id_col: str, url_col: str, payload_col: str, time: Column) -> tuple[str, DataFrame]:
    """Write all pages; (folder, captures read back from the run files, with `run` and `block`)."""
    spark = df.sparkSession
    folder = fresh_path(spark, "warc")
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                      F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
                      F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
    given = with_originals(pages).withColumn("key", url_key(F.col("url"))).select(
        "key", "time", "id", "url", "payload", "digest", "kind", "refers", "refers_url", "refers_time")

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, file, at, captures, schema = None, None, 0, [], None

        def closed():
            file.close()
            captures.sort(key=lambda c: _place(*c[:3]))
            sorted_run = _Run(fs, f"{base}/{name}.run", schema, BLOCK)
            for c in captures:
                sorted_run.add(c)
            n = sorted_run.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.run"] * n), pa.array(range(n), pa.int64())], ["run", "block"])

        for batch in batches:
            schema = _run_schema(batch.column("id").type)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    name, captures = f"{uuid.uuid4().hex}.warc.gz", []
                    file = fs.open_output_stream(f"{base}/{name}", compression=None)
                    at = file.write(_opening(name))
                data = _record(name, at, *row[1:])
                file.write(data)
                captures.append((row[0], row[1], row[2], name, at, len(data), row[6], row[7]))
                at += len(data)
                if at > ARCHIVE:
                    yield from closed()
                    file = None
        if file is not None:
            yield from closed()

    blocks = settle(given.mapInArrow(run, "run string, block long"), "runs")
    kind = pages.schema["id"].dataType.simpleString()
    return folder, blocks.mapInArrow(_blocks_read, CAPTURE.format(id=kind) + ", run string, block long")


def _blocks_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, reader = None, None
    for batch in batches:
        for path, block in zip(batch.column("run").to_pylist(), batch.column("block").to_pylist()):
            if path != name:
                name, reader = path, _opened(path)
            found = reader.get_batch(block)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array([path] * found.num_rows), pa.array([block] * found.num_rows, pa.int64())],
                                             [*COLUMNS, "run", "block"])


def _opened(path: str):
    fs, plain = file_system(path)
    return pa.ipc.open_file(fs.open_input_file(plain))


def losers(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted iterators in order, by a tree of losers: one comparison a level for every item."""
    done = (1,)
    heads = [((0, x) if (x := next(r, None)) is not None else done) for r in runs]
    n = len(runs)
    tree = [-1] * max(n, 1)  # 0: the winner; others: the loser at that inner node
    for leaf in range(n):
        winner, node = leaf, (leaf + n) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node], winner = winner, -1
                break
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while n and heads[tree[0]] != done:
        winner = tree[0]
        yield heads[winner][1]
        x = next(runs[winner], None)
        heads[winner] = (0, x) if x is not None else done
        node = (winner + n) // 2
        while node > 0:
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _stretch(number: int, path: str, first: int, last: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """(place, stretch, row, capture) of a run's blocks from `low` on and below `high`, one block in memory."""
    reader, row = _opened(path), 0
    for block in range(first, last + 1):
        for capture in zip(*(c.to_pylist() for c in reader.get_batch(block).columns)):
            place = _place(*capture[:3])
            if high is not None and place >= high:
                return
            if low is None or place >= low:
                yield place, number, row, capture
            row += 1


def merge(captures: DataFrame) -> DataFrame:
    """The captures of all runs in the order of (key, time, id), written as the index; `place` counts within a partition."""
    spark = captures.sparkSession
    kind = captures.schema["id"].dataType.simpleString()
    place = F.struct("key", F.coalesce("time", F.lit("")).alias("time"), F.col("id").isNotNull().alias("known"),
                     F.coalesce("id", F.lit(0)).cast(kind).alias("id"))
    fences = settle(captures.groupBy("run", "block").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows")), "fences")
    total = fences.agg(F.sum("rows")).first()[0] or 0
    ranges = max(1, min(RANGES, -(-total // RANGE)))
    # the first fence of each range of fences: at most RANGES rows
    cuts = fences.repartitionByRange(ranges, "first").groupBy(F.spark_partition_id().alias("p")).agg(F.min("first").alias("cut"))
    cuts = sorted(tuple(r.cut) for r in cuts.collect())[1:] if ranges > 1 else []
    edges = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, fences.schema["first"].dataType))) for c in cuts))
    below = lambda at: F.size(F.filter(edges, lambda e: e <= F.col(at))) if cuts else F.lit(0)
    stretches = (fences.withColumn("range", F.explode(F.sequence(below("first"), below("last"))))
                 .groupBy("range", "run").agg(F.min("block").alias("first"), F.max("block").alias("last")))
    low, high = [None, *cuts], [*cuts, None]

    def grouped(batches):
        """((range, group), merged captures) for each group of stretches, which lie side by side."""
        at, held = None, []

        def merged():
            return at, losers([iter(_stretch(n, *s, low[at[0]], high[at[0]])) for n, s in enumerate(held)])
        for batch in batches:
            for r, g, *s in zip(*(batch.column(c).to_pylist() for c in ("range", "group", "run", "first", "last"))):
                if at != (r, g) and held:
                    yield merged()
                    held = []
                at = (r, g)
                held.append(s)
        if held:
            yield merged()

    number = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    schema = _run_schema(number)
    folder = fresh_path(spark, "merged")

    def shorten(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for (r, _), items in grouped(batches):
            path = f"{uuid.uuid4().hex}.run"
            longer = _Run(fs, f"{base}/{path}", schema, BLOCK)
            for item in items:
                longer.add(item[3])
            n = longer.close()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([f"{folder}/{path}"]), pa.array([0], pa.int64()),
                                                  pa.array([n - 1], pa.int64())], ["range", "run", "first", "last"])

    def index(batches):
        place, held = 0, []

        def out():
            part = _batch(held, schema)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(range(place, place + len(held)), pa.int64())], [*COLUMNS, "place"])
        for _, items in grouped(batches):
            for item in items:
                held.append(item[3])
                if len(held) == 10_000:
                    yield out()
                    place, held = place + len(held), []
        if held:
            yield out()

    stretches = settle(stretches, "stretches")
    while (most := stretches.groupBy("range").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        numbered = stretches.withColumn("group", F.floor((F.row_number().over(W.partitionBy("range").orderBy("run")) - 1) / FAN_IN).cast("int"))
        tasks = numbered.repartition(ranges * -(-most // FAN_IN), "range", "group").sortWithinPartitions("range", "group", "run")
        stretches = settle(tasks.mapInArrow(shorten, "range int, run string, first long, last long"), "stretches")
    last = stretches.withColumn("group", F.lit(0)).repartitionByRange(ranges, "range").sortWithinPartitions("range", "run")
    return settle(last.mapInArrow(index, CAPTURE.format(id=kind) + ", place long"), "captures")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, block[:int(fields["Content-Length"])]


def read(folder: str, index: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, payload binary), all read from the archives."""
    number = index.schema["id"].dataType.simpleString()

    def run(batches):
        fs, base = file_system(folder)
        name, file = None, None
        for batch in batches:
            out = [[], [], [], [], [], []]
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, fs.open_input_file(f"{base}/{path}")
                file.seek(at)
                fields, block = _parsed(file.read(size))
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                told = int(re.search(rb"Content-Length: (\d+)", http)[1])
                fresh = fields["WARC-Type"] == "response"
                if fresh and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != told):
                    raise ValueError(f"damaged record at {at} of {path}")
                ident, refers = (int(fields[f]) if f in fields else None for f in ("Page-Id", "Refers-To-Page-Id"))
                for column, value in zip(out, (ident, told, digest, fields["WARC-Type"], refers, payload if fresh else None)):
                    column.append(value)
            kinds = (batch.column("id").type, pa.int64(), pa.string(), pa.string(), batch.column("id").type, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)],
                                             ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if file:
            file.close()
    near = index.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return near.select("id", "file", "at", "size").mapInArrow(
        run, f"id {number}, payload_bytes long, payload_digest string, record_type string, refers_to {number}, payload binary")
