"""Shoots as they arrive: bursts, verdicts, duplicates and results over Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shootlake.operators import bursts, catalogue, focus

CAPTURES = "project_id long, seq long, key string, seconds long, signature long, taken timestamp"
_OUT = CAPTURES.replace("signature long", "signature string") + ", burst long, place long"
_STATE = "seconds long, signature long, burst long, place long, seq long"


def streamed_bursts(captures: DataFrame, within: int = bursts.WITHIN_SECONDS, distance: int = bursts.SIGNATURE_DISTANCE,
                    late: str = "10 minutes") -> DataFrame:
    """Number bursts per project as captures arrive.

    State is the last capture of a project, five numbers however long the shoot. A project's share of
    one micro-batch is sorted by sequence, so bound the batch with `maxFilesPerTrigger`; a capture that
    arrives after a later one has been numbered gets a burst of its own. Where a batch of one project
    may outgrow a task, use `keep_bursts`.
    """
    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat([b for b in batches if len(b)])
        out, last = _number(rows.sort_values("seq"), last, within, distance)
        state.update(last)
        yield out

    # pandas holds integers with gaps as floats, too short for 64 bits, so signatures travel as text
    sent = captures.withWatermark("taken", late).withColumn("signature", F.col("signature").cast("string"))
    return sent.groupBy("project_id").applyInPandasWithState(
        number, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout).withColumn("signature", F.col("signature").cast("long"))


def _number(rows: pd.DataFrame, last: tuple | None, within: int, distance: int) -> tuple[pd.DataFrame, tuple]:
    seq, sec = rows["seq"].to_numpy(), rows["seconds"].to_numpy(dtype=float, na_value=np.nan)
    known = rows["signature"].notna().to_numpy()
    sign = rows["signature"].fillna("0").astype("int64").to_numpy()
    was, mark, burst, place, at = last or (None, None, 0, -1, None)
    before = np.append(np.nan if was is None else was, sec[:-1])
    mark_known, marks = np.append(mark is not None, known[:-1]), np.append(np.int64(mark or 0), sign[:-1])
    bits = np.where(known & mark_known, np.bitwise_count((sign ^ marks).view("uint64")), 0)  # a missing signature is no evidence
    opens = ~(np.abs(sec - before) <= within) | (bits > distance)
    opens[0] = last is not None and bool(opens[0] or seq[0] < at)  # rows are sorted: only the first can come late
    index = np.arange(len(rows))
    opened = np.maximum.accumulate(np.where(opens, index, -1))
    bursts_, places = burst + np.cumsum(opens), np.where(opened >= 0, index - opened, index + place + 1)
    last = (None if np.isnan(sec[-1]) else int(sec[-1]), int(sign[-1]) if known[-1] else None,
            int(bursts_[-1]), int(places[-1]), int(seq[-1]))
    return rows.assign(burst=bursts_, place=places), last


def keep_bursts(path: str, within: int = bursts.WITHIN_SECONDS, distance: int = bursts.SIGNATURE_DISTANCE,
                width: int = bursts.ordered.DEFAULT_WIDTH) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that numbers bursts per project, whatever share of a batch a project holds.

    A batch is numbered in chunks of each project as a whole table is (`bursts.number`), from the last
    capture of each project on, which a log of one row per project carries from batch to batch. The
    rows of a batch lie in a folder of its own and count once the log names the batch, so a batch that
    is replayed after a lost executor or driver replaces only itself. Captures of a batch that begin
    before the last one numbered open a burst of their own.
    """
    note = keep_latest(f"{path}/state", ["project_id"], generation="batch")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{path}/rows/batch={batch_id}"
        seeds = read_latest(spark, f"{path}/state", before=batch_id)
        numbered = bursts.number(batch, within, distance, width, seeds).drop("distance", "boundary")
        numbered.write.mode("overwrite").parquet(place)
        last = F.struct("seq", "seconds", "signature", "burst", "place")
        written = spark.read.schema(numbered.schema).parquet(place)
        note(written.groupBy("project_id").agg(F.max_by(last, "seq").alias("_l")).select(
            "project_id", F.lit(batch_id).cast("long").alias("batch"), "_l.*"), batch_id)

    return sink


def read_bursts(spark: SparkSession, path: str) -> DataFrame | None:
    """The captures that `keep_bursts` has numbered, or null before its first batch."""
    versions = _Log(spark, f"{path}/state").versions()
    if not versions:
        return None
    return spark.read.parquet(f"{path}/rows").where(F.col("batch") <= versions[-1]).drop("batch")


def streamed_verdicts(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A verdict per arriving focus report (photo_id, blur, judgeable, measured); repeats are skipped."""
    once = reports.withWatermark("measured", late).dropDuplicatesWithinWatermark(["photo_id"])
    return focus.with_verdicts(once)


def streamed_unique(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """One photo per content among files (path, content, arrived) arriving within the watermark."""
    keyed = files.withColumn("content_key", catalogue.content_key(F.col("content"))).drop("content")
    return keyed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["content_key"])


def latest(results: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """The newest generation per key, ties broken by the row's own values. Combines map-side."""
    rest = [c for c in results.columns if c not in (*keys, generation)]
    return results.groupBy(*keys).agg(F.max(F.struct(generation, *rest)).alias("_r")).select(*keys, "_r.*")


class _Log:
    """Numbered entries below `path`, each naming the folders that make up the table at that version.

    One writer only: the stream. An entry appears whole, by a rename, or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json"))

    def entry(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"_log/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, entry: dict) -> None:
        draft = self._at(f"_log/{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not self.fs.rename(draft, self._at(f"_log/{version}.json")):
            raise OSError(f"version {version} of {self.path} could not be written")

    def forget(self, keep: int) -> None:
        """Remove all but the newest versions, and folders that none of them names."""
        versions = self.versions()
        for version in versions[:-keep]:
            self.fs.delete(self._at(f"_log/{version}.json"), False)
        named = {name for v in versions[-keep:] for name, _ in self.entry(v)["parts"]}
        for name in self._names(""):
            if name.startswith("part-") and name not in named:
                self.fs.delete(self._at(name), True)

    def table(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        found = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}" for name, _ in entry["parts"]))
        return latest(found, entry["keys"], entry["generation"])


def keep_latest(path: str, keys: list[str], fold: int = 8, generation: str = "generation",
                keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that keeps the newest generation per key as a log of deltas.

    A batch writes its own rows only and then the entry that names the folders now in force; the last
    `fold` folders of one level become one of the next, so a row is rewritten once a level and a reader
    finds few folders. Versions older than the last `keep` go, with their folders and those of failed
    attempts; a reader slower than `keep` batches must start anew. A batch whose entry exists is skipped.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        log = _Log(batch.sparkSession, path)
        done = log.versions()
        if done and done[-1] >= batch_id:
            return
        fresh = latest(batch, keys, generation)
        entry = {"keys": keys, "generation": generation, "schema": fresh.schema.jsonValue(),
                 "parts": log.entry(done[-1])["parts"] if done else []}

        def add(rows: DataFrame, level: int) -> None:
            name = f"part-{batch_id}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{path}/{name}")
            entry["parts"].append([name, level])

        add(fresh, 0)
        while len(entry["parts"]) >= fold and len({level for _, level in entry["parts"][-fold:]}) == 1:
            last = {**entry, "parts": entry["parts"][-fold:]}
            entry["parts"] = entry["parts"][:-fold]
            add(log.table(last), last["parts"][0][1] + 1)
        log.commit(batch_id, entry)
        log.forget(keep)

    return sink


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table `keep_latest` maintains, or null before its first batch; `before` asks for an earlier version."""
    log = _Log(spark, path)
    versions = [v for v in log.versions() if before is None or v < before]
    return log.table(log.entry(versions[-1])) if versions else None
