import random

from pyspark.sql import functions as F

from shootlake.operators import bursts as B
from shootlake.streaming import captures as ST

BASE = 1_700_000_000


def run(stream, folder, sink=None):
    w = stream.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{folder}/out")).start().awaitTermination()


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], BASE
    for seq in range(300):
        t += rng.choice([0, 1, 3, 5])
        rows.append((rng.randrange(3), seq, f"k{seq}", None if rng.random() < .1 else t,
                     None if rng.random() < .1 else rng.getrandbits(64) - (1 << 63) if rng.random() < .1 else 3, t))
    df = spark.createDataFrame(rows, "project_id long, seq long, key string, seconds long, signature long, t long")
    df = df.withColumn("taken", F.timestamp_seconds("t")).drop("t")
    for i in range(3):
        df.where((F.col("seq") >= 100 * i) & (F.col("seq") < 100 * (i + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(ST.streamed_bursts(stream), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out").select("seq", "burst", "place").orderBy("seq").collect()
    assert got == B.index(df).select("seq", "burst", "place").orderBy("seq").collect()


def test_bursts_go_on_from_batch_to_batch(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], BASE
    for seq in range(240):
        t += rng.choice([0, 1, 3, 5])
        rows.append((0 if rng.random() < .5 else rng.randrange(5), seq, None if rng.random() < .1 else t,
                     None if rng.random() < .1 else rng.getrandbits(64) - (1 << 63) if rng.random() < .1 else 3))
    df = spark.createDataFrame(rows, "project_id long, seq long, seconds long, signature long").cache()
    sink = ST.keep_bursts(f"{tmp_path}/t", width=8)
    for i in range(4):
        part = df.where((F.col("seq") >= 60 * i) & (F.col("seq") < 60 * (i + 1)))
        sink(part, i)
        sink(part, i)  # replayed after its commit
    sink(df.limit(0), 4)
    columns = ["project_id", "seq", "burst", "place"]
    got = ST.read_bursts(spark, f"{tmp_path}/t").select(columns).orderBy("seq").collect()
    assert got == B.index(df).select(columns).orderBy("seq").collect()
    # captures before the last one numbered open a burst, then compare with each other; uncommitted rows are not seen
    top = max(r.burst for r in got if r.project_id == 0)
    late = spark.createDataFrame([(0, -9, BASE, 3), (0, -8, BASE + 1, 3), (77, 1, BASE, None)], df.schema)
    sink(late, 5)
    again = {(r.project_id, r.seq): (r.burst, r.place) for r in ST.read_bursts(spark, f"{tmp_path}/t").collect()}
    assert len(again) == 243 and again[0, -9] == (top + 1, 0) and again[0, -8] == (top + 1, 1) and again[77, 1] == (0, 0)
    late.selectExpr("*", "0L AS burst", "0L AS place").write.parquet(f"{tmp_path}/t/rows/batch=6")
    assert ST.read_bursts(spark, f"{tmp_path}/t").count() == 243


def test_latest_log_folds_and_forgets(spark, tmp_path):
    rng, path, want = random.Random(8), f"{tmp_path}/t", {}
    sink = ST.keep_latest(path, ["id"], fold=3)
    assert ST.read_latest(spark, path) is None
    for batch in range(14):
        rows = [(rng.randrange(12), rng.randrange(30), rng.choice("abc")) for _ in range(5)]
        for i, g, v in rows:
            want[i] = max(want.get(i, (-1, "")), (g, v))
        if batch == 7:
            (tmp_path / "t/part-7-torn").mkdir()  # of an attempt that died before its entry
        sink(spark.createDataFrame(rows, "id long, generation long, v string").coalesce(1), batch)
    assert {r.id: (r.generation, r.v) for r in ST.read_latest(spark, path).collect()} == want
    assert ST.read_latest(spark, path, before=13) is not None and ST.read_latest(spark, path, before=12) is None
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]
    assert len(folders) <= 8 and "part-7-torn" not in folders and len(list((tmp_path / "t/_log").glob("*.json"))) == 2


def test_latest_generation_survives_replay(spark, tmp_path):
    sink = ST.keep_latest(f"{tmp_path}/t", ["id"], 4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, generation long, v string")
    sink(frame([(i, 1, "a") for i in range(20)]), 0)
    sink(frame([(3, 5, "new"), (4, 0, "stale")]), 1)
    sink(frame([(3, 5, "new"), (4, 0, "stale")]), 1)
    rows = {r["id"]: r["v"] for r in ST.read_latest(spark, f"{tmp_path}/t").collect()}
    assert len(rows) == 20 and rows[3] == "new" and rows[4] == "a"
