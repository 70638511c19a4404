"""Decontamination, near duplicates, classifier, archives and pipeline against brute force."""

import gzip
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shootlake.llm import decontamination, near_duplicates, quality_model, queries, secret_scans, sentence_pieces, stages, warc_archive

SF = "/root/testdata/sf0.001"


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k, how = rng.randrange(len(chars)), rng.random()
        if how < 0.34:
            chars[k] = "q"
        elif how < 0.67:
            del chars[k]
        else:
            chars.insert(k, "q")
    return "".join(chars)


def words_of(rng, n):
    return " ".join("".join(rng.choice(["ta", "ren", "os", "mi", "ku", "del", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edited_passages_are_found():
    rng = random.Random(2)
    items = [(k, words_of(rng, rng.randint(8, 40))) for k in range(30)]
    index = decontamination.Index(items)
    for _ in range(150):
        k, item = rng.choice(items)
        e = decontamination.budget(len(item))
        other = words_of(rng, 60)
        cut = rng.choice([0, len(other), rng.randrange(len(other))])
        inserted = edited(rng, item, rng.randint(0, e))
        found = index.matches([other[:cut] + inserted + other[cut:], None, ""])
        assert [m for m in found[0] if m[0] == k], (item, inserted)
        assert found[1] == found[2] == []
        for i, a, b, cost in found[0]:
            text = other[:cut] + inserted + other[cut:]
            assert cost <= decontamination.budget(len(dict(items)[i]))
            assert distance(decontamination.folded(dict(items)[i]).tolist(), decontamination.folded(text[a:b]).tolist()) <= 2 * cost
    assert index.matches([words_of(rng, 3000)]) == [[]]


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "The quick brown fox, and the dog."), (2, None), (3, ""), (4, "brown FOX"), (5, "\nlin"), (None, "x" * 40),
                                   (1, "The quick brown fox, and the dog.")], "item_id long, text string")
    got = decontamination.scan(odd, items, into="found").collect()
    assert len(got) == odd.count()
    for r in got:
        places = {(m.item, m.start, m.end, m.edits) for m in r.found}
        if r.text and r.text.startswith("The quick"):
            assert {(1, 34 * k, 34 * k + 33, 0) for k in range(3)} | {(4, 34 * k + 10, 34 * k + 19, 0) for k in range(3)} == places
        elif r.text == "x" * 3000:
            assert places and all(m.item == -1 for m in r.found)
        elif r.text and "line\nline" in r.text:
            assert [m[0] for m in places] == [5, 5]
        else:
            assert not places
    assert decontamination.scan(none, items, into="found").count() == 0
    assert decontamination.scan(odd, items.limit(0), into="found").where(F.size("found") > 0).count() == 0


def least_edits(item, text):
    """Fewest edits that turn the item into some stretch of the text, by the full table."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        best = np.concatenate([[i], np.minimum(row[:-1] + (text != c), row[1:] + 1)])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def test_all_pairs_by_the_full_table(spark):
    rng = random.Random(12)
    items = [(k, words_of(rng, 200)[:n].strip()) for k, n in enumerate([5, 6, 8, 9, 10, 12, 15, 18, 19, 20, 25, 30, 50, 80, 120, 250, 500])]
    items.append((99, items[9][1]))
    texts = []
    for n in range(70):
        cut = words_of(rng, rng.randint(5, 60))
        k, item = rng.choice(items)
        most = decontamination.budget(len(item))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(cut))
            cut = cut[:at] + edited(rng, item, rng.randint(0, most + 2)) + cut[at:]
        texts.append((n, cut.upper() if n % 7 == 0 else cut))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = decontamination.scan(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, m.item): m for r in found.collect() for m in r.matches}
    for n, text in texts:
        codes = decontamination.folded(text)
        for k, item in items:
            edits = least_edits(decontamination.folded(item), codes)
            assert ((n, k) in got) == (edits <= decontamination.budget(len(item))), (item, text, edits)
            if (n, k) in got and len(item) < 2 * decontamination.Q:
                m = got[n, k]
                assert codes[m.start:m.end].tolist() == decontamination.folded(item).tolist()


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, words_of(rng, 12)) for k in range(9)]
    monkeypatch.setattr(decontamination, "BENCHMARK_BLOCK", 150)
    frame = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    docs = spark.createDataFrame([(t,) for _, t in items], "text string")
    found = decontamination.scan(docs, frame).collect()
    assert all(k in {m.item for r in found for m in r.matches} for k, _ in items)


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least.get(root(i)) if k is not None else None) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("words", [2, 5])
def test_components(spark, odd, words):
    rng = random.Random(words)
    base = [words_of(rng, 80) for _ in range(3)]
    rows = []
    for k in range(120):  # a chain of edits: links beyond the first copy, and copies just apart
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(t)))
        if rng.random() < 0.2:
            base.append(rows[-1][1])
    frame = odd.select("doc_id", "text", "id", "bucket").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), True)
    got = sorted(map(str, ((r.id, r.n_shingles, r.component) for r in near_duplicates.find(frame, words=words).collect())))
    assert got == sorted(map(str, brute_components([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], words, 80)))


def test_blocks_within_buckets(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    base = words_of(rng, 60).split()
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(1000)}"
        rows.append((k, " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.n_shingles, r.component) for r in near_duplicates.find(frame, words=2).collect())
    assert got == sorted(brute_components(rows, 2, 80))


def test_whole_sets_are_told_exactly():
    rng = np.random.default_rng(4)
    pool = rng.permutation(np.unique(rng.integers(0, 2 ** 63, 400_000, dtype=np.uint64)))
    top = near_duplicates.mixed(pool) >> np.uint64(32)
    order = np.argsort(top, kind="stable")
    k = np.flatnonzero(top[order][1:] == top[order][:-1])[0]
    twins = pool[order[k:k + 2]]  # equal in their first 32 bits
    rest = pool[~np.isin(pool, twins)]

    def similar(a, b):
        return near_duplicates.fine_similarity([near_duplicates.fine_hashes(a)], near_duplicates.fine_hashes(b), np.array([len(a)]), len(b))[0]
    shared, more, other = np.append(rest[:478], twins), rest[478:538], rest[538:598]
    assert similar(np.append(shared, more), np.append(shared, other)) == 480 / 600  # not 479 of 599
    a, b = np.concatenate((rest[:478], twins[:1], more)), np.concatenate((rest[:478], twins[1:], other))
    assert similar(a, b) == 478 / 600  # not 479 of 599


def test_no_documents(none):
    assert near_duplicates.find(none).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2 ** 63, 4000, dtype=np.uint64)) for _ in range(2))
    union = np.unique(np.concatenate([a, b[:2000]]))
    s = near_duplicates.sketches(np.concatenate([a, b[:2000], union]), np.cumsum([0, len(a), 2000, len(union)]))
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    e = near_duplicates.estimate(s[:1], s[2:], np.array([len(a)], float), np.array([len(union)], float))
    assert abs(e[0] - len(a) / len(union)) < 0.1


def test_classifier(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    held = [r.id for r in labels.collect() if zlib.crc32(str(r.id).encode()) % 4 == 2]
    scored = {r.id: r.score for r in quality_model.score(docs, labels.where(~F.col("id").isin(held))).collect()}
    known = {r.id: r.quality for r in labels.collect()}
    assert np.mean([(scored[i] >= 0.7) == (known[i] == 1) for i in held]) > 0.95
    some = spark.createDataFrame([(0, 1), (4, 1), (11, 0), (11, 0), (2, None), (None, 1)], "id long, quality int")
    for frame, labels in ((odd, some), (odd, some.limit(0)), (none, some)):
        got = quality_model.score(frame, labels).collect()
        assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)


def test_scores_ignore_all_but_the_text(spark, odd):
    some = spark.createDataFrame([(0, 1), (4, 1), (11, 0)], "id long, quality int")
    one = sorted((r.score for r in quality_model.score(odd, some).collect()))
    two = sorted((r.score for r in quality_model.score(odd.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), some).collect()))
    assert one == two


def test_gradients():
    rng = np.random.default_rng(3)
    x, offsets, y = rng.normal(size=(40, quality_model.FEATURES)), np.array([0, 3, 10, 11, 25, 40]), np.array([0, 1, 1, 0, 1])
    model = quality_model.train(x, offsets, y, rounds=300)
    assert ((model.score(x, offsets) > 0.5) == (y == 1)).all()


def test_archives(spark):
    big = "é" * 700
    rows = [(1, "http://www.b.org/x?q=1#f", big, 7), (2, "https://a.com/", big, 7), (3, "https://a.com/", "small", 7), (4, "http://a.com", "small", 7),
            (5, None, None, 7), (None, "http://n.x", big, 7), (7, "http://z.z/\n", big, 7), (7, "http://z.z/\n", big, 7), (8, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder, captures = warc_archive.write(pages, "page_id", "url", "html", F.timestamp_seconds(F.lit(1_700_000_000)))
    index = warc_archive.merge(captures)
    got = {(r.id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_archive.read(folder, index).collect()}
    assert got == {(1, 1400, "revisit", 7), (2, 1400, "revisit", 7), (3, 5, "response", None), (4, 5, "response", None),
                   (5, 0, "response", None), (None, 1400, "response", None), (7, 1400, "response", None), (8, 0, "response", None)}
    assert index.count() == len(rows)
    ordered = sorted((r.key, r.time, r.id is not None, r.id or 0) for r in captures.collect())
    parts = index.withColumn("part", F.input_file_name()).collect()
    held = [(r.key, r.time, r.id is not None, r.id or 0) for r in sorted(parts, key=lambda r: (re.search(r"part-(\d+)", r.part)[1], r.place))]
    assert held == ordered
    assert {r.key for r in parts} >= {"org,b)/x?q=1", "com,a)/", "com,a)"}
    folder, captures = warc_archive.write(pages.limit(0), "page_id", "url", "html", F.current_timestamp())
    assert warc_archive.read(folder, warc_archive.merge(captures)).count() == 0


def test_external_merge_in_passes(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "BLOCK", 4)
    monkeypatch.setattr(warc_archive, "FAN_IN", 3)
    monkeypatch.setattr(warc_archive, "RANGE", 150)
    monkeypatch.setattr(warc_archive, "ARCHIVE", 4000)
    rng = random.Random(9)
    rows = [(rng.randrange(300), f"http://h{'x' if rng.random() < .4 else rng.randrange(40)}.org/", rng.choice([None, 5, rng.randrange(99)]))
            for _ in range(800)] + [(None, None, None)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, t long").withColumn("html", F.concat(F.lit("p"), F.col("page_id")))
    folder, captures = warc_archive.write(pages.repartition(6), "page_id", "url", "html", F.timestamp_seconds("t"))
    assert captures.select("run").distinct().count() > 27  # three passes
    assert captures.agg(F.max("block")).first()[0] > 0
    index = warc_archive.merge(captures).withColumn("part", F.input_file_name()).collect()
    held = [(r.key, r.time or "", r.id is not None, r.id or 0) for r in sorted(index, key=lambda r: (re.search(r"part-(\d+)", r.part)[1], r.place))]
    assert held == sorted((r.key, r.time or "", r.id is not None, r.id or 0) for r in captures.collect()) and len(held) == len(rows)
    assert len({r.part for r in index}) > 3
    fs, base = warc_archive.file_system(folder)
    records = []
    for name in {r.file for r in index}:
        raw = open(f"{base}/{name}", "rb").read()
        records += re.findall(r"WARC-Record-ID: (\S+)", gzip.decompress(raw).decode())
    assert len(records) == len(set(records)) == len(rows) + len({r.file for r in index})


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        assert list(warc_archive.losers([iter(r) for r in runs])) == sorted(itertools.chain(*runs))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            want = {k for k, _, c in brute_components([(r.doc_id, r.text) for r in before.values()], 5, 80) if k == c}
            assert set(after) == want
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.values() for t in items)
            assert all(any(t in before[k].text for t in items) for k in set(before) - set(after))
        elif name == "secrets":
            assert set(after) == set(before)
            assert all((r.text == before[k].text) or "[SECRET]" in r.text for k, r in after.items())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    coder = sentence_pieces.coder(stages.PIECES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in last.collect():
        assert coder.decode(np.array(r.ids), np.array([0, len(r.ids)])) == [texts[r.doc_id]] and r.n_tokens == len(r.ids)


def test_stages_keep_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "id", "spans", "matches")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if stage is not stages.encode_pieces:
                assert out.columns == frame.columns
            out.collect()
    masked = stages.mask_secrets(spark, docs, SF)
    assert masked.count() == docs.count()
    assert secret_scans.scan(masked.drop("spans")).where(F.size("spans") > 0).count() == 0


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_registered_queries_and_stages_on_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for c in ("quality", "row", "spans", "matches", "key", "name", "clean", "component"):
        docs = docs.withColumn(c, F.lit("own"))
    more = docs.where("doc_id < 5").withColumn("doc_id", F.lit(3).cast("long"))  # an id with several texts, and rows twice
    docs.unionByName(docs.where("doc_id < 10")).unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    n = spark.read.parquet(str(tmp_path / "documents.parquet")).count()
    for name in ("op2_quality_rules", "op8_secret_scans"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == n
    assert queries.op5_decontamination(spark, str(tmp_path)).count() > 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.where("row <> 'own' or spans <> 'own' or matches <> 'own' or quality <> 'own'").count() == 0
        if name == "near_duplicates":
            assert out.groupBy("text").count().where("count > 1").count() == 0
    with pytest.raises(TypeError):
        near_duplicates.find(docs, id_col="row")
