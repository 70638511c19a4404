"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm import (
    chat_format, decontamination, exact_top_k, framed_ids, hard_negatives, merkle_manifest, near_duplicates, quality_model,
    quality_rules, secret_scans, sentence_pieces, token_counts, warc_archive)
from shootlake.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 4096


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


ORACLE["op2_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
marked AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(marked.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: list_contains([{stops}], lower(x)))) AS n_stop_words,
    len(list_filter(words, lambda x: regexp_matches(x, '^\p{Lu}[^\p{Ll}]+$'))) AS n_capital_words
  FROM w LEFT JOIN marked ON w.doc_id = marked.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {rules} AS kept
FROM v
""".replace("{stops}", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)).replace("{rules}", " AND ".join(
    f"coalesce({r.value} BETWEEN {r.least} AND {r.most}, false)" for r in quality_rules.RULES))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema))
    # every row is a message of its own, told by a log of deltas, stale drafts, edits and regenerations
    message = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = chat_format.logged(rows.select("conv_id", message.alias("message"), "role", "text"))
    back = chat_format.read_back(chat_format.render(chat_format.reconstruct(events)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE["op4_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'))
    + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 13 AS n
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scans.listed(base), 256).alias("base_sha256"), secret_scans.listed(F.col("spans")).alias("spans"))


@query
def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = framed_ids.write(table(spark, sf_dir, "documents"), WORDS, end_id=1)
    return framed_ids.read(folder, framed_ids.with_starts(manifest)).withColumnRenamed("id", "doc_id")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # pages carry no capture time: seconds from a fixed day, by id
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)))
    folder, captures = warc_archive.write(pages, "page_id", "url", "html", time)
    return warc_archive.read(folder, warc_archive.merge(captures)).drop("payload").withColumnRenamed("id", "page_id")


ORACLE["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.find(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.start").alias("start"), F.col("m.end").alias("end"),
        F.col("m.edits").alias("edits"))


@query
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda i: F.pmod(F.crc32(F.col(i).cast("string").cast("binary")), F.lit(4))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != 2).select(F.col("doc_id").alias("id"), "quality")
    scored = quality_model.score(table(spark, sf_dir, "documents"), labels)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


ORACLE["op7_near_duplicates"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                        F.col("negative").alias("negative_id"), "positive_score", "negative_score")


#: Vectors that take part, as whole numbers, and the inner product of two of them.
_VECTORS = """
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0)
"""
_PRODUCT = "CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT)"

ORACLE["op11_hard_negatives"] = f"""
WITH {_VECTORS.format(scale=256)},
l AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, {_PRODUCT} AS score
  FROM l q JOIN l c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = merkle_manifest.leaf_of(fields(F.col("text")))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, merkle_manifest.leaf_of(fields(F.translate("text", capitals, capitals.lower())))).otherwise(leaf)
    manifest = merkle_manifest.build(table(spark, sf_dir, "documents"), leaf, F.col("source"), "doc_id", {"tampered": tampered})
    proofs = manifest.proofs()
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle_manifest.folded(F.col("tampered"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


_FRAMED = " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_BEFORE, _AFTER = "array_to_string(hs[1:w.i % 16], '')", "array_to_string(hs[w.i % 16 + 2:], '')"
_TREE = """
{lv} AS (
  SELECT 0 AS lvl, * FROM ({bottom})
  UNION ALL SELECT lvl + 1, g, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
  FROM {lv} WHERE n > 1 GROUP BY lvl, g, i // 16),
{lv}_runs AS (SELECT lvl, g, i // 16 AS run, list(h ORDER BY i) AS hs FROM {lv} WHERE n > 1 GROUP BY lvl, g, i // 16)
"""
_WALK = """
{walk} AS (
  SELECT 0 AS lvl, * FROM ({start})
  UNION ALL SELECT w.lvl + 1, k, w.g, w.i // 16, sha256({before} || cur || {after}), proof || {before} || {after}
  FROM {walk} w JOIN {lv}_runs r ON w.lvl = r.lvl AND w.g = r.g AND w.i // 16 = r.run),
{walk}_end AS (SELECT * FROM {walk} QUALIFY row_number() OVER (PARTITION BY k ORDER BY lvl DESC) = 1)
""".replace("{before}", _BEFORE).replace("{after}", _AFTER)

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({_FRAMED.format(text="text")}) AS leaf,
    sha256({_FRAMED.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS small,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]),
        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
  FROM documents),
t AS (
  SELECT doc_id, g, leaf, CASE WHEN crc % 5 = 0 THEN small ELSE leaf END AS tampered, row_number() OVER () AS k,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM d),
{_TREE.format(lv="lows", bottom="SELECT g, i, n, leaf AS h FROM t")},
subs AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lows WHERE n = 1),
{_TREE.format(lv="tops", bottom="SELECT 0 AS g, i, n, h FROM subs")},
{_WALK.format(walk="climb", lv="lows", start="SELECT k, g, i, tampered AS cur, '' AS proof FROM t")},
{_WALK.format(walk="rise", lv="tops", start="SELECT c.k, 0 AS g, s.i, c.cur, c.proof FROM climb_end c JOIN subs s ON s.name = c.g")}
SELECT t.doc_id, t.leaf, s.h AS subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = u.h AS verified
FROM t JOIN rise_end e ON e.k = t.k JOIN subs s ON s.name = t.g CROSS JOIN (SELECT h FROM tops WHERE n = 1) u
"""


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_top_k.find(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE["op13_exact_top_k"] = f"""
WITH {_VECTORS.format(scale=1024)},
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_PRODUCT} AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
