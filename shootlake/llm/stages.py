"""The stages of the corpus pipeline. Each works on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shootlake.llm import decontamination, near_duplicates, quality_rules, secret_scans, sentence_pieces
from shootlake.llm.shared import settle, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _wrapped(docs: DataFrame) -> DataFrame:
    """(row, text): all columns in one, so that none clashes with what operators add."""
    return docs.select(F.struct("*").alias("row"), F.col("text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(_wrapped(docs)).where("quality.kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, of equal ids the first row; a null id comes last.

    Rows are told apart by their place in the table read, so repeated rows and equal ids with different texts are documents of
    their own.
    """
    keyed = docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").alias("name"), F.monotonically_increasing_id().alias("key"))
    found = settle(near_duplicates.find(keyed, id_col="key").select("id", "component"), "found")
    named = found.join(keyed.select(F.col("key").alias("id"), "name"), "id")
    order = F.struct(F.col("name").isNull().alias("last"), "name", "id")
    chosen = named.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.id").alias("id"))
    gone = settle(found.join(chosen, "id", "left_anti").select("id"), "gone")
    return keyed.join(gone, keyed["key"] == gone["id"], "left_anti").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontamination.scan(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows the text."""
    clean = secret_scans.masked(F.col("text"), F.col("spans"))
    found = secret_scans.scan(_wrapped(docs)).select("row", "text", clean.alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("clean") == F.col("text"), F.col("row")["n_chars"]).otherwise(
            F.length("clean").cast(docs.schema["n_chars"].dataType))
    return found.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document kept, with the digest of the text they decode to."""
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))
