"""Merkle manifest of a dataset: a digest for every row, subtree and table, and a proof for every row.

A row's leaf is the hash of its columns, each with its length in front. Within a group (a source, say) the leaves ascend by
id; every FANOUT consecutive nodes become one of the next level, the last run with as many as there are, until one node, the
subroot, is left. The subroots, ordered by group, are the leaves of an upper tree that gives the root.

Every level is a self-join: the node at slot zero of each run computes the indices of its siblings (by XOR in a binary tree, by
slot offsets otherwise), an equijoin on group and index fetches their digests, and the slot-zero rows, grouped again by run,
emit the parents. Nothing is counted on one task: a node's index is its place within a part of the table ranged by group and id
plus the number of nodes in the parts before. Proofs go the other way, from the root down: a run hands each of its nodes the
digests before and after it on top of the path of its parent; this is one join a level of tables that shrink by FANOUT each.

A proof is the array of (before, after), hexadecimal digests written one after another. folded() puts a leaf between them
level by level, which gives the root again if neither the leaf nor the siblings have changed.

Defined results: null columns hash as `-` and sort first; empty and very long texts are hashed whole; a row without id sorts before
the others; repeated rows are leaves of their own, next to each other; an empty table has no leaves and no root (None); columns
that are not named take no part, whatever their names. Levels are written to the shared folder, so lost executors cost one level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shootlake.llm.shared import settle

FANOUT = 16


def framed(column: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def group_key(column: Column) -> Column:
    """A key that is never null, ordered as the column's strings are, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@dataclass
class Tree:
    """Levels of nodes (grp, idx, n, digest, and at the bottom what leaves carry), from the bottom up; runs[k] makes level k + 1."""

    levels: list[DataFrame]
    runs: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """(grp, digest) of the last node of every group."""
        alone = [level.where("n = 1").select("grp", "digest") for level in self.levels]
        out = alone[0]
        for more in alone[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, seeds: DataFrame) -> DataFrame:
        """The bottom's nodes, each with its path and its group's seed, given (grp, path, seed) for the group's last node."""
        last = self.levels[-1].where("n = 1").join(seeds, "grp")
        for k in range(len(self.runs) - 1, -1, -1):
            above = last.select("grp", F.col("idx").alias("run"), "path", "seed")
            opened = self.runs[k].join(above, ["grp", "run"]).select(
                "grp", "run", "n", "path", "seed", F.posexplode("kids").alias("slot", "kid"), F.col("kids.digest").alias("digests"))
            step = F.struct(
                F.array_join(F.slice("digests", F.lit(1), F.col("slot")), "").alias("before"),
                F.array_join(F.slice("digests", F.col("slot") + 2, self.fanout), "").alias("after"))
            inner = opened.select("grp", (F.col("run") * self.fanout + F.col("slot")).alias("idx"), "n", "kid.digest", "kid.carried",
                                  F.concat(F.array(step), F.col("path")).alias("path"), "seed")
            last = inner.unionByName(self.levels[k].where("n = 1").join(seeds, "grp").select(*inner.columns))
        return last


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves (grp, digest, carried, ...) with idx, the place in their group by the order columns, and n, the group's size."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = settle(leaves.repartitionByRange("grp", *keys).withColumn("part", F.spark_partition_id()), "ranged")
    before = W.partitionBy("grp").orderBy("part")
    counts = ranged.groupBy("grp", "part").count().select(
        "grp", "part", F.sum("count").over(W.partitionBy("grp")).alias("n"),
        (F.sum("count").over(before) - F.col("count")).alias("earlier"))
    place = F.row_number().over(W.partitionBy("grp", "part").orderBy(*keys)) - 1
    return ranged.withColumn("place", place).join(counts, ["grp", "part"]).select(
        "grp", (F.col("earlier") + F.col("place")).alias("idx"), "n", "digest", "carried")


def grow(bottom: DataFrame, fanout: int = FANOUT) -> Tree:
    """All levels over numbered leaves."""
    level = settle(bottom, "nodes")
    levels, runs = [level], []
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        if fanout == 2:
            siblings = F.array(F.col("idx"), F.col("idx").bitwiseXOR(F.lit(1)))
        else:
            siblings = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda s: F.col("idx") + s)
        first = level.where((F.col("n") > 1) & (F.col("idx") % fanout == 0))
        wanted = first.select("grp", (F.col("idx") / fanout).cast("long").alias("run"), F.explode(siblings).alias("idx"))
        kid = F.struct((F.col("idx") % fanout).alias("slot"), "digest", "carried").alias("kid")
        joined = wanted.join(level, ["grp", "idx"]).groupBy("grp", "run", "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        joined = settle(joined.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)), "runs")
        level = joined.select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), "digest",
                              F.lit(None).cast(bottom.schema["carried"].dataType).alias("carried"))
        runs.append(joined)
        levels.append(level)
        most = -(-most // fanout)
    return Tree(levels, runs, fanout)


@dataclass
class Manifest:
    """The trees of a dataset."""

    groups: Tree
    upper: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with what it carried, its group's subroot and its path to the root."""
        path = F.array().cast("array<struct<before:string,after:string>>").alias("path")
        nothing = self.upper.levels[-1].where("n = 1").select("grp", path, F.lit("").alias("seed"))
        seeds = self.upper.paths(nothing).select("carried.grp", "path", F.col("digest").alias("seed"))
        return self.groups.paths(seeds).select(
            "grp", "carried.*", F.col("digest").alias("leaf"), F.col("seed").alias("subroot"), "path", F.lit(self.root).alias("root"))


def build(df: DataFrame, leaf: Column, group: Column, id_col: str, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table: leaf gives a row's digest, carry what is to stand beside it in proofs."""
    carried = F.struct(F.col(f"`{id_col}`").alias("id"), *(c.alias(name) for name, c in (carry or {}).items()))
    leaves = settle(df.select(group_key(group).alias("grp"), leaf.alias("digest"), carried.alias("carried"),
                              F.monotonically_increasing_id().alias("row")), "leaves").withColumn("id", F.col("carried.id"))
    groups = grow(numbered(leaves, ["id", "digest", "row"]), fanout)
    tops = groups.tops().select(F.lit("").alias("grp"), "digest", F.struct("grp").alias("carried"), F.col("grp").alias("of"))
    upper = grow(numbered(tops, ["of"]), fanout)
    root = upper.tops().first()
    return Manifest(groups, upper, root["digest"] if root else None)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
