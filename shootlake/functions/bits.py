"""Unsigned 64-bit arithmetic on BIGINT columns.

Overflow is an error in ANSI mode, so products and sums are carried in 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = 0xFFFF

# The increment and the two multipliers of splitmix64.
SPLITMIX_STEP = 0x9E3779B97F4A7C15
SPLITMIX_FIRST = 0xBF58476D1CE4E5B9
SPLITMIX_SECOND = 0x94D049BB133111EB


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _limbs(v: Column) -> list[Column]:
    return [F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(_LOW).cast("long")) for i in range(4)]


def _join(sums: list[Column]) -> Column:
    carry, out = None, None
    for i, s in enumerate(sums):
        s = s if carry is None else s + carry
        part = F.shiftleft(s.bitwiseAND(F.lit(_LOW).cast("long")), 16 * i)
        out = part if out is None else out.bitwiseOR(part)
        carry = F.shiftrightunsigned(s, 16)
    return out


def plus(df: DataFrame, name: str, v: str, constant: int) -> DataFrame:
    k = [(constant >> (16 * i)) & _LOW for i in range(4)]
    return df.withColumn(name, _join([a + k[i] for i, a in enumerate(_limbs(F.col(v)))]))


def times(df: DataFrame, name: str, v: str, constant: int) -> DataFrame:
    """`name` = `v` times a constant, modulo 2^64; each carry is a column so nothing is computed twice."""
    k = [(constant >> (16 * i)) & _LOW for i in range(4)]
    a = _limbs(F.col(v))
    sums = []
    for i in range(4):
        total = None
        for j in range(i + 1):
            term = a[j] * k[i - j]
            total = term if total is None else total + term
        sums.append(total)
    staged = df.withColumns({f"_t{i}": s for i, s in enumerate(sums)})
    for i in range(1, 4):
        staged = staged.withColumn(f"_t{i}", F.col(f"_t{i}") + F.shiftrightunsigned(F.col(f"_t{i - 1}"), 16))
    joined = None
    for i in range(4):
        part = F.shiftleft(F.col(f"_t{i}").bitwiseAND(F.lit(_LOW).cast("long")), 16 * i)
        joined = part if joined is None else joined.bitwiseOR(part)
    return staged.withColumn(name, joined).drop("_t0", "_t1", "_t2", "_t3")


def splitmix64(df: DataFrame, name: str, v: str) -> DataFrame:
    df = plus(df, name, v, SPLITMIX_STEP)
    for shift, factor in ((30, SPLITMIX_FIRST), (27, SPLITMIX_SECOND)):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(F.col(name), shift)))
        df = times(df, name, name, factor)
    return df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(F.col(name), 31)))
