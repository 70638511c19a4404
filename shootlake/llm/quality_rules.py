"""Quality rules: a threshold table compiled into one projection of built-in functions.

`MEASURES` names what can be measured, `RULES` the bounds a text must keep. `measure` and `judge` are plain column
expressions without user functions; one pass over the texts, no shuffle.

Defined results: a null or blank text has no words, all counts 0 and fails; lines are cut at line feeds, a line of white
space only never counts; very long texts are measured whole; rows are judged one by one, so repeated rows and ties cannot
matter. Windows of words are told by 64-bit hashes within one text. The table's own columns are kept; measured
values live in one struct column, so no name can clash but that struct's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.llm.shared import SPACE, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A word of two or more characters with a capital first and no small letter.
CAPITALS = rf"(?<![^{SPACE}])\p{{Lu}}[^{SPACE}\p{{Ll}}]+(?![^{SPACE}])"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se "
    "el los las y del por con no una su para al lo como o").split()


class Rule(NamedTuple):
    name: str
    value: str  # SQL over the measures
    least: float
    most: float


#: Bounds a text must keep. Ratios are per word or per line with a word.
RULES = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", 0.0, 0.5),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", 0.01, 1.0),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.5),
    Rule("shouting", "n_capital_words / nullif(n_words, 0)", 0.0, 0.7),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _marked_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the word hashes of one text."""
    def doubled(h: Column, by: int) -> Column:
        """Hash of each element with the one `by` places on."""
        return let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, 1 + by, F.size(x) - by),
                                           lambda p, q: F.xxhash64(p, q)))

    windows = doubled(doubled(doubled(hashes, 1), 2), 4)  # of 2, 4 and WINDOW words

    def places(ordered: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            near = lambda j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
            return F.when(near(k - 1) | near(k + 1), x["i"])
        return F.array_sort(F.filter(F.transform(ordered, twice), lambda i: i.isNotNull()))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(let(ordered, places), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"),
                                                 i.alias("last")), lambda s: s["n"])

    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))


def measure(text: Column) -> Column:
    """Struct of all measures of a text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(whole, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
        counts = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            counts.alias("lines"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _marked_words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(F.split(F.lower(whole), f"[{SPACE}]+"), lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.regexp_count(whole, F.lit(CAPITALS)).cast("long")
             .alias("n_capital_words"))

    def flat(m: Column) -> Column:
        return F.struct(*(m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols")),
                        m["lines"]["all"].cast("long").alias("n_lines"),
                        (m["lines"]["all"] - m["lines"]["distinct"]).cast("long").alias("n_dup_lines"),
                        *(m[n].alias(n) for n in ("n_repeat_words", "n_stop_words", "n_capital_words")))
    return let(let(words_of(text), of_words), flat)


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """The table with a struct `into`: measures, base_failed, kept and the names of broken rules; a column `into` of its own is replaced."""
    # a generator of one row: filters on the verdict stay above it and the measures are taken once
    measured = df.drop(into).select("*", F.explode(F.array(measure(F.col(f"`{text_col}`").cast("string")))).alias(into))
    m = F.col(f"`{into}`")
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capital_words")

    def value(rule: Rule) -> Column:
        sql = rule.value
        for name in names:
            sql = re.sub(rf"\b{name}\b", f"`{into}`.{name}", sql)
        return F.expr(sql)
    broken = F.filter(F.array(*(F.when(~F.coalesce(value(r).between(r.least, r.most), F.lit(False)), F.lit(r.name))
                                for r in rules)), lambda x: x.isNotNull())
    return measured.withColumn(into, F.struct(
        *(m[n].alias(n) for n in names), base.alias("base_failed"),
        (~base & (F.size(broken) == 0)).alias("kept"), broken.alias("broken")))
