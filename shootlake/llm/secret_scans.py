"""Secret scans in built-in functions.

Three fixed patterns give the base spans: assignments to password-like names, access keys, and long hexadecimal runs.
Beyond them, long strings of key-like characters are candidates: a window slides over each, character counts are kept by
adding the character that comes in and taking away the one that leaves, and the window's Shannon entropy follows from
the running sum of c*log2(c). A candidate whose best window reaches the bound of its character class is a secret, unless
an allow-list pattern matches it or a base span covers it. A candidate of 16 to 19 characters is one window, its bound
lowered as the highest entropy of so few characters is. The bounds of the classes without hexadecimal or all three sorts
of characters let about one in a hundred random strings of a window's length pass. Digits alone and letters of one case
alone, with or without separators, are of no class: numbers and words reach the entropy of random strings of that length.

Spans are (start, end, kind) in code points, end exclusive, ordered by start and then by kind. Matches are found left to
right without overlap, kind by kind; their places follow from the lengths of matches and of the stretches between.

Names are let go in every length: slugs, identifiers and paths whose pieces are letters, letters and up to eight digits, numbers, or up
to eight digits and three letters. No pattern recurses over a candidate, so a text may be one candidate of any length.

Defined results: null is the empty text and has no spans; long texts are scanned whole; repeated rows repeat their result;
the scanned table's columns are kept and the spans are put in one column; where the table has a column of that name, it gives
way, so callers that need it name another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.llm.quality_rules import let

# The base patterns, by kind, in the order of kinds.
ASSIGN = r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Character classes: (pattern a candidate matches, least entropy in bits of its best window, whether names of any length are let go).
CLASSES = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$|^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", 3.0, False),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.7, False),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", 3.4, True),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_=-]+$", 3.3, True),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", 3.6, True),
)
#: Candidates that are no secrets: UUIDs, paths of words, placeholders. Repeated groups are possessive, one whole piece at a time, so
#: that they neither recurse nor go back, however long the candidate.
_END = "(?=[+/_=-]|$)"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[a-zA-Z]*+(?:[/_-]++(?:[a-zA-Z]++|[0-9]{1,8})(?=[/_-]|$))++$",
    r"(?i)example|placeholder|xxxxxx|0123456789",
)
#: Slugs and identifiers: pieces of letters and then digits, numbers, ordinals and names like utf8mb4 between separators; words run together by capitals.
_PIECE = ("(?:[a-z]++[0-9]{0,8}|[A-Z]++[0-9]{0,8}|[A-Z][a-z]++[0-9]{0,8}|[0-9]++|[0-9]{1,8}[a-z]{1,3}"
          f"|[a-z]{{2,5}}[0-9]{{1,2}}[a-z]{{2,5}}[0-9]?){_END}")
_HUMP = ("(?:(?=[AEIOUY]|[A-Z][a-z]*[aeiouy])[A-Z][a-z]{2,}+|As|At|By|Db|Do|Id|If|In|Is|It|Js|My|No|Of|On|Or|To|Up|Css|Html|Https?|Sql|Xml)"
         "(?![a-z])")
_NAMES = (
    f"^[+/_=-]*+{_PIECE}(?:[+/_=-]++{_PIECE})*+[+/_=-]*+$",
    f"^(?:[a-z]{{2,}}+)?(?:[A-Z]{{2,4}}(?=[A-Z][a-z]))?(?:{_HUMP})++(?:[A-Z]{{2,4}})?[0-9]{{0,8}}$",
)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, found) of all matches of a pattern."""
    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.aggregate(
            F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))),
            F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["g"] + F.length(x["m"])).alias("at"),
                F.concat(s["out"], F.array(F.struct(
                    (s["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"),
                    (s["at"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("found")))).alias("out")),
            lambda s: s["out"])
    none = F.array().cast(SPANS)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


def best_entropy(candidate: Column) -> Column:
    """Highest Shannon entropy, in bits, over the windows of a candidate, by incremental counts; a shorter one is one window."""
    bits = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def slide(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            come, go = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))

            def moved(pair: Column) -> Column:
                come, go = pair["come"], pair["go"]
                more, less = F.get(s["counts"], come), F.get(s["counts"], go)
                total = s["sum"] + F.when(come == go, F.lit(0.0)).otherwise(
                    bits(more + 1) - bits(more) + F.when(go >= 0, bits(less - 1) - bits(less)).otherwise(F.lit(0.0)))
                counts = F.when(come == go, s["counts"]).otherwise(F.transform(
                    s["counts"], lambda c, k: c + F.when(k == come, 1).when(k == go, -1).otherwise(0)))
                width = F.least(F.lit(WINDOW), F.size(codes)).cast("double")
                full = F.when(i >= width - 1, F.log2(width) - total / width).otherwise(F.lit(0.0))
                return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(s["best"], full).alias("best"))
            return let(F.struct(come.alias("come"), go.alias("go")), moved)
        start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["best"])
    return let(F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c)), slide)


def _strange(found: Column) -> Column:
    """Whether a candidate's entropy is too high for its character class."""
    least, named = F.lit(None).cast("double"), F.lit(False)
    for pattern, bound, lets_names in reversed(CLASSES):
        least = F.when(F.rlike(found, F.lit(pattern)), F.lit(bound)).otherwise(least)
        if lets_names:
            named = named | F.rlike(found, F.lit(pattern))
    short = F.length(found) < WINDOW
    share = F.when(short, F.log2(F.length(found)) / F.log2(F.lit(float(WINDOW)))).otherwise(F.lit(1.0))
    scored = let(least, lambda x: F.when(x.isNotNull(), best_entropy(found) >= x * share - F.when(short, 1e-9).otherwise(0.0)).otherwise(F.lit(False)))
    for pattern in ALLOWED:
        scored = ~F.rlike(found, F.lit(pattern)) & scored
    names = F.lit(False)
    for pattern in _NAMES:
        names = names | F.rlike(found, F.lit(pattern))
    return ~((short | named) & names) & scored


def spans_of(text: Column) -> Column:
    """All spans of a text, base and added, as array of (start, kind, end, found)."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast(SPANS)
    assign = F.when(F.contains(whole, F.lit("=")) | F.contains(whole, F.lit(":")), F.filter(
        _spans(whole, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8)).otherwise(none)
    access = F.when(F.contains(whole, F.lit("AKIA")), F.filter(
        _spans(whole, ACCESS, 1), lambda s: F.length(s["found"]) >= 16)).otherwise(none)
    base = F.concat(assign, access, _spans(whole, HEX, 2))

    def with_added(kept: Column) -> Column:
        added = F.filter(_spans(whole, CANDIDATE, 3), lambda s: ~F.exists(
            kept, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])) & _strange(s["found"]))
        return F.array_sort(F.concat(kept, added))
    return let(base, with_added)


def scan(df: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """The table with its texts' spans; a column `into` of its own is replaced."""
    return df.withColumn(into, spans_of(F.col(f"`{text_col}`")))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    whole = F.coalesce(text, F.lit(""))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(s["out"], F.array(F.substr(whole, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))))
             .otherwise(s["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step,
                       lambda s: F.array_join(F.concat(s["out"], F.array(F.substr(whole, s["at"] + 1))), ""))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
