"""Chat formatting from event logs.

A log holds one row per event: conversation, message (place in the conversation), seq, role, kind and text. Kinds: `delta`
adds text, `edit` replaces what the message held, `regenerate` empties it and starts with its own text. `reconstruct`
folds the events of each message, in seq order, into its final text; `render` writes one training text per conversation
with the spans that count for the loss; `read_back` takes the turns and the text under the mask out of it again.

Template: `### role`, line feed, text, `</turn>`, line feed. Inside texts and roles a backslash becomes `\\b`, `###` becomes
`\\h`, `</turn>` becomes `\\t`, in roles also a line feed `\\n`; so the marks never occur inside and all is reversible.

A message's role is that of its last event that names one, so an edit or a regeneration without a role keeps it, and stale drafts
may tell it too.

Defined results: null texts and roles are empty; events of equal seq are taken in order of kind and text; an unknown kind
counts as delta; repeated rows are repeated events; a conversation without events has no row; null ids form one
conversation of their own; other columns are not carried. A conversation is one row and must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "### ", "</turn>\n"
#: (plain, escaped); the backslash comes first when escaping and last when reading.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(text: Column, extra: tuple = ()) -> Column:
    for plain, code in (*ESCAPES, *extra):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, extra: tuple = ()) -> Column:
    for plain, code in reversed((*ESCAPES, *extra)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


IN_ROLE = (("\n", "\\n"),)


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): every message as the log leaves it."""
    e = events.select("conv_id", "message", "seq", "role", F.coalesce("kind", F.lit("delta")).alias("kind"),
                      F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "kind", "text")
    whole = W.partitionBy("conv_id", "message")
    fresh = F.max(F.when(F.col("kind").isin("edit", "regenerate"), order)).over(whole)
    named = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).over(whole)
    live = e.withColumn("at", order).withColumns({"fresh": fresh, "named": named["role"]}).where(F.col("fresh").isNull() | (F.col("at") >= F.col("fresh")))
    return live.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("parts"), F.max("named").alias("role")).select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def logged(messages: DataFrame) -> DataFrame:
    """An event log whose fold gives the messages (conv_id, message, role, text) back.

    Every text comes in three deltas. Of four messages, by their hash, one is streamed so; one begins with a stale draft that a
    regeneration throws away; one is drafted and then edited to its text; one loses its first draft, is edited and streams
    its end. Only first events name the role. A message's events leave last first, so their order here says nothing.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    piece = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, third * 2 + 1)]

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(seq).alias("seq"), (F.col("role") if seq == 0 else F.lit(None).cast("string")).alias("role"),
                                  F.lit(kind).alias("kind"), t.alias("text")) for seq, (kind, t) in reversed(list(enumerate(events)))])
    deltas = [("delta", p) for p in piece]
    stale = [("delta", F.concat(F.lit("draft: "), piece[0])), ("delta", F.lit("</turn>"))]
    which = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    events = F.when(which == 0, log(*deltas)).when(which == 1, log(*stale, ("regenerate", F.lit(None).cast("string")), *deltas)).when(
        which == 2, log(*stale, ("edit", text))).otherwise(log(*stale, ("regenerate", piece[2]), ("edit", piece[0]), *deltas[1:]))
    return messages.select("conv_id", "message", F.explode(events).alias("e")).select("conv_id", "message", "e.*")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss: array of (start, length) in code points) from reconstructed messages."""
    head = F.concat(F.lit(START), escape(F.col("role"), IN_ROLE), F.lit("\n"))
    piece = F.concat(F.col("head"), F.col("body"), F.lit(END))
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    placed = (messages.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", piece)
              .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "message", "piece", (F.col("role") == trained).alias("trained"), F.col("start").cast("int").alias("start"),
        F.length("body").alias("length")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]),
                        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return turns.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss_text) from formatted conversations."""
    raw = F.split("formatted", END)
    turns = F.transform(F.slice(raw, 1, F.size(raw) - 1), lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1), IN_ROLE).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
