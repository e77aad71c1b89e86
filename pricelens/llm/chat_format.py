"""Conversations as marked text with a loss mask, and back, in Spark expressions only.

A block is `<|role|>`, the texts of adjacent turns of that role with `<|+|>` between them, then `<|end|>` and a line feed.
In texts and roles `&`, `<` and `[` are escaped, so no mark of this template, nor of others that begin with `<` or `[`,
can come from a text; in roles `|` is escaped too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Turns of a conversation that are put together in one step before the steps are joined.
CHUNK = 256
#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"

BETWEEN, END = "<|+|>", "<|end|>\n"
#: Order matters: the escape sign comes first, and last on the way back.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_ROLE_ESCAPES = (*_ESCAPES, ("|", "&#124;"))


def _escape(c: Column, pairs=_ESCAPES) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def unescape(c: Column, pairs=_ESCAPES) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), reversed(pairs), c)


def _opened(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>"))


def _before(previous: Column, role: Column) -> Column:
    """What stands between two texts."""
    return F.when(previous == role, F.lit(BETWEEN)).otherwise(F.concat(F.lit(END), _opened(role)))


def _joined(parts: Column, first: str, last: str, lead: Column | None) -> Column:
    """Sorted parts with what stands between them: an array of (lead, body, spans).

    `lead` is what opens the first part; null where the part stays open at its left."""
    return F.transform(
        parts,
        lambda x, i: F.struct(
            F.when(i == 0, F.lit("") if lead is None else _opened(x[first]))
            .otherwise(_before(F.get(parts, i - 1)[last], x[first]))
            .alias("lead"),
            x["body"].alias("body"),
            x["spans"].alias("spans"),
        ),
    )


def _text(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["lead"], p["body"])), "")


def _spans(pieces: Column) -> Column:
    """The pieces' spans, moved by what stands before each piece."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, p):
        at = acc["at"] + F.length(p["lead"])
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))
        return F.struct((at + F.length(p["body"])).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def formatted(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length in characters of `formatted`).

    Turns go by turn, then role and text where turns tie; a turn of null comes first. A null role or text is empty. A
    null conversation id is one conversation. Repeated rows stay turns of their own. Spans cover each text of the
    loss role and no marks; an empty text has a span of length 0. Other columns are left out.

    Turns are put together in chunks by turn number, spread over tasks, then the chunks are joined."""
    rows = conversations.select(
        F.col(conv_id).alias("conv"),
        F.floor(F.col(turn) / CHUNK).alias("chunk"),  # null for null, which sorts before all others
        F.struct(
            F.col(turn).alias("turn"),
            _escape(F.coalesce(F.col(role), F.lit("")), _ROLE_ESCAPES).alias("role"),
            _escape(F.coalesce(F.col(text), F.lit(""))).alias("body"),
        ).alias("t"),
    )
    mask = _escape(F.lit(loss_role), _ROLE_ESCAPES)
    turns = F.transform(
        F.array_sort("turns"),
        lambda t: F.struct(
            t["role"].alias("role"),
            t["body"].alias("body"),
            F.when(
                t["role"] == mask,
                F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))),
            )
            .otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
            .alias("spans"),
        ),
    )
    chunks = (
        rows.groupBy("conv", "chunk")
        .agg(F.collect_list("t").alias("turns"))
        .select("conv", "chunk", turns.alias("turns"))
        .withColumn("pieces", _joined(F.col("turns"), "role", "role", None))
        .select(
            "conv",
            F.struct(
                "chunk",
                F.element_at("turns", 1)["role"].alias("first"),
                F.element_at("turns", -1)["role"].alias("last"),
                _text(F.col("pieces")).alias("body"),
                _spans(F.col("pieces")).alias("spans"),
            ).alias("c"),
        )
    )
    return (
        chunks.groupBy("conv")
        .agg(F.array_sort(F.collect_list("c")).alias("chunks"))
        .withColumn("pieces", _joined(F.col("chunks"), "first", "last", F.lit(True)))
        .select(
            F.col("conv").alias(conv_id),
            F.concat(_text(F.col("pieces")), F.lit(END)).alias("formatted"),
            _spans(F.col("pieces")).alias("loss_spans"),
        )
    )


def turns_of(formatted_text: Column) -> Column:
    """The turns read back: array of (role, text)."""
    blocks = F.split(formatted_text, r"<\|end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last end
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"^<\|[^|]*\|>", ""), r"<\|\+\|>", -1),
                lambda t: F.struct(
                    unescape(F.regexp_extract(b, r"^<\|([^|]*)\|>", 1), _ROLE_ESCAPES).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    found = F.transform(spans, lambda s: F.substr(formatted_text, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return unescape(F.array_join(found, ""))
