"""Chat formatting with DataFrame functions only.

A turn is ``<|turn|>role\\n``, its content, ``<|end|>\\n``. Every control string starts with ``<|``; in
roles and texts each ``<``, backslashes, ``|`` gets one backslash more, so none can be forged and
unescaping restores the text exactly. Content is a list of typed parts: texts that stand next to each
other are joined and then escaped, so that no control string can be put together from several
parts, and all other kinds become placeholders in order, with a reference to the attachment and the
number of tokens that it expands to. What follows a placeholder is escaped apart from it: placeholders
end in ``>`` and control strings start with ``<``, so none can form across that border.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END, BREAK = "<|turn|>", "<|end|>\n", "<|nl|>"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Kinds of parts with a placeholder of their own; any other kind but ``text`` is a ``file``.
KINDS = ("image", "audio", "document")


@dataclass(frozen=True)
class ChatConfig:
    """Tokens that attachments expand to: for each image patch, second of audio, page."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    learn_roles: tuple[str, ...] = ("assistant",)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _attachment(part: Column, config: ChatConfig) -> Column:
    """What a part that is no text refers to, and the tokens that it expands to; null for text."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    tokens = (
        F.when(kind == "image", F.ceil(size(part["width"]) / config.patch) * F.ceil(size(part["height"]) / config.patch))
        .when(kind == "audio", F.ceil(size(part["seconds"]) * config.audio_rate))
        .when(kind == "document", size(part["pages"]).cast("long") * config.page_tokens)
        .otherwise(0)
        .cast("long")
    )
    return F.when(kind != "text", F.struct(kind.alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens")))


def _body(parts: Column) -> Column:
    """The parts as one string: runs of text joined, then escaped; a placeholder for every other part."""
    kind = lambda p: F.lower(F.coalesce(p["kind"], F.lit("text")))
    mark = lambda p: F.concat(F.lit("<|"), F.when(kind(p).isin(*KINDS), kind(p)).otherwise(F.lit("file")), F.lit("|>"))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def visit(state: Column, p: Column) -> Column:
        text = F.struct(state["done"].alias("done"), F.concat(state["open"], F.coalesce(p["text"], F.lit(""))).alias("open"))
        other = F.struct(F.concat(state["done"], escape(state["open"]), mark(p)).alias("done"), F.lit("").alias("open"))
        return F.when(kind(p) == "text", text).otherwise(other)

    return F.aggregate(parts, empty, visit, lambda state: F.concat(state["done"], escape(state["open"])))


def format_chats(rows: DataFrame, config: ChatConfig = ChatConfig(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens), one row a conversation.

    ``parts`` names a column ``array<PART>``; without it, ``text`` is the one part. Null parts are left
    out, and a part without a kind is text; a part of a kind that is not known stands as ``<|file|>``
    and is listed under its own kind with no tokens. Turns go by
    number, then role and text, so ties and repeated rows have a fixed place; a null turn comes
    first, null roles and texts are empty, and null conversation ids form one conversation.
    ``loss_spans`` are code-point ranges of ``formatted`` with what the learned roles say. A
    conversation is one string in the end, so one task holds one conversation, not more.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit("")) if parts is None else F.lit(None).cast("string")
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    base = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"), *([F.col(parts).alias("parts")] if parts else []))
    if parts:
        given = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
        base = base.withColumn("parts", given)
        base = base.withColumn("body", _body(F.col("parts"))).withColumn("refs", F.filter(F.transform("parts", lambda p: _attachment(p, config)), lambda r: r.isNotNull()))
    else:
        base = base.withColumn("body", escape(F.col("text"))).withColumn("refs", F.expr("cast(array() as array<struct<kind:string,uri:string,tokens:bigint>>)"))
    base = base.withColumn("head", F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n")))
    base = base.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("at", F.sum(F.length("piece").cast("long")).over(order) - F.length("piece"))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role").isin(*config.learn_roles), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    turns = base.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span"), "refs"))).alias("t"))
    return turns.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join("t.piece", "").alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("t.refs").alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["tokens"], F.lit(0))))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped. Placeholders stay."""

    def one(t: Column) -> Column:
        name = F.substring_index(t, "\n", 1)
        body = F.substring(t, F.length(name) + 2, F.length(t) - F.length(name) - 1 - len(END))
        return F.struct(unescape(F.replace(name, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: counts and digests of turns and of the learned text."""
    turns = F.array_join(F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.select("conv_id", F.size(parse_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
