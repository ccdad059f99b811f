"""Chat formatting of conversations with typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. The visitor flattens them in order: a text part is escaped, any
other part becomes the placeholder of its type, and its reference and expanded token count are recorded in the same order as
the placeholders. The template writes each turn as "### role: body</turn>" and a line end. Escaping takes every backslash,
'#' and '<' out of texts (and ':' and line ends out of roles), so marks and placeholders can't be forged and parsing is exact.

Defined cases: a null text is an empty one; a null role is the empty role; a part of an unknown or null type counts as text;
turns of one number are ordered by role, then body; repeated rows are turns of their own; a null conversation id is a
conversation; places in a very long conversation are summed in two levels, so the work is about in proportion to its turns; an
empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sums_before

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: Side of an image patch, tokens of a second of audio, tokens of a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")).cast("struct<type:string,text:string>"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text takes in the model's input."""
    count = lambda x: F.coalesce(x, F.lit(0))
    patches = F.ceil(count(part["width"]) / PATCH) * F.ceil(count(part["height"]) / PATCH)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(count(part["seconds"]) * AUDIO_RATE))
        .when(part["type"] == "document", count(part["pages"]) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """The flattened body, and the attachments (type, ref, tokens) in the order of their placeholders."""

    def body(part: Column) -> Column:
        shown = escape(F.coalesce(part["text"], F.lit("")))
        for kind, mark in PLACEHOLDERS.items():
            shown = F.when(part["type"] == kind, mark).otherwise(shown)
        return shown

    held = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS))
    attached = F.transform(held, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.array_join(F.transform(parts, body), ""), attached


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts (array of PART). Per conversation: formatted, loss (array of start and length, in
    code points of formatted), attachments."""
    body, attached = visit_parts(F.coalesce("parts", F.array().cast(f"array<{PART}>")))
    role = F.coalesce("role", F.lit(""))
    turns = messages.select(
        "conv_id",
        F.struct(
            "turn", F.concat(F.lit(OPEN), escape_role(role), F.lit(COLON)).alias("head"), body.alias("body"),
            role.isin(*loss_roles).alias("learned"), attached.alias("attached"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lengths = F.transform("ts", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("bigint"))
    placed = F.zip_with("ts", sums_before(lengths), lambda t, at: F.struct((at + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"), t["learned"].alias("learned")))
    loss = F.transform(F.filter(placed, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        loss.alias("loss"),
        F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attachments"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in the text."""
    chunks = F.split(formatted, CLOSE, -1)
    one = lambda c: F.struct(
        unescape_role(F.regexp_extract(c, r"(?s)^### ([^:]*): (.*)$", 1)).alias("role"),
        unescape(F.regexp_extract(c, r"(?s)^### ([^:]*): (.*)$", 2)).alias("text"),
    )
    return F.transform(F.slice(chunks, 1, F.size(chunks) - 1), one)


def loss_text(formatted: Column, loss: Column) -> Column:
    part = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss, part), "")
