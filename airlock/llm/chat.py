"""Chat formatting with Spark expressions alone.

A conversation's turns are collected as structs and sorted, adjacent turns of one role share a
header, and array functions concatenate everything into one string:

    ### role: text</turn>text of the same role's next turn</turn>
    ### other role: text</turn>

Strings that the template uses are escaped inside roles and texts, so the result can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, END, BREAK = "### ", "</turn>", "\n"
#: What is escaped, in this order, and its escape. Each escape is a backslash and a letter of its
#: own, and every backslash of a text is itself escaped, so undoing them in reverse order is exact.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
_SPAN, _SOME_TURNS = "struct<start:bigint,length:bigint>", 64
_ROLE_ONLY = (":", "\\c")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans) with one row for each conversation.

    Turns are in the order of `turn`; equal ones (ties, repeated rows) in that of role and text,
    all are kept. A null role or text is empty; a null turn comes first. Null conversation ids are
    one conversation. loss_spans are the (start, length) of the texts of `loss_roles` in
    `formatted`, in code points from 0, without headers and marks. No rows give no conversations.
    """
    slim = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sorted_turns = slim.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        follows = (i > 0) & (F.element_at("t", F.greatest(i, F.lit(1)))["_role"] == x["_role"])
        said = F.replace(escape(x["_role"]), F.lit(_ROLE_ONLY[0]), F.lit(_ROLE_ONLY[1]))
        opening = F.concat(F.when(i > 0, F.lit(BREAK)).otherwise(F.lit("")), F.lit(HEADER), said, F.lit(": "))
        head = F.when(follows, F.lit("")).otherwise(opening)
        return F.struct(head.alias("head"), escape(x["_text"]).alias("body"), x["_role"].isin(*loss_roles).alias("loss"))

    def starts_at(at: Column, kind: str) -> Column:
        return F.struct(at.alias("at"), F.array().cast(kind).alias("spans"))

    def grow(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["head"])
        span = F.struct(begin.alias("start"), F.length(x["body"]).cast("long").alias("length"))
        return F.struct((begin + F.length(x["body"]) + len(END)).alias("at"), F.when(x["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def grow_by(state: Column, some: Column) -> Column:
        """Spans are gathered for some turns at a time: a list is copied whenever it grows."""
        got = F.aggregate(some, starts_at(state["at"], f"array<{_SPAN}>"), grow)
        return F.struct(got["at"].alias("at"), F.concat(state["spans"], F.array(got["spans"])).alias("spans"))

    cut = sorted_turns.withColumn("p", F.transform("t", piece))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    by_some = F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(_SOME_TURNS)), lambda i: F.slice("p", i, _SOME_TURNS))
    return cut.select(F.col("_conv").alias(conv), whole.alias("formatted"), F.flatten(F.aggregate(by_some, starts_at(F.lit(0).cast("long"), f"array<array<{_SPAN}>>"), grow_by)["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs of role and text."""
    blocks = F.slice(F.split(formatted, HEADER, -1), 2, 1 << 30)

    def turns(block: Column) -> Column:
        said = F.substring_index(block, ":", 1)
        role = unescape(F.replace(said, F.lit(_ROLE_ONLY[1]), F.lit(_ROLE_ONLY[0])))
        ends = F.split(F.substr(block, F.length(said) + 3), END, -1)
        return F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
