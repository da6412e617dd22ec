"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns before the reply as context and the reply itself; only the
reply is trainable.  Turns after the last reply become a last row without a trainable
part, so that the output holds every conversation whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """``text`` without any ``<|``; ``unescape`` gives back the same text."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))


def examples(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Columns: the conversation's id, ``example`` (from 0), ``formatted``, ``loss_start``,
    ``loss_end`` (code points, end exclusive; both null in a row of trailing turns),
    ``is_last`` (the row that holds all turns).

    Turns are ordered by turn, role, text; null texts and roles are empty; a null
    conversation id is a conversation of its own; other columns are ignored.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    parts = F.transform(
        "_turns",
        lambda t: F.struct(
            (t["role"] == F.lit(trained)).alias("trained"),
            _header(t["role"]).alias("head"),
            F.concat(escape(t["text"])).alias("body"),
        ),
    )
    numbered = whole.select(conv_col, parts.alias("_parts")).select(
        conv_col,
        "_parts",
        F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))).alias("_rendered"),
        F.filter(
            F.sequence(F.lit(1), F.size("_parts")),
            lambda i: F.element_at("_parts", i)["trained"] | (i == F.size("_parts")),
        ).alias("_ends"),
    )
    return (
        numbered.select(conv_col, "_parts", "_rendered", F.posexplode_outer("_ends").alias("example", "_at"))
        .select(
            conv_col,
            "example",
            F.array_join(F.slice("_rendered", 1, F.col("_at")), "").alias("formatted"),
            F.element_at("_parts", F.col("_at")).alias("_reply"),
            (F.col("_at") == F.size("_rendered")).alias("is_last"),
        )
        .withColumn("_end", F.when(F.col("_reply.trained"), F.length("formatted") - F.lit(len(END) + 1)))
        .select(conv_col, "example", "formatted", (F.col("_end") - F.length("_reply.body")).alias("loss_start"), F.col("_end").alias("loss_end"), "is_last")
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted row."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != F.lit(""))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&nl;"), F.lit("\n"))).alias("role"),
            unescape(F.substring_index(F.substr(p, F.instr(p, F.lit("\n")) + 1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of a row, as it was before escaping; empty without a mask."""
    return F.coalesce(unescape(F.substr(formatted, start + 1, end - start)), F.lit(""))
