r"""Chat formatting: one training example per assistant turn, with all turns before it as context.

A turn is written as ``### role:`` and a line feed, the text, ``</turn>`` and a line feed. Inside texts and roles a
backslash is doubled, ``</turn>`` becomes ``<\/turn>`` and a ``#`` before another ``#`` is followed by a backslash; in
roles ``:`` becomes ``\:``. So the marks cannot occur inside a text, and dropping each backslash before the next
character restores it. The loss span of an example covers exactly the escaped reply, in code points.

Turns are ordered by turn, then role, then text; repeated rows stay, a null turn comes first, a null role or text is
empty, and null conv_ids are one conversation. Turns behind the last reply (or a conversation without a reply) give
one more example with an empty span, so that nothing is lost. A conversation is one row while it is formatted, as
each example holds its whole context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty

ASSISTANT = "assistant"
_END = "</turn>\n"
_HEAD = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n"


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.when(F.contains(text, F.lit("##")), F.regexp_replace(text, "#(?=#)", r"#\\")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_length, last): a span of 0 characters trains nothing.

    ``example`` is the number of turns that the example holds; ``loss_start`` counts code points from 1.
    """
    turn = F.struct("turn", or_empty("role").alias("role"), or_empty("text").alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = gathered.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t.role == ASSISTANT).alias("reply"),
                F.concat(F.lit("### "), F.replace(escape(t.role), F.lit(":"), F.lit("\\:")), F.lit(":\n")).alias("head"),
                escape(t.text).alias("body"),
            ),
        ).alias("turns"),
    ).select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(t["head"], t.body, F.lit(_END))).alias("written"),
        F.size("turns").alias("n"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda at: F.element_at("turns", at).reply | (at == F.col("n")))
    spread = rendered.select("*", F.explode(ends).alias("example"))
    final = F.element_at("turns", F.col("example"))
    text = F.array_join(F.slice("written", F.lit(1), F.col("example")), "")
    return (
        spread.withColumn("text", text)
        .withColumn("loss_length", F.when(final.reply, F.length(final.body)).otherwise(0))
        .select(
            "conv_id",
            "example",
            "text",
            (F.length("text") - F.length(final.body) - len(_END) + 1).alias("loss_start"),
            "loss_length",
            (F.col("example") == F.col("n")).alias("last"),
        )
    )


def loss_text(text: str = "text", start: str = "loss_start", length: str = "loss_length") -> Column:
    """The trainable reply of an example as it was before escaping."""
    return unescape(F.substring(F.col(text), F.col(start), F.col(length)))


def parse_turns(text: str | Column) -> Column:
    """Array of (role, text) that an example's text holds."""
    written = F.split(text, "</turn>\n")
    return F.transform(
        F.slice(written, F.lit(1), F.size(written) - 1),
        lambda part: F.struct(
            unescape(F.regexp_extract(part, _HEAD, 1)).alias("role"),
            unescape(F.regexp_replace(part, _HEAD, "")).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns from the last one, replies from every loss span in order."""
    whole = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("bigint").alias("chars"),
        F.when(F.col("loss_length") > 0, loss_text()).otherwise("").alias("reply"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    return (
        whole.groupBy("conv_id")
        .agg(
            F.max("whole").alias("whole"),
            F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            parse_turns("whole").alias("turns"),
            F.array_join(F.transform("replies", lambda r: r.reply), "").alias("loss"),
            "formatted_chars",
        )
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias(
                "turns_sha256"
            ),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
