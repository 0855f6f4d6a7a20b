"""What a message knows of its conversation: numbers, neighbours, last ones by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import text as T
from ..sources.tables import block_text


def whole() -> WindowSpec:
    """All rows of a conversation."""
    return Window.partitionBy("conv_id")


def ordered() -> WindowSpec:
    return whole().orderBy("msg_idx")


def with_context(messages: DataFrame) -> DataFrame:
    """Adds n_messages, unanswered (a user message that no assistant message follows), last_user, last_assistant. One shuffle by conv_id."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("msg_idx"))).over(whole())
    follows = F.lead("role").over(ordered())
    return messages.select(
        "*",
        F.count("*").over(whole()).alias("n_messages"),
        ((F.col("role") == "user") & F.coalesce(follows != "assistant", F.lit(True))).alias("unanswered"),
        F.coalesce(F.col("msg_idx") == last("user"), F.lit(False)).alias("last_user"),
        F.coalesce(F.col("msg_idx") == last("assistant"), F.lit(False)).alias("last_assistant"),
    )


def last_by_role(messages: DataFrame) -> DataFrame:
    """(conv_id, last_user_id, last_assistant_id)."""
    of = lambda role: F.max_by("message_id", F.when(F.col("role") == role, F.col("msg_idx")))
    return messages.groupBy("conv_id").agg(of("user").alias("last_user_id"), of("assistant").alias("last_assistant_id"))


def blocks(messages: DataFrame) -> DataFrame:
    """One row per block: the message's columns without its arrays, block_idx and the block's fields."""
    rest = [c for c in messages.columns if c not in ("blocks", "attachments", "plains")]
    return messages.select(*rest, F.posexplode("blocks").alias("block_idx", "b")).select(*rest, "block_idx", "b.*")


def with_plain(messages: DataFrame) -> DataFrame:
    """Adds plains: for each block its text without links and markdown, null for other blocks than text. Written once, it serves all sections of a document."""
    return messages if "plains" in messages.columns else messages.withColumn("plains", F.transform("blocks", lambda b: F.when(b["type"] == "text", T.plain(b["text"]))))


def plain_text(messages: DataFrame, glue: str = " ") -> DataFrame:
    """Adds plain: the text blocks without links and markdown, joined."""
    return with_plain(messages).withColumn("plain", F.array_join("plains", glue))


def input_chars(messages: DataFrame) -> DataFrame:
    """(conv_id, input_chars): units of text, code and artifact blocks."""
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + T.length(block_text(b)))
    return messages.groupBy("conv_id").agg(F.sum(size).alias("input_chars"))


def dropped_attachments(messages: DataFrame) -> DataFrame:
    """(conv_id, dropped_attachments): all but code files of at most 20,000 bytes."""
    lost = F.size(F.filter("attachments", lambda a: (a["type"] != "code_file") | (F.coalesce(a["size"], F.lit(0)) > 20_000)))
    return messages.groupBy("conv_id").agg(F.sum(lost).alias("dropped_attachments"))
