"""Tabular conversations: (conv_id, turn, role, text) rows into the engine's two tables.

conversations(conv_id, source, title, created_at, model, system_prompt)
messages(conv_id, msg_idx, message_id, role, created_at, blocks, attachments): msg_idx dense from 0 after the system prompt is lifted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


BLOCK = "struct<type:string,language:string,text:string,artifact_id:string,title:string,version:int,tool_name:string,summary:string>"
ATTACHMENT = "struct<type:string,filename:string,size:bigint,mime_type:string,inline_content:string>"
#: Roles that messages have; others are dropped.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "system": "system", "tool": "tool"}


@dataclass(frozen=True)
class Corpus:
    """Conversations and their messages. A conversation's rows fit one task: an export file holds at most 25 MiB."""

    conversations: DataFrame
    messages: DataFrame


def block(kind: str, text: Column, **more: Column) -> Column:
    names = ("language", "text", "artifact_id", "title", "version", "tool_name", "summary")
    values = {"text": text} | more
    return F.struct(F.lit(kind).alias("type"), *(values.get(n, F.lit(None)).cast("int" if n == "version" else "string").alias(n) for n in names))


_FENCE = r"```([\w-]*)\n?([\x{0}-\x{10FFFF}]*?)```"


def split_text_and_code(text: Column) -> Column:
    """ARRAY<block>: text between fences, trimmed, and the code in them. Without either the text as it is."""
    language, code = (F.regexp_extract_all(text, F.lit(_FENCE), F.lit(g)) for g in (1, 2))
    said = lambda t: F.when(T.trim(t) != "", block("text", T.trim(t)))
    fenced = lambda c, i: F.when(c.isNotNull(), block("code", F.regexp_replace(c, r"\n\z", ""), language=F.nullif(F.get(language, i), F.lit(""))))
    both = F.flatten(F.transform(F.split(text, _FENCE, -1), lambda t, i: F.array(said(t), fenced(F.get(code, i), i))))
    return T.let(F.filter(both, lambda b: b.isNotNull()), lambda p: F.when(F.size(p) == 0, F.array(block("text", text))).otherwise(p))


def block_text(b: Column) -> Column:
    """The text of a text, code or artifact block, '' for tool blocks."""
    return F.coalesce(b["text"], F.lit(""))


def lift_system_prompt(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages without a leading system message, renumbered; (conv_id, system_prompt) of those with 20 units or more)."""
    first = F.col("msg_idx") == F.min("msg_idx").over(Window.partitionBy("conv_id"))
    marked = messages.withColumn("lifted", first & (F.col("role") == "system"))
    prompt = T.trim(F.array_join(F.transform("blocks", block_text), "\n"))
    prompts = marked.filter("lifted").select("conv_id", prompt.alias("system_prompt")).filter(T.length(F.col("system_prompt")) >= 20)
    order = Window.partitionBy("conv_id").orderBy("msg_idx")
    rest = marked.filter("NOT lifted").drop("lifted").withColumn("msg_idx", F.row_number().over(order) - 1)
    return rest, prompts


def from_turns(df: DataFrame, source: str = "chatgpt") -> Corpus:
    """Rows (conv_id, turn, role, text); rows with another role, a null or a blank text are dropped."""
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("role"))
    known = df.filter(F.col("role").isin(*ROLES)).filter(T.trim(F.coalesce("text", F.lit(""))) != "")
    rows = known.select("conv_id", F.col("turn").alias("msg_idx"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), role.alias("role"), F.lit(None).cast("timestamp").alias("created_at"), split_text_and_code(F.col("text")).alias("blocks"), F.array().cast(f"array<{ATTACHMENT}>").alias("attachments"))
    messages, prompts = lift_system_prompt(rows)
    convs = known.select("conv_id").distinct().join(prompts, "conv_id", "left")
    nothing = F.lit(None).cast("string")
    return Corpus(convs.select("conv_id", F.lit(source).alias("source"), nothing.alias("title"), F.lit(None).cast("timestamp").alias("created_at"), nothing.alias("model"), "system_prompt"), messages)


