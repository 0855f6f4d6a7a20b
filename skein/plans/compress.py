"""The whole way from conversations to documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.stages import stage, stage_all
from ..operators import candidates as C
from ..operators.classify import TYPES, classify
from ..operators.messages import dropped_attachments, with_plain
from ..operators.render import LABEL, render
from ..sources.tables import Corpus

LEVELS = tuple(fixed.BUDGET_CHARS)


def types_of(corpus: Corpus, force_type: str | None = None) -> DataFrame:
    """(conv_id, type); conversations without messages are mixed."""
    if force_type is not None:
        if force_type not in (*TYPES, "mixed"):
            raise ValueError(f"unknown type {force_type!r}")
        return corpus.conversations.select("conv_id", F.lit(force_type).alias("type"))
    found = classify(corpus.messages).select("conv_id", "type")
    return corpus.conversations.select("conv_id").join(found, "conv_id", "left").withColumn("type", F.coalesce("type", F.lit("mixed")))


def compress(corpus: Corpus, level: str = "resume", force_type: str | None = None, label: str = LABEL) -> DataFrame:
    """(conv_id, level, markdown, type, input_chars, output_chars, budget_chars, dropped_messages, dropped_attachments)."""
    if level not in fixed.BUDGET_CHARS:
        raise ValueError(f"unknown level {level!r}")
    return _document(*_shared(corpus, force_type), level, label)


def _shared(corpus: Corpus, force_type: str | None) -> tuple[Corpus, DataFrame, DataFrame]:
    """What all levels have in common: the corpus, types and scored candidates, each computed once."""
    corpus = Corpus(*stage_all({"conversations": corpus.conversations, "messages": with_plain(corpus.messages)}).values())
    types, candidates = stage_all({"types": types_of(corpus, force_type), "candidates": C.extract(corpus.messages)}).values()
    return corpus, types, stage(C.score(candidates, types), "scored")


def _document(corpus: Corpus, types: DataFrame, scored: DataFrame, level: str, label: str) -> DataFrame:
    budget = fixed.BUDGET_CHARS[level]
    selected = stage(C.select(scored, budget), "selected")
    docs = render(corpus, types, selected, level, label)
    lost = C.dropped_messages(corpus.messages, selected)
    files = dropped_attachments(corpus.messages)
    out = docs.join(lost, "conv_id", "left").join(files, "conv_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        F.lit(level).alias("level"),
        "markdown",
        "type",
        "input_chars",
        T.length(F.col("markdown")).alias("output_chars"),
        F.lit(budget).alias("budget_chars"),
        F.coalesce("dropped_messages", zero).alias("dropped_messages"),
        (zero if level == "full" else F.coalesce("dropped_attachments", zero)).alias("dropped_attachments"),
    )


def compress_levels(corpus: Corpus, levels: Sequence[str] = LEVELS, force_type: str | None = None, label: str = LABEL) -> DataFrame:
    shared, out = _shared(corpus, force_type), None
    for level in levels:
        one = _document(*shared, level, label)
        out = one if out is None else out.unionByName(one)
    return out


def write(documents: DataFrame, path: str) -> None:
    """Documents as Parquet, a folder for each level."""
    documents.write.partitionBy("level").mode("overwrite").parquet(path)
