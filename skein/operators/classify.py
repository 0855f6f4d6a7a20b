"""Conversation type from signal rates: one aggregation per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.regex import count
from ..sources.tables import block_text

TYPES = ("coding", "writing", "research", "planning")


def _over(pattern: str) -> Column:
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + count(block_text(b), pattern))


def _chars(*kinds: str) -> Column:
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.when(b["type"].isin(*kinds), T.length(block_text(b))).otherwise(0))


def signals(messages: DataFrame) -> DataFrame:
    """(conv_id, code_ratio, avg_user_len, question_density, and the rates per 1,000 units).

    Patterns are counted block by block: a block's border is a line break, which none of them crosses.
    """
    user = F.col("role") == "user"
    per = messages.select(
        "conv_id",
        "role",
        F.size("blocks").alias("n_blocks"),
        _chars("text", "code", "artifact").alias("chars"),
        _chars("code", "artifact").alias("code_chars"),
        _chars("text").alias("text_chars"),
        F.when(user, _over(r"\?")).otherwise(0).alias("questions"),
        *((F.when(user, _over(p)).otherwise(0) if n == "imperative" else _over(p)).alias(n) for n, p in fixed.SIGNALS.items()),
    )
    total = per.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("n_blocks", "chars", "code_chars", "questions", *fixed.SIGNALS)),
        F.sum(F.when(user, F.col("text_chars"))).alias("user_chars"),
        F.count_if(user).alias("users"),
    )
    size = F.col("chars") + F.greatest(F.col("n_blocks") - 1, F.lit(0))
    total = total.withColumn("total", F.when(size == 0, 1).otherwise(size))
    zero = F.lit(0.0)
    return total.select(
        "conv_id",
        (F.col("code_chars") / F.col("total")).alias("code_ratio"),
        F.coalesce(F.try_divide("user_chars", "users"), zero).alias("avg_user_len"),
        F.coalesce(F.try_divide("questions", "users"), zero).alias("question_density"),
        *((F.col(n) * 1000 / F.col("total")).alias(n) for n in fixed.SIGNALS),
    )


def _c(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def classify(messages: DataFrame) -> DataFrame:
    """signals() with the scores, type and confidence. Ties go to the type that comes first in TYPES."""
    s = F.col
    scores = {
        "coding": _c(s("code_ratio") * 4) + _c(s("error") / 2) * 0.8 + _c(s("filename") / 2) * 0.7 + _c(s("imperative") / 5) * 0.5 - _c(s("avg_user_len") / 800) * 0.2,
        "writing": _c(s("avg_user_len") / 800) * 0.6 + _c(s("style") / 2) + _c(s("imperative") / 5) * 0.3 - _c(s("code_ratio") * 4) * 0.5,
        "research": _c(s("question_density") / 2) * 0.5 + _c(s("citation") / 2) + _c(s("avg_user_len") / 600) * 0.4,
        "planning": _c(s("decision") / 2) + _c(s("ideation") / 2) * 0.9 + _c(s("future_tense") / 3) * 0.5 + _c(s("imperative") / 5) * 0.3,
    }
    out = signals(messages).select("*", *(v.alias(f"score_{k}") for k, v in scores.items()))
    ranked = F.sort_array(F.array(*(F.struct(s(f"score_{k}").alias("score"), F.lit(-i).alias("i"), F.lit(k).alias("type")) for i, k in enumerate(TYPES))), asc=False)
    out = out.withColumn("_r", ranked)
    top, second = F.col("_r")[0]["score"], F.col("_r")[1]["score"]
    kind = F.when((top < fixed.MIXED_FLOOR) | (top - second < fixed.MIXED_MARGIN), "mixed").otherwise(F.col("_r")[0]["type"])
    return out.select(*[c for c in out.columns if c != "_r"], kind.alias("type"), F.when(top == 0, 0.0).otherwise((top - second) / top).alias("confidence"))
