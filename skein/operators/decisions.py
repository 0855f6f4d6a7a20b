"""Decisions that messages state: sentences of the right shape, by strength, without repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as T
from ..functions.regex import extract_all, like, replace, spark_pattern
from .messages import whole, with_plain

CAP = 8


def _names_something(s: Column, known: Column) -> Column:
    lower = F.lower(s)
    words = extract_all(replace(s, r"^[\s\"'(\[]+", ""), r"[A-Za-z][A-Za-z0-9_-]*")
    named = F.exists(F.slice(words, F.lit(2), F.size(words)), lambda w: (F.length(w) >= 3) & F.substring(w, 1, 1).between("A", "Z") & ~w.isin(*fixed.PRONOUN_LIKE))
    return F.exists(known, lambda t: (t != "") & F.contains(lower, t)) | named


def has_shape(s: Column, known: Column) -> Column:
    """Whether a sentence can state a decision. known: lower-cased identity terms."""
    words = F.size(F.filter(F.split(s, spark_pattern(r"\s+")), lambda w: w != ""))
    fragment = like(s, fixed.FRAGMENT_LEAD) & ~like(T.head(s, 80), fixed.FRAGMENT_SUBJECT)
    hypothetical = like(s, fixed.HYPOTHETICAL_LEAD) & like(s, fixed.HYPOTHETICAL_VERB)
    out = T.length(s).between(25, 300) & ~F.startswith(s, F.lit("#")) & ~F.endswith(s, F.lit("?")) & ~like(s, r":\s*\z")
    for pattern in (fixed.PROPOSAL, fixed.INSTRUCTION_LEAD, fixed.NARRATION_LEAD):
        out &= ~like(s, pattern)
    return out & ~T.looks_like_header(s) & like(s, "[a-zA-Z]") & ((words >= 8) | _names_something(s, known)) & ~fragment & ~hypothetical


def strength(s: Column, role: Column) -> Column:
    return (
        F.when(like(s, fixed.HARD_DECISION), 3.0)
        .when(like(s, fixed.DECISION_TRADEOFF), 2.5)
        .when(like(s, fixed.SOFT_COMMIT), 2.0)
        .when((role == "assistant") & like(s, fixed.RECOMMEND), 1.5)
        .otherwise(0.0)
    )


def signature(s: Column) -> Column:
    """The first stock phrase that the sentence contains, or ''."""
    out = F.lit("")
    for phrase in reversed(fixed.SIGNATURES):
        out = F.when(F.contains(F.lower(s), F.lit(phrase)), phrase).otherwise(out)
    return out


def find(messages: DataFrame, identity: DataFrame) -> DataFrame:
    """All decisions: (conv_id, msg_idx, message_id, text, position, strength, ord). identity: (conv_id, top ARRAY<string>)."""
    known = F.transform(F.slice(F.coalesce("top", F.array().cast("array<string>")), 1, 5), F.lower)
    rows = with_plain(messages).withColumn("n", F.count("*").over(whole()))
    rows = rows.select("conv_id", "msg_idx", "message_id", "role", "n", F.posexplode("plains").alias("block_idx", "plain")).filter("plain IS NOT NULL")
    parts = F.transform(F.split(F.col("plain"), spark_pattern(r"(?<=[.!?])\s+|\n+")), T.trim)
    said = rows.join(identity.select("conv_id", "top"), "conv_id", "left").withColumn("known", known).select("conv_id", "msg_idx", "block_idx", "message_id", "role", "known", "n", F.posexplode(F.filter(parts, lambda x: x != "")).alias("sent_idx", "text"))
    s = F.col("text")
    shaped = said.filter(has_shape(s, F.col("known"))).withColumn("base", strength(s, F.col("role"))).filter("base > 0")
    position = F.col("msg_idx") / F.greatest(F.lit(1), F.col("n") - 1)
    bonus = F.when(F.exists("known", lambda t: F.contains(F.lower(s), t)), 0.3).otherwise(0.0)
    out = shaped.withColumn("position", position).withColumn("strength", F.col("base") + bonus + F.col("position") * 0.5)
    order = Window.partitionBy("conv_id").orderBy("msg_idx", "block_idx", "sent_idx")
    return out.select("conv_id", "msg_idx", "message_id", "text", "position", "strength", F.row_number().over(order).alias("ord"))


def keep(found: DataFrame, cap: int = CAP) -> DataFrame:
    """(conv_id, decisions ARRAY<STRUCT(position, strength, text)>): strongest first without equal keys or signatures, then in the order of the conversation."""
    item = F.struct((-F.col("strength")).alias("s"), "ord", "position", "text", T.key(F.col("text")).alias("key"), signature(F.col("text")).alias("sign"), "message_id")
    per = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        fresh = (F.size(a["at"]) < cap) & ~F.array_contains(a["keys"], x["key"]) & ((x["sign"] == "") | ~F.array_contains(a["signs"], x["sign"]))
        return F.when(fresh, F.struct(F.array_append(a["at"], x["ord"]).alias("at"), F.array_append(a["keys"], x["key"]).alias("keys"), F.array_append(a["signs"], x["sign"]).alias("signs"))).otherwise(a)

    at = F.aggregate("items", F.struct(F.array().cast("array<int>").alias("at"), none.alias("keys"), none.alias("signs")), step)["at"]
    kept = F.filter("items", lambda x: F.array_contains(F.col("at"), x["ord"]))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["position"].alias("position"), x["s"].alias("s"), x["ord"].alias("ord"), x["text"].alias("text"), x["message_id"].alias("message_id"))))
    told = F.transform(ordered, lambda x: F.struct(x["position"].alias("position"), (-x["s"]).alias("strength"), x["text"].alias("text"), x["message_id"].alias("message_id")))
    return per.withColumn("at", at).select("conv_id", told.alias("decisions"))


def extract(messages: DataFrame, identity: DataFrame, cap: int = CAP) -> DataFrame:
    return keep(find(messages, identity), cap)
