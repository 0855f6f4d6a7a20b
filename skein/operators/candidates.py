"""Candidates: sentences, code and artifacts of messages; term statistics; scores; selection within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, libm
from ..functions import text as T
from ..functions.regex import like
from .messages import whole, blocks, with_context


def extract(messages: DataFrame) -> DataFrame:
    """One row per candidate, with its message's context columns and ord, its place in the conversation."""
    rows = blocks(with_context(messages)).filter(F.col("type").isin("text", "code", "artifact"))
    position = F.when(F.col("n_messages") == 1, 1.0).otherwise(F.col("msg_idx") / (F.col("n_messages") - 1))
    said = F.filter(F.transform(T.sentences(F.col("text")), T.strip_markdown), lambda x: x != "")
    rows = rows.select("*", position.alias("position"), F.posexplode(F.when(F.col("type") == "text", said).otherwise(F.array("text"))).alias("sent_idx", "body"))
    body, kind = F.col("body"), F.col("type")
    named = F.when(like(body, fixed.QUESTION_END), "question").when(like(body, fixed.CANDIDATE_DECISION), "decision").otherwise("sentence")
    ids = (
        F.when(kind == "text", F.concat_ws("-", "message_id", F.concat(F.lit("s"), "block_idx"), "sent_idx"))
        .when(kind == "code", F.concat_ws("-", "message_id", F.concat(F.lit("c"), "block_idx"), T.java_hash(T.head(body, 200))))
        .otherwise(F.concat(F.col("message_id"), F.lit("-a"), F.col("artifact_id")))
    )
    out = rows.select(
        "conv_id", "msg_idx", "block_idx", F.when(kind == "text", F.col("sent_idx")).alias("sent_idx"), ids.alias("cand_id"), "message_id", "role",
        F.when(kind == "text", named).otherwise(kind).alias("kind"), body.alias("text"), F.when(kind != "text", F.col("language")).alias("language"),
        T.length(body).alias("char_len"), "position", "artifact_id", "title", "version", "n_messages", "unanswered", "last_user", "last_assistant",
    )
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("msg_idx", "block_idx", F.coalesce("sent_idx", F.lit(0)))) - 1)


def _counts(candidates: DataFrame) -> DataFrame:
    """(conv_id, ord, term, tf, rarity), a row without a term for a candidate that has none. All by conversation: no shuffle but the candidates' own."""
    numbered = candidates.select("conv_id", "ord", "text", F.count("*").over(whole()).alias("n"))
    words = numbered.select("conv_id", "ord", "n", F.explode_outer(T.terms(F.col("text"))).alias("term"))
    tf = words.groupBy("conv_id", "ord", "term").agg(F.count("term").alias("tf"), F.first("n").alias("n"))
    df = F.count("*").over(Window.partitionBy("conv_id", "term"))
    return tf.select("conv_id", "ord", "term", "tf", (F.col("n") / (1 + df)).alias("rarity"))


def term_stats(candidates: DataFrame) -> DataFrame:
    """(conv_id, ord, term, tf, idf, tfidf); the corpus of a term is its conversation's candidates."""
    rows = _counts(candidates).filter("term IS NOT NULL").withColumn("idf", libm.ln(F.array("rarity"))[0] + 1)
    return rows.select("conv_id", "ord", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def term_scores(candidates: DataFrame) -> DataFrame:
    """(conv_id, ord, tfidf_score): the five heaviest terms' sum over the conversation's largest such sum; 0 for a lone candidate."""
    per = _counts(candidates).groupBy("conv_id", "ord").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("tf", "rarity"))).alias("terms"))
    per = per.withColumn("logs", libm.ln(F.transform("terms", lambda x: x["rarity"])))
    weights = F.zip_with("terms", "logs", lambda x, log: x["tf"] * (log + 1))
    top = F.slice(F.sort_array(weights, asc=False), 1, 5)
    every = per.select("conv_id", "ord", F.aggregate(top, F.lit(0.0), lambda a, x: a + x).alias("s"))
    n, most = F.count("*").over(whole()), F.max("s").over(whole())
    return every.select("conv_id", "ord", F.when((n < 2) | (most <= 0), 0.0).otherwise(F.col("s") / most).alias("tfidf_score"))


def _overlay() -> Column:
    """Factors are multiplied in tenths and divided once: a product such as 1.4 * 1.2 is the double nearest to 1.68."""
    t, text, kind = F.col("type"), F.col("text"), F.col("kind")
    by = lambda hit, tenths: F.when(hit, tenths).otherwise(10)
    return (
        F.when(t == "coding", by(kind == "code", 15) * by(like(text, fixed.SCORE_ERROR), 15) / 100)
        .when(t == "writing", by(kind == "code", 7) * by(like(text, fixed.SCORE_STYLE), 14) * by(F.col("char_len") > 200, 12) / 1000)
        .when(t == "research", by(like(text, fixed.SCORE_CITATION), 15) * by(like(text, r"\d"), 11) / 100)
        .when(t == "planning", by(like(text, fixed.SCORE_TRADEOFF), 14) * by(like(text, fixed.SCORE_DEADLINE), 15) / 100)
        .otherwise(1.0)
    )


def score(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """candidates with tfidf_score, type, score and always_keep. types: (conv_id, type).

    Ranks hang on the last bit of a score: what is a decimal by rule is counted in whole units and divided once, so candidates that
    tie by rule tie in doubles too.
    """
    timed = candidates.withColumn("recency", libm.exp(-3 * (1 - F.col("position"))))
    rows = timed.join(term_scores(candidates), ["conv_id", "ord"]).join(types.select("conv_id", "type"), "conv_id")
    text, kind = F.col("text"), F.col("kind")
    add = lambda hit, x: F.when(hit, x).otherwise(0.0)
    raw = 0.4 * F.col("recency") - F.col("char_len") * 5 / 10000
    for hit, x in (
        ((kind == "question") & (F.col("role") == "user"), 0.3),
        ((kind == "question") & F.col("unanswered"), 0.6),
        (like(text, fixed.SCORE_IMPERATIVE), 0.2),
        (like(text, fixed.SCORE_DECISION), 0.5),
        (like(text, fixed.SCORE_ERROR), 0.4),
        (like(text, fixed.SCORE_FILENAME), 0.3),
        (kind == "code", 0.3),
        (kind == "artifact", 0.8),
    ):
        raw = raw + add(hit, x)
    strong = like(text, fixed.STRONG_DECISION)
    keep = (kind == "artifact") | F.col("last_user") | (F.col("last_assistant") & kind.isin("code", "decision")) | strong
    return rows.select("*", ((raw + 0.2 * F.col("tfidf_score")) * _overlay()).alias("score"), keep.alias("always_keep")).drop("recency")


def rank(scored: DataFrame, budget: float) -> DataFrame:
    """scored with first_pick (kept before all others, within a quarter of the budget) and rank (order in which the rest is tried)."""
    keeps = F.col("always_keep")
    by_score = Window.partitionBy("conv_id", "always_keep").orderBy(F.col("score").desc(), "ord")
    cost = F.sum("char_len").over(by_score.rowsBetween(Window.unboundedPreceding, 0))
    rows = scored.withColumn("breadth", libm.log10((F.col("char_len") + 10).cast("double"))).withColumn("keep_rank", F.when(keeps, F.row_number().over(by_score)))
    rows = rows.withColumn("first_pick", keeps & ((cost <= budget * fixed.ALWAYS_KEEP_SHARE) | (F.col("keep_rank") == 1)))
    efficiency = F.col("score") / F.greatest(F.lit(1.0), F.col("breadth"))
    order = Window.partitionBy("conv_id").orderBy("first_pick", efficiency.desc(), F.coalesce("keep_rank", F.lit(0)), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).drop("breadth")


def select(scored: DataFrame, budget: float) -> DataFrame:
    """The candidates that fit the budget, one row each. The greedy walk is a fold over a conversation's ranked candidates."""
    if budget == float("inf"):
        return scored
    if budget <= 0:
        return scored.limit(0)
    ranked = rank(scored, budget)
    item = F.struct("rank", "ord", "msg_idx", "char_len", "score", "always_keep")
    per = ranked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("first_pick"), item))).alias("rest"),
        F.collect_list(F.when(F.col("first_pick"), item)).alias("first"),
    )
    picks = lambda a, x: F.struct((a["used"] + x["char_len"]).alias("used"), F.array_append(a["told"], x["msg_idx"].cast("int")).alias("told"), F.array_append(a["ords"], x["ord"]).alias("ords"))
    none = F.array().cast("array<int>")
    start = F.aggregate("first", F.struct(F.lit(0).cast("long").alias("used"), none.alias("told"), none.alias("ords")), picks)

    def walk(a: Column, x: Column) -> Column:
        # The penalty counts the picks of the message: the budget bounds their number, whatever the conversation's length.
        left = x["score"] - F.size(F.filter(a["told"], lambda m: m == x["msg_idx"])) * round(100 * fixed.DIVERSITY_PENALTY) / 100
        return F.when((a["used"] + x["char_len"] <= budget) & ((left > 0) | x["always_keep"]), picks(a, x)).otherwise(a)

    picked = per.withColumn("start", start).select("conv_id", F.explode(F.aggregate("rest", F.col("start"), walk)["ords"]).alias("ord"))
    return scored.join(picked, ["conv_id", "ord"])


def dropped_messages(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """(conv_id, dropped_messages): messages with content of which nothing was selected."""
    kept = selected.select("conv_id", "msg_idx").distinct().withColumn("kept", F.lit(True))
    rows = messages.select("conv_id", "msg_idx", F.size("blocks").alias("n")).join(kept, ["conv_id", "msg_idx"], "left")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("kept").isNull() & (F.col("n") > 0)).alias("dropped_messages"))
