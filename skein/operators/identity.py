"""Project identity: terms and bigrams with their spread over messages, project name and line, recent focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as T
from ..functions.regex import extract_all, like, replace
from ..functions.stages import stage
from .messages import with_plain

TOP_TERMS, FOCUS_MESSAGES = 12, 30


def _head(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def message_words(messages: DataFrame, code: bool = True) -> DataFrame:
    """(conv_id, msg_idx, i, gap, word, at_start): the words of text blocks and, with code, of the first lines of code and artifacts.

    Dealt by conversation: counts and windows over them need no other shuffle, and those of names, terms and bigrams share this one.
    """
    rows = with_plain(messages)
    shown = lambda b, plain: F.when(b["type"] == "text", plain).when(b["type"] == "code", _head(b["text"])).when(b["type"] == "artifact", F.concat(b["title"], F.lit(" "), _head(b["text"])))
    text = F.array_join(F.zip_with("blocks", "plains", shown) if code else F.col("plains"), " ")
    return rows.select("conv_id", "msg_idx", F.explode(T.words_in_context(text)).alias("w")).select("conv_id", "msg_idx", "w.i", "w.gap", "w.word", "w.at_start").repartition("conv_id")


def _is_capital(word: Column) -> Column:
    return F.substring(word, 1, 1).between("A", "Z")


def term_counts(words: DataFrame) -> DataFrame:
    """(conv_id, proper, term, count, messages, seen): names and lower-case terms with how often and in how many messages they occur."""
    word, lower = F.col("word"), F.lower("word")
    inside = F.max(~F.col("at_start")).over(Window.partitionBy("conv_id", "msg_idx", "word"))
    rows = words.filter(F.length("word") >= 3).withColumn("inside", inside)
    capital = _is_capital(word) & ~word.isin(fixed.CAPITAL_STOPLIST)
    proper = capital & ((word == F.upper(word)) | ~F.col("at_start") | F.col("inside"))
    common = (F.length("word") >= 4) & ~lower.isin(fixed.COMMON_LOWER)
    plain = common & (capital | (~_is_capital(word) & like(word, r"^[a-z0-9_-]+\z")))
    entries = F.filter(F.array(F.when(proper, F.struct(F.lit(True).alias("proper"), word.alias("term"))), F.when(plain, F.struct(F.lit(False).alias("proper"), lower.alias("term")))), lambda x: x.isNotNull())
    one = rows.select("conv_id", "msg_idx", "i", F.explode(entries).alias("e")).select("conv_id", "msg_idx", "i", "e.proper", "e.term")
    return _spread(one, ["proper", "term"])


def _spread(rows: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """(conv_id, key, count, messages, seen) of rows (conv_id, msg_idx, i, key): counted for each message, then over messages."""
    per = rows.groupBy("conv_id", "msg_idx", *key).agg(F.count("*").alias("n"), F.min("i").alias("i"), *more)
    first = F.struct("msg_idx", "i")
    return per.groupBy("conv_id", *key).agg(F.sum("n").alias("count"), F.count("*").alias("messages"), F.min(first).alias("seen"), *(F.min_by("term", first).alias("term") for _ in more))


def bigram_counts(words: DataFrame) -> DataFrame:
    """(conv_id, term, count, messages, seen): neighbouring words of one sentence; the term is spelled as first seen."""
    order = Window.partitionBy("conv_id", "msg_idx").orderBy("i")
    rows = words.select("conv_id", "msg_idx", "i", F.col("word").alias("a"), F.lead("word").over(order).alias("b"), F.lead("gap").over(order).alias("gap"))
    a, b = F.col("a"), F.col("b")
    fits = (F.length("a") >= 3) & (F.length("b") >= 3) & ~like(F.col("gap"), r"[.!?\n]")
    for w in (a, b):
        fits &= ~F.lower(w).isin(fixed.COMMON_LOWER) & ~w.isin(fixed.CAPITAL_STOPLIST)
    fits &= _is_capital(a) | _is_capital(b) | (like(a, r"^[a-z]+\z") & like(b, r"^[a-z]+\z"))
    pairs = rows.filter(fits).withColumn("pair", F.concat_ws(" ", F.lower(a), F.lower(b)))
    return _spread(pairs, ["pair"], F.min_by(F.concat_ws(" ", a, b), "i").alias("term")).drop("pair")


def all_terms(messages: DataFrame) -> DataFrame:
    """Every name, term and bigram frequent enough: (conv_id, class, term, count, messages, spread, weight, is_proper, seen); class 0 names, 1 terms, 2 bigrams."""
    words = message_words(messages)
    total = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    by = lambda x, y: F.when(F.col("proper"), x).otherwise(y)
    counts = term_counts(words).filter("proper AND count >= 2 AND messages >= 2 OR NOT proper AND count >= 5 AND messages >= 3")
    counts = counts.select("conv_id", by(0, 1).alias("class"), "term", "count", "messages", "seen", by(0.4, 0.3).alias("w0"), by(0.6, 0.5).alias("w1"))
    bigrams = bigram_counts(words).filter("count >= 3 AND messages >= 2").select("conv_id", F.lit(2).alias("class"), "term", "count", "messages", "seen", F.lit(0.5).alias("w0"), F.lit(0.7).alias("w1"))
    spread = F.col("messages") / F.greatest(F.lit(1), F.col("n"))
    out = counts.unionByName(bigrams).join(total, "conv_id").withColumn("spread", spread)
    proper = (F.col("class") == 0) | ((F.col("class") == 2) & _is_capital(F.col("term")))
    return out.select("conv_id", "class", "term", "count", "messages", "spread", (F.col("count") * (F.col("w0") + F.col("w1") * F.col("spread"))).alias("weight"), proper.alias("is_proper"), "seen")


def top_terms(terms: DataFrame) -> DataFrame:
    """The twelve heaviest of all_terms() with their rank from 1."""
    order = Window.partitionBy("conv_id").orderBy(F.col("weight").desc(), "class", "seen")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)


def familiar(messages: DataFrame) -> DataFrame:
    """(conv_id, top): each conversation's heaviest terms in order; conversations without any have no row."""
    return _listed(all_terms(messages))


def _listed(terms: DataFrame) -> DataFrame:
    return top_terms(terms).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top"))


def _project_terms(top: Column, name: Column, most: int = 6) -> Column:
    """Terms in order, none of whose words an earlier one has taken."""

    def step(a: Column, t: Column) -> Column:
        low = F.lower(t)
        words = F.array_union(F.array(low), F.split(low, " "))
        fresh = (F.size(a["out"]) < most) & (low != F.lower(F.coalesce(name, F.lit("")))) & ~F.arrays_overlap(a["used"], words)
        return F.when(fresh, F.struct(F.array_append(a["out"], t).alias("out"), F.array_union(a["used"], words).alias("used"))).otherwise(a)

    none = F.array().cast("array<string>")
    return F.aggregate(top, F.struct(none.alias("out"), none.alias("used")), step)["out"]


def recent_messages(messages: DataFrame, most: int = FOCUS_MESSAGES) -> DataFrame:
    """The last user and assistant messages of each conversation."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy(F.col("msg_idx").desc())
    return spoken.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def section_phrases(recent: DataFrame) -> DataFrame:
    """(conv_id, phrases): what numbered headings of assistant messages name, latest message first."""
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: T.asciiize(b["text"])), "\n\n")
    found = F.flatten(F.array(*(extract_all(F.col("t"), p, 1) for p in fixed.SECTION_HEADERS)))
    clean = F.transform(found, lambda p: replace(F.regexp_replace(T.trim(p), "[*_`]+", ""), r"\s+", " "))
    rows = recent.filter("role = 'assistant'").withColumn("t", text).select("conv_id", "msg_idx", F.filter(clean, lambda p: T.length(p).between(3, 60)).alias("p"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "p")), asc=False).alias("all"))
    return per.select("conv_id", F.flatten(F.transform("all", lambda x: x["p"])).alias("phrases"))


def _focus(phrases: Column, emergent: Column, most: int = 4) -> Column:
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("seen"))

    def phrase(a: Column, p: Column) -> Column:
        norm = T.trim(F.lower(p))
        fresh = (F.size(a["out"]) < most) & (norm != "") & ~F.array_contains(a["seen"], norm)
        return F.when(fresh, F.struct(F.array_append(a["out"], p).alias("out"), F.array_append(a["seen"], norm).alias("seen"))).otherwise(a)

    def term(a: Column, t: Column) -> Column:
        norm = F.lower(t)
        fresh = (F.size(a["out"]) < most) & ~F.exists(a["seen"], lambda s: F.contains(s, norm) | F.contains(norm, s))
        return F.when(fresh, F.struct(F.array_append(a["out"], t).alias("out"), F.array_append(a["seen"], norm).alias("seen"))).otherwise(a)

    return F.aggregate(emergent, F.aggregate(phrases, start, phrase), term)["out"]


def recent_focus(messages: DataFrame, named: DataFrame) -> DataFrame:
    """(conv_id, recent_focus_line, recent_blocks). named: (conv_id, project_name, top ARRAY<string>)."""
    recent = recent_messages(messages)
    size = recent.groupBy("conv_id").agg(F.sum(F.size("blocks")).alias("recent_blocks"), F.count("*").alias("n"))
    counts = term_counts(message_words(recent, code=False)).join(size, "conv_id").filter("proper AND count >= 2 OR NOT proper AND count >= 3 AND messages >= 2")
    spread = F.col("messages") / F.col("n")
    weight = F.col("count") * F.when(F.col("proper"), 0.4 + 0.6 * spread).otherwise(0.3 + 0.5 * spread)
    rows = counts.withColumn("weight", weight).join(named, "conv_id").filter(F.lower("term") != F.lower(F.coalesce("project_name", F.lit(""))))
    lifted = F.col("weight") + F.when(F.array_contains(F.transform(F.slice("top", 1, 5), F.lower), F.lower("term")), 0.0).otherwise(0.5)
    order = F.struct((-lifted).alias("w"), (-F.col("weight")).alias("v"), (~F.col("proper")).alias("c"), "seen", "term")
    emergent = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["term"]).alias("emergent"))
    none = F.array().cast("array<string>")
    both = size.join(section_phrases(recent), "conv_id", "left").join(emergent, "conv_id", "left")
    picked = _focus(F.coalesce("phrases", none), F.coalesce("emergent", none))
    return both.select("conv_id", F.when(F.size(picked) > 0, F.concat(F.array_join(picked, ", "), F.lit("."))).otherwise("").alias("recent_focus_line"), "recent_blocks")


def identity(conversations: DataFrame, messages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per conversation: project_name, top (terms), project_line, confidence, recent_focus_line, recent_blocks."""
    terms = stage(all_terms(messages), "terms") if terms is None else terms
    names = terms.filter("class = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seen", "term", "count", "messages", "spread", "weight"))).alias("names"))
    rows = conversations.select("conv_id", "title").join(names, "conv_id", "left").join(_listed(terms), "conv_id", "left")
    rows = rows.withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
    title = F.filter(extract_all(F.coalesce("title", F.lit("")), r"[A-Z][A-Za-z0-9_-]*"), lambda w: (F.length(w) >= 3) & ~w.isin(fixed.CAPITAL_STOPLIST) & ~like(w, fixed.GENERIC_TITLE_WORDS))
    from_title = F.get(F.filter(F.transform(title, lambda w: F.get(F.filter("names", lambda p: F.lower(p["term"]) == F.lower(w)), F.lit(0))), lambda p: p.isNotNull()), F.lit(0))
    heaviest = F.array_sort(F.transform(F.filter("names", lambda p: p["spread"] >= 0.02), lambda p: F.struct((-p["weight"]).alias("w"), p["seen"].alias("seen"), p.alias("p"))))
    rows = rows.withColumn("name", F.coalesce(from_title, F.get(heaviest, F.lit(0))["p"])).withColumn("project_name", F.col("name")["term"])
    rows = rows.withColumn("beside", _project_terms(F.col("top"), F.col("project_name"))).withColumn("keywords", _project_terms(F.col("top"), F.lit(None).cast("string")))
    line = (
        F.when(F.col("project_name").isNotNull() & (F.size("beside") > 0), F.concat("project_name", F.lit(" - project around "), F.array_join("beside", ", "), F.lit(".")))
        .when(F.size("keywords") > 0, F.concat(F.lit("Project keywords: "), F.array_join("keywords", ", "), F.lit(".")))
        .otherwise("")
    )
    rows = rows.withColumn("project_line", line)
    n, m = F.col("name")["count"], F.col("name")["messages"]
    confidence = F.when(F.col("project_name").isNull() | (F.col("project_line") == ""), "low").when((n >= 10) & (m >= 5), "high").when((n >= 4) & (m >= 3), "medium").otherwise("low")
    rows = rows.select("conv_id", "project_name", "top", "project_line", confidence.alias("confidence"))
    focus = recent_focus(messages, rows.select("conv_id", "project_name", "top"))
    return rows.join(focus, "conv_id", "left").withColumn("recent_focus_line", F.coalesce("recent_focus_line", F.lit(""))).withColumn("recent_blocks", F.coalesce("recent_blocks", F.lit(0)))
