"""The end of a conversation: snippets of recent messages, next steps, plans, open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as T
from ..functions.regex import extract, extract_all, like
from .identity import recent_messages
from .messages import whole, plain_text, with_context, with_plain

NEXT_STEP_MESSAGES, QUESTION_MESSAGES, CAP, PLAN_CAP, PLAN_LINES = 10, 20, 5, 6, 29


def snippets(messages: DataFrame, identity: DataFrame, budget: int = fixed.STATE_BUDGET) -> DataFrame:
    """(conv_id, msg_idx, role, text, had_code): the recent messages in a few sentences each, as many from the end as the budget holds, two at least."""
    known = F.transform(F.coalesce("top", F.array().cast("array<string>")), F.lower)
    rows = plain_text(recent_messages(messages)).join(identity.select("conv_id", "top"), "conv_id", "left")
    rows = rows.select("conv_id", "msg_idx", "role", F.exists("blocks", lambda b: b["type"].isin("code", "artifact")).alias("had_code"), T.collapse(F.col("plain")).alias("all"), known.alias("known"))
    rows = rows.withColumn("s", F.filter(T.sentences(F.col("all")), lambda x: ~T.looks_like_header(x)))
    s, n = F.col("s"), F.size("s")
    user = F.when((n <= 3) | (F.get(s, n - 1) == F.get(s, F.lit(1))), F.when(n <= 3, s).otherwise(F.slice(s, 1, 2))).otherwise(F.concat(F.slice(s, 1, 2), F.slice(s, -1, 1)))
    telling = F.filter(F.slice(s, F.lit(3), F.size(s)), lambda x: F.exists("known", lambda t: F.contains(F.lower(x), t)))
    picked = F.when(F.col("role") == "user", user).otherwise(F.slice(F.concat(F.slice(s, 1, 2), telling), 1, 4))
    body = F.concat(F.array_join(picked, " "), F.when(F.col("had_code"), " [+ code, see artifacts]").otherwise(""))
    text = F.when(F.col("all") == "", F.when(F.col("had_code"), "[code only - see artifacts]").otherwise("")).when(n == 0, T.cut_words(F.col("all"), 240, 239)).otherwise(T.cut_words(body, 400, 399))
    out = rows.select("conv_id", "msg_idx", "role", text.alias("text"), "had_code")
    return suffix_budget(out, T.length(F.col("text")) + 20, budget)


def suffix_budget(rows: DataFrame, cost: Column, budget: int, least: int = 2) -> DataFrame:
    """The longest suffix of each conversation's rows whose costs fit the budget, least rows at any rate."""
    back = Window.partitionBy("conv_id").orderBy(F.col("msg_idx").desc())
    marked = rows.withColumn("_c", F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(back))
    return marked.filter((F.col("_c") <= budget) | (F.col("_r") <= least)).drop("_c", "_r")


def next_steps(messages: DataFrame, scan: int = NEXT_STEP_MESSAGES, cap: int = CAP) -> DataFrame:
    """(conv_id, position, msg_idx, i, text): the last distinct next steps that users name, in order."""
    n = messages.withColumn("n", F.count("*").over(whole()))
    order = Window.partitionBy("conv_id").orderBy(F.col("msg_idx").desc())
    users = n.filter("role = 'user'").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= scan)
    rows = plain_text(users).select("conv_id", "msg_idx", (F.col("msg_idx") / F.greatest(F.lit(1), F.col("n") - 1)).alias("position"), F.posexplode(T.sentences(F.col("plain"))).alias("i", "text"))
    s = F.col("text")
    rows = rows.filter(T.length(s).between(12, 240) & ~T.looks_like_header(s) & like(s, fixed.NEXT_STEP)).withColumn("key", T.key(s))
    late = [F.col("msg_idx").desc(), F.col("i")]
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(*late))).filter("_d = 1")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy(*late))).filter(F.col("_k") <= cap)
    return rows.select("conv_id", "position", "msg_idx", "i", "text")


def open_questions(messages: DataFrame, lookback: int = QUESTION_MESSAGES, cap: int = CAP) -> DataFrame:
    """(conv_id, ord, text): the first distinct questions of recent user messages that no assistant followed."""
    rows = with_context(with_plain(messages)).filter((F.col("n_messages") - F.col("msg_idx") <= lookback) & F.col("unanswered"))
    per = rows.select("conv_id", "msg_idx", F.posexplode("plains").alias("block_idx", "plain")).filter("plain IS NOT NULL")
    said = per.select("conv_id", "msg_idx", "block_idx", F.posexplode(T.sentences(F.col("plain"))).alias("i", "text"))
    s = F.col("text")
    said = said.filter(F.endswith(s, F.lit("?")) & T.length(s).between(12, 240)).withColumn("key", T.key(s))
    order = ["msg_idx", "block_idx", "i"]
    said = said.withColumn("_d", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(*order))).filter("_d = 1")
    return said.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).filter(F.col("ord") <= cap).select("conv_id", "ord", "text")


def _item(text: Column) -> Column:
    return T.cut_words(T.trim(F.regexp_replace(T.collapse(text), r"[*_`]+\z", "")), 140, 137)


def _entry(label: Column, text: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), text.alias("text"))


def _long_enough(items: Column) -> Column:
    return F.filter(items, lambda x: T.length(x["text"]) >= 4)


def _parts(text: Column) -> Column:
    kind, number, rest = (extract_all(text, fixed.PART_HEADER, g) for g in (1, 2, 3))
    name = lambda k: F.when(F.upper(k) == "PART", "PART").otherwise(F.initcap(k))
    zipped = F.arrays_zip(kind.alias("k"), number.alias("n"), rest.alias("t"))
    return _long_enough(F.transform(zipped, lambda x: _entry(F.concat(name(x["k"]), F.lit(" "), x["n"]), _item(x["t"]))))


def _list_after(lines: Column, is_head) -> Column:
    """Numbered lines that follow the first line for which is_head holds; another line ends them, and so do two blank ones."""
    at = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())), F.lit(-1))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("blank"), F.lit(False).alias("over"))

    def item(t: Column) -> Column:
        return F.when(like(t, fixed.NUMBERED_ITEM), _item(extract(t, fixed.NUMBERED_ITEM, 2)))

    def step(a: Column, raw: Column) -> Column:
        some = F.size(a["out"]) > 0
        blank = F.struct(a["out"].alias("out"), (a["blank"] + 1).alias("blank"), ((a["blank"] >= 1) & some).alias("over"))
        other = F.struct(a["out"].alias("out"), F.lit(0).alias("blank"), some.alias("over"))
        numbered = lambda x: F.struct(F.when(T.length(x) >= 4, F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"), F.lit(0).alias("blank"), F.lit(False).alias("over"))
        return T.let(T.trim(raw), lambda t: F.when(a["over"], a).when(t == "", blank).otherwise(T.let(item(t), lambda x: F.when(x.isNotNull(), numbered(x)).otherwise(other))))

    found = F.aggregate(F.slice(lines, at + 2, F.lit(PLAN_LINES)), start, step)["out"]
    return F.transform(F.when(at >= 0, found).otherwise(F.array().cast("array<string>")), lambda t: _entry(F.lit(None), t))


def structured_plan(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_idx, plan ARRAY<STRUCT(label, text)>): from the newest recent message that holds a plan of two items or more."""
    rows = plain_text(recent_messages(messages), "\n\n").select("conv_id", "msg_idx", "plain", F.split("plain", "\n", -1).alias("lines"))
    plain, lines = F.col("plain"), F.col("lines")
    numbered = F.filter(lines, lambda x: like(x, fixed.NUMBERED_ITEM))
    numbered = _long_enough(F.transform(numbered, lambda x: _entry(F.lit(None), _item(extract(x, fixed.NUMBERED_ITEM, 2)))))
    rows = rows.withColumn("a", _parts(plain)).withColumn("b", _list_after(lines, lambda x: like(T.trim(x), fixed.ANCHORED_HEADER))).withColumn("c", _list_after(lines, lambda x: like(x, fixed.N_THINGS_INTRO))).withColumn("d", numbered)
    plan = F.when(F.size("a") >= 2, F.col("a")).when(F.size("b") >= 2, F.col("b")).when(F.size("c") >= 2, F.col("c")).when(F.size("d") >= 3, F.col("d"))
    best = rows.withColumn("plan", plan).filter("plan IS NOT NULL").groupBy("conv_id").agg(F.max("msg_idx").alias("msg_idx"), F.max_by("plan", "msg_idx").alias("plan"))
    return best.select("conv_id", "msg_idx", F.slice("plan", 1, PLAN_CAP).alias("plan"))
