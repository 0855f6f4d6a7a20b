"""Artifacts of a conversation: attached code files, named artifacts, large blocks of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attachments as A
from ..functions import fixed
from ..functions import text as T
from ..functions.regex import extract, like, replace, spark_pattern
from .messages import ordered

LARGE_LINES = 40


def collapse_versions(blocks: DataFrame) -> DataFrame:
    """Blocks less the artifacts of which the conversation has a later version."""
    newest = F.max("version").over(Window.partitionBy("conv_id", "artifact_id"))
    return blocks.withColumn("_v", newest).filter((F.col("type") != "artifact") | (F.col("version") == F.col("_v"))).drop("_v")


def _first(*options: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in options), F.lit(""))


def _lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def top_declaration(content: Column) -> Column:
    head = _lines(content, 30)
    return _first(*(extract(head, p, 1) for p in fixed.DECLARATIONS))


def framework(content: Column) -> Column:
    head, out = _lines(content, 50), F.lit("")
    for pattern, name in reversed(fixed.FRAMEWORKS):
        out = F.when(like(head, pattern), name).otherwise(out)
    return F.when(content == "", "").otherwise(out)


def role_hint(name: Column) -> Column:
    out = F.lit("")
    for pattern, hint in reversed(fixed.ROLE_HINTS):
        out = F.when(like(name, pattern), hint).otherwise(out)
    return out


def leading_comment(content: Column, language: Column) -> Column:
    """The first sentence of the comment that opens a file; ''."""
    clean = lambda t: T.trim(F.regexp_replace(t, spark_pattern(r"(?m)^#\s?"), ""))
    some = lambda t, f: F.nullif(T.let(t, lambda x: F.when(x != "", f(x)).otherwise("")), F.lit(""))
    hashes = lambda body, n: F.regexp_extract(body, rf"^(?:#[^\n]*\n){{1,{n}}}", 0)
    first = T.first_sentence

    def python(body: Column) -> Column:
        docstring = F.regexp_extract(body, spark_pattern(r'^\s*"""') + r'([\x{0}-\x{10FFFF}]+?)"""', 1)
        return F.coalesce(some(docstring, first), some(hashes(body, 5), lambda t: first(clean(t))), F.lit(""))

    def markdown(body: Column) -> Column:
        prose = F.get(F.filter(F.transform(F.split(body, "\n", -1), T.trim), lambda x: (x != "") & ~like(x, r"^#{1,6}\s")), F.lit(0))
        return F.coalesce(first(prose), F.lit(""))

    def other(body: Column) -> Column:
        block = F.regexp_extract(body, spark_pattern(r"^\s*\/\*+") + r"([\x{0}-\x{10FFFF}]+?)\*\/", 1)
        slashes = F.regexp_extract(body, r"^(?:\/\/[^\n]*\n){1,5}", 0)
        return F.coalesce(
            some(block, lambda t: first(T.trim(replace(t, r"(?m)^[\s*]+", "")))),
            some(slashes, lambda t: first(T.trim(replace(t, r"(?m)^\/\/\s?", "")))),
            some(hashes(body, 3), lambda t: T.let(clean(t), lambda c: F.when(T.length(c) > 5, first(c)).otherwise(""))),
            F.lit(""),
        )

    body = F.regexp_replace(content, r"^#!.*\n", "")
    return T.let(body, lambda b: F.when(content == "", "").when(language == "python", python(b)).when(language == "markdown", markdown(b)).otherwise(other(b)))


def describe(name: Column, content: Column, language: Column, loc: Column) -> Column:
    comment = leading_comment(content, language)
    role, frame, declared = role_hint(name), framework(content), top_declaration(content)
    defines = T.let(declared, lambda d: F.when(d != "", F.concat(F.lit("defines `"), d, F.lit("`"))).otherwise(""))
    parts = F.filter(F.array(frame, role, defines), lambda x: x != "")
    cut = lambda t: T.cut_words(T.collapse(t), 110, 107)
    module = F.concat(T.capitalize_language(language), F.lit(" module, "))
    count = F.concat(loc.cast("string"), F.lit(" LOC"))
    named = lambda p: (
        F.when((F.size(p) > 0) & (loc > 0) & (F.size(p) == 1) & F.startswith(F.get(p, F.lit(0)), F.lit("defines `")), cut(F.concat(module, F.array_join(p, " "), F.lit(", "), count)))
        .when(F.size(p) > 0, cut(F.array_join(p, " ")))
        .when(loc > 0, F.concat(module, count))
        .otherwise(T.capitalize_language(language))
    )
    return T.let(comment, lambda c: F.when((c != "") & T.prose_like(c), cut(T.strip_urls(c))).otherwise(T.let(parts, named)))


def _large_code(messages: DataFrame) -> DataFrame:
    """Code blocks of 40 lines or more after the first message, named after a file that the user message before them mentions, a symbol, or their place."""
    said = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: extract(b["text"], fixed.FILE_MENTION, 1)), "\n")
    mentioned = F.regexp_extract(said, r"[^\n]+", 0)
    rows = messages.select("conv_id", "msg_idx", "role", "blocks", mentioned.alias("mentioned"))
    rows = rows.withColumn("before", F.when(F.lag("role").over(ordered()) == "user", F.lag("mentioned").over(ordered())))
    code = rows.select("conv_id", "msg_idx", "before", F.posexplode("blocks").alias("i", "b")).filter((F.col("b.type") == "code") & (F.col("msg_idx") > 0) & (F.size(F.split("b.text", "\n", -1)) >= LARGE_LINES))
    symbol = top_declaration(F.col("b.text"))
    place = F.concat(F.lit("inline "), F.coalesce("b.language", F.lit("code")), F.lit(" #"), F.col("msg_idx").cast("string"))
    name = _first(F.coalesce("before", F.lit("")), F.when(symbol != "", F.concat(symbol, F.lit("()"))).otherwise(""), place)
    return code.select("conv_id", "msg_idx", F.lit(2).alias("part"), "i", F.lit("inline-code").alias("source"), name.alias("name"), F.col("b.text").alias("content"), F.lit(None).cast("bigint").alias("size"))


def summarize(messages: DataFrame) -> DataFrame:
    """(conv_id, ord, source, display_name, description, language, loc, char_len, inline_content, anonymous): each artifact once, as first seen."""
    files = messages.select("conv_id", "msg_idx", F.posexplode("attachments").alias("i", "a")).filter("a.type = 'code_file'")
    files = files.select("conv_id", "msg_idx", F.lit(0).alias("part"), "i", F.lit("attachment").alias("source"), A.display_name(F.col("a.filename")).alias("name"), F.coalesce("a.inline_content", F.lit("")).alias("content"), F.col("a.size").alias("size")).filter("name <> ''")
    named = messages.select("conv_id", "msg_idx", F.posexplode("blocks").alias("i", "b")).filter("b.type = 'artifact'")
    named = named.select("conv_id", "msg_idx", F.lit(1).alias("part"), "i", F.lit("claude-artifact").alias("source"), F.coalesce(F.nullif("b.title", F.lit("")), F.lit("artifact")).alias("name"), F.col("b.text").alias("content"), F.lit(None).cast("bigint").alias("size"))
    rows = files.unionByName(named).unionByName(_large_code(messages))
    order = [(F.col("part") == 2).cast("int"), "msg_idx", "part", "i"]
    first = F.row_number().over(Window.partitionBy("conv_id", "source", "name").orderBy(*order))
    rows = rows.withColumn("_f", first).filter("_f = 1")
    language = F.coalesce(F.nullif(A.language(F.col("name")), F.lit("")), F.lit("code"))
    loc = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n", -1)))
    rows = rows.withColumn("language", language).withColumn("loc", loc)
    return rows.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("ord"),
        "source",
        F.col("name").alias("display_name"),
        describe(F.col("name"), F.col("content"), F.col("language"), F.col("loc")).alias("description"),
        "language",
        "loc",
        F.coalesce("size", T.length(F.col("content")).cast("bigint")).alias("char_len"),
        F.nullif("content", F.lit("")).alias("inline_content"),
        ((F.col("source") == "inline-code") & like(F.col("name"), fixed.ANONYMOUS_INLINE)).alias("anonymous"),
    )


def section(summaries: DataFrame) -> DataFrame:
    """(conv_id, artifacts_section): one or two small artifacts whole, else a list within 1,500 units and a count of nameless blocks by language."""
    line = F.concat(F.lit("- `"), F.col("display_name"), F.lit("` - "), F.col("description"))
    rows = summaries.withColumn("line", line)
    named = Window.partitionBy("conv_id", "anonymous").orderBy("ord")
    rows = rows.withColumn("cost", F.sum(T.length(F.col("line"))).over(named.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.when(F.col("inline_content").isNotNull(), F.concat(F.col("line"), F.lit("\n\n```"), F.col("language"), F.lit("\n"), F.col("inline_content"), F.lit("\n```"))).otherwise(F.col("line"))
    fits = ~F.col("anonymous") & (F.col("cost") <= fixed.ARTIFACTS_BUDGET)
    per = rows.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.sum(T.length(F.coalesce("inline_content", F.lit("")))).alias("inline"),
        F.array_sort(F.collect_list(F.struct("ord", whole.alias("t")))).alias("all"),
        F.array_sort(F.collect_list(F.when(fits, F.struct("ord", F.col("line").alias("t"))))).alias("listed"),
        F.count_if(~F.col("anonymous")).alias("named"),
        F.count_if("anonymous").alias("nameless"),
    )
    kinds = rows.filter("anonymous").groupBy("conv_id", "language").agg(F.count("*").alias("k"), F.min("ord").alias("o"))
    told = kinds.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), "o", F.concat(T.capitalize_language(F.col("language")), F.lit(" ×"), F.col("k").cast("string")).alias("t")))).alias("kinds"))
    per = per.join(told, "conv_id", "left")
    join = lambda name, glue: F.array_join(F.transform(name, lambda x: x["t"]), glue)
    missing = F.col("named") - F.size("listed")
    more = F.when(missing > 0, F.concat(F.lit("- *("), missing.cast("string"), F.lit(" more named artifact"), F.when(missing == 1, "").otherwise("s"), F.lit(" not listed)*")))
    rest = F.when(F.col("nameless") > 0, F.concat(F.lit("- Plus "), F.col("nameless").cast("string"), F.lit(" inline code block"), F.when(F.col("nameless") == 1, "").otherwise("s"), F.lit(" ("), join("kinds", ", "), F.lit(")")))
    listed = F.array_join(F.array(F.nullif(join("listed", "\n"), F.lit("")), more, rest), "\n")
    small = (F.col("n") <= 2) & (F.col("inline") < fixed.INLINE_ALL_BELOW)
    return per.select("conv_id", F.concat(F.lit("## Code artifacts in this conversation\n"), F.when(small, join("all", "\n")).otherwise(listed)).alias("artifacts_section"))
