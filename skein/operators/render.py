"""Documents: sections as columns, one row per conversation, put together twice since a document tells its own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attachments as A
from ..functions import fixed
from ..functions import text as T
from ..functions.regex import like
from ..functions.stages import stage, stage_all
from ..sources.tables import Corpus
from . import artifacts, decisions, identity, recency
from .messages import input_chars
from .textrank import summary_column

LABEL = "Skein"


def _joined(parts: list[Column], glue: str = "\n\n") -> Column:
    return F.array_join(F.array(*(F.nullif(p, F.lit("")) for p in parts)), glue)


def _texts(blocks: str | Column, glue: str) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), glue)


def _ends(messages: DataFrame) -> DataFrame:
    """(conv_id, first_said, last_said): the text of the first and the last user message."""
    user = F.when(F.col("role") == "user", F.col("msg_idx"))
    rows = messages.withColumn("t", _texts("blocks", " "))
    return rows.groupBy("conv_id").agg(F.min_by("t", user).alias("first_said"), F.max_by("t", user).alias("last_said"))


def goal(first_user: Column) -> Column:
    told = lambda s: F.when(F.size(s) == 1, F.concat(F.lit("## Goal\n"), F.get(s, F.lit(0)))).when(F.size(s) == 2, F.concat(F.lit("## Goal\n- "), F.array_join(s, "\n- "))).otherwise("")
    return T.let(F.slice(T.sentences(T.collapse(F.coalesce(first_user, F.lit("")))), 1, 2), told)


def next_lines(last_user: Column) -> Column:
    lead = lambda t: T.let(F.slice(T.sentences(t), 1, 2), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(T.head(t, 300)))
    return T.let(T.trim(F.coalesce(last_user, F.lit(""))), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("## Next steps\n"), lead(t))))


def _bullets(rows: DataFrame, head: str, name: str, cap: int, distinct: bool) -> DataFrame:
    """(conv_id, name): the texts of rows as bullets in order, cap at most; distinct drops those whose first 80 characters came before."""
    rows = rows.withColumn("line", T.bullet(F.col("text"))).withColumn("key", F.substring(F.lower("line"), 1, 80))
    if distinct:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("ord"))).filter("_d = 1")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy("ord"))).filter(F.col("_k") <= cap)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    return rows.groupBy("conv_id").agg(F.concat(F.lit(f"## {head}\n"), F.array_join(lines, "\n")).alias(name))


def selected_sections(selected: DataFrame, ends: DataFrame) -> DataFrame:
    """Sections made of selected candidates: decisions, questions, findings, tradeoffs, style notes, draft."""
    text, kind, role = F.col("text"), F.col("kind"), F.col("role")
    said = ~kind.isin("code", "artifact") & (T.length(T.trim(text)) >= 25)
    decided = (kind == "decision") | like(T.trim(text), fixed.RECOMMENDATION) | ((role == "assistant") & like(T.trim(text), fixed.IMPERATIVE_LEAD))
    asked = selected.filter((kind == "question") & (role == "user") & F.col("unanswered")).join(ends.select("conv_id", "last_said"), "conv_id")
    asked = asked.filter(F.substring(F.lower(T.bullet(text)), 1, 80) != F.substring(F.lower(T.bullet(F.coalesce("last_said", F.lit("")))), 1, 80))
    sentence = kind == "sentence"
    drafts = selected.filter((role == "assistant") & sentence).groupBy("conv_id").agg(F.max("msg_idx").alias("msg_idx"))
    latest = selected.join(drafts, ["conv_id", "msg_idx"]).filter(kind != "code")
    draft = latest.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "ord", "text"))), lambda x: x["text"]), " ").alias("t"))
    parts = {
        "key_decisions": _bullets(selected.filter(said & decided), "Key decisions", "key_decisions", 8, True),
        "questions": _bullets(asked, "Open questions", "questions", 5, True),
        "findings": _bullets(selected.filter(sentence & (role == "assistant") & (like(text, fixed.SECTION_CITATION) | like(text, r"\d"))), "Findings", "findings", 10, False),
        "tradeoffs": _bullets(selected.filter(sentence & like(text, fixed.SECTION_TRADEOFF)), "Tradeoffs", "tradeoffs", 6, False),
        "style_notes": _bullets(selected.filter(sentence & like(text, fixed.SECTION_STYLE)), "Style notes", "style_notes", 5, False),
        "draft": draft.filter(T.trim(F.col("t")) != "").select("conv_id", F.concat(F.lit("## Current draft\n"), "t").alias("draft")),
    }
    out = selected.select("conv_id").distinct()
    for part in stage_all(parts).values():
        out = out.join(part, "conv_id", "left")
    return out


def attachment_summary(messages: DataFrame) -> DataFrame:
    """(conv_id, attachment_summary): code files shown, the others named."""
    rows = messages.select("conv_id", "msg_idx", F.posexplode("attachments").alias("i", "a"))
    shown = A.inlined(F.col("a"))
    item = lambda hit, t: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("msg_idx", "i", t.alias("t"))))), lambda x: x["t"])
    per = rows.groupBy("conv_id").agg(item(shown, A.inline_code(F.col("a"))).alias("code"), item(~shown, F.concat(F.lit("- "), A.placeholder(F.col("a")))).alias("refs"))
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("## Attachments\n"), F.array_join("refs", "\n"))).otherwise("")
    return per.select("conv_id", _joined([F.array_join("code", "\n\n"), refs]).alias("attachment_summary"))


def full_body(messages: DataFrame) -> DataFrame:
    """(conv_id, body): all messages in full."""

    def shown(b: Column) -> Column:
        fence = F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```"))
        return F.when(b["type"] == "text", b["text"]).when(b["type"] == "code", fence).when(b["type"] == "artifact", F.concat(F.lit("**Artifact: "), b["title"], F.lit("**\n\n"), fence))

    head = F.when(F.col("role") == "user", "### User").when(F.col("role") == "assistant", "### Assistant").otherwise(F.concat(F.lit("### "), "role"))
    files = F.transform("attachments", lambda a: F.when(A.inlined(a), A.inline_code(a)).otherwise(A.placeholder(a)))
    rows = messages.select("conv_id", "msg_idx", F.array_join(F.concat(F.array(head), F.transform("blocks", shown), files), "\n\n").alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "t"))), lambda x: x["t"]), "\n\n").alias("body"))


def handoff_sections(corpus: Corpus) -> DataFrame:
    """Sections of coding and mixed documents: title, about, state, decisions, artifacts, open ends, counts."""
    m = corpus.messages
    who = stage(identity.identity(corpus.conversations, m), "identity")
    state = recency.snippets(m, who).filter("text <> ''")
    line = F.concat(F.when(F.col("role") == "user", "**You:** ").otherwise("**Assistant:** "), "text")
    state = state.groupBy("conv_id").agg(F.concat(F.lit("## Current state\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("t")))), lambda x: x["t"]), "\n\n")).alias("state"))
    decided = decisions.extract(m, who).select("conv_id", F.array_join(F.transform("decisions", lambda d: F.concat(F.lit("- "), T.cut_words(T.collapse(d["text"]), 200, 197))), "\n").alias("decided"))
    listed = lambda rows, key: rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("t"))
    asked = listed(recency.open_questions(m), ["ord"]).withColumnRenamed("t", "asked")
    steps = listed(recency.next_steps(m), ["position", F.col("msg_idx"), "i"]).withColumnRenamed("t", "steps")
    plan = recency.structured_plan(m).select("conv_id", F.array_join(F.transform("plan", lambda p: F.concat(F.lit("- "), F.when(p["label"].isNotNull(), F.concat(F.lit("**"), p["label"], F.lit(":** "))).otherwise(""), p["text"])), "\n").alias("plan"))
    made = artifacts.section(artifacts.summarize(m))
    named = F.filter("attachments", lambda a: A.usable_name(a["filename"]))
    kinds = lambda *k: F.sum(F.size(F.filter(named, lambda a: a["type"].isin(*k))))
    counts = m.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("created_at").alias("since"), F.max("created_at").alias("until"), kinds("image").alias("images"), kinds("pdf", "document").alias("documents"), kinds("code_file").alias("code_files"))
    out = who
    for part in stage_all({"state": state, "decided": decided, "asked": asked, "steps": steps, "plan": plan, "made": made, "counts": counts}).values():
        out = out.join(part, "conv_id", "left")
    return out


def _verb(inp: Column, out: Column) -> Column:
    return F.concat(F.when(out <= inp, "Compressed ").otherwise("Restructured "), T.thousands(inp), F.lit(" -> "), T.thousands(out), F.lit(" chars"))


def _meta_line(inp: Column, out: Column) -> Column:
    return F.concat(F.lit("**Source:** "), "source", F.lit(" | **Type:** "), "type", F.lit(" | **"), _verb(inp, out), F.lit("**"))


def _plural(n: str, what: str) -> Column:
    return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what}"), F.when(F.col(n) == 1, "").otherwise("s")))


def _metadata(inp: Column, out: Column) -> Column:
    ratio = F.when(inp > 0, (inp - out) / inp * 100).otherwise(0.0)
    told = T.one_decimal(ratio)
    size = F.concat(T.format_chars(inp), F.lit(" -> "), T.format_chars(out), F.when(ratio > 90, F.concat(F.lit(" ("), told, F.lit("% compression - significant detail loss expected)"))).when(ratio > 0, F.concat(F.lit(" ("), told, F.lit("% compression)"))).otherwise(""))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    dates = F.when(F.col("since").isNotNull(), F.concat(day("since"), F.lit(" -> "), day("until")))
    first = F.concat(F.lit("- "), F.array_join(F.array(F.concat(F.col("n_messages").cast("string"), F.lit(" messages")), dates, size), " | "))
    files = F.array_join(F.array(_plural("images", "image"), _plural("documents", "document"), _plural("code_files", "code file")), ", ")
    lost = F.when(files != "", F.concat(F.lit("- Attachments: "), files, F.lit(" (not transferred verbatim)")))
    return F.array_join(F.array(F.lit("## Conversation metadata"), first, lost, F.concat(F.lit("- Source: "), F.when(F.col("source") == "chatgpt", "ChatGPT").otherwise("Claude"))), "\n")


def _open_ends() -> Column:
    steps = F.coalesce("plan", "steps")
    some = F.coalesce("asked", steps).isNotNull()
    lines = F.array(F.lit("## Open questions / Next steps"), F.when(~some, "\n*Not explicitly stated in recent messages.*"), F.concat(F.lit("\n**Open questions:**\n"), "asked"), F.concat(F.lit("\n**Next steps:**\n"), steps))
    return F.array_join(lines, "\n")



def render(corpus: Corpus, types: DataFrame, selected: DataFrame | None, level: str, label: str = LABEL) -> DataFrame:
    """(conv_id, type, input_chars, markdown). selected is needed for level resume alone."""
    m = corpus.messages
    rows = corpus.conversations.join(types.select("conv_id", "type"), "conv_id").join(input_chars(m), "conv_id", "left").withColumn("input_chars", F.coalesce("input_chars", F.lit(0)))
    title = F.nullif(T.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    foot = F.lit(f"---\n*Generated by {label}.*")
    if level == "full":
        rows = rows.join(full_body(m), "conv_id", "left")
        head = F.concat(F.lit("# "), F.coalesce(title, F.lit("Conversation")), F.lit("\n\n**Source:** "), "source", F.lit("\n"))
        system = F.concat(F.lit("## System\n"), F.nullif("system_prompt", F.lit("")))

        def document(out: Column) -> Column:
            end = F.concat(F.lit(f"---\n*Generated by {label}. Compressed "), T.thousands(F.col("input_chars")), F.lit(" -> "), T.thousands(out), F.lit(" chars.*"))
            return F.concat(F.array_join(F.array(head, system, "body", end), "\n\n"), F.lit("\n"))

        return _twice(rows, document)
    ends = _ends(m)
    ends = stage(ends, "ends")
    rows = rows.join(ends, "conv_id", "left")
    context = F.when(T.length(F.col("system_prompt")) >= 60, F.concat(F.lit("## Context\n"), F.col("context"))).otherwise("")
    rows = rows.withColumn("context", summary_column(F.coalesce("system_prompt", F.lit("")), 400)).withColumn("context", context).withColumn("goal", goal(F.col("first_said"))).withColumn("next", next_lines(F.col("last_said")))
    header = lambda out: F.concat(F.lit("# "), F.coalesce(title, F.lit("Conversation Handoff")), F.lit("\n\n"), _meta_line(F.col("input_chars"), out))
    if level == "tldr":
        return _twice(rows, lambda out: F.concat(_joined([header(out), F.col("context"), F.col("goal"), F.col("next"), foot]), F.lit("\n")))
    parts = stage_all({"heads": rows, "selected-sections": selected_sections(selected, ends), "attachments": attachment_summary(m), "handoff": handoff_sections(corpus)})
    rows, *others = parts.values()
    for part in others:
        rows = rows.join(part, "conv_id", "left")
    rows = stage(rows, "sections")
    known = F.col("confidence") != "low"
    about = _joined([F.when(known & (F.col("project_line") != ""), F.concat(F.lit("**Project:** "), "project_line")), F.when((F.col("recent_focus_line") != "") & (F.col("recent_blocks") >= 30), F.concat(F.lit("**Recent focus:** "), "recent_focus_line"))], "\n")
    name = F.concat(F.lit("# "), F.coalesce(title, F.when(known, F.col("project_name")), F.lit("Conversation Handoff")))
    decided = F.coalesce(F.concat(F.lit("## Key decisions made\n"), "decided"), F.lit("## Key decisions made\n\n*No decisions explicitly stated in this conversation.*"))
    middle = {
        "writing": ["style_notes", "draft", "key_decisions", "questions"],
        "research": ["findings", "questions"],
        "planning": ["key_decisions", "tradeoffs", "questions"],
    }

    def document(out: Column) -> Column:
        handoff = _joined([name, _meta_line(F.col("input_chars"), out), about, F.col("state"), decided, F.col("artifacts_section"), _open_ends(), _metadata(F.col("input_chars"), out), foot])
        told = handoff
        for kind, names in middle.items():
            told = F.when(F.col("type") == kind, _joined([header(out), F.col("context"), F.col("goal"), *(F.col(n) for n in names), F.col("next"), F.col("attachment_summary"), foot])).otherwise(told)
        return F.concat(told, F.lit("\n"))

    return _twice(rows, document)


def _twice(rows: DataFrame, document) -> DataFrame:
    first = stage(rows.withColumn("_out", T.length(document(F.lit(0)))), "drafts")
    return first.select("conv_id", "type", "input_chars", document(F.col("_out")).alias("markdown"))
