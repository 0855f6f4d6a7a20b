"""Attachments: kinds, names, languages, what a document shows of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T


def classify(filename: Column, mime: Column | None = None) -> Column:
    lower = F.lower(filename)
    ext = F.when(F.contains(lower, F.lit(".")), F.substring_index(lower, ".", -1)).otherwise("")
    base = F.regexp_replace(lower, r"^.*[\\/]", "")
    m = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    has = lambda *xs: F.lit(False) if not xs else F.contains(m, F.lit(xs[0])) if len(xs) == 1 else F.contains(m, F.lit(xs[0])) | has(*xs[1:])
    return (
        F.when(base.isin("dockerfile", "makefile"), "code_file")
        .when(ext == "svg", "image")
        .when(ext.isin(fixed.CODE_EXTENSIONS), "code_file")
        .when(ext.isin(fixed.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(fixed.PDF_EXTENSIONS), "pdf")
        .when(ext.isin(fixed.DOCUMENT_EXTENSIONS), "document")
        .when(F.startswith(m, F.lit("image/")), "image")
        .when(m == "application/pdf", "pdf")
        .when(F.startswith(m, F.lit("text/")) | m.isin("application/json", "application/xml") | has("javascript", "typescript"), "code_file")
        .when(has("word", "excel", "powerpoint", "opendocument"), "document")
        .otherwise("other")
    )


def language(filename: Column) -> Column:
    """The language that a name's last part after a dot stands for; ''."""
    table = F.create_map(*(F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.substring_index(F.lower(filename), ".", -1)), F.lit(""))


def display_name(filename: Column) -> Column:
    return F.regexp_replace(T.trim(F.coalesce(filename, F.lit(""))), r"^\d{10,16}_", "")


def usable_name(filename: Column) -> Column:
    return T.trim(F.coalesce(filename, F.lit(""))) != ""


def label(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.KIND_LABELS.items() for x in kv)), kind)


def inlined(a: Column) -> Column:
    """Whether a document shows the attachment's content."""
    content = F.coalesce(a["inline_content"], F.lit(""))
    return (a["type"] == "code_file") & (content != "") & (F.coalesce(a["size"], F.lit(0)) <= fixed.INLINE_CODE_BYTES) & (T.length(content) <= fixed.INLINE_CODE_BYTES)


def placeholder(a: Column) -> Column:
    name = F.coalesce(F.nullif(display_name(a["filename"]), F.lit("")), F.concat(F.lit("<unnamed "), label(a["type"]), F.lit(">")))
    size = F.when(F.coalesce(a["size"], F.lit(0)) != 0, F.concat(F.lit(", "), T.format_bytes(a["size"]))).otherwise("")
    return F.concat(F.lit("[Attachment: "), name, F.lit(" - "), label(a["type"]), size, F.lit("]"))


def inline_code(a: Column) -> Column:
    cut = T.truncate_lines(a["inline_content"], fixed.INLINE_CODE_LINES)
    more = F.concat(F.lit("\n// ... [truncated, "), (cut["original_lines"] - fixed.INLINE_CODE_LINES).cast("string"), F.lit(" more lines]"))
    name = F.coalesce(F.nullif(display_name(a["filename"]), F.lit("")), F.lit("<unnamed file>"))
    return F.concat(F.lit("**Attached file: `"), name, F.lit("`**\n\n```"), language(a["filename"]), F.lit("\n"), cut["text"], F.when(cut["truncated"], more).otherwise(""), F.lit("\n```"))


