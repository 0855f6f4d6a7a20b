"""Text functions as column expressions. Lengths and cuts count UTF-16 units, orders are those of the text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .regex import WS, count, extract_all, like, replace, spark_pattern

#: Ends a block while lines are put together; the character itself, where a text holds it, is written otherwise meanwhile.
_BREAK, _SIGN, _KEPT = "\u001e1", "\u001e", "\u001e0"


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def length(text: Column) -> Column:
    """UTF-16 units: one for each character, two beyond the basic plane."""
    return let(text, lambda t: F.length(t) + F.regexp_count(t, F.lit("[\\x{10000}-\\x{10FFFF}]")))


def head(text: Column, n: int) -> Column:
    """The first n UTF-16 units; half of a pair is dropped."""
    wide = lambda raw: F.decode(F.substring(raw, 1, 2 * n - 2 * F.hex(F.substring(raw, 2 * n - 1, 1)).between("D8", "DB").cast("int")), "UTF-16BE")
    return let(text, lambda t: F.when(F.length(t) + F.regexp_count(t, F.lit("[\\x{10000}-\\x{10FFFF}]")) == F.length(t), F.substring(t, 1, n)).otherwise(let(F.encode(t, "UTF-16BE"), wide)))


def collapse(text: Column) -> Column:
    return trim(replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    return trim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "))


def blocks(text: Column) -> Column:
    """Paragraphs of a normalised text; each bullet or numbered line is one of its own, without its mark."""

    marked = lambda bare: F.when(bare == "", F.lit(_BREAK)).otherwise(F.regexp_replace(bare, spark_pattern(r"^(?:[-*•]|\d+[.)])\s+(.*)\z"), f"{_BREAK}$1{_BREAK}"))
    line = lambda x: let(trim(x), marked)

    joined = F.array_join(F.transform(F.split(F.replace(text, F.lit(_SIGN), F.lit(_KEPT)), "\n"), line), " ")
    return F.filter(F.transform(F.split(joined, _BREAK), lambda b: F.replace(trim(b), F.lit(_KEPT), F.lit(_SIGN))), lambda x: x != "")


_SENTENCE_END = spark_pattern(r"(?<=[.!?])(?<!(?:^|\s)(?i:" + "|".join(re.escape(a) for a in fixed.ABBREVIATIONS) + r")) (?=[A-Z\"'(\[])")


def sentences(text: Column) -> Column:
    """Sentences in order, none empty."""
    parts = F.flatten(F.transform(blocks(normalize(text)), lambda b: F.split(b, _SENTENCE_END)))
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def tokens_estimate(text: Column) -> Column:
    return F.ceil(length(text) / 4).cast("int")


def lines(text: Column) -> Column:
    return let(text, lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, "\n", -1))))


def truncate_lines(text: Column, most: int) -> Column:
    """STRUCT(text, truncated, original_lines)."""
    cut = lambda parts: F.struct(F.array_join(F.slice(parts, 1, most), "\n").alias("text"), (F.size(parts) > most).alias("truncated"), F.size(parts).alias("original_lines"))
    return let(F.split(text, "\n", -1), cut)


def strip_code_fences(text: Column) -> Column:
    return replace(replace(text, r"^```[\w-]*\n?", ""), r"\n?```\s*\z", "")


def java_hash(text: Column) -> Column:
    """The 32-bit hash of a string's UTF-16 units, base 36."""
    units = lambda raw: F.transform(F.sequence(F.lit(1), (F.octet_length(raw) / 2).cast("int")), lambda i: F.conv(F.hex(F.substring(raw, i * 2 - 1, F.lit(2))), 16, 10).cast("long"))
    folded = lambda raw: F.aggregate(units(raw), F.lit(0).cast("long"), lambda h, u: (h * 31 + u) % (1 << 32))
    return let(F.encode(text, "UTF-16BE"), lambda raw: F.when(F.octet_length(raw) == 0, F.lit("0")).otherwise(F.lower(F.conv(folded(raw).cast("string"), 10, 36))))


def asciiize(text: Column) -> Column:
    one = F.translate(text, "—–―‘’‚‛“”„‟·•", "---''''\"\"\"\"|-")
    for a, b in (("…", "..."), ("→", "->"), ("←", "<-")):
        one = F.replace(one, F.lit(a), F.lit(b))
    return F.regexp_replace(one, "[─-╿]", "-")


#: What each step of strip_markdown removes, in order: fences, headings, images, links, code marks, quotes, bullets, numbers, emphasis.
_MARKDOWN = (
    (r"```[\s\S]*?```", " "),
    (r"(?m)^#{1,6}\s+", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^>\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+[.)]\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"(\s|^)\*+", "$1"),
    (r"\*+(?=\s|\z)", ""),
    (r"(\s|^)_+", "$1"),
    (r"_+(?=\s|\z)", ""),
)


def strip_markdown(text: Column) -> Column:
    for pattern, by in _MARKDOWN:
        text = F.regexp_replace(text, r"```[\x{0}-\x{10FFFF}]*?```", by) if "S" in pattern else replace(text, pattern, by)
    return trim(F.regexp_replace(asciiize(text), "[ \t]+", " "))


def looks_like_header(text: Column) -> Column:
    first = lambda t: F.substring(t, 1, 1)
    return let(trim(text), lambda t: (t != "") & (length(t) <= 80) & ~like(t, r"[.!?]\z") & (first(t) == F.upper(first(t))))


URL = r"https?://\S+"


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(replace(text, URL, " "), "[ \t]+", " ")


def url_ratio(text: Column) -> Column:
    chars = lambda t: F.aggregate(extract_all(t, URL), F.lit(0), lambda a, u: a + length(u))
    return let(text, lambda t: F.coalesce(F.try_divide(chars(t).cast("double"), length(t)), F.lit(0.0)))


def plain(text: Column) -> Column:
    """Without links and markdown."""
    return strip_markdown(strip_urls(text))


def bullet(text: Column) -> Column:
    return replace(collapse(text), r"^[-*]\s*", "")


def cut_words(text: Column, most: int, keep: int) -> Column:
    """Texts longer than most are cut to keep units, lose their last partial word and get dots."""
    return let(text, lambda t: F.when(length(t) <= most, t).otherwise(F.concat(replace(head(t, keep), r"\s\S*\z", ""), F.lit("..."))))


def key(text: Column, n: int = 60) -> Column:
    """What equal items share: letters and digits of the lower-cased text."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, n)


def terms(text: Column) -> Column:
    """Words for term statistics: lower-case ASCII letters and digits, three or more, no stopwords."""
    words = F.split(F.regexp_replace(F.lower(text), f"[^a-z0-9{WS}]", " "), f"[{WS}]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOPWORDS))


def words_in_context(text: Column) -> Column:
    """ARRAY<STRUCT(gap, word, at_start)>: words with what stands before them and whether they begin a sentence."""
    shape = r"([^A-Za-z]*)([A-Za-z][A-Za-z0-9_-]*)"
    both = F.arrays_zip(extract_all(text, shape, 1).alias("gap"), extract_all(text, shape, 2).alias("word"))
    start = lambda x, i: (i == 0) | like(x["gap"], r"[.!?]\s*\z|\n")
    return F.transform(both, lambda x, i: F.struct(x["gap"].alias("gap"), x["word"].alias("word"), start(x, i).alias("at_start"), i.alias("i")))


def slugify(text: Column) -> Column:
    s = replace(trim(F.regexp_replace(F.lower(text), f"[^a-z0-9{WS}-]", "")), r"\s+", "-")
    return F.coalesce(F.nullif(F.substring(s, 1, 60), F.lit("")), F.lit("conversation"))


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def _tenths(n: Column, unit: int, places: int) -> Column:
    """n / unit with places decimals, halves up."""
    ten = 10**places
    scaled = F.floor((n.cast("long") * 2 * ten + unit) / (2 * unit)).cast("long")
    return F.concat((scaled / ten).cast("long").cast("string"), F.lit("."), F.lpad((scaled % ten).cast("string"), places, "0"))


def one_decimal(x: Column) -> Column:
    """x, not negative, with one decimal: the exact value of the double counts, halves go up."""
    rest = ((x - F.floor(x)) * F.lit(float(1 << 56))).cast("long")
    tenths = lambda t: F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))
    return let((F.floor(x) * 10 + F.shiftright(rest * 10 + (1 << 55), 56)).cast("long"), tenths)


def format_bytes(n: Column) -> Column:
    return let(n, lambda n: F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(_tenths(n, 1024, 1), F.lit(" KB"))).otherwise(F.concat(_tenths(n, 1 << 20, 1), F.lit(" MB"))))


def format_chars(n: Column) -> Column:
    return let(n, lambda n: F.when(n < 1024, F.concat(n.cast("string"), F.lit(" chars"))).when(n < 1 << 20, F.concat(_tenths(n, 1024, 1), F.lit(" KB"))).otherwise(F.concat(_tenths(n, 1 << 20, 2), F.lit(" MB"))))


def capitalize_language(name: Column) -> Column:
    up = lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2)))
    return let(F.coalesce(name, F.lit("")), lambda n: F.when(n.isin("", "code"), F.lit("Code")).when(n == F.lower(n), up(n)).otherwise(n))


def first_sentence(text: Column) -> Column:
    found = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^[^.!?\n]{8,180}[.!?]?", 0), F.lit("")), head(c, 120))
    return trim(let(collapse(text), found))


def prose_like(text: Column) -> Column:
    letters = lambda t: F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return let(trim(text), lambda t: (t != "") & ~like(t, fixed.CODE_LIKE_LEAD) & (letters(t) * 2 >= length(t)))


