"""Text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from skein.functions import attachments as A
from skein.functions import text as T
from skein.sources.tables import split_text_and_code


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.x for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]

    return run


def test_sentences(apply):
    got = apply(T.sentences, "One. Two! Three?", "See e.g. The book. Next one.", "Intro\n- first item\n2. second\nmore text here. End", "", "Version 2.3 is out. ok then", "a.b. \"Quoted\" (Paren) x")
    assert got[0] == ["One.", "Two!", "Three?"]
    assert got[1] == ["See e.g. The book.", "Next one."]
    assert got[2] == ["Intro", "first item", "second", "more text here.", "End"]
    assert got[3] == []
    assert got[4] == ["Version 2.3 is out. ok then"]
    assert got[5] == ["a.b.", '"Quoted" (Paren) x']


def test_strip_markdown_keeps_lines_and_orders_steps(apply):
    got = apply(T.strip_markdown, "# Title\n**bold** and `code`\n> quote\n* item\n3. third [link](http://x) ![alt](y)", "snake_case stays, _emph_ goes — really…", "```py\nx\n```after")
    assert got[0] == "Title\nbold and code\nquote\nitem\nthird link alt"
    assert got[1] == "snake_case stays, emph goes - really..."
    assert got[2] == "after"


def test_lengths_count_utf16_units(apply):
    assert apply(T.length, "😀a", "", "é") == [3, 0, 1]
    assert apply(lambda t: T.head(t, 2), "😀ab", "a😀b", "abc") == ["😀", "a", "ab"]


def test_hash_is_that_of_utf16_strings(apply):
    def expected(s):
        h, digits = 0, ""
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) % 2**32
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    texts = ["", "a", "hello world", "😀 naïve", "x" * 200]
    assert apply(T.java_hash, *texts) == [expected(t) for t in texts]


def test_ascii_word_borders_and_unicode_space(apply):
    from skein.functions.regex import like

    assert apply(lambda t: like(t, r"caf\b"), "caféx", "caf x", "cafx") == [True, True, False]
    assert apply(lambda t: like(t, r"a\sb"), "a b", "a b", "a_b") == [True, True, False]
    assert apply(T.collapse, " \ta \n b ") == ["a b"]


def test_measures(apply):
    assert apply(T.looks_like_header, "Setup", "setup", "Done.", "", "123 go", "X" * 81) == [True, False, False, False, True, False]
    assert apply(T.tokens_estimate, "", "abcde") == [0, 2]
    assert apply(T.lines, "", "a", "a\nb\n") == [0, 1, 3]
    assert apply(T.slugify, "Hello, World! 2", "???", " a  b ") == ["hello-world-2", "conversation", "a-b"]
    assert apply(T.url_ratio, "", "https://x.y z") == [0.0, pytest.approx(11 / 13)]
    assert apply(lambda t: T.cut_words(t, 10, 9), "short", "one two three four") == ["short", "one two..."]


def test_fences(apply):
    plain = lambda b: (b["type"], b["language"], b["text"])
    got = apply(split_text_and_code, "before\n```py\nx = 1\n```\nafter", "no code", "```\nopen only", "```js\n```")
    assert [plain(b) for b in got[0]] == [("text", None, "before"), ("code", "py", "x = 1"), ("text", None, "after")]
    assert [plain(b) for b in got[1]] == [("text", None, "no code")]
    assert [plain(b) for b in got[2]] == [("text", None, "```\nopen only")]
    assert [plain(b) for b in got[3]] == [("code", "js", "")]


def test_sizes_and_names(spark):
    rows = spark.createDataFrame([(500,), (1536,), (2_400_000,)], "n long")
    assert [r[0] for r in rows.select(T.format_bytes(F.col("n"))).collect()] == ["500 B", "1.5 KB", "2.3 MB"]
    assert [r[0] for r in rows.select(T.format_chars(F.col("n"))).collect()] == ["500 chars", "1.5 KB", "2.29 MB"]
    names = spark.createDataFrame([("1700000000000_app.tsx",), ("Dockerfile",), ("a.svg",)], "f string")
    got = names.select(A.display_name(F.col("f")).alias("d"), A.classify(F.col("f")).alias("k"), A.language(F.col("f")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("app.tsx", "code_file", "tsx"), ("Dockerfile", "code_file", ""), ("a.svg", "image", "")]


def test_one_decimal_rounds_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    pairs = [(2000, 1137), (1200, 681), (3, 1), (800, 799), (10**6, 10**6 - 1), (2000, 0), *((2000, k) for k in range(1, 2000, 7))]
    ratios = [(n - k) / n * 100 for n, k in pairs]
    got = spark.createDataFrame([(x,) for x in ratios], "x double").select("x", T.one_decimal(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == {x: str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in ratios}
    assert ratios[0] < Decimal("43.15") and got[0].t == "43.1"  # the shortest spelling, 43.15, would go up
