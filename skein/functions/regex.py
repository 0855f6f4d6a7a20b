"""Patterns as columns: ASCII word borders and Unicode white space for Spark's engine, whose own are the other way round."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, to stand inside a character class.
WS = r"\t-\r    -     　﻿"
_WORD = "[A-Za-z0-9_]"
_BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


@cache
def spark_pattern(pattern: str) -> str:
    """The pattern with its \\b, \\s and \\S spelled out."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(WS if inside else f"[{WS}]")
        elif two == r"\S":
            out.append(f"[^{WS}]")
        elif two == r"\b":
            out.append(_BORDER)
        elif two[0] == "\\":
            out.append(two)
        else:
            c = two[0]
            inside = c == "[" or inside and c != "]"
            out.append(r"\[" if c == "[" and out and inside and pattern[at - 1 : at] != "\\" and _open_class(pattern, at) else c)
            at -= 1
        at += 2
    return "".join(out)


def _open_class(pattern: str, at: int) -> bool:
    """Whether place at lies inside a character class already, where Spark's engine needs a bracket escaped."""
    inside, k = False, 0
    while k < at:
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[":
            inside = True
        elif pattern[k] == "]":
            inside = False
        k += 1
    return inside


def lit(pattern: str) -> Column:
    return F.lit(spark_pattern(pattern))


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, lit(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, lit(pattern))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, lit(pattern), F.lit(by))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; '' without one."""
    return F.regexp_extract(text, spark_pattern(pattern), group)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, lit(pattern), F.lit(group))
