"""Share links and share pages: link forms, the page's payload, the conversation in it.

Fetching pages is left to the caller; ERROR_CODES names what it may meet. A payload is a flat array whose objects and lists refer to
other places by number; following the references is a walk that column expressions do not hold, so that part is a function over
Arrow batches. It keeps a stack of its own and each place's value, and gives up (null) where a payload stands for more than
MOST_VALUES values or nests deeper than JSON readers go.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed
from ..functions import text as T
from ..functions.regex import like

ERROR_CODES = ("INVALID_URL", "NOT_FOUND_OR_PRIVATE", "UPSTREAM_BLOCKED", "FETCH_FAILED", "TIMED_OUT", "FORMAT_CHANGED", "INTERNAL")
#: How deep the search for a conversation goes.
DEPTH = 10
#: Values that a payload may stand for, references followed.
MOST_VALUES = 5_000_000


def _parts(url: Column) -> tuple[Column, Column]:
    """(host, segments of the path) of a link; null host for what is none."""
    u = T.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    return host, F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")


def share_id(url: Column) -> Column:
    """The id of a share link; null for other links."""
    host, path = _parts(url)
    found = F.get(path, F.lit(1))
    return F.when(host.isin(*fixed.CHATGPT_HOSTS) & (F.get(path, F.lit(0)) == "share") & like(found, fixed.SHARE_ID), found)


def canonical_url(url: Column) -> Column:
    return F.concat(F.lit(f"https://{fixed.CHATGPT_HOSTS[0]}/share/"), share_id(url))


def platform(url: Column) -> Column:
    """'chatgpt', 'claude' or 'unsupported'."""
    host, path = _parts(url)
    shared = (F.get(path, F.lit(0)) == "share") & F.get(path, F.lit(1)).isNotNull()
    return F.when(host.isin(*fixed.CHATGPT_HOSTS) & shared, "chatgpt").when(host.isin(*fixed.CLAUDE_HOSTS) & shared, "claude").otherwise("unsupported")


def error_code(status: Column) -> Column:
    """What an answer's status means for the caller; null for 2xx."""
    return F.when(status == 404, "NOT_FOUND_OR_PRIVATE").when(status.isin(403, 429), "UPSTREAM_BLOCKED").when((status < 200) | (status >= 300), "FETCH_FAILED")


def payload(html: Column) -> Column:
    """The strings that a page enqueues, unescaped and joined; literals that are no JSON count as ''."""
    found = F.regexp_extract_all(html, F.lit(r'streamController\.enqueue\("((?:\\.|[^"\\])*)"\)'), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), F.lit(0)), F.lit(""))), "")


_MISSING = object()


def flat_array(text: str) -> list:
    out: list = []
    for line in (x.strip() for x in text.split("\n")):
        if line and not re.match(r"[A-Z]\d+:", line):
            try:
                got = json.loads(line, parse_constant=lambda _: None, parse_float=_finite)
            except (ValueError, RecursionError):
                continue
            if isinstance(got, list):
                out += got
    return out


def _finite(number: str) -> float | None:
    x = float(number)
    return x if abs(x) < float("inf") else None


class TooLarge(ValueError):
    """A payload stands for more values than are taken."""


# What negative places stand for; -1 and -5 are absent values, JSON has no form for the others.
CONSTANTS = {-1: _MISSING, -5: _MISSING, -3: None, -4: None, -6: None}


class _Resolver:
    """Follows the references of a flat array. Values of places that reach no cycle are kept and shared; a place inside itself is null."""

    def __init__(self, flat: list):
        self.flat, self.kept, self.open = flat, {}, set()

    def run(self, at):
        """The value of a place: steps of place() are taken from a stack, so nesting needs no recursion."""
        stack, got = [self.place(at)], None
        while stack:
            try:
                stack.append(stack[-1].send(got))
                got = None
            except StopIteration as done:
                stack.pop()
                got = done.value
        return got[0]

    def place(self, at):
        """Yields the places that it needs; returns (value, values in it, whether a cycle was cut)."""
        if not _number(at):
            return at, 1, False
        if at < 0:
            return CONSTANTS.get(at), 1, False
        if at in self.kept:
            return self.kept[at]
        if at in self.open or at != int(at):
            return None, 1, at in self.open
        if at >= len(self.flat):
            return _MISSING, 1, False
        raw, size, cut = self.flat[int(at)], 1, False
        self.open.add(at)
        if isinstance(raw, list):
            value = []
            for x in raw:
                got, n, c = (yield self.place(x)) if _number(x) else (x, 1, False)
                value.append(None if got is _MISSING else got)
                size, cut = size + n, cut or c
        elif isinstance(raw, dict):
            value = {}
            for k, x in raw.items():
                if not (k.startswith("_") and _number(x)):
                    value[k] = x
                elif re.fullmatch(r"_-?\d+", k):
                    name, _, c = yield self.place(int(k[1:]))
                    got, n, d = yield self.place(x)
                    size, cut = size + n, cut or c or d
                    if isinstance(name, str) and got is not _MISSING:
                        value[name] = got
        else:
            value = raw
        self.open.discard(at)
        if size > MOST_VALUES:
            raise TooLarge
        if not cut:
            self.kept[at] = (value, size, False)
        return value, size, cut


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def resolve(at, flat: list):
    """The value that a place stands for; negative places are constants, a place inside itself is null."""
    return _Resolver(flat).run(at)


def conversation_in(value, depth: int = 0):
    """The first object, depth first, with a mapping and a current node."""
    if depth > DEPTH:
        return None
    if isinstance(value, list):
        return next((f for x in value if (f := conversation_in(x, depth + 1))), None)
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("mapping"), dict | list) and value.get("current_node"):
        return value
    answer = value.get("serverResponse")
    first = [answer["data"]] if isinstance(answer, dict) and answer.get("data") else []
    return next((f for x in [*first, *value.values()] if (f := conversation_in(x, depth + 1))), None)


def _dump(text: str | None, pick=lambda x: x) -> str | None:
    """The JSON of what pick takes from a payload; null where there is nothing, too much, or too deep a nesting."""
    if not text or not (flat := flat_array(text)):
        return None
    try:
        value = pick(resolve(0, flat))
        return None if value is None or value is _MISSING else json.dumps(value, ensure_ascii=False)
    except (TooLarge, RecursionError):
        return None


@F.pandas_udf(StringType())
def decode(text: pd.Series) -> pd.Series:
    """The JSON that a payload stands for."""
    return text.map(_dump)


@F.pandas_udf(StringType())
def conversation(text: pd.Series) -> pd.Series:
    """The JSON of the conversation in a payload."""
    return text.map(lambda t: _dump(t, conversation_in))


def repair_truncated(text: str) -> str | None:
    """The longest readable list of messages in a cut-off export, as a conversation; null if there is none."""
    first = text.find('"uuid":')
    start = text.rfind("{", 0, first) if first >= 0 else -1
    if start < 0:
        return None
    decoder, messages, at = json.JSONDecoder(), [], start
    while at < len(text) and text[at] == "{":
        try:
            got, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        messages.append(got)
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
    dates = sorted(m["created_at"] for m in messages if isinstance(m.get("created_at"), str))
    if not messages:
        return None
    return json.dumps({"uuid": "reconstructed", "name": "Reconstructed conversation", "created_at": dates[0] if dates else None, "updated_at": dates[-1] if dates else None, "chat_messages": messages}, ensure_ascii=False)


@F.pandas_udf(StringType())
def repair(text: pd.Series) -> pd.Series:
    return text.map(lambda t: repair_truncated(t) if t else None)
