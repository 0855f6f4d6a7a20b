"""Byte-pair encoding and decoding of whole texts with a public vocabulary whose words end in a marked symbol.

Encoding is the backtracking encoder: an Aho-Corasick automaton reports every token inside a word in one pass, the longest token
at the current place is tried first, and a token is accepted only if it can stand after the one before it. Whether two tokens can
be neighbours is decided by the pair-compatibility table (merges and the two halves of each token). The outcome is the sequence
that the merge rules give, in time linear in the word. Decoding copies each token's bytes out of one blob through an offset table.

Null texts count as empty, an empty text has no tokens, repeated rows are encoded each, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import give_back, map_arrow, texts

#: Distinct stretches of text, and words, whose tokens a worker keeps: those it meets first, so the frequent ones.
KEPT_WORDS = 100_000
#: Pairs of tokens whose compatibility a worker keeps; others are decided anew.
KEPT_PAIRS = 200_000


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follows from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


#: Characters that str.split() parts words at and the vocabularies' pattern does not, and white space without them.
_ODD_SPACE, _SPACE = re.compile("[\x1c-\x1f]").search, re.compile("[^\\S\x1c-\x1f]+").split


class Words:
    """Normalisation and word splitting of a tokenizer file: NFC, lower case, white space dropped, special strings kept whole.

    White space never joins or parts words otherwise, so stretches between it are split one by one. ASCII needs no table of
    characters; other stretches go through the tokenizers library's own normaliser and splitter, whose tables then hold.
    """

    def __init__(self, spec: dict):
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        bare = {"version": spec["version"], "normalizer": spec["normalizer"], "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.normalize = Tokenizer.from_str(json.dumps(bare)).normalizer.normalize_str  # without the vocabulary, which takes room
        self.split_words = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = sorted({s[:2] for s in self.special})

    def split(self, stretch: str) -> list[str]:
        """The normalised words of a stretch without white space."""
        if stretch.isascii():
            low = stretch.lower()
            return [low] if low.isalpha() else self.find(low)
        return [w for w, _ in self.split_words(self.normalize(stretch))]

    def chunks(self, text: str) -> list[str | int]:
        """Stretches between white space; no word crosses it. A special token appears as its id."""
        if not any(m in text for m in self.marks):
            return self.plain(text)
        out: list[str | int] = []
        for k, piece in enumerate(self.cut.split(text)):  # a mark alone is no special token: pieces between them are plain
            out += [self.special[piece]] if k % 2 else self.plain(piece)
        return out

    def plain(self, text: str) -> list[str]:
        """Stretches of a text without special tokens."""
        return [x for x in _SPACE(text) if x] if _ODD_SPACE(text) else text.split()


class BacktrackingBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words, model = Words(spec), spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        n = max(max(vocab.values()), *self.words.special.values()) + 1
        # A word is a string of symbols: its bytes as chr(0..255), the last one as chr(256..511) for "byte that ends a word".
        symbols: list[str] = [""] * n
        first, second = list(range(n)), list(range(n))
        self.pair: dict[int, int] = {}
        self.single = [0] * 512
        for b, c in enumerate(letters):
            self.single[b], self.single[256 + b] = vocab[c], vocab[c + end]
            symbols[vocab[c]], symbols[vocab[c + end]] = chr(b), chr(256 + b)
        self.n = n
        for x in model["merges"]:
            a, b = (vocab[t] for t in (x if isinstance(x, list) else x.split(" ")))
            t = vocab[(x[0] + x[1]) if isinstance(x, list) else x.replace(" ", "")]
            symbols[t], first[t], second[t] = symbols[a] + symbols[b], a, b
            self.pair[a * n + b] = t
        if any(t <= max(first[t], second[t]) for t in self.pair.values()):
            raise ValueError("the ids of merged tokens must follow the order of the merges")
        self.first, self.second = first, second
        self.apt: dict[int, bool] = {}
        reached = [first[t] == t for t in range(n)]
        for t in sorted(self.pair.values()):
            reached[t] = reached[first[t]] and reached[second[t]] and self._neighbours(first[t], second[t], t)
        self.length = [len(s) for s in symbols]
        self.automaton = ahocorasick.Automaton()
        ids = {s: t for t, s in enumerate(symbols) if s and reached[t]}
        for s, t in ids.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest token that is a proper prefix of the token
        for s, t in ids.items():
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in ids:
                    self.shorter[t] = ids[s[:k]]
                    break
        self.known: dict[str | int, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        names = [""] * n
        for s, t in (vocab | self.words.special).items():
            names[t] = s
        spelled = [(s + " ").encode() for s in names]
        self.blob = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def _neighbours(self, a: int, b: int, limit: int) -> bool:
        """Whether merges below limit leave the border between tokens a and b alone: walks down the halves that touch the border, latest merge first; single symbols have no halves."""
        pair, n = self.pair, self.n
        while True:
            if pair.get(a * n + b, limit) < limit:
                return False
            left, right = self.second[a] != a, self.first[b] != b
            if not left and not right:
                return True
            if left and (a > b or not right):
                limit, a = a, self.second[a]
            else:
                limit, b = b + 1, self.first[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.n + b
        found = self.apt.get(key)
        if found is None:
            found = self._neighbours(a, b, self.n + 1)
            if len(self.apt) < KEPT_PAIRS:
                self.apt[key] = found
        return found

    def word(self, word: str) -> list[int]:
        """Token ids of one word."""
        raw = word.encode("utf-8")
        line = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n, length, shorter = len(line), self.length, self.shorter
        longest = [0] * n
        for stop, t in self.automaton.iter(line):
            at = stop + 1 - length[t]
            longest[at] = t if length[t] > length[longest[at]] or not longest[at] else longest[at]
        if n == 1:
            return [self.single[ord(line)]]
        for at, c in enumerate(line):  # token 0 is a real token: single symbols are set where no longer one was found
            if length[longest[at]] <= 1:
                longest[at] = self.single[ord(c)]
        out: list[int] = []
        dead, at, t = set(), 0, longest[0]
        while at < n:
            stop = at + length[t]
            if stop not in dead and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = stop
                t = longest[at] if at < n else -1
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                dead.add(at)
                t = out.pop()
                at -= length[t]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known
        chunks = self.words.chunks(text)
        rare = {c: self._chunk(c) for c in chunks if c not in known}
        if rare and len(known) < KEPT_WORDS:
            known.update(rare)
        return b"".join([known[c] if c in known else rare[c] for c in chunks])

    def _chunk(self, chunk: str | int) -> bytes:
        if isinstance(chunk, int):
            return struct.pack("<I", chunk)
        spelled, out = self.spelled, []
        for w in self.words.split(chunk):
            ids = spelled.get(w)
            if ids is None:
                ids = array("I", self.word(w)).tobytes()
                if len(spelled) < KEPT_WORDS:
                    spelled[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' spellings with single spaces between them, as a tokenizer without a decoder gives."""
        if not len(ids):
            return b""
        size = self.size[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.start[ids] - stop + size, size)
        at += np.arange(stop[-1])
        return self.blob[at][:-1].tobytes()


@lru_cache(maxsize=1)
def load(path: str) -> BacktrackingBpe:
    try:
        return BacktrackingBpe(path)
    finally:
        give_back()  # the parsed file is large


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): each whole text's ids as little-endian unsigned 32-bit integers. No shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        return pa.record_batch([b.column(0), pa.array([bpe.encode(t) for t in texts(b, "text")], pa.binary())], ["doc_id", "ids"])

    return map_arrow(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the decoded texts. Null ids decode as no tokens."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        out = [bpe.decode(np.frombuffer(x or b"", dtype="<u4")).decode() for x in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_arrow(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), run, f"doc_id {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode() followed by decode(), in one pass; with_ids adds the ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        n, ids_sha, text_sha, every = [], [], [], []
        for t in texts(b, "text"):
            ids = bpe.encode(t)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
            every.append(ids if with_ids else b"")
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.record_batch([*cols, pa.array(every, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
