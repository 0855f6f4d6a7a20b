"""Toxicity by noisy-channel deobfuscation.

A character model (trigrams counted over the whole corpus) judges what a disguised word was. A suspicious stretch of characters
becomes a lattice: each symbol may stand for itself or for the letters it is written for (leetspeak), a run of one letter may be
one or two of it (repetition), a separator between single characters may be nothing or the border of two words (spacing). Viterbi
decoding finds the likeliest path. The restored words and their beginnings are then scored by a logistic model whose features
are chosen on labelled rows.

Null texts count as empty; the empty text gets the score of the bias. Without training labels every score is below one half.
Repeated rows come back one each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, map_arrow, segment_sums, trim_driver, word_table
from .labelled import collect_features, held_out, logistic, training_labels

# What symbols are written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~ '`/\\,:;"
TRIPLE = re.compile(r"([^\W\d_])\1\1").search
PARTS = re.compile("[" + re.escape(SEPARATORS) + "]+").split
EDGE = ".,;:!?\"'()[]{}<>#$%&*|+-=_~`/\\…«»“”‘’¿¡"
MARKS = "".join(c for c in EDGE if c not in LEET)

#: Symbols of the character model: letters, the border of a word, any other letter.
ALPHABET, BORDER, OTHER = 28, 26, 27
#: Log probabilities that the channel gives to a substituted symbol, a kept non-letter, a run cut short, a pair written for one,
#: a dropped separator, a separator that parts words.
SUBSTITUTE, KEEP_SYMBOL, REPEAT, HALVE, DROP, SPLIT = -0.7, -6.0, -0.5, -3.0, -0.2, -2.5
#: Lengths of the beginnings of words that count as features; single characters in a row from which they are read as one stretch.
BEGINNINGS, LEAST_SPACED = (4, 5, 6), 4
#: Words up to this length are sought whole inside readings of spaced characters, longer ones by their beginnings.
LONGEST_WITHIN = 16
#: Characters of a reading whose inner words are hashed at once, and hashes of a word up to which they are kept.
PIECE, KEPT_HASHES = 10_000, 1_000

_CLASS = np.full(256, BORDER, dtype=np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[128:] = OTHER


def count_characters(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams of all texts: counted per task, then added up; the table has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, dtype=np.int64)
        for b in batches:
            text = pc.fill_null(b.column(0), "").cast(pa.large_string())
            data = text.buffers()[2]
            if data is None:
                continue
            places = np.frombuffer(text.buffers()[1], dtype="<i8")
            raw = np.frombuffer(data, dtype=np.uint8)[places[text.offset] : places[text.offset + len(text)]]
            for a in range(0, len(raw), 1 << 22):
                c = _CLASS[raw[a : a + (1 << 22) + 2]]
                total += np.bincount(c[:-2] * ALPHABET**2 + c[1:-1] * ALPHABET + c[2:], minlength=ALPHABET**3)
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], ["trigram", "n"])
        give_back()

    bounded_batches(docs.sparkSession)
    got = docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALPHABET**3)
    out[got["trigram"].to_numpy()] = got["n"].to_numpy()
    return out


class CharacterModel:
    """Interpolated trigram log probabilities."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(ALPHABET, ALPHABET, ALPHABET) + 0.0
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + ALPHABET)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)
        self.log = np.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1).tolist()

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 97 if "a" <= c <= "z" else OTHER

    @staticmethod
    def repeats(n: int, k: int) -> float:
        """What the channel gives to n symbols written for k."""
        return 0.0 if n == k else HALVE if n == 2 else REPEAT

    def lattice(self, stretch: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of one symbol: the strings it may stand for and what the channel gives them. A symbol that comes again behind a separator may go on with the one before."""
        at, before = 0, ""
        while at < len(stretch):
            c, n = stretch[at], 1
            while at + n < len(stretch) and stretch[at + n] == c:
                n += 1
            if c in LEET:
                way = [(x, SUBSTITUTE) for x in LEET[c]]
                yield [(x * k, s * k + self.repeats(n, k)) for x, s in way for k in {1, min(n, 2)}] + [(c * n, KEEP_SYMBOL * n)] + [("", REPEAT)] * (c == before)
            elif c in SEPARATORS:
                yield [("", DROP), (" ", SPLIT)]
            else:
                yield [(c * k, self.repeats(n, k)) for k in {1, min(n, 2)}] + [("", REPEAT)] * (c == before)
            if c not in SEPARATORS:
                before = c
            at += n

    def decode(self, stretch: str) -> str:
        """The likeliest reading; words in it are separated by blanks. Linear in the stretch: states carry links to what they said before."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(BORDER, BORDER): (0.0, None)}
        sure: list[str] = []
        for ways in chain(self.lattice(stretch), [[(" ", 0.0)]]):
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, said) in best.items():
                for letters, channel in ways:
                    x, y, s = a, b, score + channel
                    for c in letters:
                        z = BORDER if c == " " else self.symbol(c)
                        s += self.log[x][y][z]
                        x, y = y, z
                    if (x, y) not in reached or s > reached[x, y][0]:
                        reached[x, y] = (s, (said, letters))
            if len(reached) == 1:  # all paths lead here: what was said so far is settled
                ((state, (s, said)),) = reached.items()
                sure += self.spelled(said)
                reached = {state: (s, None)}
            best = reached
        return "".join([*sure, *self.spelled(max(best.values(), key=lambda x: x[0])[1])]).strip()

    @staticmethod
    def spelled(said: tuple | None) -> list[str]:
        out = []
        while said:
            said, letters = said
            out.append(letters)
        return out[::-1]


def spaced(word: str) -> bool:
    """Runs of single characters between separators: as many as make a spaced word, and most of what stands there."""
    parts = [x for x in PARTS(word) if x]
    alone = sum(x == x[0] * len(x) for x in parts)
    return alone >= LEAST_SPACED and alone * 2 > len(parts)


def suspicious(word: str) -> bool:
    """A letter, and symbols for letters, separators inside or a letter three times in a row: whether it is a disguise is for the character model to say."""
    if len(word) < 3 or not any(c.isalpha() for c in word):
        return False
    return any(c in LEET for c in word) or any(c in SEPARATORS for c in word[1:-1]) or TRIPLE(word) is not None


def restored(word: str, model: CharacterModel) -> list[str]:
    """The words that a token is read as: itself without marks around it, its parts between separators and, of what looks disguised, what decoding gives."""
    bare = word.strip(EDGE)
    if bare.isalpha() and word.rstrip(".,;:?!\"')").lstrip(MARKS) == bare and not TRIPLE(bare):
        return [bare]
    found = [bare] if bare else []
    for whole in dict.fromkeys((word, *PARTS(bare))):
        inner = whole.strip(EDGE)
        if not inner:
            continue
        found.append(inner)
        for shape in dict.fromkeys((inner, whole.rstrip(".,;:?!\"')"), whole.strip(SEPARATORS))):
            if suspicious(shape):
                found += model.decode(shape).split()
    return list(dict.fromkeys(found))


_MARKED = tuple((k, f"p{k}") for k in BEGINNINGS)


def hashes(word: str) -> list[int]:
    h, n = xxhash.xxh64_intdigest, len(word)
    return [h("w" + word), *[h(p + word[:k]) for k, p in _MARKED if n > k]]


def within(word: str) -> list[int]:
    """Hashes of what may be a word inside the reading of spaced characters, whose word borders are lost: longer words show by their beginning."""
    h, longest = xxhash.xxh64_intdigest, BEGINNINGS[-1]
    found = {word[a:z] for a in range(len(word)) for z in range(a + LEAST_SPACED, min(len(word), a + LONGEST_WITHIN) + 1)}
    begun = {word[a : a + longest] for a in range(len(word) - longest)}
    return [*(h("w" + x) for x in found), *(h(f"p{longest}" + x) for x in begun)]


def token_hashes(word: str, model: CharacterModel) -> list[int]:
    if word.isalpha() and not TRIPLE(word):  # as restored() has it, in short
        return hashes(word)
    found = restored(word, model)
    if len(found) == 1:
        return hashes(found[0])
    return [h for x in found for h in hashes(x)] + [h for x in found[1:] if spaced(word) for at in range(0, len(x), PIECE) for h in within(x[at : at + PIECE + LONGEST_WITHIN])]


#: Words whose hashes a worker keeps.
KEPT_WORDS = 60_000


def extract(column: pa.Array, model: CharacterModel, kept: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's features, features): distinct hashes of the restored words and their beginnings."""
    offsets, codes, distinct = word_table(column)
    n = len(offsets) - 1
    words = distinct.to_pylist()
    lists, single, between = [], np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
    for i, w in enumerate(words):
        mine = kept.get(w)
        if mine is None:
            mine = token_hashes(w if w.isascii() else w.lower(), model)
            if len(kept) < KEPT_WORDS and len(mine) <= KEPT_HASHES:
                kept[w] = mine
        lists.append(mine)
        alone = w.strip(SEPARATORS)
        single[i] = alone != "" and (alone[0].isalnum() or alone[0] in LEET) and alone == alone[0] * len(alone)
        between[i] = not alone
    size = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.array([h for x in lists for h in x], dtype=np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair = np.unique(owner * max(len(words), 1) + codes)
    owner_of, code_of = pair // max(len(words), 1), pair % max(len(words), 1)
    reps = size[code_of] if len(pair) else np.zeros(0, np.int64)
    at = np.repeat(start[code_of] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum()) if len(pair) else np.zeros(0, np.int64)
    hashed, text_of = flat[at] if len(at) else np.zeros(0, np.uint64), np.repeat(owner_of, reps)
    extra_h, extra_t = [], []
    if len(codes):  # stretches of single characters
        s, letters = (single | between)[codes], np.concatenate([[0], np.cumsum(single[codes])])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], s.astype(np.int8), [0]])))
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            if letters[z] - letters[a] < LEAST_SPACED:
                continue
            for t in range(int(owner[a]), int(owner[z - 1]) + 1):
                lo, hi = max(a, offsets[t]), min(z, offsets[t + 1])
                if letters[hi] - letters[lo] >= LEAST_SPACED:
                    for w in model.decode(" ".join(words[c].strip(SEPARATORS) for c in codes[lo:hi] if single[c])).split():
                        for at in range(0, len(w), PIECE):  # long readings in overlapping pieces
                            extra_h.append(np.array(hashes(w)[: None if not at else 0] + within(w[at : at + PIECE + LONGEST_WITHIN]), dtype=np.uint64))
                            extra_t.append(np.full(len(extra_h[-1]), t))
    hashed = np.concatenate([hashed, *extra_h])
    text_of = np.concatenate([text_of, *extra_t])
    order = np.lexsort((hashed, text_of))
    hashed, text_of = hashed[order], text_of[order]
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text_of[1:] != text_of[:-1])
    hashed, text_of = hashed[new], text_of[new]
    return np.searchsorted(text_of, np.arange(n + 1)), hashed


@dataclass
class ToxicityModel:
    characters: CharacterModel
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, base: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(base) - 1, self.bias)
        at = np.minimum(np.searchsorted(self.features, hashed), len(self.features) - 1)
        return self.bias + segment_sums(np.where(self.features[at] == hashed, self.weights[at], 0.0), base)


#: A feature is taken if it stands in so many texts of one class and its log odds are so many standard errors from those of all texts.
LEAST_TEXTS, LEAST_Z = 3, 3.5
#: Steps over the sample, and how strongly weights are drawn to 0.
STEPS, SHRINK = 3000, 2e-7


def fit(base: np.ndarray, features: np.ndarray, y: np.ndarray, characters: CharacterModel) -> ToxicityModel:
    none = np.zeros(0)
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg or not len(features):
        return ToxicityModel(characters, none.astype(np.uint64), none, -3.0)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(base))
    order = np.argsort(features, kind="stable")
    row, names = row[order], features[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    n = np.diff(np.concatenate([starts, [len(names)]]))
    n1 = np.add.reduceat(y[row], starts)
    n0 = n - n1
    odds = np.log((n1 + 0.5) / (pos - n1 + 0.5)) - np.log((n0 + 0.5) / (neg - n0 + 0.5))
    error = np.sqrt(1 / (n1 + 0.5) + 1 / (pos - n1 + 0.5) + 1 / (n0 + 0.5) + 1 / (neg - n0 + 0.5))
    good = (n1 >= LEAST_TEXTS) & (odds > 0) & (odds / error >= min(LEAST_Z, 0.85 * float((odds / error).max())))
    chosen = np.flatnonzero(good)
    row = np.concatenate([row[:0], *(row[starts[k] : starts[k] + n[k]] for k in chosen)])
    column = np.repeat(np.arange(len(chosen)), n[chosen])
    names = names[starts[chosen]]
    w, bias = np.zeros(len(chosen)), float(np.log(pos / neg))
    seen_w, seen_b = np.full(len(chosen), 1e-3), 1e-3
    for _ in range(STEPS):  # whole-sample steps on the log loss, weights kept non-negative and drawn to 0
        z = np.bincount(row, weights=w[column], minlength=len(y)) + bias
        g = (logistic(z) - y) / len(y)
        gw = np.bincount(column, weights=g[row], minlength=len(chosen)) + SHRINK * w
        seen_w += gw * gw
        seen_b += g.sum() ** 2
        w = np.maximum(w - 0.3 * gw / np.sqrt(seen_w), 0)
        bias -= 0.1 * g.sum() / np.sqrt(seen_b)
    used = w > 0.02
    return ToxicityModel(characters, names[used], w[used], bias)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    characters = CharacterModel(count_characters(docs))

    def split(column: pa.Array) -> list[np.ndarray]:
        out, kept = [], {}
        for at in range(0, len(column), SLICE):
            base, hashed = extract(column.slice(at, SLICE), characters, kept)
            out += [hashed[a:z] for a, z in zip(base[:-1], base[1:], strict=True)]
        return out

    model = fit(*collect_features(docs, training_labels(labels, "toxic"), split, "<u8"), characters)
    give_back()
    trim_driver(docs.sparkSession)
    return model


#: Texts that are taken apart at once.
SLICE = 250


def scores(column: pa.Array, model: ToxicityModel, kept: dict[str, list[int]]) -> np.ndarray:
    parts = [model.margins(*extract(column.slice(at, SLICE), model.characters, kept)) for at in range(0, len(column), SLICE)]
    return logistic(np.concatenate([np.zeros(0), *parts]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. No shuffle."""
    kept: dict[str, list[int]] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(b.column("text"), model, kept)
        return pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.7."""
    model = train(docs, labels)
    kept: dict[str, list[int]] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(b.column(b.schema.get_field_index("text")), model, kept)
        return b.filter(pa.array(s < 0.7))

    return map_arrow(docs, run, docs.schema)
