"""Embedding near-duplicates by collision counting over projections.

Every vector is scaled to length one and turned at random; its coordinates then are one-dimensional projections. Of a pair the
collisions are counted: the projections on which one vector lies in the window centred on the other. Pairs that reach a count
calibrated on a bounded sample for the wanted recall are verified. One sorted projection alone selects next to nothing (a window that
keeps 95 of 100 pairs at a cosine of 0.9 also keeps about half of all others), so it cannot propose the pairs. What tells vectors
apart are the ends of the sorted projections: at a cosine of 0.9 more than half of all pairs agree on which of a turn's projections
lies farthest out, of strangers one in twice as many as there are projections. So a table sorts the vectors by the outermost
projections of several turns, and pairs that meet in a table are counted. How many turns a table takes follows from the number of
vectors and the sample's strangers, how many tables from the sample's recall.

A first pass deals ids alone and keeps the cells with two vectors or more; sketches go only there. Large cells are split into pairs
of pieces. A pair is looked at in the first table where it meets. Sketches are fine enough to decide all pairs but those within
0.0003 of the cosine, which are verified from the vectors in double precision. What leaves a task is, per vector, the number
of its links and one link towards its component, so a group of near copies gives rows in proportion to its members.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their own row. Vectors of
different lengths do not link; an embedding column has one length as a rule, and each length takes a pass of its own. Equal vectors
are compared once. Repeated vec_ids come back one row each, with the links of their own vectors. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, map_arrow, materialise
from .components import connected_components

#: Cosine from which vectors link, recall wanted of pairs just at it (of the tables, of the count), vectors that calibrate both.
LEAST_COSINE, TABLE_RECALL, COUNT_RECALL, MAX_SAMPLE = 0.9, 0.97, 0.99, 2000
#: Half of a collision window, in standard deviations of the difference of a pair at the cosine.
HALF_WINDOW = 2.0
#: Strangers that a vector may meet in a cell, turns of a table at most, pairs that calibrate.
STRANGERS, MOST_TURNS, PAIRS = 0.5, 8, 1000
#: Vectors that one cell compares in one piece, larger cells are split into pairs of pieces; pairs that are compared at once.
PIECE, PAIRS_AT_ONCE = 1024, 100_000
SCALE = 32767.0


@lru_cache(maxsize=16)
def _hadamard(d: int) -> np.ndarray:
    out = np.ones((1, 1), dtype=np.float32)
    while len(out) < d:
        out = np.block([[out, out], [out, -out]])
    return out


def turn(x: np.ndarray, seed: int) -> np.ndarray:
    """The rows of x, as wide as a power of two, after a random rotation: three rounds of random signs and a Hadamard transform. Only the seed is kept."""
    n, d = x.shape
    inner = 1 << (d.bit_length() // 2)
    left, right = (_hadamard(w).astype(x.dtype) for w in (d // inner, inner))
    for s in np.random.default_rng(seed).integers(0, 2, (3, d)).astype(x.dtype) * 2 - 1:
        x = (x * (s / x.dtype.type(math.sqrt(d)))).reshape(n, d // inner, inner) @ right
        x = (left @ x).reshape(n, d) if d > inner else x.reshape(n, d)
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, filled up with zeros to a power of two, 64 at least: signs alone turn a few coordinates in a few ways only."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    width = max(64, 1 << (vectors.shape[1] - 1).bit_length())
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


@dataclass(frozen=True)
class Projections:
    """What is subtracted before outermost projections are sought, turns of a table, tables, the count a pair must reach."""

    mean: np.ndarray
    turns: int
    tables: int
    least: int

    @property
    def half(self) -> float:
        return HALF_WINDOW * math.sqrt(2 * (1 - LEAST_COSINE) / len(self.mean)) * SCALE

    @staticmethod
    def sketch(units: np.ndarray) -> np.ndarray:
        return np.rint(turn(units, 0) * SCALE).astype(np.int16)

    @staticmethod
    def outermost(centred: np.ndarray, seed: int) -> np.ndarray:
        """Which projection of a turn lies farthest out, and on which side."""
        p = turn(centred, seed)
        at = np.abs(p).argmax(axis=1)
        return at * 2 + (p[np.arange(len(p)), at] > 0)

    def cell(self, centred: np.ndarray, table: int) -> np.ndarray:
        """One number for each vector in a table."""
        h = np.full(len(centred), table + 1, dtype=np.uint64)
        for k in range(self.turns):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.outermost(centred, 1 + table * MOST_TURNS + k).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def cells(self, units: np.ndarray) -> np.ndarray:
        centred = (units - self.mean).astype(np.float32)
        return np.stack([self.cell(centred, t) for t in range(self.tables)], axis=1)

    def collisions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.abs(a.astype(np.int32) - b) <= self.half).sum(axis=1)

    @property
    def doubt(self) -> float:
        """How far the cosine of two sketches may lie from that of their vectors."""
        off = math.sqrt(len(self.mean)) * 0.5 / SCALE
        return 2 * off + off * off + 1e-9


def partners(units: np.ndarray, rng: np.random.Generator, d: int) -> np.ndarray:
    """A vector at just the least cosine for each of units, whose first d places are in use."""
    other = np.zeros_like(units)
    other[:, :d] = rng.normal(size=(len(units), d))
    other -= (other * units).sum(axis=1, keepdims=True) * units
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    return LEAST_COSINE * units + math.sqrt(1 - LEAST_COSINE**2) * other


def _tables(units: np.ndarray, near: np.ndarray, far: np.ndarray, mean: np.ndarray, n: int, most: float) -> tuple[float, Projections]:
    """Turns and tables that find the pairs (near, far) if mean is subtracted, and the entries and comparisons that they cost a vector; gives up beyond most tables."""
    a, b, whole = ((x - mean).astype(np.float32) for x in (near, far, units))
    met = [0.0]
    for k in (k for k in (1, 2, 3, 5, 8, 13) if k < len(units)):
        apart = (units * np.roll(units, k, axis=0)).sum(axis=1) < LEAST_COSINE
        if apart.any():
            met += [(c == np.roll(c, k))[apart].mean() for c in (Projections.outermost(whole, 2**32 - s) for s in range(1, 9))]
    by_chance = min(0.9, max(float(np.mean(met)), 0.5 / units.shape[1]))
    turns = min(MOST_TURNS, max(1, math.ceil(math.log(max(n / STRANGERS, 2)) / -math.log(by_chance))))
    found, tables, p = np.zeros(len(near), dtype=bool), 0, Projections(mean, turns, 0, 0)
    while found.mean() < TABLE_RECALL:
        if tables >= most:
            return math.inf, p
        found |= p.cell(a, tables) == p.cell(b, tables)
        tables += 1
    return tables * (1 + n * by_chance**turns), Projections(mean, turns, tables, 0)


def choose(sample: np.ndarray, n: int, seed: int = 3) -> Projections:
    """Turns, tables and count for n vectors, calibrated on the sample and partners of its vectors at just the least cosine.

    Vectors that crowd around a direction are told apart better with the mean subtracted; that is done where it costs less.
    """
    units = unit(sample)
    near = np.resize(units, (PAIRS, units.shape[1]))
    far = partners(near, np.random.default_rng(seed), sample.shape[1])
    cost, p = _tables(units, near, far, np.zeros(units.shape[1]), n, math.inf)
    less, q = _tables(units, near, far, units.mean(axis=0), n, 2 * p.tables)
    p = q if less < cost else p
    counts = p.collisions(p.sketch(near), p.sketch(far))
    return Projections(p.mean, p.turns, p.tables, int(np.quantile(counts, 1 - COUNT_RECALL)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sketches(vectors: DataFrame, p: Projections) -> DataFrame:
    """(id, copies, sketch, codes): codes are the vector's cells, one for each table."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        units = unit(_matrix(b.column(2)))
        codes = p.cells(units)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * p.tables), pa.array(codes.ravel()))
        return pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in p.sketch(units)], pa.binary()), lists], ["id", "copies", "sketch", "codes"])

    return map_arrow(vectors.select("id", "copies", "embedding"), run, "id long, copies long, sketch binary, codes array<int>")


def _gather(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place that the pairs (x, y) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


MET = "a long, b long, n long"


def _meet(rows: DataFrame, p: Projections) -> DataFrame:
    """(a, b, n): a vector, one that it is connected with, and its links found here; n is null for pairs that sketches cannot decide."""

    def pairs(key: np.ndarray, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, sketch: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], np.any(key[:, 1:] != key[:, :-1], axis=0)]))
        ends = np.concatenate([starts[1:], [key.shape[1]]])
        table, place = key[0] >> 32, np.arange(len(ids))
        reach = np.repeat(ends, ends - starts) - place - 1  # partners after each row
        total, lo = np.cumsum(reach), 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(place[lo:hi], reach[lo:hi])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(reach[lo:hi]) - reach[lo:hi], reach[lo:hi])
            lo = hi
            ok = (key[1, x] == key[2, x]) | (side[x] != side[y])
            x, y = x[ok], y[ok]
            ok = p.collisions(sketch[x], sketch[y]) >= p.least
            x, y = x[ok], y[ok]
            ok = (codes[x] == codes[y]).argmax(axis=1) == table[x]
            x, y = x[ok], y[ok]
            cosine = np.einsum("ij,ij->i", sketch[x].astype(np.float64), sketch[y].astype(np.float64)) / SCALE**2
            open_ = np.abs(cosine - LEAST_COSINE) <= p.doubt
            if open_.any():
                yield pa.record_batch([pa.array(ids[x[open_]]), pa.array(ids[y[open_]]), pa.nulls(int(open_.sum()), pa.int64())], ["a", "b", "n"])
            ok = ~open_ & (cosine > LEAST_COSINE)
            if ok.any():
                there, at = np.unique(np.concatenate([x[ok], y[ok]]), return_inverse=True)
                x, y = at[: len(at) // 2], at[len(at) // 2 :]
                mates = copies[there]
                n = np.bincount(x, mates[y], len(there)) + np.bincount(y, mates[x], len(there))
                yield pa.record_batch([pa.array(ids[there]), pa.array(ids[there[_gather(x, y, len(there))]]), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            mine = [b.column(i).to_numpy() for i in range(3, 6)]
            mine.append(np.frombuffer(b"".join(b.column(6).to_pylist()), dtype=np.int16).reshape(b.num_rows, -1))
            mine.append(b.column(7).flatten().to_numpy().reshape(b.num_rows, -1))
            if kept is not None:
                key = np.concatenate([kept[0], key], axis=1)
                mine = [np.concatenate([u, v]) for u, v in zip(kept[1:], mine, strict=True)]
            last = int(np.flatnonzero(np.concatenate([[True], np.any(key[:, 1:] != key[:, :-1], axis=0)]))[-1])
            if last:
                yield from pairs(key[:, :last], *(v[:last] for v in mine))
            kept = [key[:, last:], *(v[last:] for v in mine)]
        if kept is not None:
            yield from pairs(*kept)
        give_back()

    bounded_batches(rows.sparkSession)
    spread = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return spread.select("cell", "i", "j", "id", "copies", "side", "sketch", "codes").mapInArrow(run, MET)


def near(vectors: DataFrame) -> DataFrame | None:
    """(a, b, n): the links of a materialised table (id, copies, embedding) of valid, distinct vectors of one length, told per vector; None for fewer than two."""
    n = vectors.count()
    if n < 2:
        return None
    sample = vectors.orderBy(F.xxhash64("id")).limit(MAX_SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    p = choose(_matrix(sample), n)
    sketches = materialise(_sketches(vectors, p), "sketches")
    entries = sketches.select("id", F.posexplode("codes").alias("t", "code")).select("id", F.expr("shiftleft(cast(t as bigint), 32) | (code & 4294967295L)").alias("cell"))
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell", F.expr(f"cast(ceil(n / {PIECE}) as long)").alias("pieces"))
    rows = entries.join(materialise(sizes, "cells"), "cell").withColumn("side", F.expr("pmod(xxhash64(id), pieces)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, pieces - 1)")))
    rows = rows.select("id", "cell", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    met = materialise(_meet(rows.join(sketches, "id"), p), "met")

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = _matrix(b.column(4)), _matrix(b.column(5))
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        return pa.record_batch([b.column(i) for i in range(4)], ["a", "b", "m", "n"]).filter(pa.array(cosine >= LEAST_COSINE))

    left = vectors.select(F.col("id").alias("a"), F.col("copies").alias("m"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.col("copies").alias("n"), F.col("embedding").alias("y"))
    asked = met.filter("n IS NULL").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y")
    told = materialise(map_arrow(asked, verify, "a long, b long, m long, n long"), "verified")
    return met.filter("n IS NOT NULL").union(told.select("a", "b", "n")).union(told.select("b", "a", "m"))


def valid(name: str = "embedding"):
    e = F.col(name)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0), F.lit(False))


def link(df: DataFrame) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept. A row without a vec_id is never kept."""
    rows = df.select("vec_id", "embedding")
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # one zero, not two
    good = rows.filter(valid()).withColumn("embedding", plain).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(11), "embedding"))
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written
    links = None
    for d in [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]:  # lengths, one as a rule
        found = near(classes.filter(F.size("embedding") == d).select("id", "copies", "embedding"))
        links = found if links is None else links if found is None else links.union(found)
    if links is None:
        links = df.sparkSession.createDataFrame([], MET)
    labels = connected_components(links.select("a", "b"))
    named = classes.select("id", "h1", "h2", "vec_id", "copies")
    of = named.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    mates = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("mates"))
    told = of.join(least, "component").join(mates, "id", "left").select("h1", "h2", "component_id", (F.coalesce("mates", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
