"""N-gram Jaccard self-join with token-combination prefixes.

A text's set is its distinct word shingles. All sets are ordered alike: by how many texts hold a shingle, rarest first. Two sets
of similarity t or more share K shingles in the first n - ceil(t n) + K of each. So it suffices to index that extended prefix: a
rare shingle alone, and of the frequent ones every combination of K (here 2), since a pair that shares no rare shingle there
shares K frequent ones. A set with so many frequent shingles in its prefix that combinations outnumber them is indexed by single
ones, and so are, for its sake, the frequent ones of all others. Candidates from the lists are verified on whole sets.

A pair that meets in frequent shingles alone shares no rare one, so a set stands in such lists only if three quarters of it are
frequent: a line that a fifth of all texts hold makes no list of them.

Texts with equal sets form a class and are compared once. Within a list, links are sought as a component needs them: first
between a leader and everyone else, in two rounds, then between pairs that are still in different components and whose sizes and
numbers of shared shingles allow a link; for that, long lists are split into pairs of pieces, which are tasks of their own. A pair
that is skipped is already connected, so the components are those of all links.

Counting goes through packed arrays: the shingles of a block of texts, split by the first bits of their hashes, four bytes each.
Null and empty texts and those of white space have an empty set and link with nothing. Texts with fewer words than a shingle have
their whole sequence as the one shingle. Repeated rows form a class like equal texts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, columns, divided, fresh, give_back, map_arrow, materialise, member_filter, without_members, word_table
from .components import connected_components

#: Words of a shingle, similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
#: Size of the combinations, texts that a rare shingle stands in at most, frequent shingles in a prefix up to which combinations are indexed.
COMBINE, RARE, MOST_COMBINED = 2, 24, 12
#: Entries of a list that meet in one piece in the last round.
PIECE = 2000
#: Texts in a packed block; shingles that one bucket should get.
BLOCK_TEXTS, BUCKET_SHINGLES = 2000, 1 << 20

INFO = np.dtype([("there", "?"), ("id", "<i8"), ("n", "<u4"), ("h1", "<i8"), ("h2", "<i8")])


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    offsets, codes, distinct = word_table(column)
    named = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    h = named[codes] if len(codes) else np.zeros(0, np.uint64)

    def mixed(parts: list[np.ndarray]) -> np.ndarray:
        m = parts[0] * np.uint64(0x9E3779B97F4A7C15)
        for p in parts[1:]:
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + p
        m = (m ^ (m >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return m ^ (m >> np.uint64(31))

    k = len(h) - words + 1
    grams = mixed([h[i : i + k] for i in range(words)]) if k > 0 else np.zeros(0, np.uint64)
    out = []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(grams[a : z - words + 1]))
        elif z > a:
            out.append(mixed([np.array([z - a], dtype=np.uint64), *(h[i : i + 1] for i in range(a, z))]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def least_overlap(n: int) -> int:
    """Shingles that a set of n must share with any set that it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


PACKED = "bucket int, block long, docs binary, shingles binary"


def _pack(df: DataFrame, bits: int) -> DataFrame:
    """For each block of texts and bucket of hashes: how many shingles each text has there, and 32 bits of each. Buckets from 2**bits on carry the texts' own data."""
    buckets = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_TEXTS):
                b = whole.slice(at, BLOCK_TEXTS)
                sets = shingle_sets(b.column(1))
                info = np.zeros(len(sets), dtype=INFO)
                info["there"] = [x is not None for x in b.column(0).to_pylist()]
                info["id"] = pa.compute.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
                info["n"] = [len(s) for s in sets]
                hashes = [set_hash(s) for s in sets]
                info["h1"], info["h2"] = [x for x, _ in hashes], [x for _, x in hashes]
                flat = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), info["n"])
                bucket = (flat >> np.uint64(64 - bits)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                low = ((flat >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                owner = owner[order]
                block = part << 32 | seq
                seq += 1
                docs, shingles, there = [info.tobytes()], [b""], [buckets + block % buckets]
                for k in range(buckets):
                    a, z = ends[k], ends[k + 1]
                    if z > a:
                        there.append(k)
                        docs.append(np.bincount(owner[a:z], minlength=len(sets)).astype("<u4").tobytes())
                        shingles.append(low[a:z].tobytes())
                yield pa.record_batch([pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int64()), pa.array(docs, pa.binary()), pa.array(shingles, pa.binary())], ["bucket", "block", "docs", "shingles"])
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, PACKED)


COUNTED = "block long, bucket int, docs binary, shingles binary, held binary"


def _count(buckets: int):
    """For one bucket: which shingles stand in more than one text, and in how many; sent back to their blocks."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("docs", pa.binary()), ("shingles", pa.binary()), ("held", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        rows = []
        bucket, blocks, docs, shingles = t["bucket"][0].as_py(), t["block"].to_pylist(), t["docs"].to_pylist(), t["shingles"].to_pylist()
        if bucket >= buckets:
            rows = [(b, bucket, d, b"", b"") for b, d in zip(blocks, docs, strict=True)]
        else:
            parts = [np.frombuffer(x, dtype="<u4") for x in shingles]
            _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            held, at = n[back], 0
            for b, d, p in zip(blocks, docs, parts, strict=True):
                mine = held[at : at + len(p)]
                at += len(p)
                many = mine > 1
                if many.any():
                    counts = np.frombuffer(d, dtype="<u4")
                    owner = np.repeat(np.arange(len(counts)), counts)[many]
                    rows.append((b, bucket, owner.astype("<u2").tobytes(), p[many].tobytes(), np.minimum(mine[many], 65535).astype("<u2").tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


PREFIXES = "uid long, doc_id long, n long, h1 long, h2 long, shared long, core long, rare array<long>, frequent array<long>, mask array<long>"


#: 64-bit words of the mask of a set's frequent shingles.
MASK_WORDS = 8


def _mask(keys: np.ndarray) -> np.ndarray:
    """One bit for each key. A bit that only one of two masks has stands for a key that only that set has."""
    bit = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 - MASK_WORDS.bit_length() + 1)
    words = np.zeros(MASK_WORDS, dtype=np.uint64)
    np.bitwise_or.at(words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    return words.view(np.int64)


def _prefixes(buckets: int):
    """For one block: each text's extended prefix without the shingles that no other text has, which come first and match nothing."""

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        info, docs, keys, held = None, [], [], []
        for bucket, d, s, h in zip(t["bucket"].to_pylist(), t["docs"].to_pylist(), t["shingles"].to_pylist(), t["held"].to_pylist(), strict=True):
            if bucket >= buckets:
                info = np.frombuffer(d, dtype=INFO)
            else:
                docs.append(np.frombuffer(d, dtype="<u2").astype(np.int64))
                keys.append(np.frombuffer(s, dtype="<u4").astype(np.int64) | bucket << 32)
                held.append(np.frombuffer(h, dtype="<u2").astype(np.int64))
        docs, keys, held = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, keys, held))
        order = np.lexsort((keys, held, docs))
        docs, keys, held = docs[order], keys[order], held[order]
        ends = np.searchsorted(docs, np.arange(len(info) + 1))
        rare, frequent, masks = [], [], []
        for i, n in enumerate(info["n"].tolist()):
            a, z = int(ends[i]), int(ends[i + 1])
            take = n - least_overlap(n) + COMBINE - (n - (z - a))  # what the prefix still holds after the text's own shingles
            end = max(a, min(z, a + take))
            cut = a + int(np.searchsorted(held[a:end], RARE, "right"))
            rare.append(keys[a:cut])
            frequent.append(keys[cut:end])
            masks.append(_mask(keys[cut:z]) if end > cut else None)
        uid = block // (1 << 32) << 42 | block % (1 << 32) << 12
        cols = [
            pa.array(uid + np.arange(len(info))), pa.array(info["id"], mask=~info["there"]), pa.array(info["n"].astype(np.int64)), pa.array(info["h1"]), pa.array(info["h2"]),
            pa.array(np.diff(ends)), pa.array(np.bincount(docs[held > RARE], minlength=len(info))), pa.array(rare, pa.list_(pa.int64())), pa.array(frequent, pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.int64())),
        ]
        return pa.table(cols, names=["uid", "doc_id", "n", "h1", "h2", "shared", "core", "rare", "frequent", "mask"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(x) + len(y) - len(np.union1d(x, y))
            good.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        return pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good))

    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "ma", "mb"), run, "a long, b long").distinct()


def _possible(na: str, sa: str, nb: str, sb: str) -> str:
    """Whether a pair's sizes and the shingles that it may share leave room for a link.

    In a rare shingle's list a text may share those that some other text has. A pair that shares a rare shingle is in such a list;
    one that meets only in lists of frequent shingles shares no rare one (they all stand before the frequent ones of a prefix),
    so there its overlap is at most the smaller number of frequent shingles. A list's rows say which number holds.
    """
    return f"{NUMERATOR + DENOMINATOR} * least({sa}, {sb}) >= {NUMERATOR} * ({na} + {nb})"


def classes_and_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with the hash of their class, classes, components of classes): the tables behind join()."""
    spark = df.sparkSession
    rows = df.selectExpr(f"cast(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text")
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # rows that are in no file have no known size
        size = (rows.select(F.sum(F.octet_length("text"))).first()[0] or 0) / 1.7
    bits = min(16, max(6, math.ceil(math.log2(max(1.0, size / 3.5 / BUCKET_SHINGLES)))))
    packed = _pack(rows, bits)
    counted = packed.groupBy("bucket").applyInArrow(_count(1 << bits), COUNTED)
    texts = materialise(counted.groupBy("block").applyInArrow(_prefixes(1 << bits), PREFIXES), "prefixes")

    grouped = texts.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("doc_id"), F.max("shared").alias("shared"), F.max("core").alias("core"), F.first("rare").alias("rare"), F.first("frequent").alias("frequent"), F.first("mask").alias("mask"))
    classes = materialise(grouped, "classes")

    dense = F.size("frequent") > MOST_COMBINED
    mine = classes.filter("size(rare) + size(frequent) > 0").select("cls", "n", "shared", "core", dense.alias("dense"), "rare", "frequent")
    pairs_of = F.expr("flatten(transform(sequence(1, size(frequent)), i -> transform(slice(frequent, i + 1, size(frequent)), y -> xxhash64(1, frequent[i - 1], y))))")
    keys = F.concat(
        F.transform("rare", lambda x: F.struct(F.xxhash64(F.lit(0), x).alias("key"), F.lit(0).alias("kind"))),
        F.transform(F.when(~dense & (F.size("frequent") > 1), pairs_of).otherwise(F.array().cast("array<long>")), lambda x: F.struct(x.alias("key"), F.lit(1).alias("kind"))),
        F.transform("frequent", lambda x: F.struct(F.xxhash64(F.lit(2), x).alias("key"), F.lit(2).alias("kind"))),
    )
    entries = mine.select("cls", "n", "shared", "core", "dense", F.explode(keys).alias("e"))
    share = F.when(F.col("e.kind") == 0, F.col("shared")).otherwise(F.col("core"))
    entries = entries.filter(f"e.kind = 0 OR {DENOMINATOR} * core >= {NUMERATOR} * n")  # who meets in frequent shingles alone shares no others
    entries = entries.select("cls", "n", share.alias("shared"), (F.col("core") / F.col("n")).alias("common"), "dense", "e.key", "e.kind")
    order = F.struct(*(F.col(c).alias(c) for c in ("common", "cls", "n", "shared")))  # who has most in common with many leads
    heads = entries.groupBy("key").agg(F.count("*").alias("size"), F.max(order).alias("l")).filter("size > 1")
    heads = heads.select("key", F.col("l.cls").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.shared").alias("lead_shared"))
    lists = materialise(entries.join(heads, "key"), "lists")

    candidates = lists.select("cls").distinct().join(classes.select("cls", "h1", "h2", "doc_id"), "cls")
    near, _ = divided(rows, F.col("doc_id"), member_filter(candidates, "doc_id"))

    def members(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column(1))
        hashes = [set_hash(s) for s in sets]
        return pa.record_batch([pa.array([x for x, _ in hashes], pa.int64()), pa.array([x for _, x in hashes], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), b.column(0)], ["h1", "h2", "members", "doc_id"])

    found = map_arrow(near, members, "h1 long, h2 long, members binary, doc_id long")
    same = candidates.withColumnRenamed("doc_id", "first_id")
    sets = materialise(found.join(same, ["h1", "h2"]).filter("doc_id <=> first_id").select("cls", "members"), "sets")

    # Round 1: each list's leader and everyone else.
    tried = lists.filter("cls <> lead").filter(_possible("n", "shared", "lead_n", "lead_shared")).select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    links = materialise(_verify(tried, sets), "links")
    labels = connected_components(links)

    def placed(entries: DataFrame) -> DataFrame:
        return entries.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def split_lists(entries: DataFrame) -> DataFrame:
        """Entries of lists that are still in more than one component."""
        open_ = entries.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        return entries.join(open_, "key")

    def joined(links: DataFrame, labels: DataFrame) -> DataFrame:
        """Components after further links between components."""
        of = labels.withColumnRenamed("id", "c")
        a = links.join(of.select(F.col("c").alias("a"), F.col("component").alias("ca")), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
        ab = a.join(of.select(F.col("c").alias("b"), F.col("component").alias("cb")), "b", "left").withColumn("cb", F.coalesce("cb", "b"))
        merged = connected_components(ab.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        seen = labels.select("id", "component").union(ab.select("a", "ca")).union(ab.select("b", "cb")).distinct()
        up = merged.select(F.col("id").alias("component"), F.col("component").alias("further"))
        return materialise(seen.join(up, "component", "left").select("id", F.coalesce("further", "component").alias("component")), "components")

    # Round 2: a second leader from outside the first one's component.
    rest = materialise(split_lists(placed(lists.select("key", "cls", "n", "shared", "common", "dense", "kind", "lead"))), "open-lists")
    if rest.take(1):
        first = labels.select(F.col("id").alias("lead"), F.col("component").alias("lead_component"))
        apart = rest.join(first, "lead", "left").filter("component <> coalesce(lead_component, lead)")
        second = apart.groupBy("key").agg(F.max(F.struct(*(F.col(c).alias(c) for c in ("common", "cls", "n", "shared", "component")))).alias("l"))
        met = rest.join(second, "key").filter("component <> l.component").filter(_possible("n", "shared", "l.n", "l.shared"))
        tried2 = met.select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        links2 = materialise(_verify(tried2, sets), "links")
        if links2.take(1):
            labels = joined(links2, labels)

        # Then all pairs that are still apart. Where a pair shares frequent shingles alone, the masks tell how many of each it does not share.
        rest = materialise(split_lists(placed(rest.drop("component", "lead"))), "open-lists")
        bits = classes.select("cls", *(F.get("mask", F.lit(i)).alias(f"m{i}") for i in range(MASK_WORDS)))
        rest = rest.join(bits, "cls")
        size = rest.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {PIECE}) as int)").alias("pieces"))
        rest = rest.join(size, "key").withColumn("side", F.expr("cast(pmod(xxhash64(cls), pieces) as int)")).withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
        rest = rest.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
        x, y = (rest.select("key", "i", "j", "kind", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "shared", "dense", "component", "side", *(f"m{i}" for i in range(MASK_WORDS))))) for s in "ab")
        alone = {s: " + ".join(f"bit_count(m{i}_{s} & ~m{i}_{t})" for i in range(MASK_WORDS)) for s, t in ("ab", "ba")}
        close = _possible("n_a", f"(shared_a - ({alone['a']}))", "n_b", f"(shared_b - ({alone['b']}))")
        met = x.join(y.drop("kind"), ["key", "i", "j"]).filter("cls_a < cls_b AND component_a <> component_b AND (i = j OR side_a <> side_b)").filter(_possible("n_a", "shared_a", "n_b", "shared_b"))
        still = met.filter(f"kind = 0 OR ((kind = 1 OR dense_a OR dense_b) AND {close})")
        tried3 = still.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct().join(tried.union(tried2), ["a", "b"], "left_anti")
        links3 = materialise(_verify(tried3, sets), "links")
        if links3.take(1):
            labels = joined(links3, labels)
    return texts, classes, labels


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    texts, classes, labels = classes_and_links(df, id_col, text_col)
    of = classes.select("cls", "h1", "h2", F.col("doc_id").alias("first_id")).join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    least = of.filter("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(least, "component", "left").select("h1", "h2", F.coalesce("component_id", "first_id").alias("component_id"))
    out = texts.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of df, all columns, less all but one of each component: that with the smallest doc_id, and of its rows one.

    Decisions are made for each pair of doc_id and set, so rows of one doc_id with unlike texts are told apart; rows without a
    doc_id come last in the choice. Texts with an empty set link with nothing and all stay. Only rows whose doc_id is to go or
    stands more than once are looked at again; the others pass.
    """
    texts, classes, labels = classes_and_links(df)
    of = classes.select("cls", "h1", "h2").join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("h1", "h2", F.coalesce("component", "cls").alias("component"))
    groups = texts.filter("n > 0").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("rows")).join(of, ["h1", "h2"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = groups.groupBy("component").agg(F.min(place).alias("first"))
    told = groups.join(first, "component").select("doc_id", "h1", "h2", "rows", (place == F.col("first")).alias("kept"))
    told = materialise(told, "choices")
    many = materialise(texts.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    key = F.xxhash64("doc_id")
    if not many.take(1):
        return without_members(df, "doc_id", told.filter("NOT kept").select("doc_id"))
    lost = told.filter("NOT kept").join(many, told["doc_id"].eqNullSafe(many["doc_id"]), "left_anti").select("doc_id")
    twice, once = divided(without_members(df, "doc_id", lost), key, member_filter(many.select(key.alias("k")), "k"))
    h1, h2, one = fresh(df, "_h1", "_h2", "_one")

    def named(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [set_hash(x) if len(x) else None for x in shingle_sets(b.column(b.schema.get_field_index("text")))]
        more = [pa.array([x and x[k] for x in sets], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*b.columns, *more], schema=b.schema.append(pa.field(h1, pa.int64())).append(pa.field(h2, pa.int64())))

    known = map_arrow(twice, named, T.StructType([*df.schema.fields, T.StructField(h1, T.LongType()), T.StructField(h2, T.LongType())]))
    empty = known.filter(F.col(h1).isNull()).select(*columns(df))
    choice = told.filter("kept").select(F.col("doc_id").alias(one), F.col("h1").alias(h1), F.col("h2").alias(h2))
    same = F.col("doc_id").eqNullSafe(F.col(one))
    found = known.join(choice, [h1, h2]).filter(same).dropDuplicates([h1, h2]).select(*columns(df))  # one choice for each set at most
    return once.unionByName(empty).unionByName(found)
