"""Mixing sources to target weights by temperature, with DataFrame functions alone.

Each source's share of all tokens is raised to an exponent and normalised. The exponent is bisected: to the largest one whose
weights reach a target entropy, or to the smallest one at which no source is repeated more often than a limit. Weights times the
token budget give each source's quota. A quota is realised as whole passes over the source and a part of one more: documents are
dealt into blocks by a hash, the blocks follow one another in hash order (a permutation that costs no sort), and the last pass
takes whole blocks until the quota ends inside one, which alone is walked document by document.

Tokens are runs of anything but ASCII white space; null texts have none. A null source is a source of its own. Sources without
any token have weight 0 and their documents are taken once. A document is in the last pass while the tokens before it are below
the quota. Equal ids and texts share their place in the order: all of them are taken or none. Without rows there is no result.
Other columns pass through draw() unchanged and are ignored by plan().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, materialise

#: Documents that a block holds on average, bisection steps, and rows of the table of sources that may be broadcast.
BLOCK_DOCUMENTS, STEPS, MOST_BROADCAST = 1024, 48, 100_000


@dataclass(frozen=True)
class Target:
    """entropy: wanted entropy as a share of the largest possible. repeats: most passes over a source. One of them is given.

    budget: tokens to draw, as a multiple of all tokens; None: as many as give every source one whole pass at least.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: float | None = 1.0
    seed: int = 0


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))


def _most(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: F.greatest(a, f(x)))


def _budget(shares: Column, alpha: Column, target: Target) -> Column:
    """Tokens to draw, as a multiple of all tokens."""
    if target.budget is not None:
        return F.lit(float(target.budget))
    return _most(shares, lambda p: F.pow(p, 1 - alpha)) * _sum(shares, lambda p: F.pow(p, alpha))


def _exponent(shares: Column, target: Target) -> Column:
    """The bisected exponent between 0 (equal weights) and 1 (the corpus as it is)."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        z = _sum(shares, lambda p: F.pow(p, mid))
        if target.entropy is not None:
            reached = F.log(z) - mid * _sum(shares, lambda p: F.pow(p, mid) * F.log(p)) / z >= F.lit(float(target.entropy)) * F.log(F.size(shares).cast("double"))
            return F.struct(F.when(reached, mid).otherwise(s["lo"]).alias("lo"), F.when(reached, s["hi"]).otherwise(mid).alias("hi"))
        within = _most(shares, lambda p: F.pow(p, mid - 1)) / z * _budget(shares, mid, target) <= F.lit(float(target.repeats))
        return F.struct(F.when(within, s["lo"]).otherwise(mid).alias("lo"), F.when(within, mid).otherwise(s["hi"]).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return ends["lo"] if target.entropy is not None else ends["hi"]


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def _place(seed: int) -> list[Column]:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return [digest.alias("_order"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("_hash")]


def weights(sized: DataFrame, target: Target) -> DataFrame:
    """Per source: tokens, share, exponent, weight, quota, passes (whole ones), rest (tokens of the last one), blocks. sized: (_source, _n).

    The shares of all sources stand in one array while the exponent is bisected: sources are counted in thousands, not with the rows.
    """
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("give either an entropy or a limit of repeats")
    per = sized.groupBy("_source").agg(F.sum("_n").alias("tokens"), F.count("*").alias("documents"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("_source", "tokens", "documents"))).alias("all"), F.sum("tokens").alias("total"))
    shares = F.transform(F.filter("all", lambda x: x["tokens"] > 0), lambda x: x["tokens"] / F.col("total"))
    one = one.withColumn("shares", shares)
    one = one.withColumn("exponent", F.when(F.size("shares") > 0, _exponent(F.col("shares"), target)))
    one = one.select("all", "total", "exponent", _sum(F.col("shares"), lambda p: F.pow(p, F.col("exponent"))).alias("z"), (_budget(F.col("shares"), F.col("exponent"), target) * F.col("total")).alias("budget"))
    out = one.select("total", "exponent", "z", "budget", F.inline("all"))
    share = F.col("tokens") / F.col("total")
    out = out.withColumn("share", F.when(F.col("tokens") > 0, share).otherwise(0.0))
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", "exponent") / F.col("z")).otherwise(0.0))
    out = out.withColumn("quota", F.col("weight") * F.coalesce("budget", F.lit(0.0)))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1)
    out = out.withColumn("passes", whole.cast("long"))
    out = out.withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens"))).otherwise(0.0))
    out = out.withColumn("rest", F.when(F.col("rest") > 1e-6 * F.col("tokens"), F.col("rest")).otherwise(0.0))
    return out.withColumn("blocks", F.ceil(F.col("documents") / BLOCK_DOCUMENTS).cast("long")).select("_source", "tokens", "documents", "share", "exponent", "weight", "quota", "passes", "rest", "blocks")


def _beside(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df joined with the table of sources: broadcast while that has few rows, else shuffled (skewed partitions are split at run time)."""
    return df.join(F.broadcast(sources) if _few(sources) else sources, "_source")


def _few(sources: DataFrame) -> bool:
    return sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _cut(parts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """parts (keys, _source, rest, before, place, n) less all but those in which the rest of their source ends, with before: the tokens ahead of them."""
    ahead = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter("before < rest AND before + n >= rest")


def cuts(sized: DataFrame, target: Target) -> DataFrame:
    """weights() with cut_block and cut_order: the place in each source's order up to which the last pass goes. sized: (_source, _n, _order, _hash).

    The place is sought among groups of blocks, then among the blocks of one group, then among the documents of one block, so
    that no task holds all blocks of a source.
    """
    per = weights(sized, target)
    placed = _beside(sized, per.select("_source", "blocks", "rest").filter("rest > 0")).withColumn("block", F.expr("pmod(_hash, blocks)"))
    blocks = placed.groupBy("_source", "block", "rest").agg(F.sum("_n").alias("n")).withColumn("part", F.expr(f"block div {BLOCK_DOCUMENTS}"))
    parts = _cut(blocks.groupBy("_source", "part", "rest").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("long")), ["_source"], "part")
    part = parts.groupBy("_source").agg(F.min(F.struct("part", "before")).alias("c")).select("_source", F.col("c.part").alias("part"), F.col("c.before").alias("before"))
    cut = _cut(blocks.join(F.broadcast(part) if _few(part) else part, ["_source", "part"]), ["_source"], "block")
    cut = cut.groupBy("_source").agg(F.min(F.struct("block", "before")).alias("c")).select("_source", F.col("c.block").alias("cut_block"), F.col("c.before").alias("cut_before"))
    inside = _beside(placed, cut).filter("block = cut_block").groupBy("_source", "_order", "rest", "cut_before").agg(F.sum("_n").alias("n"))
    within = Window.partitionBy("_source").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("at", F.col("cut_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).filter("at < rest").groupBy("_source").agg(F.max("_order").alias("cut_order"))
    return per.join(cut.select("_source", "cut_block"), "_source", "left").join(last, "_source", "left")


def size(df: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, _source, _n, _order, _hash) of each document, written once: the one pass that counts tokens."""
    return materialise(df.select("doc_id", "source", _key("source").alias("_source"), tokens("text").alias("_n"), *_place(seed)), "sizes")


def decide(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with weight, passes, block and copies (how often each document is drawn). df has _source, _order, _hash; table is cuts()."""
    out = _beside(df, table).withColumn("block", F.expr("pmod(_hash, blocks)"))
    taken = (F.col("rest") > 0) & ((F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & (F.col("_order") <= F.col("cut_order"))))
    return out.withColumn("copies", F.col("passes") + F.coalesce(taken, F.lit(False)).cast("long"))


def plan(df: DataFrame, target: Target) -> DataFrame:
    """Per document: doc_id, source, n_tokens, weight, passes, block, copies."""
    sized = size(df, target.seed)
    out = decide(sized, cuts(sized, target))
    return out.select("doc_id", "source", F.col("_n").alias("n_tokens"), F.round("weight", 9).alias("weight"), "passes", "block", "copies")


def draw(df: DataFrame, target: Target) -> DataFrame:
    """df's rows as often as they are drawn, all columns. Texts are not shuffled."""
    table = cuts(size(df, target.seed), target)
    held = df.select(F.struct(*columns(df)).alias("_row"), _key("source").alias("_source"), *_place(target.seed))
    out = decide(held, table).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


#: The registered query's target: 98 percent of the largest entropy, as many tokens as there are.
QUERY_TARGET = Target(entropy=0.98)

ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents),
per AS (SELECT k, sum(n)::BIGINT AS tokens, count(*) AS documents FROM sized GROUP BY k),
shares AS (SELECT k, tokens / (SELECT sum(tokens) FROM per) AS p FROM per WHERE tokens > 0),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= t THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (b.lo + b.hi) / 2))) - (b.lo + b.hi) / 2 * sum(pow(p, (b.lo + b.hi) / 2) * ln(p)) / sum(pow(p, (b.lo + b.hi) / 2)) FROM shares) AS h,
               (SELECT {QUERY_TARGET.entropy} * ln(count(*)) FROM shares) AS t FROM bisect b WHERE i < {STEPS})),
w AS (
  SELECT per.k, tokens, documents, coalesce(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, (SELECT lo AS a FROM bisect WHERE i = {STEPS})), 0) AS weight
  FROM per LEFT JOIN shares USING (k), (SELECT lo AS a FROM bisect WHERE i = {STEPS})),
q AS (SELECT *, weight * (SELECT sum(tokens) FROM per) AS quota, ceil(documents / {BLOCK_DOCUMENTS}.0)::BIGINT AS blocks FROM w),
r AS (SELECT *, CASE WHEN tokens > 0 THEN floor(quota / tokens + 1e-9)::BIGINT ELSE 1 END AS passes FROM q),
s AS (SELECT *, CASE WHEN tokens > 0 AND quota - passes * tokens > 1e-6 * tokens THEN quota - passes * tokens ELSE 0 END AS rest FROM r),
placed AS (SELECT sized.*, weight, passes, rest, ('0x' || o[1:8])::BIGINT % blocks AS block FROM sized JOIN s USING (k)),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY block, o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n) OVER (PARTITION BY k, block, o) AS before FROM placed)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, passes, block, passes + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM run
"""
