"""Sentence ranking by a random walk over term similarity, and summaries within a size.

The walk iterates over the similarities of one text's sentences, which column expressions do not hold: a vectorised function over
Arrow batches takes the sentences and their terms, both split natively.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions import fixed
from ..functions import text as T


def walk(terms: list[list[str]]) -> np.ndarray:
    """Scores of sentences from their terms, by nine digits, so that equal sentences tie.

    A step goes from sentences to terms and back: with u the weight of a term in a sentence of length one, the similarities of i to
    all others sum to u_i . sum(u) - u_i . u_i, and the same holds for scores spread over them. So memory and time follow the words
    of a text, not the square of its sentences.
    """
    n = len(terms)
    if n < 2:
        return np.ones(n)
    rows = np.repeat(np.arange(n), [len(ts) for ts in terms])
    _, columns = np.unique(np.array([t for ts in terms for t in ts] or [""]), return_inverse=True)
    columns = columns[: len(rows)]
    many = int(columns.max()) + 1 if len(rows) else 1
    pair, tf = np.unique(rows * many + columns, return_counts=True)
    rows, columns = pair // many, pair % many
    held = np.bincount(columns, minlength=many)
    weight = tf * (np.log(n / (1 + held[columns])) + 1)
    length = np.sqrt(np.bincount(rows, weight * weight, n))
    unit = np.divide(weight, length[rows], out=np.zeros(len(rows)), where=length[rows] > 0)
    own = np.bincount(rows, unit * unit, n)
    spread = lambda x: np.bincount(rows, unit * np.bincount(columns, unit * x[rows], many)[columns], n) - own * x
    out = spread(np.ones(n))
    alone = out <= 1e-12 * n
    scores = np.ones(n)
    for _ in range(fixed.MAX_ITERATIONS):
        given = np.divide(scores, out, out=np.zeros(n), where=~alone)
        following = 1 - fixed.DAMPING + fixed.DAMPING * spread(given)
        delta = np.abs(following - scores).sum()
        scores = following
        if delta < fixed.TOLERANCE:
            break
    return scores.round(9)


def units(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def within(sentences: list[str], scores: np.ndarray, most: int) -> str:
    """The best sentences that fit, in the order of the text."""
    used, picked = 0, []
    for i in np.argsort(-scores, kind="stable"):
        cost = units(sentences[i]) + 1
        if used + cost <= most:
            picked.append(i)
            used += cost
    return " ".join(sentences[i] for i in sorted(picked))


@F.pandas_udf(ArrayType(DoubleType()))
def _walk(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: walk([list(t) for t in ts]))


def rank(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, score)."""
    said = df.select(key, T.sentences(F.col(text)).alias("s"))
    scored = said.withColumn("scores", _walk(F.transform("s", lambda x: T.terms(F.lower(x)))))
    return scored.select(key, F.posexplode(F.arrays_zip(F.col("s"), F.col("scores"))).alias("idx", "x")).select(key, "idx", F.col("x.s").alias("sentence"), F.col("x.scores").alias("score"))


def summary_column(text: Column, most: int) -> Column:
    """The text if it fits, else a summary of whole sentences, else its beginning."""

    @F.pandas_udf(StringType())
    def best(sentences: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([within(list(s), walk([list(t) for t in ts]), most) for s, ts in zip(sentences, terms, strict=True)])

    short = T.length(text) <= most
    said = F.when(short, F.array().cast("array<string>")).otherwise(T.sentences(text))
    made = best(said, F.transform(said, lambda x: T.terms(F.lower(x))))
    return F.when(short, text).when(made != "", made).otherwise(T.head(text, most))


def summarize(df: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """(key, summary): the top best sentences in the order of the text."""
    from pyspark.sql.window import Window

    ranked = rank(df, key, text).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "idx"))).filter(F.col("_r") <= top)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
