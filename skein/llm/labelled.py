"""Labelled samples for the classifiers: folds, the bounded training sample, collected features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow

#: Labelled documents that a model is fitted on at most, and bytes of their features: those whose hash is smallest.
MAX_TRAINING, MAX_FEATURE_BYTES = 8000, 128 << 20


def held_out(name: str = "doc_id"):
    """True for the fold that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int = MAX_TRAINING) -> DataFrame:
    """At most most rows (doc_id, y) outside the held-out fold; one row per document, contradicting labels give the larger one."""
    rows = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def collect_features(docs: DataFrame, labels: DataFrame, extract, dtype: str | np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, features, labels) of the sample on the driver, by doc_id. extract(texts array) gives one numpy array per text.

    The sample ends, in the order of hashes, before its features exceed their bound in bytes; the window sees at most MAX_TRAINING rows.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "y")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("doc_id"), b.column("y"), pa.array([x.tobytes() for x in extract(b.column("text"))], pa.binary())], ["doc_id", "y", "features"])

    made = map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, features binary")
    up_to = F.sum(F.octet_length("features")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = made.withColumn("up_to", up_to).filter(F.col("up_to") <= MAX_FEATURE_BYTES).drop("up_to").toArrow().sort_by("doc_id")
    packed, y = got["features"].combine_chunks(), got["y"].to_numpy().astype(np.float64)
    if not len(y):
        return np.zeros(1, np.int64), np.zeros(0, dtype), y
    packed = packed.cast(pa.large_binary()) if isinstance(packed, pa.Array) else packed.chunk(0).cast(pa.large_binary())
    _, places, data = packed.buffers()
    places = np.frombuffer(places, dtype="<i8")[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]].tobytes() if data is not None else b""
    return (places - places[0]) // np.dtype(dtype).itemsize, np.frombuffer(flat, dtype=dtype), y


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
