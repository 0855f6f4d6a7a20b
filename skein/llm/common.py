"""Helpers shared by the training-data operators: table access, Arrow batch maps, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stages import run_folder

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker; long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1000, 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Sets the size limits of Arrow batches for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system at the end of a task; a worker process is used again by later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _lean() -> None:
    """Arrays of a megabyte or more go back to the system as soon as they are freed, and threads share two heaps: a worker's peak is what it uses."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # fixed values: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)


_lean()


def trim_driver(spark: SparkSession) -> None:
    """Returns to the system what the driver's JVM has freed outside its heap: its allocator keeps room for each of the hundreds of threads of a large plan. Nothing where the JVM lacks the command."""
    jvm = spark._jvm
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        (call,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow for functions that turn one batch into at most one batch. Columns may have names that mapInArrow does not take."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(pa.RecordBatch.from_arrays(b.columns, names=names))) is not None:
                yield out
        give_back()

    bounded_batches(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the application's own one in spark.checkpoint.dir, which all executors see; it goes with the application."""
    return f"{run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows to a Parquet table in the shared folder and reads them back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as the empty text."""
    return pc.fill_null(batch.column(name), "").to_pylist()


def word_table(column: pa.Array, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Splits lower-cased (A-Z only) texts into words: (offsets of each text's words, code of each word, distinct words).

    Without pattern, words are runs of anything but ASCII white space (\\x20, \\x09-\\x0D); else pattern matches what separates them.
    """
    low = pc.ascii_lower(pc.fill_null(column, ""))
    lists = pc.ascii_split_whitespace(low) if pattern is None else pc.split_pattern_regex(low, pattern)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets.astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; empty segments give 0. Sums along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def null_first(name: str):
    return F.col(name).asc_nulls_first()


#: Bits of a member filter: 16 MB at most, whatever the input.
FILTER_BITS = 1 << 27


def _bit(col):
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)) + 1


def member_filter(ids: DataFrame, name: str) -> DataFrame:
    """A bit set of the ids in column name, as rows (bucket, bits) of 32,768 bits each: at most FILTER_BITS bits in all, so it may be broadcast."""
    bit = _bit(F.col(name))
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with low lines at their ends as far as df has columns called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def flag_members(df: DataFrame, key: Column, members: DataFrame, flag: str) -> DataFrame:
    """df with the new column flag: true for rows whose key is in the filter, and for a few more, more of them as the filter fills up. No shuffle."""
    bucket, at, bits = fresh(df, f"{flag}_bucket", f"{flag}_at", f"{flag}_bits")
    bit = _bit(key)
    marks = F.broadcast(members.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits)))
    hit = df.withColumn(bucket, F.bitmap_bucket_number(bit)).withColumn(at, F.bitmap_bit_position(bit)).join(marks, bucket, "left")
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    return hit.select(*columns(df), F.expr(f"coalesce(getbit({byte}, cast({at} % 8 as int)) = 1, false)").alias(flag))


def divided(df: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df that flag_members() marks, all others)."""
    (flag,) = fresh(df, "_maybe")
    flagged = flag_members(df, key, members, flag)
    return flagged.filter(flag).drop(flag), flagged.filter(f"NOT {flag}").drop(flag)


def without_members(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose column name is none of ids' (column name, without nulls). Only rows that the bit filter marks are shuffled."""
    maybe, sure = divided(df, F.col(name), member_filter(ids, name))
    return sure.unionByName(maybe.join(ids.select(name).distinct(), name, "left_anti").select(*columns(df)))
