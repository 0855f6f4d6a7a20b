"""Intermediate tables: results that several later steps read are written once to the folder that all executors share.

This keeps such results from being computed for each reader, keeps plans small, and survives lost executors. An application's tables
stand in a folder of its own, which is removed when it ends.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one under /tmp, which a local master's tasks share and no others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = "file:///tmp/skein-stages"
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder under the shared one. It goes when the application ends."""
    folder = f"{shared_root(spark)}/skein-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


_made: set[str] = set()


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """stage() for tables that do not depend on one another, planned and run side by side."""
    with ThreadPoolExecutor(min(8, len(tables))) as pool:
        return dict(zip(tables, pool.map(lambda kv: stage(kv[1], kv[0]), tables.items()), strict=True))
