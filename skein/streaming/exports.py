"""Exports as a stream: files of a folder are compressed as they come. A file holds whole conversations, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..plans.compress import compress_levels
from ..sources import exports


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, levels: tuple[str, ...] = ("resume",)) -> StreamingQuery:
    """Reads new files of folder and puts their documents into out, a folder for each level and batch in it.

    A batch that is tried again overwrites what it wrote before. Files over the limit are not loaded and give no documents.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    files = files.filter(F.col("length") <= fixed.MAX_FILE_BYTES).select(F.col("path").alias("file"), F.col("content").cast("string").alias("raw"))

    def put(batch: DataFrame, number: int) -> None:
        documents = compress_levels(exports.parse(batch), levels).withColumn("batch", F.lit(number))
        documents.write.partitionBy("level", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
