"""Incremental indexing: a stream of changed files, each micro-batch indexed as a batch of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..indexing import index_files
from ..sources.store import Store

CHANGES = "path string, language string, content string, version long"


def changes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of changed files from JSON lines that arrive in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """path, language, content, version: of several versions of a path the last."""
    w = Window.partitionBy("path").orderBy(F.desc("version"))
    return batch.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "language", "content", "version")


def newer(batch: DataFrame, indexed: DataFrame) -> DataFrame:
    """The rows of a batch that no later version of their path has been indexed before."""
    known = indexed.select("path", F.coalesce("version", F.lit(-1)).alias("known"))
    return batch.join(known, "path", "left").where(F.col("known").isNull() | (F.coalesce("version", F.lit(-1)) >= F.col("known"))).drop("known")


def maintain(stream: DataFrame, settings: Settings, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps an index up to date; writing a batch twice after a failure gives the same tables, as all writes are by key or by file."""

    def write(batch: DataFrame, _: int) -> None:
        rows = newer(latest(batch), Store(batch.sparkSession, settings.index_path).read("files")).persist()
        try:
            if not rows.isEmpty():
                index_files(batch.sparkSession, rows, settings)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
