"""Helpers that the operators of this subpackage share.

Inputs are DataFrames.  Every operator selects the columns it needs by name and
returns only columns of its own, so extra or clashing columns never matter.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handed to a Python worker at once.  Texts can be long, so a batch is also bound by bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (the path may be one only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    A lost executor costs nothing here: the files are Parquet in shared storage.
    drop() removes them once the results that need them are written; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/symlake-{uuid.uuid4().hex}"
        self.n = 0
        self._fs, self._path = hadoop_path(spark, self.root)
        self._fs.deleteOnExit(self._path)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A result written to the shared folder, where it stays until the session ends; what it was made from may go."""
    return Scratch(spark).write(df)


def as_bytes(name: str = "text") -> F.Column:
    """A string column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("binary")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns (or to several of them)."""
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(b)
            for x in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(x[k.name], k.type) for k in target], schema=target)

    return df.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """True for the rows no label may be learnt from: crc32 of the id as text is divisible by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def spread(df: DataFrame, floor: int = 1) -> int:
    """Shuffle partitions the session asks for."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished phases (it acts when the JVM collects garbage)."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
