"""Vector search: exact cosine top-k for a batch of queries, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import merged

VECTORS, QUERIES = 2048, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def of_dimension(vec: Column, dimension: int) -> Column:
    """The vector; one of another dimension is an error."""
    said = F.concat(F.lit(f"a vector of dimension {dimension} is expected, not of "), F.size(vec).cast("string"))
    return F.when(F.size(vec) == dimension, vec).otherwise(F.raise_error(said).cast("array<float>"))


def _blocks(rows: DataFrame, n: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows of (id, vec) in n blocks, each of one dimension: number, dimension, list of rows."""
    usable = rows.where(F.col("vec").isNotNull() & (F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)) > 0))
    no, dim, packed = names
    return usable.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(no), F.size("vec").alias(dim)).agg(F.collect_list(F.struct("id", F.col("vec").cast("array<double>").alias("vec"))).alias(packed))


def search(queries: DataFrame, vectors: DataFrame, limit: int = 10, dimension: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, id, score; queries: query_id, vec; vectors: id, vec.  Ties go to the smaller id.

    Both sides are packed into blocks of a bounded number of vectors; each block of queries meets each block of
    vectors of its dimension once, by an equi-join on block numbers, and at most `limit` rows of a query and a pair of
    blocks (more only on ties) go on to the ranking.
    """
    if dimension is not None:
        vectors = vectors.where(F.col("vec").isNotNull()).withColumn("vec", of_dimension(F.col("vec"), dimension))
    numbers = max(1, -(-vectors.count() // VECTORS))
    v = _blocks(vectors.select("id", "vec"), numbers, ("block", "dim", "vs"))
    q = _blocks(queries.select(F.col("query_id").alias("id"), "vec"), max(1, -(-queries.count() // QUERIES)), ("qblock", "dim", "qs"))
    # blocks are large, and those of queries grow with the queries: they are dealt and merged, not broadcast
    pairs = v.join(merged(q.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))), ["block", "dim"])
    schema = "query_id long, id long, score double"
    target = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit vectors of a block, from Arrow's flat values."""
        ids = rows.field("id").to_numpy(zero_copy_only=False)
        m = rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        return ids, m / np.sqrt((m * m).sum(1))[:, None]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                (vid, vm), (qid, qm) = matrix(b["vs"][k].values), matrix(b["qs"][k].values)
                s = np.round(qm @ vm.T, digits) + 0.0
                least = np.partition(s, s.shape[1] - limit, axis=1)[:, s.shape[1] - limit] if s.shape[1] > limit else np.full(len(s), -2.0)
                row, col = np.nonzero(s >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(vid[col]), pa.array(s[row, col])], schema=target)

    found = pairs.select("vs", "qs").mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def sparse_search(queries: DataFrame, vectors: DataFrame, limit: int = 10, digits: int = 6) -> DataFrame:
    """The same over sparse unit vectors (id, idx, value): an equi-join on the places."""
    q = queries.select(F.col("id").alias("query_id"), "idx", F.col("value").alias("qv"))
    s = vectors.join(q, "idx").groupBy("query_id", "id").agg(F.round(F.sum(F.col("value") * F.col("qv")), digits).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def chunk_hits(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Search hits of found rows (query_id, rank, id, score) with the payload of the vectors table."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.join(vectors, "id").select("query_id", "rank", "id", "score", text("file_path"), text("symbol"), text("content"), F.lit("vector").alias("source"), F.lit("vector").alias("retrieval_method"), "line_start", "line_end")
