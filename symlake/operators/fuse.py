"""Query routing, weighted reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import looks_exact

CONSTANT = 60
#: Weights of exact, full-text and vector search for queries that look exact and for others.
EXACT_WEIGHTS, OTHER_WEIGHTS = (0.70, 0.20, 0.10), (0.25, 0.35, 0.40)
METHODS = ("ripgrep", "fts", "vector")


def route(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """queries with is_exact and the three weights."""
    exact = looks_exact(F.col(text_col))
    out = queries.withColumn("is_exact", exact)
    for k, m in enumerate(METHODS):
        out = out.withColumn(f"{m}_weight", F.when(F.col("is_exact"), EXACT_WEIGHTS[k]).otherwise(OTHER_WEIGHTS[k]))
    return out


def dedupe_key(h: str = "") -> Column:
    """file:start:end where there are lines, else file:symbol, else the id."""
    c = lambda n: F.col(h + n)
    spans = c("file_path").isNotNull() & (c("file_path") != "") & c("line_start").isNotNull() & c("line_end").isNotNull()
    named = (c("file_path") != "") & (c("symbol") != "")
    return F.when(spans, F.concat_ws(":", c("file_path"), c("line_start").cast("string"), c("line_end").cast("string"))).when(named, F.concat_ws(":", c("file_path"), c("symbol"))).otherwise(c("id"))


def fuse(hits: DataFrame, limit: int = 10, digits: int = 9) -> DataFrame:
    """Weighted RRF of hits that carry list_no, rank and weight besides the columns of a hit.

    A key's payload is that of its first list and rank; ties keep that order.  A key that stands twice in one list counts twice.
    """
    payload = ["id", "file_path", "symbol", "content", "source", "retrieval_method", "line_start", "line_end"]
    keyed = hits.withColumn("key", dedupe_key()).withColumn("first", F.struct("list_no", "rank"))
    by = keyed.groupBy("query_id", "key").agg(F.round(F.sum(F.col("weight") / (CONSTANT + F.col("rank"))), digits).alias("score"), F.min("first").alias("first"), F.min_by(F.struct(*payload), "first").alias("hit"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    top = by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.select("query_id", "rank", "hit.id", "score", "hit.file_path", "hit.symbol", "hit.content", "hit.source", "hit.retrieval_method", "hit.line_start", "hit.line_end")


def hybrid(queries: DataFrame, lists: dict[str, DataFrame], limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(fused hits, counts): lists has the hits of each method, in the order of METHODS; a method that is missing counts 0.

    counts: query_id, method, n of the raw hits.
    """
    weights = route(queries).select("query_id", *[f"{m}_weight" for m in METHODS])
    parts = [h.select("query_id", "rank", "id", "file_path", "symbol", "content", "source", "retrieval_method", "line_start", "line_end", F.lit(METHODS.index(m)).alias("list_no"), F.lit(m).alias("method")) for m, h in lists.items()]
    raw = reduce(DataFrame.unionByName, parts)
    weight = F.when(F.col("list_no") == 0, F.col("ripgrep_weight")).when(F.col("list_no") == 1, F.col("fts_weight")).otherwise(F.col("vector_weight"))
    fused = fuse(raw.join(weights, "query_id").withColumn("weight", weight), limit)
    every = queries.select("query_id").withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    counts = every.join(raw.groupBy("query_id", "method").agg(F.count("*").alias("n")), ["query_id", "method"], "left").select("query_id", "method", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return fused, counts
