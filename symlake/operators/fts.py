"""Full-text search: BM25 over tokens of one or more columns, phrases included.

A query is the OR of its identifier tokens; a token that holds underscores is a phrase
of its parts.  AND, OR and NOT are ordinary terms.  The score is negated, so that the
best rows come first in ascending order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import merged

#: Letters with marks and the letters that they are indexed as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
K1, B, FLOOR = 1.2, 0.75, 1e-6


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_phrases(query: Column) -> Column:
    """An array of phrases, each an array of index tokens; digits alone are no identifier and are left out."""
    idents = F.regexp_extract_all(query, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.filter(F.transform(idents, index_tokens), lambda p: F.size(p) > 0)


def stored(rows: DataFrame, id_col: str, columns: list[str], terms: list[str] | None = None) -> DataFrame:
    """Postings as an index keeps them: id, dl (tokens in all columns), col, term, positions; with `terms` of these alone.

    Each row's tokens are sorted where they are, so nothing is dealt out; rows of one id give postings each.
    """
    ids = rows.schema[id_col].dataType.simpleString()
    wanted = None if terms is None else pa.array(terms, pa.string())
    names = ["id", "dl", "col", "term", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            dl = sum((pc.list_value_length(b.column(k + 1)).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(columns))), np.zeros(b.num_rows, np.int64))
            for k in range(len(columns)):
                row, pos, code, words = coded(b.column(k + 1))
                if wanted is not None:
                    ok = pc.is_in(words, wanted).to_numpy(zero_copy_only=False)[code]
                    row, pos, code = row[ok], pos[ok], code[ok]
                order, starts = runs(row * max(1, len(words)) + code)
                first = order[starts]
                for at in range(0, len(first), ROWS):
                    one = first[at : at + ROWS]
                    begin, end = starts[at], starts[at + ROWS] if at + ROWS < len(starts) else len(order)
                    offsets = np.append(starts[at : at + ROWS], end) - begin
                    places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pos[order[begin:end]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[one])), pa.array(dl[row[one]]), pa.array(np.full(len(one), k), pa.int32()), words.take(pa.array(code[one])).cast(pa.string()), places], names)

    tokens = rows.select(F.col(id_col).alias("id"), *[index_tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])
    return tokens.mapInArrow(run, f"id {ids}, dl long, col int, term string, positions array<int>")


#: Rows that go back to the JVM at once, and rows that are sorted at once.
ROWS, SORTED = 20_000, 2_000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SORTED):
            yield b.slice(at, SORTED)


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place and code of each item of a column of lists of strings, and the strings by code."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    items = lists.flatten().dictionary_encode()
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), items.indices.to_numpy(zero_copy_only=False).astype(np.int64), items.dictionary


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that lays equal keys together and leaves them as they stand, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    return order, np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1])) if len(keys) else np.zeros(0, np.int64)


def pairs(texts: DataFrame, column: str) -> DataFrame:
    """phrase, docs, places: two tokens in a row, the rows that hold them and the times that they stand there, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            row, _, code, words = coded(b.column(0))
            if len(row) < 2:
                continue
            together = row[1:] == row[:-1]
            row, pair = row[1:][together], (code[:-1] * len(words) + code[1:])[together]
            order, starts = runs(pair)
            places = np.diff(np.append(starts, len(order)))
            rows_ = row[order]  # rising within a pair
            new = np.append(True, rows_[1:] != rows_[:-1]) if len(rows_) else np.zeros(0, bool)
            new[starts] = True
            docs = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else starts
            one = pair[order[starts]]
            phrase = pc.binary_join_element_wise(words.take(pa.array(one // len(words))).cast(pa.string()), words.take(pa.array(one % len(words))).cast(pa.string()), " ")
            for at in range(0, len(one), ROWS):
                yield pa.RecordBatch.from_arrays([phrase[at : at + ROWS], pa.array(docs[at : at + ROWS]), pa.array(places[at : at + ROWS].astype(np.int64))], ["phrase", "docs", "places"])

    some = texts.select(index_tokens(F.col(column)).alias("t")).mapInArrow(run, "phrase string, docs long, places long")
    return some.groupBy("phrase").agg(F.sum("docs").alias("docs"), F.sum("places").alias("places"))


def lengths(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id, dl: tokens in all indexed columns."""
    total = sum((F.size(index_tokens(F.col(c))) for c in columns), F.lit(0))
    return rows.select(F.col(id_col).alias("id"), total.cast("long").alias("dl"))


def scores(queries: DataFrame, rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """query_id, id, score of every row that a query matches; queries: query_id, text."""
    corpus = lengths(rows, id_col, columns).agg(F.count("*").cast("double").alias("total"), F.avg("dl").alias("avgdl"))
    return scored(queries, lambda terms: stored(rows, id_col, columns, terms), rows, corpus)


def stored_scores(queries: DataFrame, post: DataFrame, rows: DataFrame) -> DataFrame:
    """The same over stored postings; rows: the indexed rows, of which only the number is read."""
    tokens = post.agg(F.sum(F.size("positions")).alias("n"))
    corpus = rows.agg(F.count("*").cast("double").alias("total")).join(tokens).select("total", F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")).alias("avgdl"))
    return scored(queries, lambda terms: post, rows, corpus)


#: Terms of all queries that are held against the scan of postings, and rows that are brought to all tasks; more of them
#: meet by a join of both sides.  Pairs of a query and a row that a task adds up.
FEW, PAIRS = 100_000, 2_000_000


def scored(queries: DataFrame, postings: Callable[[list[str] | None], DataFrame], rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, id, score from postings (of the terms, where they are few) and corpus (one row: total, avgdl).

    Only postings of wanted terms leave the scan.  Where the terms of queries are few, postings are dealt by row, so that
    a row's scores for all queries are added up in one place; where queries are many and postings few, it is the other
    way round.  There are as many places as keep the pairs of each below a bound.
    """
    asked = queries.select("query_id", F.explode(query_phrases(F.col("text"))).alias("phrase")).withColumn("key", F.array_join("phrase", " "))
    wanted = asked.groupBy("key").agg(F.first("phrase").alias("phrase"))
    terms = wanted.select("key", F.size("phrase").alias("n"), F.posexplode("phrase").alias("at", "term"))
    size = terms.agg(F.count("*").alias("terms"), F.count_distinct("key").alias("keys"), F.max("n").alias("longest")).first()
    known = size.terms <= FEW
    few = F.broadcast if known else merged
    post = postings([r.term for r in terms.select("term").distinct().collect()] if known else None)
    found = post.join(few(terms.where("n = 1").select("key", "term")), "term").select("id", "dl", "key", F.size("positions").cast("long").alias("f"))
    if (size.longest or 1) > 1:
        # a phrase stands where all of its terms stand in a row within one column
        at = post.join(few(terms.where("n > 1")), "term").withColumn("pos", F.explode("positions"))
        starts = at.groupBy("id", "dl", "key", "n", "col", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("k")).where("k = n")
        found = found.unionByName(starts.groupBy("id", "dl", "key").agg(F.count("*").alias("f")))
    times = asked.groupBy("query_id", "key").agg(F.count("*").alias("times"))
    n_rows, n_queries, n_times = rows.count(), queries.count(), asked.count()
    places = n_rows * n_queries // PAIRS
    places = max(places, spark_partitions(queries)) if places else 0
    by = lambda df, *cols: df.repartition(places, *cols) if places else df.repartition(*cols)
    by_query = n_times > FEW and n_rows * size.keys <= FEW
    found = (found if by_query or n_times > FEW else by(found, "id")).groupBy("id", "dl", "key").agg(F.sum("f").alias("f"))
    idf = found.groupBy("key").agg(F.count("*").alias("n")).join(corpus).select("key", F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR)).alias("idf"), "avgdl")
    part = F.col("times") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    if by_query:
        weights = found.join(F.broadcast(idf), "key").select("id", "key", "idf", "f", "dl", "avgdl")
        met = by(times, "query_id").join(F.broadcast(weights), "key")
    elif n_times > FEW:
        met = by(found.join(merged(times.join(merged(idf), "key")), "key"), "query_id", "id")
    else:
        met = found.join(F.broadcast(times.join(idf, "key")), "key")
    return met.groupBy("query_id", "id").agg((-F.sum(part)).alias("score"))


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 1)


def search(queries: DataFrame, rows: DataFrame, id_col: str, columns: list[str], limit: int = 10, digits: int = 6) -> DataFrame:
    """query_id, rank, id, score: the best rows of each query, ties to the smaller id."""
    return best(scores(queries, rows, id_col, columns), limit, digits)


def best(found: DataFrame, limit: int = 10, digits: int = 6) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


#: The columns of chunks that are indexed.
CHUNK_COLUMNS = ["unit_type", "symbol_qualified_name", "file_path", "content", "profile"]


def chunk_hits(queries: DataFrame, chunks: DataFrame, limit: int = 10, post: DataFrame | None = None) -> DataFrame:
    """Search hits over a chunks table, from its stored postings where there are any; the hits' score is 1, BM25 only orders them."""
    found = scores(queries, chunks, "id", CHUNK_COLUMNS) if post is None else stored_scores(queries, post, chunks)
    top = best(found, limit).drop("score")
    return top.join(chunks, "id").select("query_id", "rank", "id", F.lit(1.0).alias("score"), "file_path", F.col("symbol_qualified_name").alias("symbol"), "content", F.lit("sqlite").alias("source"), F.lit("fts").alias("retrieval_method"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
