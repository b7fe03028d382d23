"""Exact top-k search by inner product, in buckets of vectors of like length.

Vectors are made integer (floor of 256 x), equal ones are put together, and the
distinct ones are sorted by length into buckets of a bounded number of vectors.  The
longest vectors, FIRST of them at most, are sent to the queries and give each a lower
bound of its k-th score.  Divided by the query's length that is the shortest vector
worth looking at: queries are sorted by it into blocks, and a block goes only to the
buckets of vectors that are long enough for one of its queries.  In a bucket the bound,
divided by the lengths, is a cosine threshold: where it is low only the length prunes
and a block's products are one matrix product, where it is high the query's largest
coordinates prune as well; the products of what remains are computed exactly.

Defined results: vectors that are null or hold null, NaN or infinite components take
no part, nor do rows without a vec_id; a component whose 256-fold is beyond a double
counts as the largest double; a score beyond a long counts as the largest or smallest
long; vectors of different dimension never meet; ties go to the smaller vec_id; a
query's own vec_id is never in its list; fewer candidates than k give shorter lists;
rows that repeat a vec_id and a vector count once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, _arrow, map_batches, settled, tuned

BUCKET, BLOCK, FIRST = 4096, 256, 4096
#: Blocks that meet a bucket in one task; a bucket of more blocks goes to several tasks.
MEET = 64
#: Ranges of lengths that blocks are cut by.
CUTS = 1024
#: From this cosine threshold on, a bucket is pruned by coordinates; so many of them are looked at.
COORD_FROM, FOCUS = 0.5, 3


def _integers(values: list) -> bytes | None:
    """floor(256 x), whole numbers as doubles; None for a vector that takes no part."""
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        return (np.clip(np.floor(256 * x), -sys.float_info.max, sys.float_info.max) + 0.0).astype("<f8").tobytes()


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec (packed whole numbers), norm (length) of the vectors that take part."""
    tuned(df.sparkSession)

    def run(b):
        packed = [_integers(v) for v in b["vec"].to_pylist()]
        ids = b["vec_id"].to_pylist()
        ok = [k for k, p in enumerate(packed) if p is not None and ids[k] is not None]
        return {"vec_id": [ids[k] for k in ok], "vec": [packed[k] for k in ok], "norm": [float(lengths(np.frombuffer(packed[k], "<f8")[None])[0]) for k in ok]}

    return map_batches(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")), run, "vec_id long, vec binary, norm double")


def lengths(vecs: np.ndarray) -> np.ndarray:
    """Lengths of rows, also where squares are beyond a double."""
    most = np.maximum(np.abs(vecs).max(1, initial=0.0), 1e-300)
    return most * np.sqrt(np.square(vecs / most[:, None]).sum(1))


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of whole numbers: by floating point where that is exact, by Python's integers where it isn't."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2**52:
        return (q.astype(np.float64, copy=False) @ p.astype(np.float64, copy=False).T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(p).T, -(2**63), 2**63 - 1).astype(np.int64)


class Bucket:
    """Vectors of like length, longest first."""

    def __init__(self, vecs: np.ndarray, ids: list[list[int]]):
        length = lengths(vecs)
        order = np.argsort(-length, kind="stable")
        self.vecs, self.length, self.ids = vecs[order].astype(np.float64), length[order], [ids[k] for k in order]
        self.unit = self.vecs / np.maximum(self.length, 1e-300)[:, None]

    def reach(self, size: float, bound: float) -> int:
        """How many of the vectors are long enough for a product with a query of this length to reach the bound."""
        if not size or bound <= 0 or not np.isfinite(bound):
            return len(self.vecs)
        return int(np.searchsorted(-self.length, -(bound / size) * (1 - 1e-9), side="right"))

    def steep(self, size: float, bound: float) -> bool:
        """Whether the cosine threshold of this bucket is high enough for coordinates to prune."""
        return bool(size) and bound > 0 and np.isfinite(bound) and bound / size / max(self.length[0], 1e-300) >= COORD_FROM

    def candidates(self, q: np.ndarray, bound: float) -> np.ndarray:
        """Places of the vectors whose product with q may reach the bound; the others provably cannot."""
        size, slack = float(lengths(q[None].astype(np.float64))[0]), 1e-9
        far = self.reach(size, bound)
        if not far or not self.steep(size, bound):
            return np.arange(far)
        # per vector threshold t: |u_f - t' q_f| is bound by sqrt((1 - t^2)(1 - q_f^2)) for unit vectors with cosine >= t
        unit, t = q / size, np.minimum(1.0, bound / size / np.maximum(self.length[:far], 1e-300))
        keep = np.ones(far, bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            u, c = self.unit[:far, f], float(unit[f])
            # the largest cosine that a unit vector with coordinate u can have with q
            keep &= u * c + np.sqrt(np.maximum(0, 1 - u * u)) * np.sqrt(max(0.0, 1 - c * c)) >= t * (1 - slack) - slack
        return np.flatnonzero(keep)

    def best(self, qs: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, vec_id, score): for each query the k best of this bucket that reach its bound."""
        if not len(self.vecs):
            return
        sizes = lengths(qs)
        steep = np.array([self.steep(float(s), float(b)) for s, b in zip(sizes, bounds, strict=True)], bool)
        flat = np.flatnonzero(~steep)
        if len(flat):
            # all vectors that are long enough for one of these queries, in one product
            far = max(self.reach(float(sizes[n]), float(bounds[n])) for n in flat)
            scores = exact_products(qs[flat], self.vecs[:far])
            for n, score in zip(flat.tolist(), scores, strict=True):
                yield from self._first(n, np.arange(far), score, bounds[n], k)
        for n in np.flatnonzero(steep).tolist():
            at = self.candidates(qs[n], bounds[n])
            yield from self._first(n, at, exact_products(qs[n][None], self.vecs[at])[0], bounds[n], k)

    def _first(self, n: int, at: np.ndarray, score: np.ndarray, bound: float, k: int) -> Iterator[tuple[int, int, int]]:
        if len(at) > k:
            bound = max(bound, np.partition(score, len(score) - k)[len(score) - k])
        ok = score >= bound
        found = sorted((-int(s), i) for a, s in zip(at[ok].tolist(), score[ok].tolist(), strict=True) for i in self.ids[a])
        for s, i in found[:k]:
            yield n, i, -s


_RESULT = "query long, vec_id long, score long"


def _starts(first: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query, vec, dim, norm, best (vec_id, score): the k best of the longest vectors for each query, which these are sent to."""
    held = [(r.dim, r.vec, r.ids) for r in first.select("dim", "vec", "ids").collect()]  # FIRST vectors at most
    shared = wanted.sparkSession.sparkContext.broadcast(held)
    buckets: dict[int, Bucket] = {}

    def run(b):
        dims, raws = b["dim"].to_pylist(), b["vec"].to_pylist()
        best: list[list[dict]] = [[] for _ in raws]
        for dim in set(dims):
            own = [(v, ids) for d, v, ids in shared.value if d == dim]
            if dim not in buckets:
                buckets[dim] = Bucket(np.frombuffer(b"".join(v for v, _ in own), "<f8").reshape(len(own), dim), [ids for _, ids in own])
            at = [n for n, d in enumerate(dims) if d == dim]
            for cut in range(0, len(at), BLOCK):
                some = at[cut : cut + BLOCK]
                qs = np.frombuffer(b"".join(raws[n] for n in some), "<f8").reshape(len(some), dim)
                for n, i, s in buckets[dim].best(qs, np.full(len(some), -np.inf), k):
                    best[some[n]].append({"vec_id": i, "score": s})
        return {c: b[c].to_pylist() for c in ("query", "vec", "dim", "norm")} | {"best": best}

    return map_batches(wanted.select("query", "vec", "dim", "norm"), run, "query long, vec binary, dim int, norm double, best array<struct<vec_id: long, score: long>>")


def _search(candidates: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each bucket for each query.

    candidates: bucket, dim, vec, ids; blocks: bucket, dim, vecs (packed), queries (ids), bounds.  A bucket that very
    many blocks come to is dealt to several places.  There a bucket's vectors come first and stay in memory, its blocks
    stream past; a bucket that no block comes to goes nowhere.
    """
    target = _arrow(_RESULT)
    places = blocks.groupBy("bucket").agg(F.ceil(F.count("*") / MEET).alias("places"))
    candidates = candidates.join(places, "bucket").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    blocks = blocks.join(places, "bucket").withColumn("place", F.pmod(F.xxhash64("queries"), "places"))
    both = candidates.select("bucket", "place", F.lit(0).alias("kind"), F.col("vec").alias("raw"), "dim", "ids", F.lit(None).cast("array<double>").alias("bounds"))
    both = both.unionByName(blocks.select("bucket", "place", F.lit(1).alias("kind"), F.col("vecs").alias("raw"), "dim", F.col("queries").alias("ids"), "bounds"))
    both = both.repartition("bucket", "dim", "place").sortWithinPartitions("bucket", "dim", "place", "kind")

    def run(batches):
        here, vecs, ids, bucket = None, [], [], None
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for where, place, kind, raw, dim, own, bounds in zip(*(b[c].to_pylist() for c in ("bucket", "place", "kind", "raw", "dim", "ids", "bounds")), strict=True):
                if (where, dim, place) != here:
                    here, vecs, ids, bucket = (where, dim, place), [], [], None
                if kind == 0:
                    vecs.append(np.frombuffer(raw, "<f8"))
                    ids.append(own)
                elif vecs:
                    bucket = bucket or Bucket(np.stack(vecs), ids)
                    qs = np.frombuffer(raw, "<f8").reshape(len(own), dim)
                    out += [(own[n], i, s) for n, i, s in bucket.best(qs, np.array(bounds), k)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=target)

    return both.mapInArrow(run, _RESULT)


def _blocks(queries: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Queries (query, vec, dim, bound, need: the least length of a vector that may reach the bound) in blocks of like need, packed."""
    n = max(1, -(-queries.count() // block))
    dealt = scratch.write(queries.repartitionByRange(n, "need", "query").withColumn("block", F.spark_partition_id()))
    cut = dealt.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("block", "dim").orderBy("query")) - 1) / block))

    def pack(b):
        return {"dim": b["dim"].to_pylist(), "need": b["need"].to_pylist(), "queries": [[x["query"] for x in xs] for xs in b["all"].to_pylist()], "vecs": [b"".join(x["vec"] for x in xs) for xs in b["all"].to_pylist()], "bounds": [[x["bound"] for x in xs] for xs in b["all"].to_pylist()]}

    whole = cut.groupBy("block", "part", "dim").agg(F.min("need").alias("need"), F.collect_list(F.struct("query", "vec", "bound")).alias("all"))
    return map_batches(whole.select("dim", "need", "all"), pack, "dim int, need double, queries array<long>, vecs binary, bounds array<double>")


def _last_buckets(placed: DataFrame, n: int) -> list[tuple[float, int]]:
    """(length, bucket): up to which bucket vectors of at least this length lie, for CUTS ranges of buckets at most."""
    wide = -(-n // CUTS)
    rows = placed.groupBy(F.floor(F.col("bucket") / wide).alias("cut")).agg(F.max("norm").alias("norm")).collect()  # CUTS rows at most
    return sorted((r.norm, min(n, (r.cut + 1) * wide) - 1) for r in rows)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 5, is_query: F.Column | None = None, bucket: int = BUCKET, block: int = BLOCK, first: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query among all the others."""
    spark = tuned(vectors.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.write(integer_vectors(vectors))
    # equal vectors become one candidate with its k + 1 smallest ids: no list can hold more of them
    few = rows.withColumn("__k", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("__k") <= k + 1)
    distinct = scratch.write(few.groupBy("vec").agg(F.first("norm").alias("norm"), F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("dim", (F.octet_length("vec") / 8).cast("int")))
    asked = rows.where(F.col("vec_id") % 50 == 0 if is_query is None else is_query).select("vec_id", "vec", "norm").distinct()
    wanted = asked.groupBy("vec").agg(F.min("vec_id").alias("query"), F.first("norm").alias("norm"))
    asked = scratch.write(asked.join(wanted.select("vec", "query"), "vec").select(F.col("vec_id").alias("query_id"), "query"))
    wanted = scratch.write(wanted.withColumn("dim", (F.octet_length("vec") / 8).cast("int")))
    first = scratch.write(distinct.orderBy(F.desc("norm"), "vec").limit(FIRST if first is None else first))
    begun = scratch.write(_starts(first, wanted, k + 1))
    start = begun.select("query", F.explode("best").alias("b")).select("query", "b.*")
    rest = distinct.join(first.select("vec"), "vec", "left_anti")
    n = -(-(distinct.count() - first.count()) // bucket)
    if n > 0:
        # places in the order of length, from a range partition: bucket numbers follow it
        placed = scratch.write(rest.repartitionByRange(n, F.desc("norm"), F.xxhash64("vec")).withColumn("bucket", F.spark_partition_id()))
        bound = F.when(F.size("best") > k, F.array_min(F.transform("best", lambda x: x["score"])).cast("double")).otherwise(F.lit(float("-inf")))
        known = begun.select("query", "vec", "dim", "norm", bound.alias("bound"))
        need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
        blocks = _blocks(known.withColumn("need", need), block, scratch)
        ends = _last_buckets(placed, n)
        last = F.aggregate(F.array(*[F.struct(F.lit(length).alias("norm"), F.lit(until).alias("until")) for length, until in ends]), F.lit(-1), lambda m, x: F.when(x["norm"] >= F.col("need"), F.greatest(m, x["until"])).otherwise(m))
        blocks = scratch.write(blocks).withColumn("last", last).where("last >= 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("last"))))
        start = scratch.write(_top(start.unionByName(_search(placed, blocks, k + 1)), k + 1))
    lists = asked.join(start, "query").where("vec_id != query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = settled(spark, out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    scratch.drop()
    return out


#: The same in DuckDB; products of integers below 2**53 are exact in doubles.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vec from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.vec) = len(c.vec)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
