"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group and stay together.  Groups, largest first, go to
the shard with the least load.  Groups of the same number of bytes are alike, so the
heap runs over classes (bytes, number of groups), not over groups.  Classes stream
through the driver, largest first, PAGE of them at a time, and what each shard gets of
them is written to the shared folder page by page; the driver holds the loads of the
shards and one page, however many classes there are.  A class of many groups is dealt
in closed form with the loads that the heap would give.

Defined results: a null text has the size and group of an empty one; repeated rows
are rows of their own with slots of their own; an empty table gives no rows; any
doc_id may be null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settled, spread

SHARDS = 24
#: Classes that the driver holds at once.
PAGE = 100_000
#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` jobs of one size each shard gets, least load first, ties to the smaller shard; loads are raised."""
    got = [0] * len(loads)
    many = count > 8 * len(loads)
    if many and size:
        # water level: the largest whole number of jobs that can be given without overshooting `count`
        low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
        while low < high:
            mid = (low + high + 1) // 2
            if sum(-((load - mid) // size) for load in loads if load < mid) <= count:
                low = mid
            else:
                high = mid - 1
        for k, load in enumerate(loads):
            if load < low:
                got[k] = -((load - low) // size)
                loads[k] += got[k] * size
        count -= sum(got)
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, k = heap[0]
        got[k] += 1
        loads[k] = load + size
        heapq.heapreplace(heap, (load + size, k))
    return got


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each class (bytes, groups), largest first: the shards that get some of it, and up to which rank within the class."""
    loads = [0] * shards
    for size, count in classes:
        got = deal(loads, size, count)
        to = [k for k, n in enumerate(got) if n]
        yield size, to, list(accumulate(got[k] for k in to))


def _quotas(classes: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """bytes, to, until of every class, in tables of a page each."""
    spark, schema = classes.sparkSession, "bytes long, to array<int>, until array<long>"
    page, parts = [], []
    for row in schedule(((r.bytes, r.groups) for r in classes.orderBy(F.desc("bytes")).toLocalIterator()), shards):
        page.append(row)
        if len(page) == PAGE:
            parts, page = [*parts, scratch.write(spark.createDataFrame(page, schema))], []
    parts.append(scratch.write(spark.createDataFrame(page, schema)))
    return reduce(DataFrame.unionByName, parts)


def _ranked(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Gapless ranks from 0 within `by`, in two levels, so that no one task sees a whole class or shard."""
    cell = [*by, "__bucket"]
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*cell).agg(F.count("*").alias("__n"))
    before = counts.select(*cell, (F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    within = df.withColumn("__k", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)
    return within.join(before, cell).withColumn(name, F.col("__before") + F.col("__k")).drop("__bucket", "__k", "__before")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark), 4 * spread(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    same = ["key", "size", "text_crc32"]
    groups = scratch.write(rows.groupBy(*same).agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")))
    quota = _quotas(scratch.write(groups.groupBy("bytes").agg(F.count("*").alias("groups"))), shards, scratch)
    placed = _ranked(groups.select(*same, "bytes"), ["bytes"], ["key", "text_crc32", "size"], "rank", buckets).join(quota.hint("merge"), "bytes")
    placed = placed.select(*same, F.element_at("to", F.size(F.filter("until", lambda u: u <= F.col("rank"))) + 1).alias("shard"))
    out = _ranked(rows.join(placed, same), ["shard"], ["doc_id", "key"], "slot", buckets)
    out = settled(spark, out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
    scratch.drop()
    return out
