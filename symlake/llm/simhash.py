"""SimHash near-duplicates by deletion variants.

A text's fingerprint has a bit set where more than half of the hashes of its word
shingles have it.  Fingerprints link within `distance` bits.  They are cut into
distance // 2 + 1 segments, so that of two that link one segment differs in one bit at
most; each segment is indexed once for every bit, with that bit left out, and equal
entries meet in a bucket.  Buckets are verified: a bucket gives the links of a spanning
forest of its members within the distance, never all pairs.  Buckets of more than
`large` members are cut once more by the same rule over the bits that they do not
share.  Components then come from alternating large and small stars.

Equal fingerprints are put together before any of it, so groups of copies cost one row.

Defined results: null and blank texts have fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; repeated rows share a component; a
null doc_id takes part like any other and is no component's id, unless no row of the
component has an id; a doc_id with several texts may be the id of several components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow, as_bytes, map_batches, settled, tuned

WORDS, DISTANCE, BITS, SEED = 3, 3, 64, 42
#: Members from which a bucket is cut again.
LARGE = 512


def shingle_hashes(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Unsigned XXH64 of every shingle; A-Z are lower-cased, words are runs of bytes that are no ASCII white space."""
    w = (raw or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(w), max(1, len(w) - words + 1)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[:k].tolist(), end[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:z], SEED) for a, z in zip(begin, end, strict=True)), np.uint64, k)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes: a bit is set if it is set in over half of them."""
    if not len(hashes):
        return 0
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs (doc_id, text)."""
    tuned(docs.sparkSession)

    def run(b):
        return {"doc_id": b["doc_id"].to_pylist(), "fp": [_signed(majority(shingle_hashes(t, words))) for t in b["text"].to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), run, "doc_id long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Places (a, b) of links within the distance that connect all members of a bucket which such links connect."""
    rest, out = np.arange(1, len(fps)), []
    frontier = [0]
    while len(rest) or frontier:
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
        a = frontier.pop()
        near = np.bitwise_count(fps[rest] ^ fps[a]) <= distance
        if near.any():
            hit = rest[near].tolist()
            out += [(a, b) for b in hit]
            frontier += hit
            rest = rest[~near]
    return out


def variants(bits: list[int]) -> list[tuple[int, int]]:
    """(mask of the segment without one bit, its number) for segments of about equal length over the given bits."""
    return [(sum(1 << x for x in bits if x != b), n) for n, b in enumerate(bits)]


def _segments(bits: list[int], count: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), count)]


def _step(k: int) -> np.uint64:
    """The k-th multiple of an odd number, modulo 2**64."""
    return np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _entries(rows: DataFrame, distance: int) -> DataFrame:
    """key, shared, fp: an entry for every one-wildcard variant of every segment.

    shared is the mask of the bits that all members of the entry's bucket have in common.  Rows with a `shared` of
    their own are cut over the other bits; those of shared 0 over all of them.
    """
    target = _arrow("key long, shared long, fp long")
    cut = distance // 2 + 1

    def run(batches):
        plans: dict[int, list[int]] = {}
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            shared, base = b["shared"].to_numpy().view(np.uint64), b["key"].to_numpy().view(np.uint64)
            for s in np.unique(shared).tolist():
                if s not in plans:
                    free = [x for x in range(BITS) if not s >> x & 1]
                    plans[s] = [m for seg in _segments(free, cut) if seg for m, _ in variants(seg)]
                mine = shared == np.uint64(s)
                f, k = fp[mine], base[mine]
                for n, m in enumerate(plans[s]):
                    key = _mix((f & np.uint64(m)) + _mix(k + _step(n + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(f), _signed(s | m), np.int64)), pa.array(f.view(np.int64))], schema=target)

    return rows.select("key", "shared", "fp").mapInArrow(run, "key long, shared long, fp long")


def whole_keys(parts: Iterable[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by their first column, put together so that no key is cut; a key of many batches is joined once."""
    held: list[list[np.ndarray]] = []
    for new in parts:
        if not len(new[0]):
            continue
        last = int(np.searchsorted(new[0], new[0][-1]))  # the last key may go on in the next batch
        if held and held[-1][0][-1] != new[0][-1]:
            yield [np.concatenate(x) for x in zip(*held, [x[:last] for x in new], strict=True)]
            held = []
        elif last:
            yield [x[:last] for x in new]
        held.append([x[last:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _verified(entries: DataFrame, distance: int, large: int) -> DataFrame:
    """a, b, shared, key: links of the spanning forests of all buckets (shared 0).

    Entries lie sorted by key and a bucket streams through.  Members of a bucket of more than `large` come back as
    (fp, fp, shared, key) to be cut again; `large` 0 takes buckets of any size.
    """
    target = _arrow("a long, b long, shared long, key long")

    def flush(key: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        two = begin[end - begin == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        left, right, cut = [fp[two]], [fp[two + 1]], [np.zeros(0, np.int64)]
        more = end - begin > 2
        for s, e in zip(begin[more].tolist(), end[more].tolist(), strict=True):
            if large and e - s > large:
                cut.append(np.arange(s, e))
            elif found := forest(fp[s:e], distance):
                a, b = np.array(found).T
                left.append(fp[s:e][a])
                right.append(fp[s:e][b])
        cut, left, right = map(np.concatenate, (cut, left, right))
        none = np.zeros(len(left), np.int64)
        cols = [np.concatenate(x) for x in ((left.view(np.int64), fp[cut].view(np.int64)), (right.view(np.int64), fp[cut].view(np.int64)), (none, shared[cut]), (none, key[cut]))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=target)

    def run(batches):
        for key, shared, fp in whole_keys([b["key"].to_numpy(), b["shared"].to_numpy(), b["fp"].to_numpy().view(np.uint64)] for b in batches):
            yield flush(key, shared, fp)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, shared long, key long")


def links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """a, b: links between the distinct fingerprints of fps (fp) that connect whatever links within the distance connect."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows are three numbers here
    rows = fps.select("fp").distinct().withColumns({"key": F.lit(0).cast("long"), "shared": F.lit(0).cast("long")})
    found = None
    for level in range(3):
        out = scratch.write(_verified(_entries(rows, distance), distance, large if level < 2 else 0))
        part = out.where("shared = 0").select("a", "b").distinct()
        found = part if found is None else found.unionByName(part)
        rows = out.where("shared != 0").select("key", "shared", F.col("a").alias("fp"))
        if level < 2 and rows.isEmpty():
            break
    tuned(spark)
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the smallest node that each node of the edges (u, v) reaches, by alternating large and small stars.

    Each round is two joins on minima of neighbours, written to the shared folder; rounds grow with the logarithm of
    a component's diameter.  Only a count and a checksum of the edges reach the driver.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    now, seen = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        now = scratch.write(small_star(large_star(now)))
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(said) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(said)


def group(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    fps = scratch.write(fingerprints(docs, words))
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(nodes, scratch, distance)
    # components are those of fingerprints; ids come in at the end, so null and repeated ids connect nothing
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    rooted = scratch.write(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = settled(spark, fps.join(classes, "fp").select("doc_id", "fp", "component_id"))
    scratch.drop()
    return out
