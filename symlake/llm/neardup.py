"""Near-duplicate documents: SimHash by deletion variants, completed by minimal hashes; one document of each group stays.

Texts that are equal but for case of A-Z and white space are put together.  Two texts are
linked if their sets of FIVE-word shingles have a Jaccard similarity of SIMILAR or more.

Candidates come in two steps, and every one is verified on its shingles before it links.

1. The SimHash operator, over five-word shingles: fingerprints within its distance.  That
   finds copies with few changes, but at a similarity of 0.8 most pairs differ in more bits.
2. Therefore a text also has BANDS keys, each of ROWS minima of its shingles' hashes under
   functions of their own; texts that share a key are in a bucket.  First one member of a
   bucket is compared with all others; while it has members that no links connect, members
   of its smaller parts are compared with those of all other parts, GROWTH times as many in
   each round.  So all pairs of a bucket are compared but those that links connect anyway.
   Two texts are compared in the bucket of the first key that they share.  A comparison
   looks at the sizes of their sets, which bound their similarity, and at the lowest bytes
   of minima (BANDS x ROWS of them, WIDE in later rounds); pairs that share too few of them
   are no candidates.

A pair of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS, however its
texts differ and whatever the number of rows: one in two million pairs of similarity 0.8
shares none, and fewer of more similar ones.  Of pairs of 0.8 one in three million shares
too few bytes (fewer than the mean less five standard deviations).

Defined results: blank and null texts are copies of each other; of a group the row with
the smallest doc_id stays (null last), of equal rows one; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow, map_batches, release_shuffles, settled, tuned
from .simhash import _mix, _signed, _step, components, links, majority, shingle_hashes, whole_keys

BANDS, ROWS = 48, 6
#: Words in a shingle, and the similarity of near-duplicates.
FIVE, SIMILAR = 5, 0.8
#: Members that a bucket compares with all others in the first round, where it has more than a few; the growth of that.
HUBS, FEW, GROWTH = 2, 3, 16
#: Minima of texts that are compared in more than the first round.
WIDE = 1024
#: Members of a bucket in one row, where they go on to the next round.
TOGETHER = 1024
#: Neighbours of one text that are verified in one group.
SALT = 256


#: Odd factors, one for each minimum.
FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _step(1)) | np.uint64(1)
WIDE_FACTORS = _mix(np.arange(BANDS * ROWS + 1, BANDS * ROWS + WIDE + 1, dtype=np.uint64) * _step(1)) | np.uint64(1)


def minima(hashes: np.ndarray, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The minimum under each function: a factor's least product with a hash, modulo 2**64."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 128):
        np.minimum(least, (hashes[at : at + 128, None] * factors).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The keys of a text from its minima."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _step(1) + least[k::ROWS])
    return key


def least_alike(n: int) -> int:
    """Of n lowest bytes of minima, how many must be equal."""
    p = SIMILAR + (1 - SIMILAR) / 256
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def alike(sketch: np.ndarray, size: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Whether texts may be similar enough to one of them, by sizes of sets (exact) and by lowest bytes of minima."""
    a, b = np.minimum(size[others], size[one]), np.maximum(size[others], size[one])
    ok = a >= SIMILAR * b - 1e-9
    ok[ok] = (sketch[others[ok]] == sketch[one]).sum(1) >= least_alike(sketch.shape[1])
    return ok


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _rid() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("\x00")))


def _described(docs: DataFrame) -> DataFrame:
    """rid, doc_id, tkey (of the normalised text), fp (SimHash), size (of the set of shingles), bands, sketch."""
    schema = "rid long, doc_id long, tkey long, fp long, size int, bands binary, sketch binary"
    target = _arrow(schema)

    def run(batches):
        for b in batches:
            keys, cols = [], []
            for raw in b["raw"].to_pylist():
                line = b" ".join((raw or b"").lower().split())
                keys.append(xxhash.xxh64_intdigest(line, 1))
                h = shingle_hashes(line, FIVE)
                own = np.unique(h)
                least = minima(own)
                cols.append((_signed(majority(h)), len(own), bands(least).tobytes() if len(h) else b"", least.astype(np.uint8).tobytes()))
            made = [pa.array(x, t) for x, t in zip(list(zip(*cols, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b["rid"], b["doc_id"], pa.array(np.array(keys, np.uint64).view(np.int64)), *made], schema=target)

    return docs.select(_rid().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)


def _entries(texts: DataFrame) -> DataFrame:
    """key, node for each key of each text."""
    target = _arrow("key long, node long")

    def run(batches):
        for b in batches:
            found = [np.frombuffer(x, np.int64) for x in b["bands"].to_pylist()]
            key = np.concatenate([np.zeros(0, np.int64), *found])
            node = np.repeat(b["node"].to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], schema=target)

    return texts.select("node", "bands").mapInArrow(run, "key long, node long")


def _members(entries: DataFrame) -> DataFrame:
    """The entries (key, node) whose key another text has as well."""
    target = _arrow("key long, node long")

    def run(batches):
        for key, node in whole_keys([b["key"].to_numpy(), b["node"].to_numpy()] for b in batches):
            same = key[1:] == key[:-1]
            ok = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(node[ok])], schema=target)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long")


def _sketched(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """node, sketch of WIDE bytes of texts (node, rid)."""

    def run(b):
        return {"node": b["node"].to_pylist(), "sketch": [minima(np.unique(shingle_hashes(raw, FIVE)), WIDE_FACTORS).astype(np.uint8).tobytes() for raw in b["raw"].to_pylist()]}

    rows = docs.select(_rid().alias("rid"), F.col("text").cast("binary").alias("raw")).join(texts, "rid").dropDuplicates(["node"])
    return map_batches(rows.select("node", "raw"), run, "node long, sketch binary")


def _candidates(members: DataFrame, hubs: int) -> DataFrame:
    """a, b: pairs of members (key, node, root, size, bands, sketch) of one bucket and different roots that may be similar; a is the one that is compared with many.

    Members that have pairs left that are not compared yet come back with their key as `rest`, up to TOGETHER in a row.
    """
    schema = "a long, b long, key long, rest array<long>"
    target = _arrow(schema)

    def flush(key, node, root, size, keys, sketch):
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        left, right, keyed, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        more = end - begin > 1
        for s, e in zip(begin[more].tolist(), end[more].tolist(), strict=True):
            _, part, n = np.unique(root[s:e], return_inverse=True, return_counts=True)
            order = np.lexsort((part, n[part]))  # members of small parts first, the largest part last
            outside = e - s - int(n[part[order[-1]]])
            take = outside if outside <= max(hubs, FEW) else hubs
            at = np.flatnonzero(keys[s] == (int(key[s]) & 0xFFFFFFFF))  # the bucket's number among a text's keys, if it is one of them
            for k in range(take):
                one = s + int(order[k])
                others = order[k + 1 :][part[order[k + 1 :]] != part[order[k]]] + s
                if len(at) and len(others):
                    others = others[np.argmax(keys[others] == keys[one], axis=1) == at[0]]
                others = others[alike(sketch, size, one, others)]
                left.append(np.full(len(others), one))
                right.append(others)
            if take < outside:
                for cut in range(take, e - s, TOGETHER):
                    keyed.append(int(key[s]))
                    rest.append(node[s + order[cut : cut + TOGETHER]])
        left, right = node[np.concatenate(left)], node[np.concatenate(right)]
        none = lambda n, kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), none(len(left), pa.int64()), none(len(left), pa.list_(pa.int64()))], schema=target)
        yield pa.RecordBatch.from_arrays([none(len(rest), pa.int64()), none(len(rest), pa.int64()), pa.array(keyed, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], schema=target)

    def run(batches):
        table = lambda c, n, kind: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(n, -1)
        # of a key the lower half tells it from a text's other keys
        columns = lambda b: [*(b[x].to_numpy() for x in ("key", "node", "root", "size")), table(b["bands"], b.num_rows, np.uint64).astype(np.uint32), table(b["sketch"], b.num_rows, np.uint8)]
        for part in whole_keys(columns(b) for b in batches if b.num_rows):
            yield from flush(*part)

    return members.select("key", "node", "root", "size", "bands", "sketch").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, schema)


def _components(docs: DataFrame, entries: DataFrame, texts: DataFrame, scratch: Scratch, about: DataFrame | None = None) -> DataFrame:
    """node, root of the texts that have near-duplicates: what the similar pairs of fingerprints and of all buckets of entries (key, node) connect.

    texts: node, rid; about: node, fp, size, bands, sketch of the texts, found anew where it isn't given.
    """
    spark = docs.sparkSession
    if about is None:
        about = scratch.write(texts.select("node", "rid").join(_described(docs), "rid").groupBy("node").agg(F.min(F.struct("fp", "size", "bands", "sketch")).alias("of")).select("node", "of.*"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        edges = scratch.write(pairs)
        release_shuffles(spark)
        tuned(spark)
        found = scratch.write(_verify(docs, edges, texts, scratch))
        release_shuffles(spark)
        return edges, found

    # texts of one fingerprint stand for it by the smallest, which is compared with the others
    prints = scratch.write(about.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    close = links(prints, scratch)
    pairs = close.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    same = about.join(prints.where("n > 1"), "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    tested, similar = verified(pairs.unionByName(same).distinct())
    roots = components(similar, scratch)
    members, hubs = scratch.write(_members(entries)), HUBS
    while True:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows are narrow here
        here = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(about.select("node", "size", "bands", "sketch"), "node")
        out = scratch.write(_candidates(here, hubs))
        edges, found = verified(out.where("rest is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        tested, similar = tested.unionByName(edges), similar.unionByName(found)
        if not found.isEmpty():
            roots = components(similar, scratch)
        members, hubs = out.where("rest is not null").select("key", F.explode("rest").alias("node")), hubs * GROWTH
        if members.isEmpty():
            return roots
        if hubs == HUBS * GROWTH:
            open_ = members.select("node").distinct()
            wide = scratch.write(_sketched(docs, texts.select("node", "rid").join(open_, "node")))
            about = about.drop("sketch").join(wide, "node")


def _verify(docs: DataFrame, edges: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: the candidates whose shingles are similar enough.

    The shingles of a star's centre go to each of its groups of about SALT neighbours, those of a neighbour to its group.
    """
    # written, so that the join below splits a centre with very many neighbours
    size = scratch.write(edges.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts")))
    salted = edges.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    centres = size.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select("node", F.col("node").alias("centre"), "salt")
    places = salted.select(F.col("b").alias("node"), F.col("a").alias("centre"), "salt").unionByName(centres)
    wanted = places.join(texts.select("node", "rid"), "node").groupBy("rid").agg(F.first("node").alias("node"), F.collect_list(F.struct("centre", "salt")).alias("all"))
    rows = docs.select(_rid().alias("rid"), F.col("text").cast("binary").alias("raw")).join(wanted, "rid").select("node", "raw", "all")
    schema = "centre long, salt long, node long, is_centre boolean, shingles binary"
    target, links = _arrow(schema), _arrow("u long, v long")

    def sets(batches):
        for b in batches:
            for node, raw, all_ in zip(b["node"].to_pylist(), b["raw"].to_pylist(), b["all"].to_pylist(), strict=True):
                packed = np.unique(shingle_hashes(raw, FIVE)).tobytes()
                for k in range(0, len(all_), 64):
                    some = all_[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([x["centre"] for x in some], pa.int64()), pa.array([x["salt"] for x in some], pa.int64()), pa.array([node] * len(some), pa.int64()), pa.array([x["centre"] == node for x in some]), pa.array([packed] * len(some), pa.binary())], schema=target)

    def check(batches):
        centre, own = None, None
        for b in batches:
            left, right = [], []
            for c, node, is_centre, packed in zip(*(b[x].to_pylist() for x in ("centre", "node", "is_centre", "shingles")), strict=True):
                s = np.frombuffer(packed, np.uint64)
                if is_centre:
                    centre, own = c, s
                elif c == centre and jaccard(own, s) >= SIMILAR:
                    left.append(c)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=links)

    dealt = rows.mapInArrow(sets, schema).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.desc("is_centre"))
    return dealt.mapInArrow(check, "u long, v long").distinct()


def kept_rows(docs: DataFrame) -> DataFrame:
    """rid of the rows that stay: one for each group of near-duplicate documents (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    base = scratch.write(_described(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    one = base.groupBy(F.col("tkey").alias("node")).agg(first, F.min(F.struct("fp", "size", "bands", "sketch")).alias("of"))
    texts = scratch.write(one.select("node", "first", F.col("first.rid").alias("rid"), "of.*"))
    roots = _components(docs, _entries(texts), texts, scratch, texts.select("node", "fp", "size", "bands", "sketch"))
    groups = texts.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    out = settled(spark, groups.select("first.rid"))
    scratch.drop()
    return out


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    # the columns travel in one struct, so their names cannot clash with rid
    rows = docs.select(F.struct(*docs.columns).alias("row"), _rid().alias("rid"))
    return rows.join(kept_rows(docs), "rid", "left_semi").dropDuplicates(["rid"]).select("row.*")
