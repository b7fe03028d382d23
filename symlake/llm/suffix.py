"""Suffix-array dedup: every byte under a string of LENGTH bytes that also starts elsewhere.

The corpus is cut for distribution first, without losing a match.  In every window of
LENGTH bytes the smallest hash of its runs of RUN bytes marks an anchor, so equal
windows have equal anchors at equal places.  An anchor is home to a range of window
starts; the bytes of that range are its context.

1. Anchors whose hash stands alone have no repeated window.  Of the others, contexts
   with the same bytes are repeated as a whole; all but one of them rest from here on.
2. What remains - one context of each kind at anchors with differing contexts - is
   sorted by the difference-cover algorithm: contexts of one anchor hash lie together,
   a task builds the suffix array of some of them (sampled triples are sorted, named and
   recursed on, the remaining suffixes merged), and compares adjacent prefixes.  As only
   LENGTH bytes count, recursion ends when names stand for that many.
3. Anchors with more than `hot` contexts (where one passage begins in very many texts)
   are dealt out over tasks before that: a context is cut into pieces of a few starts,
   and pieces go together if the bytes that all of their windows hold are the same, as
   equal windows have them in the same place.  Pieces alone are done, equal pieces are
   repeated as a whole, and the rest is sorted as in 2 or, if there are still very many,
   cut again into pieces of fewer starts, at last of one.

That bytes are the same is decided in 2 by comparing them, in 1 and 3 by digests of 128
bits of a cryptographic hash (BLAKE2b), as copies of the bytes in one place would take
several times the corpus in shuffles.  The hashes of anchors only bring contexts together.

Defined results: null counts as empty; texts under LENGTH bytes keep everything; equal
rows are copies of each other; a match never crosses texts but may overlap itself; texts
of any length are read whole, BLOCK starts at a time.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow, map_batches, release_shuffles, settled, tuned

LENGTH, RUN = 200, 32
#: Window starts handled at once, and bytes of contexts that close a suffix array.
BLOCK, CHUNK = 1 << 17, 1 << 20
#: Contexts of one group that one suffix array takes, and starts in the pieces that larger groups are cut into.
HOT, PIECES = 1_000, (32, 8, 2, 1)
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    m = 1
    while m < n:
        e = min(m, n - m)
        out[m : m + e] = out[:e] * _U(pow(base, m, 1 << 64))
        m += e
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def prefix_sums(raw: bytes | memoryview) -> np.ndarray:
    """Sums of byte x multiplier power, from which any substring's hash follows."""
    c = np.frombuffer(raw, np.uint8).astype(np.uint64) + _U(1)
    out = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c * _powers(BASE, BLOCK + 2 * LENGTH)[: len(c)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * _powers(pow(BASE, -1, 1 << 64), BLOCK + 2 * LENGTH)[begin]


def anchors(raw: bytes) -> list[tuple[np.ndarray, ...]]:
    """(anchor hash, digest of the context in two parts, anchor, first start, last start) arrays, block by block of window starts."""
    out = []
    view = memoryview(raw)
    for block in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = view[block : block + BLOCK + LENGTH - 1]
        n = len(part)
        sums = prefix_sums(part)
        runs = np.arange(n - RUN + 1)
        h = _mix(substring_hashes(sums, runs, runs + RUN))
        # the hash's upper bits decide, then the place: the leftmost smallest one
        m = (h & ~_U(0xFFFFF)) | runs.astype(np.uint64)
        width, step = LENGTH - RUN + 1, 1
        while 2 * step <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if width > step:
            m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        at = (m & _U(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        a = at[first]
        one, two = digests(part, first.tolist(), (last + LENGTH).tolist())
        out.append((h[a], one, two, a + block, first + block, last + block))
    return out


def digests(raw: bytes | memoryview, begin: list[int], end: list[int]) -> np.ndarray:
    """Two numbers for each substring: its BLAKE2b digest of 128 bits."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(raw[a:z], digest_size=16).digest() for a, z in zip(begin, end, strict=True)]), np.int64).reshape(-1, 2).T


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 in the order of the keys, equal keys equal; and the largest."""
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], k[1:] != k[:-1]]))
    return rank, int(rank[order[-1]]) if len(key) else 0


def suffix_array(t: np.ndarray, depth: int = 1, enough: int = LENGTH) -> np.ndarray:
    """Suffixes of t (numbers from 1) in order, by the difference cover of 3.

    Each number stands for `depth` symbols; suffixes that agree on `enough` symbols may come in any order.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    pad = np.concatenate([t, np.zeros(3, np.int64)])
    size = int(t.max()) + 1
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names, most = _dense((pad[sample] * size + pad[sample + 1]) * size + pad[sample + 2])
    if most < len(sample) and 3 * depth < enough:
        inner = suffix_array(names, 3 * depth, enough)
        names = np.empty(len(sample), np.int64)
        names[inner] = np.arange(1, len(sample) + 1)
        by_name = inner
    else:
        by_name = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sampled = sample[by_name]
    sampled = sampled[sampled < n]
    wide = len(sample) + 2
    key0 = pad[zero] * wide + rank[zero + 1]
    zeros = zero[np.argsort(key0)]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(pad[ones] * wide + rank[ones + 1], pad[zeros] * wide + rank[zeros + 1])
    pairs = lambda i: (pad[i] * size + pad[i + 1]) * wide + rank[i + 2]
    before += np.searchsorted(pairs(twos), pairs(zeros))
    # ties among suffixes that agree on enough symbols must not turn the merge back
    place = np.maximum.accumulate(before) + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = sampled
    return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Starts, in the contexts put one after another with one separator each, of windows that occur twice."""
    joined = np.frombuffer(b"".join(x + b"\0" for x in contexts), np.uint8)
    size = np.fromiter((len(x) + 1 for x in contexts), np.int64, len(contexts))
    ends = np.cumsum(size) - 1
    ok = np.ones(len(joined), bool)
    for k in range(length):  # a window must end before its separator
        ok[np.maximum(ends - k, 0)] = False
    used = np.zeros(257, np.int64)
    text = joined.astype(np.int64) + 1
    text[ends] = 0
    used[np.unique(text)] = 1
    text = np.cumsum(used)[text]  # a small alphabet from 1; the separator is the least
    order = suffix_array(text, 1, length)
    order = order[ok[order]]
    same = np.ones(len(order) - 1 if len(order) else 0, bool)
    left, right = order[:-1], order[1:]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([joined, np.zeros(8, np.uint8)]), 8)
    at = np.arange(len(same))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        equal = (words[left[at] + k].copy().view(np.uint64) == words[right[at] + k].copy().view(np.uint64))[:, 0]
        at = at[equal]
    same[:] = False
    same[at] = True
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    return np.sort(order[hit])


_ANCHORS = "anchor long, c1 long, c2 long, rid long, at int, lo int, hi int"
_SLICES = "anchor long, rid long, at int, lo int, n int, hot boolean, raw binary"
_PIECE = "g1 long, g2 long, c1 long, c2 long, rid long, at int, lo int, hi int, raw binary"
_SPANS = "rid long, lo int, hi int"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _find_anchors(docs: DataFrame) -> DataFrame:
    target = _arrow(_ANCHORS)

    def run(batches):
        for b in batches:
            parts = [(np.full(len(x[0]), rid, np.int64), *x) for rid, raw in zip(b["rid"].to_pylist(), b["raw"].to_pylist(), strict=True) if raw and len(raw) >= LENGTH for x in anchors(raw)]
            if parts:
                rid, h, one, two, at, lo, hi = map(np.concatenate, zip(*parts, strict=True))
                yield _batch(target, h.view(np.int64), one, two, rid, at.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))

    return _numbered(docs).select("rid", F.col("text").cast("binary").alias("raw")).mapInArrow(run, _ANCHORS)


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (rid, list of anchor, at, lo, hi, n, hot)."""
    target = _arrow(_SLICES)

    def run(batches):
        for b in batches:
            for rid, raw, all_ in zip(b["rid"].to_pylist(), b["raw"].to_pylist(), b["all"].to_pylist(), strict=True):
                for k in range(0, len(all_), 4096):
                    rows = [(x["anchor"], rid, x["at"], x["lo"], x["n"], x["hot"], raw[x["lo"] : x["hi"] + LENGTH]) for x in all_[k : k + 4096]]
                    yield _batch(target, *zip(*rows, strict=True))

    texts = _numbered(docs).select("rid", F.col("text").cast("binary").alias("raw"))
    return texts.join(wanted, "rid").select("rid", "raw", "all").mapInArrow(run, _SLICES)


def pieces(at: int, lo: int, raw: bytes, width: int) -> list[tuple[int, int, int]]:
    """(distance, first start, last start) of the pieces of a context: starts whose distance to the anchor is alike but for `width`."""
    far, near = at - lo, at - (lo + len(raw) - LENGTH)
    return [(d, at - min(far, d + width - 1), at - max(near, d)) for d in range(near // width * width, far + 1, width)]


def _dealt(contexts: DataFrame, width: int) -> DataFrame:
    """Pieces of contexts (group, rid, at, lo, raw) with digests of what their windows have in common (with the group) and of the whole."""
    target = _arrow(_PIECE)

    def run(batches):
        for b in batches:
            rows = []
            for group, rid, at, lo, raw in zip(*(b[c].to_pylist() for c in ("group", "rid", "at", "lo", "raw")), strict=True):
                for d, first, last in pieces(at, lo, raw, width):
                    piece = raw[first - lo : last - lo + LENGTH]
                    common = raw[at - d - lo : at - d - width + 1 - lo + LENGTH]
                    (g1, c1), (g2, c2) = digests(struct.pack("<qi", group, d) + common + piece, [0, 12 + len(common)], [12 + len(common), 12 + len(common) + len(piece)]).tolist()
                    rows.append((g1, g2, c1, c2, rid, at, first, last, piece))
            yield _batch(target, *(list(zip(*rows, strict=True)) or [[]] * 9))

    return contexts.select("group", "rid", "at", "lo", "raw").mapInArrow(run, _PIECE)


def _deal_out(contexts: DataFrame, scratch: Scratch, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans that are repeated as a whole, contexts to sort: anchor, rid, lo, n, raw) of groups of very many contexts."""
    spark, group, kind = contexts.sparkSession, ["g1", "g2"], ["g1", "g2", "c1", "c2"]
    spans, rest = [], []
    now = contexts.select(F.col("anchor").alias("group"), "rid", "at", "lo", "raw")
    for width in PIECES:
        made = scratch.write(_dealt(now, width))
        kinds = scratch.write(made.groupBy(*kind).agg(F.count("*").cast("int").alias("n"), F.min(F.struct("rid", "at", "lo", "raw")).alias("one")))
        spans.append(scratch.write(made.join(kinds.where("n > 1").select(*kind), kind).select("rid", "lo", "hi")))
        several = kinds.groupBy(*group).agg(F.count("*").alias("k")).where("k > 1")
        left = scratch.write(kinds.join(several, group).select(F.col("g1").alias("anchor"), "k", "n", "one.*"))
        release_shuffles(spark)
        rest.append(left.where(F.col("k") <= hot).select("anchor", "rid", "lo", "n", "raw"))
        now = left.where(F.col("k") > hot).select(F.col("anchor").alias("group"), "rid", "at", "lo", "raw")
        if now.isEmpty():
            break
    return spans, rest


def _sort_contexts(slices: DataFrame) -> DataFrame:
    """Spans of repeated windows of contexts that occur once, from suffix arrays of whole anchors' contexts."""
    target = _arrow(_SPANS)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        starts = repeated_starts([x[4] for x in held])
        base = np.cumsum([0, *(len(x[4]) + 1 for x in held)])
        which = np.searchsorted(base, starts, side="right") - 1
        rid, lo, n = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
        begin = starts - base[which] + lo[which]
        # starts that follow each other make one span
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (begin[1:] != begin[:-1] + 1)]) if len(starts) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]]) if len(first) else first
        once = n[which[first]] == 1
        return _batch(target, rid[which[first]][once], begin[first][once].astype(np.int32), begin[last][once].astype(np.int32))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("anchor", "rid", "lo", "n", "raw")), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield flush(held)

    return slices.select("anchor", "rid", "lo", "n", "raw").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def repeated_spans(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """rid, lo, hi: ranges of starts of windows that occur again, for docs (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    found = scratch.write(_find_anchors(docs))
    # written, so that the join below splits anchors that very many texts share
    alike = (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))
    shared = scratch.write(found.groupBy("anchor").agg(F.count("*").alias("n"), alike.alias("alike")).where("n > 1").drop("n"))
    rep = scratch.write(found.join(shared, "anchor"))
    release_shuffles(spark)
    kind = ["anchor", "c1", "c2"]
    kinds = scratch.write(rep.where("not alike").groupBy(*kind).agg(F.count("*").cast("int").alias("n"), F.min(F.struct("rid", "at", "lo", "hi")).alias("one")))
    whole = rep.where("alike").select("rid", "lo", "hi").unionByName(rep.where("not alike").join(kinds.where("n > 1").select(*kind), kind).select("rid", "lo", "hi"))
    whole = scratch.write(whole)
    many = scratch.write(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("anchor", F.lit(True).alias("hot")))
    wanted = kinds.join(many, "anchor", "left").select("anchor", "n", "one.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi", "n", "hot")).alias("all"))
    slices = scratch.write(_cut(docs, wanted))
    release_shuffles(spark)
    sort = slices.where("not hot").select("anchor", "rid", "lo", "n", "raw")
    if not many.isEmpty():
        spans, rest = _deal_out(slices.where("hot"), scratch, hot)
        whole, sort = reduce(DataFrame.unionByName, spans, whole), reduce(DataFrame.unionByName, rest, sort)
    out = whole.unionByName(scratch.write(_sort_contexts(sort)))
    release_shuffles(spark)
    return out


def merge(spans: list, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs [begin, end) from ranges of starts."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        end = min(size, hi + length)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    by_text = spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return _numbered(docs).join(by_text, "rid", "left")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, scratch)

    def run(b):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for raw, s in zip(b["raw"].to_pylist(), b["spans"].to_pylist(), strict=True):
            raw = raw or b""
            runs = merge(s, len(raw))
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(z - a for a, z in runs))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(hashlib.sha256(kept(raw, runs)).hexdigest())
        return {"doc_id": b["doc_id"].to_pylist()} | out

    out = map_batches(_with_spans(docs, spans).select("doc_id", F.col("text").cast("binary").alias("raw"), "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = settled(spark, out)
    scratch.drop()
    return out


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in runs:
        parts.append(raw[at:a])
        at = z
    return b"".join([*parts, raw[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated bytes taken out of text; n_chars, where there is one, follows the text.

    A character that is cut within its bytes goes as a whole.  Intermediate tables stay in the shared folder, as the
    result is read from them when it is used.
    """
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    spans = settled(spark, repeated_spans(docs.select("doc_id", "text"), scratch).distinct())
    scratch.drop()

    def run(b):
        texts = []
        for raw, s in zip(b["raw"].to_pylist(), b["spans"].to_pylist(), strict=True):
            texts.append(None if raw is None else kept(raw, merge(s, len(raw))).decode("utf-8", "ignore"))
        return {"row": b["row"].to_pylist(), "new_text": texts}

    # all columns travel in one struct, so their names cannot clash with those used here
    rows = _with_spans(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), spans)
    packed = rows.select("row", F.col("text").cast("binary").alias("raw"), "spans")
    out = map_batches(packed, run, f"row {packed.schema['row'].dataType.simpleString()}, new_text string")
    n_chars = F.length("new_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("new_text"), "n_chars": n_chars}
    return out.select(*[(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
