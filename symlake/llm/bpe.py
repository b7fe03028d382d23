"""BPE encoding and decoding through a minimal acyclic transducer.

The tokenizer file is a public byte-level BPE (path is a parameter).  Frequent
words are compiled, with their ids as outputs, into a minimal acyclic automaton
(shared suffixes); word numbers come from counts on the edges, so equal suffixes
of words with different ids are still shared.  Executors memory-map its arrays.
Words that it lacks are merged exactly, pair by pair in rank order, many words at once.

The lexicon holds the most frequent words of all documents, ``lexicon_words`` at most,
which are counted in partitions first; it decides how fast a word is encoded, never how.  Lexicon
and tokenizer file lie in the shared folder, from where Spark hands them to executors.

A tokenizer file that asks for what isn't done here (a normaliser, a space before the
text, another way of cutting words, dropout, special tokens that take in white space) is
refused.

Defined results: a null text counts as empty; an empty text has no ids; repeated
rows give repeated results; text equal to a special token becomes that token, as
the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow, hadoop_path, map_batches, tuned

#: Fixed value: how byte-level BPE cuts text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_WORDS = 50_000
#: Words in one generation of a worker's memo, and characters encoded at once; they bound its memory.
MEMO_WORDS = 200_000
#: Different words that a partition counts before it hands on their counts.
COUNTED = 500_000
CHARS_AT_ONCE = 1 << 20
#: Bytes from which a word is merged with a heap.
LONG_WORD = 200
#: Bytes of words that are merged at once.
MERGED_AT_ONCE = 1 << 16
#: Stands for no token beside a word's ends when its pairs are looked up.
NO_ID = (1 << 31) - 1


@cache
def _patterns() -> tuple[re.Pattern, regex.Pattern]:
    """SPLIT twice: for texts of the basic plane with its classes spelt out for re, which takes half the time, and for all others."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, space = ("".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(f"[{kind}]+", plane)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    near = f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(near), regex.compile(SPLIT)


def cut(text: str) -> list[str]:
    """The words of a text, as SPLIT says."""
    near, far = _patterns()
    return (near if len(text.encode("utf-16-le")) == 2 * len(text) else far).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


def refuse(data: dict) -> None:
    """An error for a tokenizer file whose settings would give other ids than those made here."""
    model, cut = data["model"], data.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if data.get("normalizer") else []
    odd += ["model"] if model.get("type", "BPE") != "BPE" else []
    odd += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False else []
    odd += [f"added token {t['content']!r}" for t in data.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"this tokenizer's settings are not supported: {', '.join(odd)}")


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, alphabet = data["model"], byte_alphabet()
        refuse(data)
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        ids = model["vocab"]
        self.token_bytes: dict[int, bytes] = {i: to_bytes(t) for t, i in ids.items()}
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = ids[c]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((ids[a], ids[b]), rank)
            self.merged.append(ids[a + b])
        pairs = np.array([(a << 32 | b, r) for (a, b), r in sorted(self.ranks.items())], np.int64).reshape(-1, 2)
        self._pairs, self._pair_ranks, self._merged, self._byte_ids = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), np.array(self.merged, np.int32), np.array(self.byte_ids, np.int32)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: the pair of lowest rank is merged first, leftmost on ties."""
        ids, rank_of, merged = [self.byte_ids[b] for b in word], self.ranks.get, self.merged
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        none = len(merged)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = (merged[best],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), none)
        return ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """merge for each word; words of similar length are merged at once, one pair of each in a round."""
        out: list[list[int]] = [[]] * len(words)
        at, some, size = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist(), [], 0
        for k in at:
            if len(words[k]) > LONG_WORD or not self.merged:
                out[k] = self.merge(words[k])
                continue
            some.append(k)
            size += len(words[k])
            if size >= MERGED_AT_ONCE:
                self._merge_rows(words, some, out)
                some, size = [], 0
        if size:
            self._merge_rows(words, some, out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; len(merged) for those that don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_ranks[at], np.int32(len(self.merged)))

    def _merge_rows(self, words: list[bytes], some: list[int], out: list[list[int]]) -> None:
        raw = [words[k] for k in some]
        sizes, some = np.fromiter(map(len, raw), np.int64, len(raw)), np.array(some)
        width, none = int(sizes.max()), len(self.merged)
        ids = np.full((len(raw), width + 1), NO_ID, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self._byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        # ranks[:, j] is that of the pair that begins at j; the last column is never one, and is written for the pair before a word's first token
        ranks = np.full((len(raw), width + 1), none, np.int32)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(some):
            k = ranks.argmin(1)
            best = ranks[np.arange(len(some)), k]
            go = best < none
            if not go.all():
                done = ~go
                for w, n, x in zip(some[done].tolist(), sizes[done].tolist(), ids[done].tolist(), strict=True):
                    out[w] = x[:n]
                ids, ranks, sizes, some, k, best = ids[go], ranks[go], sizes[go], some[go], k[go], best[go]
                if not len(some):
                    break
            # every row left loses one token, so all stay flush with the last column
            rows, column, here = np.arange(len(some)), np.arange(ids.shape[1] - 1), self._merged[best]
            kept = column + (column > k[:, None]) + rows[:, None] * ids.shape[1]
            ids, ranks, sizes = ids.ravel()[kept], ranks.ravel()[kept], sizes - 1
            ids[rows, k] = here
            ranks[rows, k] = self._ranks(here, ids[rows, np.minimum(k + 1, len(column) - 1)])
            ranks[rows, k - 1] = self._ranks(np.where(k > 0, ids[rows, k - 1], np.int32(NO_ID)), here)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a word of any length in n log n: a heap of pairs over a linked list."""
        n, rank_of, merged = len(ids), self.ranks.get, self.merged
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k, pair in enumerate(zip(ids, ids[1:])) if (r := rank_of(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or rank_of((ids[k], ids[j])) != r:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j], after[k] = merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if (m := rank_of((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (m, k))
            if before[k] >= 0 and (m := rank_of((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (m, before[k]))
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> str:
        """Ids to text; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Transducer:
    """A minimal acyclic automaton over bytes; each accepted word has a number, each number its ids.

    Arrays: edge keys (state * 256 + byte, sorted), edge targets, words skipped by an edge,
    final flags, and the ids of word k at ids[offset[k]:offset[k + 1]].
    """

    FIELDS = ("keys", "targets", "skips", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        # states under construction: [final, {byte: child}]; children of finished states are numbers
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(state: list) -> int:
            sig = (state[0], tuple(state[1].items()))
            if sig not in register:
                register[sig] = len(frozen)
                frozen.append(sig)
            return register[sig]

        path: list[tuple[int, list]] = [(-1, [False, {}])]
        last = b""
        order = sorted(words)
        for w in order:
            common = len(os.path.commonprefix([last, w]))
            while len(path) - 1 > common:
                byte, state = path.pop()
                path[-1][1][1][byte] = freeze(state)
            for b in w[common:]:
                path.append((b, [False, {}]))
            path[-1][1][0] = True
            last = w
        while len(path) > 1:
            byte, state = path.pop()
            path[-1][1][1][byte] = freeze(state)
        start = freeze(path[0][1])
        # children are frozen before parents, so counts can be summed in order; the start state becomes 0
        count = [0] * len(frozen)
        for s, (final, edges) in enumerate(frozen):
            count[s] = int(final) + sum(count[t] for _, t in edges)
        name = {start: 0}
        for s in range(len(frozen)):
            name.setdefault(s, len(name))
        rows = []
        for s, (final, edges) in enumerate(frozen):
            skip = int(final)
            for b, t in sorted(edges):
                rows.append((name[s] * 256 + b, name[t], skip))
                skip += count[t]
        rows.sort()
        final = np.zeros(len(frozen), bool)
        for s, (f, _) in enumerate(frozen):
            final[name[s]] = f
        table = np.array(rows, np.int64).reshape(-1, 3)
        sizes = [len(words[w]) for w in order]
        return cls({
            "keys": table[:, 0].copy(), "targets": table[:, 1].astype(np.int32), "skips": table[:, 2].astype(np.int32), "final": final,
            "offset": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "ids": np.array([i for w in order for i in words[w]], np.int32),
        })

    def pack(self) -> bytes:
        """One file: a JSON header line with the arrays' places, then the arrays, each aligned to 64 bytes."""
        at, head, parts = 0, {}, []
        for k in self.FIELDS:
            a = np.ascontiguousarray(getattr(self, k))
            head[k] = [str(a.dtype), len(a), at]
            pad = -a.nbytes % 64
            parts.append(a.tobytes() + b"\0" * pad)
            at += a.nbytes + pad
        return json.dumps(head).encode().ljust(1023) + b"\n" + b"".join(parts)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.pack())

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        whole = np.memmap(path, np.uint8, "r", 1024)
        return cls({k: whole[at : at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in head.items()})

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton has none; all words walk at once."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join(words), np.uint8)
        alive, state, number, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(alive):
            done = size[alive] == depth
            hit = done & self.final[state]
            out[alive[hit]] = number[hit]
            alive, state, number = alive[~done], state[~done], number[~done]
            if not len(alive):
                break
            key = state * 256 + flat[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at, number = alive[ok], at[ok], number[ok]
            state, number, depth = self.targets[at].astype(np.int64), number + self.skips[at], depth + 1
        return out

    def outputs(self, number: int) -> list[int]:
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist()


class Encoder:
    """Encodes texts with a transducer, a bounded memo and exact merges for the rest.

    What is kept of a word: its ids as decimal text, and the bytes that they decode to.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.decimal = {i: str(i).encode() for i in vocabulary.token_bytes}

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.v.token_bytes.__getitem__, ids))

    def learn(self, pieces: set[str]) -> None:
        """Puts words into the memo; of two generations the older is dropped when the younger is full."""
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = pieces.difference(young)
        new = missing.difference(old)
        young |= {w: old[w] for w in missing.difference(new)}
        words = list(new)
        raw = [w.encode() for w in words]
        found = self.lexicon.find(raw).tolist()
        merged = iter(self.v.merge_all([b for b, k in zip(raw, found, strict=True) if k < 0]))
        for w, k in zip(words, found, strict=True):
            young[w] = self._entry(self.lexicon.outputs(k) if k >= 0 else next(merged))

    def sections(self, text: str) -> list[list[str]]:
        """Words of the text; every other section is one special token."""
        if self.v.special_split and any(s in text for s in self.v.special):
            return [[x] if k % 2 else cut(x) for k, x in enumerate(self.v.special_split.split(text))]
        return [cut(text)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: its ids as decimal text joined by commas, and the bytes that they decode to."""
        parted = [self.sections(t) for t in texts]
        pieces: set[str] = set()
        for sections in parted:
            for x in sections[::2]:
                pieces.update(x)
        self.learn(pieces)
        out = []
        for sections in parted:
            parts: list[tuple[bytes, bytes]] = []
            for k, x in enumerate(sections):
                parts += [self._entry([self.v.special[x[0]]])] if k % 2 else map(self.young.__getitem__, x)
            out.append((b",".join([ids for ids, _ in parts]), b"".join([raw for _, raw in parts])))
        return out


def ids_of(decimal: bytes) -> list[int]:
    return list(map(int, decimal.split(b","))) if decimal else []


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    """Texts one after another, some at a time, so that their words fit in memory."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHARS_AT_ONCE:
            size, end = size + len(texts[end]), end + 1
        yield texts[at:end]
        at = end


def _lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int) -> Transducer:
    """The most frequent words of all documents, with their ids."""
    target = _arrow("word string, n long")

    def count(batches):
        found = Counter()
        for b in batches:
            for t in b["text"].to_pylist():
                found.update(cut(t))
                if len(found) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], schema=target)
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=target)

    counted = docs.where("text is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    scratch = Scratch(docs.sparkSession)
    # sixteenths of powers of two: counts of one step go in or stay out together, so no task sorts or sends more than what goes in
    table = scratch.write(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(16 * F.log2("n"))))
    least, total = 1 << 30, 0
    for r in sorted(table.groupBy("step").agg(F.count("*").alias("k")).collect(), reverse=True):  # 1024 rows at most
        if total + r.k > words:
            break
        least, total = r.step, total + r.k
    top = table.where(F.col("step") >= least).select("word").collect()
    scratch.drop()
    raw = [r.word.encode() for r in top]
    return Transducer.build(dict(zip(raw, vocabulary.merge_all(raw), strict=True)))


_STATE: dict[str, Encoder] = {}


def _encoder(key: str) -> Encoder:
    """The worker's encoder: built once from the files that Spark has sent to the executor."""
    if key not in _STATE:
        with open(SparkFiles.get(f"{key}.json"), encoding="utf-8") as f:
            vocabulary = Vocabulary(f.read())
        _STATE.clear()
        _STATE[key] = Encoder(vocabulary, Transducer.open(SparkFiles.get(f"{key}.dawg")))
    return _STATE[key]


def prepare(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon and hands it, with the tokenizer file, to every executor; returns their key."""
    spark = tuned(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    vocabulary, scratch, key = Vocabulary(text), Scratch(spark), f"bpe-{uuid.uuid4().hex}"
    files = {"json": text.encode(), "dawg": _lexicon(docs, vocabulary, lexicon_words).pack()}
    for kind, raw in files.items():
        fs, path = hadoop_path(spark, f"{scratch.root}/{key}.{kind}")
        out = fs.create(path, True)
        out.write(bytearray(raw))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return key


def encode(docs: DataFrame, tokenizer_path: str, ids: bool = True, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256 of every text.

    decoded_sha256 is of the text that the ids decode to, put together from the tokens' bytes.
    """
    key = prepare(docs, tokenizer_path, lexicon_words)

    def run(b):
        e, texts = _encoder(key), [t or "" for t in b["text"].to_pylist()]
        out: dict[str, list] = {"doc_id": b["doc_id"].to_pylist(), "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for some in batches_of(texts):
            for decimal, raw in e.encode(some):
                out["n_tokens"].append(decimal.count(b",") + 1 if decimal else 0)
                if ids:
                    out["ids"].append(ids_of(decimal))
                out["ids_sha256"].append(hashlib.sha256(decimal).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
        return out

    kind = "ids array<int>, " if ids else ""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, n_tokens long, {kind}ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of rows of doc_id and ids; null ids decode to an empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    spark = tuned(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(raw)  # one tokenizer file, a few MB
    state: list[Vocabulary] = []

    def run(b):
        if not state:
            state.append(Vocabulary(shared.value))
        return {"doc_id": b["doc_id"].to_pylist(), "text": [state[0].decode(x or []) for x in b["ids"].to_pylist()]}

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
