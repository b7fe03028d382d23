"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are compared in lower case with single spaces.  An item of n characters
may lie in a text with up to n // EDIT_EVERY edits; cut into one piece more than that,
one of its pieces stands in the text unchanged.  One Aho-Corasick pass finds the pieces
of all items; around the hits, Myers' bit-parallel distance decides.

Items of fewer than MIN_ITEM characters allow no edits and would stand in most texts by
chance; they match where a whole line of a text, or the whole text, equals them.

Items are matched by their text and ids come in afterwards, so an item without an id and
items that share an id are found like any other.

Defined results: null and empty texts and items match nothing; repeated rows of documents
give repeated results, repeated rows of items count once; a null id stays null; of several
places of an item in a text the one of the smallest distance, then the first, is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, tuned

EDIT_EVERY, MIN_ITEM = 16, 24
#: Characters of items in one automaton; more items take more passes over the texts.
PASS_CHARS = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece): the item cut into budget + 1 pieces of about equal length."""
    cut = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of the pattern to a substring of the text, and the first end of one.

    One bit for each character of the pattern, in Python's integers of any length.
    """
    m = len(pattern)
    eq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << k
    ones, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = ones, 0, m, m, 0
    for k, c in enumerate(text):
        x = eq.get(c, 0)
        d0 = (((x & up) + up) ^ up) | x | down
        right, left = down | (ones & ~(d0 | up)), up & d0
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & ones, left << 1 & ones  # a match may begin anywhere
        up, down = left | (ones & ~(d0 | right)), right & d0
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    """Item texts, which are different and normal, compiled for matching; results name them by their places in the list."""

    def __init__(self, items: list[str]):
        self.items = items
        self.budget = [len(t) // EDIT_EVERY if len(t) >= MIN_ITEM else 0 for t in items]
        self.lines = {t: i for i, t in enumerate(items) if len(t) < MIN_ITEM}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(items):
            if len(t) >= MIN_ITEM:
                for place, piece in pieces(t, self.budget[i]):
                    at.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def find(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end) of the items that lie in the text within their budgets; the end is a place in the normal text."""
        line = normal(text)
        if not line:
            return
        if self.lines:
            yield from self._whole_lines(text)
        if self.automaton is None:
            return
        near: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(line):
            for i, place in where:
                begin, e = last + 1 - size - place, self.budget[i]
                spans = near.setdefault(i, [])
                begin, end = max(0, begin - e), begin + len(self.items[i]) + e
                if spans and spans[-1][0] <= begin <= spans[-1][1]:  # hits of a repetitive text are put together as they come
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
        for i, spans in sorted(near.items()):
            merged: list[list[int]] = []
            for a, z in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            distance, end = min((d, a + e) for a, z in merged for d, e in [myers(self.items[i], line[a:z])])
            if distance <= self.budget[i]:
                yield i, distance, end

    def _whole_lines(self, text: str) -> Iterator[tuple[int, int, int]]:
        found, end = {}, 0
        for part in map(normal, text.splitlines()):
            if part:
                end += len(part) + (end > 0)
                if part in self.lines:
                    found.setdefault(self.lines[part], end)
        whole = normal(text) if len(text) < 64 * MIN_ITEM else ""
        if whole in self.lines:
            found.setdefault(self.lines[whole], len(whole))
        yield from ((i, 0, e) for i, e in sorted(found.items()))


def _passes(items: DataFrame) -> Iterator[list[tuple[str, list[int | None]]]]:
    """(normal text, ids) of the items in parts of a bounded number of characters and ids; a text may come back in another part with other ids."""
    part, size = {}, 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        t = normal(r.text)
        if t:
            size += 8 if t in part else 8 + len(t)
            part.setdefault(t, set()).add(r.item_id)
        if size > PASS_CHARS:
            yield [(t, sorted(x, key=lambda i: (i is None, i))) for t, x in part.items()]
            part, size = {}, 0
    yield [(t, sorted(x, key=lambda i: (i is None, i))) for t, x in part.items()]


def _matcher(shared, state: list[Matcher]) -> Matcher:
    if not state:
        state.append(Matcher([t for t, _ in shared.value]))
    return state[0]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, budget, place_end: every benchmark item that lies in a text of docs (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(part: list[tuple[str, list[int | None]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)  # PASS_CHARS characters at most, and one item
        state: list[Matcher] = []

        def run(b):
            m = _matcher(shared, state)
            found = [(d, item, distance, end, m.budget[i]) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for i, distance, end in m.find(t) for item in shared.value[i][1]]
            cols = list(zip(*found, strict=True)) or [[]] * 5
            return dict(zip(("doc_id", "item_id", "distance", "place_end", "budget"), map(list, cols), strict=True))

        return map_batches(rows, run, "doc_id long, item_id long, distance int, budget int, place_end long")

    return reduce(DataFrame.unionByName, [one(p) for p in _passes(items)])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; a pass over the texts, without a shuffle."""
    spark = tuned(docs.sparkSession)
    for part in _passes(items):
        docs = _without(spark, docs, part)
    return docs


def _without(spark, docs: DataFrame, part: list[tuple[str, list[int | None]]]) -> DataFrame:
    shared = spark.sparkContext.broadcast(part)  # PASS_CHARS characters at most, and one item
    state: list[Matcher] = []

    def run(batches):
        for b in batches:
            m = _matcher(shared, state)
            texts = b.column(b.schema.get_field_index("text")).cast("string").to_pylist()
            yield b.filter(pa.array([next(m.find(t), None) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
