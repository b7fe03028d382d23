"""Licence scans: matching statistics of a text over a generalised suffix automaton of template words.

All templates go into one automaton over word numbers.  A text is streamed through
it; within each maximal match of MIN_MATCH words or more, the matches of each template
are placed, as shorter ones lie inside those of other templates, and matches that
follow each other in both text and template are chained.  A chain that
covers enough of its template is a span, and gives the template's label.

Templates are short notices and whole texts of public licences (`licence_texts`); the
score is the largest part of a template that a chain covers, 1 where a base phrase stands.

Defined results: null counts as empty; an empty text has no words, no labels and
score 0; repeated rows give repeated results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, tuned
from .licence_texts import TEMPLATES

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words in the shortest match that counts, words that may lie between chained matches, and the part of a template that a span covers.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 4, 0.7

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words: runs of a-z, 0-9 and characters beyond ASCII."""
    return raw.translate(_WORD).split()


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers, with the end of one occurrence for each state."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]
        for t, words in enumerate(texts):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w, (t, k))

    def _new(self, length: int, link: int, edges: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, end: tuple[int, int]) -> int:
        q = self.next[last].get(w)
        if q is not None:  # this word after this context is in an earlier template already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._new(self.length[last] + 1, 0, {}, end)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def maximal_matches(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """(start, length) of the matches of the text, of `least` words or more, that cannot be extended to the right."""
        out, state, size = [], 0, 0
        for k, w in enumerate([*words, -2]):
            if w not in self.next[state]:
                if size >= least:
                    out.append((k - size, size))
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state = size = 0
        return out


def _fits(kept: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether a range of words lies apart from those kept, which are in order; if so, it is kept as well."""
    k = bisect_left(kept, (first, last))
    apart = (k == 0 or kept[k - 1][1] < first) and (k == len(kept) or kept[k][0] > last)
    if apart:
        kept.insert(k, (first, last))
    return apart


class Scanner:
    """Templates compiled for scanning."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _ in templates]
        texts = [words_of(t.encode()) for _, t in templates]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.texts = [[self.number[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton(self.texts)
        #: Where each run of MIN_MATCH template words stands: (template, place).
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, words in enumerate(self.texts):
            for k in range(len(words) - MIN_MATCH + 1):
                self.places.setdefault(tuple(words[k : k + MIN_MATCH]), []).append((t, k))
        self.base = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in base.items()]

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, part of the template covered) of the chains in a text.

        Of each template: the best chain, and every other of MIN_COVER or more that does not overlap a better one of it.
        """
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], number >= 0, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        found: dict[int, set[tuple[int, int, int]]] = {}
        for b, e in zip(begin[end - begin >= MIN_MATCH].tolist(), end[end - begin >= MIN_MATCH].tolist(), strict=True):
            run = number[b:e].tolist()
            done = 0
            for at, size in self.automaton.maximal_matches(run, MIN_MATCH):
                for k in range(max(at, done), at + size - MIN_MATCH + 1):
                    for t, place, n in self._placed(run, k):
                        found.setdefault(t, set()).add((b + k, place, n))
                done = max(done, at + size - MIN_MATCH + 1)
        out = []
        for t, matches in found.items():
            every, chains = [], []  # a chain: covered words, first word, last word, next place in template
            for at, place, size in sorted(matches):
                fitting = [c for c in chains if 0 <= at - c[2] - 1 <= MAX_GAP and c[3] <= place <= c[3] + MAX_GAP]
                prior = max(fitting, default=None)
                chain = (size + (prior[0] if prior else 0), prior[1] if prior else at, at + size - 1, place + size)
                chains = [c for c in chains if c[2] + MAX_GAP + 1 >= at] + [chain]
                every.append(chain[:3])
            every.sort(key=lambda c: -c[0])
            kept: list[tuple[int, int]] = []
            for covered, first, last in every:
                part = covered / len(self.texts[t])
                if kept and part < MIN_COVER:
                    break
                if _fits(kept, first, last):
                    out.append((t, first, last, part))
        return out

    def strong(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of the spans of MIN_COVER or more, those that overlap no better one of the same label, in order."""
        kept: dict[str, list[tuple[int, int]]] = {}
        ranked = sorted((s for s in spans if s[3] >= MIN_COVER), key=lambda s: (-s[3] * len(self.texts[s[0]]), -s[3], s))
        return sorted((s for s in ranked if _fits(kept.setdefault(self.labels[s[0]], []), s[1], s[2])), key=lambda s: (s[1], s[2], s[0]))

    def _placed(self, run: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        """(template, place, length) of the matches that begin at a word of a run and cannot begin before it."""
        for t, place in self.places[tuple(run[k : k + MIN_MATCH])]:
            words = self.texts[t]
            if k and place and run[k - 1] == words[place - 1]:
                continue
            n = MIN_MATCH
            while k + n < len(run) and place + n < len(words) and run[k + n] == words[place + n]:
                n += 1
            yield t, place, n

    def scan(self, raw: bytes | None) -> dict:
        """Everything that is reported of one text."""
        words = words_of(raw or b"")
        line = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = line.find(phrase, at + 1)
        # the number of a word is that of the blanks before it
        starts = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), places).tolist() if places else []
        spans = self.spans(words)
        strong = self.strong(spans)
        score = max([s[3] for s in spans] + [1.0] * bool(starts), default=0.0)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {self.labels[s[0]] for s in strong})), "score": score,
            "spans": [{"label": self.labels[t], "first": a, "last": z, "covered": c} for t, a, z, c in strong],
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, covered: double>>"


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, labels, score and the covered spans of templates."""
    tuned(docs.sparkSession)
    state: list[Scanner] = []

    def run(b):
        if not state:
            state.append(Scanner(templates, base))
        found = [state[0].scan(t) for t in b["text"].to_pylist()]
        return {"doc_id": b["doc_id"].to_pylist()} | {k: [x[k] for x in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), run, SCHEMA)
