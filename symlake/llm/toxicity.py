"""Toxicity: Levenshtein automata intersected with a trie of a lexicon, and windows of context.

The lexicon is a short list of words plus words and word beginnings that the labels
single out (learnt from a bounded sample of labelled rows, by a test that allows for
the number of candidates; every one that passes is in).  Its trie is intersected with a
Levenshtein automaton: a state is a set of (trie node, edits so far), made when it is
first reached, so a word costs one step for each character until no term can match any
more.  A window around each hit tells quotation (a hit between marks that open and close
in its line, reporting words that have no quotation of their own, quoted lines) from
abuse (second person); a logistic regression on both sums gives the score.

Defined results: null counts as empty, which has no hits; without labels, or with
labels of one class, fixed weights are used; of contradicting labels of one document
the mean counts, 0.5 as 1; repeated rows give repeated results; a text of more than
CHARS_AT_ONCE characters is read in parts that end at white space, as windows do there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, map_batches, settled, tuned

#: Abusive words, words that report speech, words of the second person.
LEXICON = "idiot moron stupid trash worthless pathetic loser scum clown disgusting imbecile bastard dumbass asshole bitch retard vermin subhuman".split()
REPORTING = frozenset("said says saying quote quoted quotes wrote writes called calls term word phrase reported testified".split())
SECOND = frozenset("you your you're u ur du dein dich tu toi ton vous votre usted tú ustedes".split())
#: Quotation marks and what closes them; an apostrophe within a word is none.
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
MARK = re.compile(r"[\"“”„«»\n]|(?<!\w)‘|’(?!\w)")
#: Bounds of the sample of labelled rows, the odds from which a term is learnt, and the beginnings that are looked at.
SAMPLE = {1: 4_000, 0: 16_000}
ODDS, BEGINNINGS = 6, (4, 5, 6, 7, 8)
#: States of the automaton that a worker keeps; beyond them it starts anew.
STATES = 100_000
WINDOW, THRESHOLD = 8, 0.5
#: Characters of texts whose words are held at once.
CHARS_AT_ONCE = 1 << 20

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


@dataclass
class Term:
    text: str
    weight: float
    begins: bool = False  # matches any word that begins with it

    @property
    def edits(self) -> int:
        """Misspellings that still count: none in short terms and in beginnings."""
        return 0 if self.begins or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class FuzzyTrie:
    """The product of a trie of terms with Levenshtein automata, its states made on demand."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits that some term below a node allows
        for n, t in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], t.edits)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], t.edits)
            self.ends[node].append(n)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset[tuple[int, int]], int] = {frozenset(): 0}
        self.sets: list[frozenset[tuple[int, int]]] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        #: For a state, the beginnings that a word has had when it comes there.
        self.begun: list[list[tuple[int, float, int]]] = [[]]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs and of those reached from them by leaving out characters of a term."""
        least: dict[int, int] = {}
        todo = sorted(pairs, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.begun.append([(0, -self.terms[n].weight, n) for node, e in key if e == 0 for n in self.ends[node] if self.terms[n].begins])
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            out.add((node, e + 1))
            out |= {(child, e + 1) for child in self.children[node].values()}
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term for a word: fewest edits, then largest weight."""
        found: list[tuple[int, float, int]] = []
        if len(self.sets) > STATES:
            self._clear()
        state, steps, begun = self.start, self.steps, self.begun
        for c in word:
            nxt = steps[state].get(c)
            if nxt is None:
                nxt = steps[state][c] = self._step(state, c)
            state = nxt
            if not state:
                break
            if begun[state]:
                found += begun[state]
        if state:
            found += [(e, -self.terms[n].weight, n) for node, e in self.sets[state] for n in self.ends[node] if e <= self.terms[n].edits]
        if not found:
            return None
        e, _, n = min(found)
        return n, e


def quotations(text: str) -> list[tuple[int, int]]:
    """(begin, end) of what stands between marks that open and close in one line, apart and in order."""
    found: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in MARK.finditer(text):
        c, at = m.group(), m.start()
        if c == "\n":
            opened.clear()
        elif closes := [o for o in opened if c in CLOSERS[o]]:
            begin = opened[closes[-1]]
            opened = {o: k for o, k in opened.items() if k < begin}
            while found and found[-1][0] > begin:
                found.pop()
            found.append((begin, at))
        elif c in CLOSERS:
            opened.setdefault(c, at)
    return found


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.5, 2.5, 1.5, 0.3, 0.5]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about CHARS_AT_ONCE characters that end at white space, if there is any within as many again."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        m = re.compile(r"\s").search(text, at + CHARS_AT_ONCE, at + 2 * CHARS_AT_ONCE)
        end = m.end() if m else at + CHARS_AT_ONCE
        yield text[at:end]
        at = end
    yield text[at:]


def _between(spans: list[tuple[int, int]], begins: list[int], a: int, z: int) -> bool:
    """Whether one of the spans lies between two places."""
    k = bisect_left(begins, a)
    return k < len(spans) and spans[k][1] <= z


class Scorer:
    """Hits and features of texts."""

    def __init__(self, terms: list[Term]):
        self.trie = FuzzyTrie(terms)

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        match = self.trie.match
        return {w: m for w in words if (m := match(w)) is not None}

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """For each text: (term, edits, word, context) of its hits; context under 1 speaks for quotation, over 1 for abuse."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        held, size = [], 0
        for n, t in enumerate(texts):
            for part in parts_of(t or ""):
                if held and size + len(part) > CHARS_AT_ONCE:  # some at a time, as words take many times the memory of their text
                    self._add(held, out)
                    held, size = [], 0
                held.append((n, part.lower()))
                size += len(part)
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: list[list[tuple[int, int, str, float]]]) -> None:
        split = [WORD.findall(t) for _, t in held]
        known = self.hits(set().union(*split))
        for (n, t), words in zip(held, split, strict=True):
            if not known.keys().isdisjoint(words):
                out[n] += self._windows(t, known)

    def _windows(self, text: str, known: dict[str, tuple[int, int]]) -> list[tuple[int, int, str, float]]:
        tokens = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
        marked = quotations(text)
        begins = [x for x, _ in marked]
        out = []
        for k, (w, a, z) in enumerate(tokens):
            if w in known:
                around = tokens[max(0, k - WINDOW) : k + WINDOW + 1]
                at = bisect_right(begins, a) - 1
                line = text.rfind("\n", 0, a) + 1
                quoted = (at >= 0 and marked[at][1] >= z) or text[line : line + 1] == ">"
                # a reporting word with a quotation between it and the hit reports that one
                quoted = quoted or any(x in REPORTING and not _between(marked, begins, min(z, j), max(a, i)) for x, i, j in around)
                out.append((*known[w], w, (0.3 if quoted else 1.0) * (1.25 if any(x[0] in SECOND for x in around) else 1.0)))
        return out

    def features(self, found: list[tuple[int, int, str, float]]) -> list[float]:
        """A constant, and logarithms of the weight of exact hits, of misspelled hits and of quoted hits; kinds of terms."""
        exact = fuzzy = quoted = 0.0
        for n, e, _, context in found:
            w = self.trie.terms[n].weight
            if context < 1:
                quoted += w
            elif e:
                fuzzy += w * context
            else:
                exact += w * context
        return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len({n for n, *_ in found}))]


def _candidates(text: str | None) -> set[str]:
    """Words of a text, and beginnings of its words with * after them."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def learn(sample: DataFrame, seen: dict[int, int]) -> list[Term]:
    """Terms that the labels of the sample (text, y) single out, with the logarithm of their odds as weight."""

    def count(b):
        by: dict[str, list[int]] = {}
        for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
            for c in _candidates(t):
                by.setdefault(c, [0, 0])[y] += 1
        return {"term": list(by), "n0": [x[0] for x in by.values()], "n1": [x[1] for x in by.values()]}

    pos, neg = seen[1], seen[0]
    both = map_batches(sample.select("text", "y"), count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # a term that stands in n texts has n1 by chance with a probability below exp(-n KL): small even among a million candidates
    rate, n = pos / (pos + neg), F.col("n0") + F.col("n1")
    p = F.col("n1") / n
    kl = p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    fit_ = both.where(f"n1 >= 4 and n1 * {neg} > {ODDS} * n0 * {pos}").where(n * kl > math.log(1e6)).orderBy("term")
    # the sample's bound bounds what is collected
    out = [Term(r.term.rstrip("*"), min(6.0, math.log((r.n1 + 0.5) / pos) - math.log((r.n0 + 0.5) / neg)), r.term.endswith("*")) for r in fit_.collect()]
    begins = {t.text: t.weight for t in out if t.begins}
    # a term that weighs hardly more than one of its beginnings adds nothing
    return [t for t in out if not any(begins.get(t.text[:k], -1) > t.weight - 0.5 for k in range(1, len(t.text) + (not t.begins)))]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by Newton's method, held by a ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from a sample of labelled rows, at most about SAMPLE of each class, chosen by a hash of the id."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = [Term(t, 4.0) for t in LEXICON]
    if len(counts) < 2:
        return Model(base)
    share = {y: min(1.0, SAMPLE[y] / n) for y, n in counts.items()}
    level = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    picked = known.where(level < F.when(F.col("y") == 1, F.lit(share[1] * (1 << 20))).otherwise(F.lit(share[0] * (1 << 20))))
    scratch = Scratch(docs.sparkSession)
    # the sample's ids are bound by SAMPLE, so they are broadcast and no text is shuffled
    sample = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "y"))
    seen = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        scratch.drop()
        return Model(base)
    learnt = learn(sample, seen)
    exact = {t.text for t in learnt if not t.begins}
    terms = learnt + [t for t in base if t.text not in exact]
    state: list[Scorer] = []

    def run(b):
        if not state:
            state.append(Scorer(terms))
        found = state[0].batch(b["text"].to_pylist())
        return {"x": [state[0].features(f) for f in found], "y": b["y"].to_pylist()}

    rows = map_batches(sample, run, "x array<double>, y int").collect()  # bound by SAMPLE
    scratch.drop()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    # rows weigh as many labelled rows as they stand for
    return Model(terms, logistic(x, y, np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0])))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for each row of docs (doc_id, text)."""
    tuned(docs.sparkSession)
    model = fit(docs, labels, label)
    state: list[Scorer] = []

    def run(b):
        if not state:
            state.append(Scorer(model.terms))
        found = state[0].batch(b["text"].to_pylist())
        x = np.array([state[0].features(f) for f in found]).reshape(-1, len(model.weights))
        return {"doc_id": b["doc_id"].to_pylist(), "score": model.probability(x).tolist(), "n_hits": [len(f) for f in found]}

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, n_hits long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, in one pass and without a shuffle."""
    tuned(docs.sparkSession)
    model = fit(docs, labels, label)
    state: list[Scorer] = []

    def run(batches):
        for b in batches:
            if not state:
                state.append(Scorer(model.terms))
            found = state[0].batch(b.column(b.schema.get_field_index("text")).cast("string").to_pylist())
            x = np.array([state[0].features(f) for f in found]).reshape(-1, len(model.weights))
            yield b.filter(pa.array(model.probability(x) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
