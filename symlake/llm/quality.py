"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

Statistics of each whole text (shares of byte classes, words, lines) are standardised
and mapped to cosines that approximate a Gaussian kernel.  Each partition of labelled
rows sums its share of the normal equations; the sums are added in two levels.  The
ridge score is calibrated by isotonic regression over all labelled rows, summed into
fixed bins.  No labelled row is left out, and nothing but sums reaches the driver.

Defined results: null counts as empty; an empty text has statistics of zeros and is
scored like any other; without labels every score is 0.5, with labels of one class it
is that class; of contradicting labels of one document the mean counts; of several
texts under one labelled doc_id the one with the smallest statistics is learnt from, so
that fits agree; texts of any length are read whole, one batch of bounded bytes at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow, as_bytes, held_out, map_batches, settled, tuned

FEATURES, RIDGE, SEED, BINS, THRESHOLD = 256, 1e-3, 7, 2048, 0.3

#: Classes of bytes whose shares are statistics.
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "beyond": range(128, 256), "space": (32,), "line": (10,), "stop": b".?", "comma": b",;:",
    "shout": b"!", "bar": b"|", "symbol": b"#$%&*@^~`_+=<>/\\", "bracket": b"()[]{}", "quote": b"\"'", "control": (*range(10), *range(11, 32), 127),
}
_SHARE = np.array([[float(b in set(c)) for c in _CLASSES.values()] for b in range(256)])
N_STATS = len(_CLASSES) + 12


def statistics(raw: bytes | None) -> list[float]:
    """Statistics of one text."""
    if not raw:
        return [0.0] * N_STATS
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    k, distinct = len(words), set(words)
    length = sum(map(len, words)) / max(1, k)
    pairs = set(zip(words, words[1:], strict=False))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines))
    return [
        *(hist @ _SHARE / n).tolist(), math.log1p(n), math.log1p(k), length, max(map(len, words), default=0) ** 0.5, len(distinct) / max(1, k), len(distinct) / max(1, k) ** 0.8,
        len(pairs) / max(1, k - 1) if k > 1 else 1.0, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), k / max(1, len(lines)) / 100, ended, float(-(share * np.log2(share)).sum()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row of docs (doc_id, text)."""
    tuned(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), lambda b: {"doc_id": b["doc_id"].to_pylist(), "x": [statistics(t) for t in b["text"].to_pylist()]}, "doc_id long, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def partition_sums(df: DataFrame, f, shape: tuple[int, int]) -> np.ndarray:
    """Adds f(x, y), an array of the given shape, over all batches: in partitions, then row by row of the array."""
    rows, width = shape

    def inside(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                x = np.array(b["x"].to_pylist(), np.float64)
                total += f(x, np.array(b["y"].to_pylist(), np.float64))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "v"])

    part = df.select("x", "y").mapInArrow(inside, "i int, v binary")

    target = _arrow("i int, v binary")

    def add(key, t):
        return pa.table({"i": [key[0].as_py()], "v": [np.sum([np.frombuffer(v, np.float64) for v in t["v"].to_pylist()], axis=0).tobytes()]}, schema=target)

    some = part.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(32)).alias("p")).applyInArrow(add, "i int, v binary")
    out = np.zeros(shape)
    for r in some.groupBy("i").applyInArrow(add, "i int, v binary").collect():
        out[r.i] = np.frombuffer(r.v, np.float64)
    return out


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing means that fit best, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for c, t in zip(count, total, strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from rows of x (statistics) and y (0 to 1)."""
    rng = np.random.default_rng(seed)
    sums = partition_sums(labelled, lambda x, y: np.vstack([np.append(x.sum(0), len(x)), np.append((x * x).sum(0), y.sum())]), (2, N_STATS + 1))
    n, positive = sums[0, -1], sums[1, -1]
    mean = sums[0, :-1] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[1, :-1] / max(n, 1) - mean**2, 0)) + 1e-6
    # the kernel's width: the mean distance of standardised points is about the root of twice their dimension
    m = Model(mean, scale, rng.normal(0, 1 / math.sqrt(N_STATS), (N_STATS, features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([positive / n if n else 0.5]))
    if not n or positive in (0, n):
        return m

    def equations(x, y):
        phi = m.features(x)
        return np.hstack([phi.T @ phi, (phi.T @ y)[:, None]])

    eq = partition_sums(labelled, equations, (features + 1, features + 2))
    m.beta = np.linalg.solve(eq[:, :-1] + ridge * n * np.eye(features + 1) / features, eq[:, -1])

    def binned(x, y):
        at = np.clip(((m.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]).astype(float)

    bins = partition_sums(labelled, binned, (2, BINS))
    some = bins[0] > 0
    m.edges = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[some]
    m.levels = isotonic(bins[0][some], bins[1][some])
    return m


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels: doc_id and the label's column."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    stats = scratch.write(document_statistics(docs))
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    labelled = scratch.write(stats.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).select("x", "y"))
    model = fit(labelled)

    def run(b):
        s = model.score(np.array(b["x"].to_pylist(), np.float64).reshape(-1, N_STATS)).tolist()
        return {"doc_id": b["doc_id"].to_pylist(), "score": s}

    out = map_batches(stats, run, "doc_id long, score double")
    out = settled(spark, out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
    scratch.drop()
    return out
