"""Embeddings: hashed tokens in SQL, and a registry of providers for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tokens

DIMENSION = 384


def hash_sparse(texts: DataFrame, id_col: str, text_col: str, dimension: int = DIMENSION) -> DataFrame:
    """id, idx, value: signed token counts by hashed place, of length 1; texts without tokens have no rows.

    The place is the first four bytes of a token's SHA-256, the sign the parity of the fifth.
    """
    each = texts.select(F.col(id_col).alias("id"), F.explode(tokens(F.lower(F.col(text_col)))).alias("token"))
    counts = each.groupBy("id", "token").agg(F.count("*").alias("n"))  # a token is hashed once for a text
    h = F.sha2("token", 256)
    idx = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dimension).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = counts.groupBy("id", idx.alias("idx")).agg(F.sum(F.col("n") * sign).cast("double").alias("v")).where("v != 0")
    norm = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, "id").select("id", "idx", (F.col("v") / F.col("norm")).alias("value"))


def hash_dense(texts: DataFrame, id_col: str, text_col: str, dimension: int = DIMENSION) -> DataFrame:
    """id, vector: the same as arrays; zeros where a text has no tokens."""
    sparse = hash_sparse(texts, id_col, text_col, dimension).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)).cast("float"))
    return texts.select(F.col(id_col).alias("id")).join(sparse, "id", "left").select("id", places.alias("vector"))


Encoder = Callable[[list[str]], list[list[float]]]


def model_dense(texts: DataFrame, id_col: str, text_col: str, load: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """id, vector by a model: load() runs once in each worker and gives a function from texts to vectors."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            values = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(values), batch) for v in encode(values[k : k + batch])])

    return texts.select(F.col(id_col).alias("id"), embed(F.col(text_col)).alias("vector"))


def _library(name: str, make: Callable) -> Callable[[str], Callable[[], Encoder]]:
    def of(model: str) -> Callable[[], Encoder]:
        def load() -> Encoder:
            import importlib

            return make(importlib.import_module(name), model)

        return load

    return of


#: Loaders of model libraries; the libraries are looked up only when a worker needs them.
PROVIDERS = {
    "sentence_transformers": _library("sentence_transformers", lambda lib, model: lambda m=lib.SentenceTransformer(model): lambda xs: m.encode(xs, normalize_embeddings=True).tolist()),
    "fastembed": _library("fastembed", lambda lib, model: lambda m=lib.TextEmbedding(model): lambda xs: [list(map(float, v)) for v in m.embed(xs)]),
}


def embed(texts: DataFrame, id_col: str, text_col: str, provider: str = "hash", model: str = "", dimension: int = DIMENSION, batch: int = 32) -> DataFrame:
    """id, vector by provider: hash, or a model library."""
    if provider == "hash":
        return hash_dense(texts, id_col, text_col, dimension)
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {provider}")
    load = PROVIDERS[provider](model)
    return model_dense(texts, id_col, text_col, lambda: load()(), batch)
