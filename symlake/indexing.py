"""Building an index: files to symbols, edges, chunks, profiles and vectors, in one parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import chunks, embed, enrich, fts, parsing, symbols, vector
from .sources.store import Store, buckets_of
from .sources.trees import source_files


def index_files(spark: SparkSession, files: DataFrame, settings: Settings, make_client: Callable | None = None) -> dict[str, int]:
    """Writes the tables of an index for files (path, language, content); gives counts.

    Files are parsed once; edges of the files are replaced, everything else is put in by key, and nothing that has
    vanished is deleted.
    """
    store = Store(spark, settings.index_path)
    parsed = parsing.parse(files, settings.on_error).persist()
    try:
        found = symbols.symbols(parsed)
        edges = symbols.edges(parsed)
        units = chunks.indexed(files, found)
        client = make_client or enrich.client_for(settings.llm)
        units, profiles = enrich.enrich(units, client)
        touched = buckets_of(files, "path")
        with store.commit():
            store.upsert("files", files, touched)
            store.upsert("symbols", found, touched)
            store.upsert("chunks", units, touched)
            # the full-text index takes chunks as they have just been written, models' profiles included
            new = store.read("chunks", touched).join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
            store.replace_ids("postings", fts.stored(new, "id", fts.CHUNK_COLUMNS).join(new.select("id", "file_path"), "id"), new.select("id", "file_path"), touched)
            store.replace_files("symbol_edges", edges, files.select("path"), touched)
            if profiles is not None:
                store.upsert("llm_enrichments", profiles)
            if settings.vectors:
                e = settings.embeddings
                payload = chunks.payloads(units, found, edges)
                vectors = embed.embed(payload, "id", "embedding_text", e.provider, e.model, e.dimensions, e.batch_size)
                if e.provider != "hash":  # hashed tokens have the dimension that they are asked for
                    vectors = vectors.withColumn("vector", vector.of_dimension(F.col("vector"), e.dimensions))
                store.upsert("vectors", payload.join(vectors, "id"), touched)
        count = lambda df: df.agg(F.count("*")).first()[0]
        n = count(files)
        occurrences = symbols.occurrences(parsed)
        return {"files": n, "symbols": count(occurrences), "chunks": count(occurrences) + n, "edges": symbols.edge_count(parsed, edges).first().n, "vectors": count(store.read("vectors")) if settings.vectors else 0}
    finally:
        parsed.unpersist()


def index_tree(spark: SparkSession, root: str, settings: Settings, make_client: Callable | None = None) -> dict[str, int]:
    return index_files(spark, source_files(spark, root, settings.include_globs, settings.exclude_dirs), settings, make_client)
