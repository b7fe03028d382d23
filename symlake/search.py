"""Searches over an index: hybrid with its fallback, and the reports of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import embed, fts, fuse, graph, grep, impact, tools, vector
from .operators.window import checked_window
from .sources.store import Store
from .sources.trees import source_files


class Index:
    """An index that has been built, with the tree that it came from where that is at hand."""

    def __init__(self, spark: SparkSession, settings: Settings, root: str | None = None):
        self.spark, self.settings, self.root = spark, settings, root
        self.store = Store(spark, settings.index_path)

    def asked(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, text string")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def vector_hits(self, asked: DataFrame, limit: int) -> DataFrame:
        e = self.settings.embeddings
        q = embed.embed(asked, "query_id", "text", e.provider, e.model, e.dimensions, e.batch_size).select(F.col("id").alias("query_id"), F.col("vector").alias("vec"))
        v = self.table("vectors")
        # vectors are searched by numbers, so ids come back by a join on them
        keyed = v.withColumn("n", F.xxhash64("id"))
        top = vector.search(q, keyed.select(F.col("n").alias("id"), F.col("vector").alias("vec")), limit, e.dimensions)
        return vector.chunk_hits(top.withColumnRenamed("id", "n").join(keyed.select("n", "id"), "n").drop("n"), v)

    def exact_hits(self, text: str, limit: int) -> DataFrame:
        return grep.hits(grep.chunks(grep.searched(source_files(self.spark, self.root, ("*",), (*self.settings.exclude_dirs, ".git"))), text, max_results=limit))

    def text_hits(self, asked: DataFrame, limit: int) -> DataFrame:
        return fts.chunk_hits(asked, self.table("chunks"), limit, self.table("postings"))

    def search(self, text: str, limit: int = 10, vectors: bool = True) -> tuple[DataFrame, dict[str, int], dict[str, str]]:
        """(hits, raw counts, errors): exact search where there is a tree, full text, vectors; a failing vector search counts 0."""
        asked, lists, errors = self.asked(text), {}, {}
        if self.root is not None:
            lists["ripgrep"] = self.exact_hits(text, limit)
        lists["fts"] = self.text_hits(asked, limit)
        if vectors and self.settings.vectors:
            try:
                lists["vector"] = self.vector_hits(asked, limit)
                lists["vector"].take(1)
            except Exception as e:  # a provider that isn't installed must not stop the other methods
                lists.pop("vector", None)
                errors["vector"] = str(e)
        fused, counts = fuse.hybrid(asked, lists, limit)
        return fused, {r.method: r.n for r in counts.collect()}, errors

    def search_or_graph(self, text: str, limit: int = 10, vectors: bool = True) -> list[dict]:
        """Hits in order, or where there are none the edges that the question asks for."""
        hits = [r.asDict() for r in self.search(text, limit, vectors)[0].orderBy("rank").collect()]
        return hits or [r.asDict() for r in graph.architecture_search(self.asked(text), self.table("symbol_edges"), limit).orderBy("rank").collect()]

    def explain(self, name: str) -> dict | None:
        rows = graph.explain(self.asked(name), self.table("symbols"), self.table("symbol_edges")).orderBy("rank").collect()
        if not rows:
            return None
        head = rows[0].asDict()
        symbol = {k: head[k] for k in ("id", "qualified_name", "symbol_file", "name", "kind", "start_line", "end_line")}
        return {"symbol": symbol, "edges": [{k: r[k] for k in ("src_symbol_id", "dst_symbol_id", "edge_type", "file_path", "confidence")} for r in rows if r.src_symbol_id is not None]}

    def usages(self, name: str) -> list[dict]:
        return [r.asDict() for r in graph.usages(self.asked(name), self.table("symbols"), self.table("symbol_edges")).orderBy("rank").collect()]

    def related(self, name: str, limit: int = 10) -> dict | None:
        found = graph.related(self.asked(name), self.table("symbols"), self.table("symbol_edges"), limit).first()
        return tools.related_answer(found) if found else None

    def check_vectors(self) -> None:
        """An error if vector search cannot work: no vectors, some of another dimension, or a provider that isn't there."""
        e = self.settings.embeddings
        if self.table("vectors").isEmpty():
            raise RuntimeError(f"there are no vectors under {self.store.root}")
        try:
            self.vector_hits(self.asked("availability"), 1).collect()
        except Exception as x:
            raise RuntimeError(f"vector search with {e.provider} is not available: {str(x).splitlines()[0]}") from x

    def impact(self, name: str, depth: int = 2, limit: int = 10, radius: int = 12) -> dict | None:
        files = source_files(self.spark, self.root, self.settings.include_globs, self.settings.exclude_dirs) if self.root else None
        r = impact.report(self.asked(name), self.table("symbols"), self.table("symbol_edges"), files, depth, limit, radius)
        root = r["symbol"].first()
        if root is None:
            return None
        rows = lambda k, order: [x.asDict() for x in r[k].orderBy(order).collect()]
        return {
            "symbol": root.asDict(), "direct_callers": rows("direct_callers", "rank"), "related_methods": rows("related_methods", "rank"), "files_affected": rows("files_affected", "rank"),
            "risk_notes": r["risk_notes"].first().notes, "top_code_windows": rows("top_code_windows", "rank") if files is not None else [], "impact_graph": rows("impact_graph", "ord"),
        }

    def window(self, path: str, line: int, radius: int = 20) -> dict | None:
        row = checked_window(source_files(self.spark, self.root, ("*",), self.settings.exclude_dirs), path, line, radius).first()
        return row.asDict() if row else None
