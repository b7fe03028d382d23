"""Tools for agents: searches and lookups whose answers are cut to a budget."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_lines
from . import fts, fuse, graph, grep
from .window import code_windows

MAX_RESULTS, MAX_LINES, MAX_CHARS = 5, 40, 12_000


@dataclass(frozen=True)
class Limits:
    results: int = MAX_RESULTS
    lines: int = MAX_LINES
    chars: int = MAX_CHARS


def clip_hits(hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The first hits of each query, each cut to its first lines."""
    return hits.where(F.col("rank") <= limits.results).withColumn("content", clip_lines(F.col("content"), limits.lines))


def fit_budget(answers: DataFrame, column: str = "answer", limits: Limits = Limits()) -> DataFrame:
    """answers (JSON text) with truncated and, in place of what is over the budget, a preview of it."""
    over = F.length(column) > limits.chars
    preview = F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(column, 1, limits.chars).alias("preview")))
    return answers.withColumn("truncated", over).withColumn(column, F.when(over, preview).otherwise(F.col(column)))


def related_answer(row) -> dict:
    """A row of graph.related as a map."""
    return {"symbol": row.symbol.asDict(), "related_symbol_ids": list(row.related), "edges": [{k: v for k, v in e.asDict().items() if k != "rank"} for e in row.edges]}


class Tools:
    """The five tools over the tables of an index; answers are maps ready for JSON.  An unknown name has an answer too, an empty one."""

    def __init__(self, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, limits: Limits = Limits(), postings: DataFrame | None = None):
        self.chunks, self.symbols, self.edges, self.files, self.limits, self.postings = chunks, symbols, edges, files, limits, postings

    def _asked(self, text: str) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([(0, text)], "query_id long, text string")

    def _within(self, answer: dict) -> dict:
        whole = json.dumps(answer, default=str)
        return answer if len(whole) <= self.limits.chars else {"truncated": True, "preview": whole[: self.limits.chars]}

    def search_code(self, query: str, top_k: int = MAX_RESULTS) -> dict:
        """Hits of full-text and exact search, fused; every list has as many as are asked for."""
        n, asked = min(top_k, self.limits.results), self._asked(query)
        lists = {"ripgrep": grep.hits(grep.chunks(grep.searched(self.files), query, max_results=n)), "fts": fts.chunk_hits(asked, self.chunks, n, self.postings)}
        rows = clip_hits(fuse.hybrid(asked, lists, n)[0], Limits(n, self.limits.lines)).orderBy("rank").collect()
        return self._within({"query": query, "results": [{k: r[k] for k in ("file_path", "symbol", "line_start", "line_end", "retrieval_method", "content")} for r in rows]})

    def code_window(self, path: str, line: int, radius: int = 20) -> dict:
        place = self.chunks.sparkSession.createDataFrame([(path, line)], "file_path string, line int")
        at = code_windows(place, self.files, min(radius, self.limits.lines // 2))
        found = at.select("file_path", "line_start", "line_end", clip_lines(F.col("content"), self.limits.lines).alias("content")).first()
        return self._within(found.asDict() if found else {})

    def explain_symbol(self, name: str) -> dict:
        rows = graph.explain(self._asked(name), self.symbols, self.edges).orderBy("rank").collect()
        if not rows:
            return self._within({"symbol": name, "edges": []})
        head = rows[0].asDict()
        symbol = {c: head["symbol_file" if c == "file_path" else c] for c in self.symbols.columns}
        return self._within({"symbol": symbol, "edges": [{c: r[c] for c in self.edges.columns} for r in rows if r.src_symbol_id is not None]})

    def find_usages(self, name: str) -> dict:
        rows = graph.usages(self._asked(name), self.symbols, self.edges).where(F.col("rank") <= self.limits.results).orderBy("rank").collect()
        return self._within({"symbol": name, "usages": [{c: r[c] for c in self.edges.columns} for r in rows]})

    def related_symbols(self, name: str) -> dict:
        found = graph.related(self._asked(name), self.symbols, self.edges, self.limits.results).first()
        return self._within(related_answer(found) if found else {"symbol": name, "related_symbol_ids": [], "edges": []})
