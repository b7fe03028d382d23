"""Runs of evaluations: retrieval cases by mode, fault localisation by bug, with means of the measures."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions.exprs import token_count
from .indexing import index_tree
from .operators import evals, fts, fuse, graph, grep, impact
from .search import Index
from .sources.trees import source_files

MODES = ("ripgrep", "fts", "hybrid")
MEASURES = ["recall_at_5", "recall_at_10", "mrr", "hit_at_1", "context_compression_ratio"]
LOCAL_MEASURES = ["file_recall_at_1", "file_recall_at_5", "file_recall_at_10", "method_recall_at_10", "mrr", "context_compression_ratio"]
CASES = "id string, query string, expected_symbols array<string>, expected_files array<string>"
BUG_CASES = "bug_id string, project string, query string, impact_symbol string, expected_files array<string>, expected_methods array<string>"


def numbered(cases: DataFrame, id_col: str = "id") -> DataFrame:
    """Cases with a number for each, as the operators take batches of numbered queries."""
    return cases.withColumn("query_id", F.xxhash64(id_col)).withColumn("text", F.coalesce("query", F.lit("")))


def tree_tokens(index: Index):
    """Tokens of all files of the tree, as a column."""
    n = source_files(index.spark, index.root, ("*",), (".git",)).agg(F.sum(token_count(F.col("content"))).alias("n")).first().n
    return F.lit(n or 0)


def exact_hits(index: Index, asked: DataFrame, limit: int) -> DataFrame:
    """Hits of exact search; patterns differ by case, so each case is a search of its own, and cases are few."""
    files = grep.searched(source_files(index.spark, index.root, ("*",), index.settings.exclude_dirs))
    parts = [grep.hits(grep.chunks(files, r.text, max_results=limit), r.query_id) for r in asked.select("query_id", "text").collect()]
    return reduce(DataFrame.unionByName, parts)


def hits_by_mode(index: Index, asked: DataFrame, limit: int = 10, vectors: bool = False) -> dict[str, DataFrame]:
    """Hits of every case in each mode; the lists of the modes are made once.  With vectors, hybrid takes them in."""
    lists = {"ripgrep": exact_hits(index, asked, limit), "fts": index.text_hits(asked, limit)}
    if vectors:
        lists["vector"] = index.vector_hits(asked, limit)
    lists = {m: graph._cut(h) for m, h in lists.items()}
    fused, counts = fuse.hybrid(asked, lists, limit)
    return lists | {"hybrid": graph._cut(fused), "counts": counts}  # every measure reads the fused list


def evaluate(index: Index, cases: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(measures of each mode and case, their means for each mode and overall); cases as CASES says."""
    asked = numbered(cases)
    none = F.array().cast("array<string>")
    wanted = asked.select(F.col("query_id").alias("case_id"), F.concat(F.coalesce("expected_symbols", none), F.coalesce("expected_files", none)).alias("expected"))
    total = tree_tokens(index)
    names = asked.select(F.col("query_id").alias("case_id"), "id")
    by_mode = hits_by_mode(index, asked, limit)
    parts = [evals.case_metrics(wanted, by_mode[mode].withColumnRenamed("query_id", "case_id"), total).withColumn("mode", F.lit(mode)) for mode in MODES]
    metrics = reduce(DataFrame.unionByName, parts).join(names, "case_id").select("mode", "id", *MEASURES, "retrieved_tokens")
    return metrics, evals.summary(metrics, ["mode"], MEASURES)


def impact_symbol(cases: DataFrame) -> DataFrame:
    """cases with the symbol whose impact is looked at: the given one, the last part of the first method, or the query."""
    method = F.element_at(F.split(F.get(F.coalesce("expected_methods", F.array().cast("array<string>")), 0), r"\."), -1)
    return cases.withColumn("impact_symbol", F.coalesce(F.when(F.col("impact_symbol") != "", F.col("impact_symbol")), method, F.col("query")))


def localise(index: Index, cases: DataFrame, limit: int = 10, depth: int = 2, radius: int = 12, vectors: bool = False) -> DataFrame:
    """Measures of fault localisation for the cases of one tree (BUG_CASES)."""
    asked = numbered(impact_symbol(cases), "bug_id")
    hits = hits_by_mode(index, asked, limit, vectors)["hybrid"].withColumnRenamed("query_id", "case_id")
    symbols, edges = index.table("symbols"), index.table("symbol_edges")
    looked = asked.select("query_id", F.col("impact_symbol").alias("text"))
    # what several legs read is cut off, or the measures' plan holds it dozens of times, each time with its broadcasts
    best = graph._cut(graph.find_symbols(looked, symbols, 1).drop("rank"))
    roots = graph._cut(best.dropDuplicates(["id"]))
    f = {k: graph._cut(v) for k, v in impact.fragments(roots, symbols, edges, limit).items()}
    files = source_files(index.spark, index.root, index.settings.include_globs, index.settings.exclude_dirs)
    frames = {"symbol": roots.withColumnRenamed("id", "root"), "direct_callers": f["callers"], "files_affected": impact.affected_files(roots, f), "related_methods": impact.related_methods(roots, f, limit), "top_code_windows": impact.windows(roots, f, files, radius, limit)}
    # several cases may look at one symbol: its frames are joined to each of them
    of = best.select(F.col("id").alias("root"), F.col("query_id").alias("case_id"))
    frames = {k: graph._cut((v.drop("query_id") if "query_id" in v.columns else v).join(of, "root")) for k, v in frames.items()}
    wanted = asked.select(F.col("query_id").alias("case_id"), "bug_id", "project", "expected_files", "expected_methods")
    out = evals.localise(wanted.drop("bug_id", "project"), hits, frames, tree_tokens(index))
    return graph._cut(wanted.select("case_id", "bug_id", "project").join(out, "case_id").drop("case_id"))


#: Parts of an impact report that a summary keeps, and how many rows of each.
SUMMARY_ROWS = 5


def impact_summary(report: dict | None) -> dict | None:
    """The head of an impact report: symbol, first callers and files, notes, and the places of windows without their text."""
    if report is None:
        return None
    place = ("file_path", "line_start", "line_end", "reason")
    return {
        "symbol": report["symbol"], "direct_callers": report["direct_callers"][:SUMMARY_ROWS], "files_affected": report["files_affected"][:SUMMARY_ROWS],
        "risk_notes": report["risk_notes"], "top_code_windows": [{k: w[k] for k in place} for w in report["top_code_windows"][:SUMMARY_ROWS]],
    }


def case_reports(index: Index, cases: DataFrame, limit: int = 10, depth: int = 2, radius: int = 12, vectors: bool = False) -> list[dict]:
    """What a report says of each case of a tree: measures, hits by method, first hits, impact.  Cases are few."""
    asked = numbered(impact_symbol(cases), "bug_id")
    measured = {r.bug_id: r.asDict() for r in localise(index, cases, limit, depth, radius, vectors).collect()}
    by_mode = hits_by_mode(index, asked, limit, vectors)
    raw = {(r.query_id, r.method): r.n for r in by_mode["counts"].collect()}
    fused = {(r.query_id, r.retrieval_method): r.n for r in evals.method_counts(by_mode["hybrid"]).collect()}
    first = evals.hit_summary(by_mode["hybrid"], SUMMARY_ROWS).orderBy("query_id", "rank").collect()
    methods = ("ripgrep", "fts", "vector")
    return [
        {
            "bug_id": r.bug_id, "query": r.query, "impact_symbol": r.impact_symbol, "metrics": {k: measured[r.bug_id][k] for k in LOCAL_MEASURES},
            "retrieval_method_counts": {m: fused[r.query_id, m] for m in methods if (r.query_id, m) in fused}, "raw_retrieval_method_counts": {m: raw[r.query_id, m] for m in methods if vectors or m != "vector"},
            "search_hits": [h.asDict() for h in first if h.query_id == r.query_id], "impact": impact_summary(index.impact(r.impact_symbol, depth, limit, radius)),
        }
        for r in asked.orderBy("bug_id").collect()
    ]


def version_of(bug: str) -> tuple[str, str]:
    """(project, version) of a bug's name, as in Lang_1b."""
    project, _, version = bug.partition("_")
    if not project or not version:
        raise ValueError(f"a bug is named project_version, not {bug}")
    return project, version


def _indexed(spark, bug: str, root: str, settings: Settings, vectors: bool, reuse: bool) -> Index:
    own = settings.with_overrides(vectors=vectors).for_bug(bug)
    if not reuse:
        index_tree(spark, root, own)
    index = Index(spark, own, root)
    if vectors:
        index.check_vectors()
    return index


def benchmark(spark, cases: DataFrame, trees: dict[str, str], settings: Settings, limit: int = 10, vectors: bool | None = None, reuse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(measures of each case, means by bug and overall): every bug's tree is indexed on its own."""
    vectors = settings.vectors if vectors is None else vectors
    parts = [localise(_indexed(spark, bug, root, settings, vectors, reuse), cases.where(F.col("bug_id") == bug), limit, vectors=vectors) for bug, root in sorted(trees.items())]
    metrics = reduce(DataFrame.unionByName, parts)
    return metrics, evals.summary(metrics, ["bug_id"], LOCAL_MEASURES)


def means(rows: list[dict]) -> dict[str, float]:
    """Means of measures over rows, nulls left out; a measure that all rows lack is left out as well."""
    known = {k: [r[k] for r in rows if r.get(k) is not None] for k in sorted({k for r in rows for k in r})}
    return {k: sum(v) / len(v) for k, v in known.items() if v}


def benchmark_report(spark, cases: DataFrame, trees: dict[str, str], settings: Settings, limit: int = 10, vectors: bool | None = None, reuse: bool = False) -> dict:
    """A whole run ready for JSON: every bug with project, version, counters of its index, cases and means, and the means of all."""
    vectors, bugs = settings.vectors if vectors is None else vectors, []
    for bug, root in sorted(trees.items()):
        project, version = version_of(bug)
        index = _indexed(spark, bug, root, settings, vectors, reuse)
        found = case_reports(index, cases.where(F.col("bug_id") == bug), limit, vectors=vectors)
        bugs.append({
            "bug_id": bug, "project": project, "version": version, "root": root, "index_path": index.settings.index_path, "collection": index.settings.collection if vectors else None,
            "index_counts": {r.name: r.n for r in index.store.counters().collect()}, "summary": means([c["metrics"] for c in found]), "cases": found,
        })
    return {"with_vectors": vectors, "summary": means([c["metrics"] for b in bugs for c in b["cases"]]), "bugs": bugs}


def write_json(path: str, frames: dict[str, DataFrame]) -> None:
    """Reports (bounded by the number of cases) as one JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in frames.items()}, f, indent=2, default=str)


def write_cases(path: str, cases: DataFrame) -> None:
    """Cases as YAML, keys in the order of the columns."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump([r.asDict(recursive=True) for r in cases.collect()], f, sort_keys=False, allow_unicode=True)
