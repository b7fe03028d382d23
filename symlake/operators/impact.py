"""Impact of a change to a symbol: callers, files, related methods, notes, code windows, call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept
from . import graph
from .window import code_windows


def _first_ends(roots: DataFrame, edges: DataFrame, end: str, limit: int) -> DataFrame:
    """The first edges at one end of each root, and the first that are calls: confidence falling, then lines, nulls first.

    rank counts all edges of the root in this order, calls_rank the calls among them.
    """
    r = roots.select(F.col("id").alias("root"))
    at = edges.join(r if graph.few(r) else r.hint("shuffle_hash"), F.col(end) == F.col("root"))  # roots lie in parts; edges need not be sorted for them
    w = Window.partitionBy("root").orderBy(F.desc("confidence"), F.asc_nulls_first("line_start"), "src_symbol_id", "dst_symbol_id", "edge_type", "file_path")
    calls = F.count(F.when(F.col("edge_type") == "calls", 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = at.withColumns({"rank": F.row_number().over(w), "calls_rank": calls.cast("int")})
    return both.where((F.col("rank") <= limit) | ((F.col("edge_type") == "calls") & (F.col("calls_rank") <= limit)))


def fragments(roots: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """callers, incoming, outgoing, neighbours of each root (root, rank, ...)."""
    symbols, edges = kept(symbols), kept(edges)  # each is read by several legs, and by what comes of them
    incoming = graph.with_names(kept(_first_ends(roots, edges, "dst_symbol_id", limit)), symbols)
    outgoing = graph.with_names(_first_ends(roots, edges, "src_symbol_id", limit), symbols)
    return {
        "callers": incoming.where((F.col("edge_type") == "calls") & (F.col("calls_rank") <= limit)).withColumn("rank", F.col("calls_rank")).drop("calls_rank"),
        "incoming": incoming.where(F.col("rank") <= limit).drop("calls_rank"),
        "outgoing": outgoing.where(F.col("rank") <= limit).drop("calls_rank"),
        "neighbours": graph.same_file_neighbours(roots, symbols, limit),
    }


def affected_files(roots: DataFrame, f: dict[str, DataFrame]) -> DataFrame:
    """root, file_path, score, reasons (in order of first mention).  A caller counts as caller and as incoming edge."""
    source = F.coalesce(F.when(F.col("src_file_path") != "", F.col("src_file_path")), F.col("file_path"))
    leg = lambda df, n, path, reason, weight: df.select("root", path.alias("file_path"), reason.alias("reason"), F.lit(weight).alias("weight"), F.struct(F.lit(n).alias("leg"), F.col("rank").alias("rank")).alias("at"))
    own = roots.select(F.col("id").alias("root"), F.col("file_path"), F.lit("target symbol is defined here").alias("reason"), F.lit(2.0).alias("weight"), F.struct(F.lit(0).alias("leg"), F.lit(0).alias("rank")).alias("at"))
    parts = own.unionByName(leg(f["callers"], 1, source, F.lit("direct caller"), 1.5))
    parts = parts.unionByName(leg(f["incoming"], 2, source, F.concat(F.lit("incoming "), "edge_type", F.lit(" edge")), 1.0))
    parts = parts.unionByName(leg(f["outgoing"], 3, F.col("file_path"), F.concat(F.lit("outgoing "), "edge_type", F.lit(" edge")), 0.5))
    by = parts.where("file_path is not null and file_path != ''").groupBy("root", "file_path").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("all"))
    reasons = F.array_distinct(F.transform("all", lambda x: x["reason"]))
    return graph.ranked(by, ["root"], [F.desc("score"), "file_path"]).select("root", "rank", "file_path", "score", reasons.alias("reasons"))


def related_methods(roots: DataFrame, f: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """root, rank, symbol_id, symbol, relations, file_path in order of first mention; of paths the last counts."""
    at = lambda n: F.struct(F.lit(n).alias("leg"), F.col("rank").alias("rank")).alias("at")
    rows = f["incoming"].select("root", at(0), F.col("src_symbol_id").alias("symbol_id"), F.coalesce("src_symbol", "src_symbol_id").alias("symbol"), F.concat(F.lit("incoming "), "edge_type").alias("relation"), F.col("src_file_path").alias("path"))
    rows = rows.unionByName(f["outgoing"].select("root", at(1), F.col("dst_symbol_id").alias("symbol_id"), F.coalesce("dst_symbol", "dst_symbol_id").alias("symbol"), F.concat(F.lit("outgoing "), "edge_type").alias("relation"), F.col("file_path").alias("path")))
    rows = rows.unionByName(f["neighbours"].select("root", at(2), F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol"), F.lit("same file").alias("relation"), F.col("file_path").alias("path")))
    rows = rows.where("coalesce(symbol_id, symbol) is not null and symbol_id != root")
    by = rows.groupBy("root", "symbol_id").agg(F.min("at").alias("first"), F.min_by("symbol", "at").alias("symbol"), F.max_by("path", F.when(F.col("path") != "", F.col("at"))).alias("file_path"), F.array_sort(F.collect_list(F.struct("at", "relation"))).alias("all"))
    relations = F.array_distinct(F.transform("all", lambda x: x["relation"]))
    return graph.ranked(by, ["root"], ["first"], limit).select("root", "rank", "symbol_id", "symbol", relations.alias("relations"), "file_path")


#: The texts of notes.
CALLERS_NOTE, FILES_NOTE = " direct caller(s) may need regression coverage.", ("Impact crosses ", " files.")
CALLS_NOTE = "Target calls other symbols; validate downstream parsing and conversion behavior."
TESTED_NOTE = "Tests already reference this symbol; failing tests can guide localization."
ALONE_NOTE = "No indexed direct callers found; impact may come from reflection, framework entrypoints, or unresolved calls."


def risk_notes(roots: DataFrame, f: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """root, notes."""
    callers = f["callers"].groupBy("root").agg(F.count("*").alias("callers"))
    tests = f["incoming"].groupBy("root").agg(F.max(F.coalesce(F.when(F.col("src_file_path") != "", F.col("src_file_path")), F.col("file_path")).contains("test/")).alias("tested"))
    calls = f["outgoing"].groupBy("root").agg(F.max(F.col("edge_type") == "calls").alias("calls"))
    crossing = files.groupBy("root").agg(F.count("*").alias("files"))
    r = roots.select(F.col("id").alias("root"), "kind")
    for part in (callers, tests, calls, crossing):
        r = r.join(part, "root", "left")
    n = F.coalesce("callers", F.lit(0))
    notes = F.array(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(CALLERS_NOTE))),
        F.when(F.col("calls"), CALLS_NOTE),
        F.when(F.col("tested"), TESTED_NOTE),
        F.when(F.col("files") > 1, F.concat(F.lit(FILES_NOTE[0]), F.col("files").cast("string"), F.lit(FILES_NOTE[1]))),
        F.when(F.col("kind").isin("method", "function", "async_function") & (n == 0), ALONE_NOTE),
    )
    return r.select("root", F.array_compact(notes).alias("notes"))


def windows(roots: DataFrame, f: dict[str, DataFrame], files: DataFrame, radius: int = 12, limit: int = 10) -> DataFrame:
    """root, rank, file_path, line_start, line_end, content, reason: the target and its callers, each place once."""
    own = roots.select(F.col("id").alias("root"), F.lit(0).alias("rank"), "file_path", F.col("start_line").alias("line"), F.lit("target definition").alias("reason"))
    line = F.coalesce(F.when(F.col("line_start") != 0, F.col("line_start")), F.col("src_start_line"))
    path = F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.col("src_file_path"))
    calls = f["callers"].select("root", "rank", path.alias("file_path"), line.alias("line"), F.concat(F.lit("direct caller: "), F.coalesce("src_symbol", F.lit("None"))).alias("reason"))
    asked = own.unionByName(calls.where("file_path is not null and line is not null"))
    once = graph.ranked(asked, ["root", "file_path", "line"], ["rank"], 1, "k").drop("k")
    return graph.ranked(code_windows(once, files, radius).withColumnRenamed("rank", "place"), ["root"], ["place"], limit).drop("place", "line")


def report(queries: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame | None = None, depth: int = 2, limit: int = 10, radius: int = 12) -> dict[str, DataFrame]:
    """Seven frames by name; roots are the best symbols of the queries, and an unknown symbol has no rows anywhere."""
    roots = graph.find_symbols(queries, symbols, 1).drop("rank")
    f = fragments(roots, symbols, edges, limit)
    paths = affected_files(roots, f)
    empty = roots.select(F.col("id").alias("root")).where("false")
    return {
        "symbol": roots, "direct_callers": f["callers"], "related_methods": related_methods(roots, f, limit), "files_affected": paths,
        "risk_notes": risk_notes(roots, f, paths), "top_code_windows": windows(roots, f, files, radius, limit) if files is not None else empty,
        "impact_graph": graph.with_names(graph.calls_walk(roots, edges, depth, limit), symbols),
    }
