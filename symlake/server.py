"""A server that offers the tools of an index to agents; its library is looked up only when it is started."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from .config import Settings
from .operators.tools import MAX_CHARS, MAX_LINES, MAX_RESULTS, Limits, Tools
from .search import Index
from .sources.trees import source_files


def tools_of(index: Index, limits: Limits = Limits()) -> Tools:
    files = source_files(index.spark, index.root, ("*",), index.settings.exclude_dirs)
    return Tools(index.table("chunks"), index.table("symbols"), index.table("symbol_edges"), files, limits, index.table("postings"))


def build(tools: Tools):
    """A server with the five tools under their names."""
    try:
        library = importlib.import_module("mcp.server.fastmcp")
    except ImportError as e:
        raise RuntimeError("the tool server needs the package mcp") from e
    server = library.FastMCP("symlake")

    def get_code_window(file: str, line: int, radius: int = 20) -> dict:
        return tools.code_window(file, line, radius)

    for tool in (tools.search_code, get_code_window, tools.explain_symbol, tools.find_usages, tools.related_symbols):
        server.tool()(tool)
    return server


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symlake-server")
    p.add_argument("--root", required=True)
    p.add_argument("--index-path", default=Settings().index_path)
    p.add_argument("--max-results", type=int, default=MAX_RESULTS)
    p.add_argument("--max-lines-per-result", type=int, default=MAX_LINES)
    p.add_argument("--max-total-chars", type=int, default=MAX_CHARS)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("symlake-server").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    index = Index(spark, Settings(index_path=a.index_path), a.root)
    build(tools_of(index, Limits(a.max_results, a.max_lines_per_result, a.max_total_chars))).run()


if __name__ == "__main__":
    main()
