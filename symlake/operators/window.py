"""Code windows: lines around a line of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LINE_BREAK
from ..sources.store import merged


def inside(path: Column) -> Column:
    """Whether a path stays within the tree: relative, and no part of it leads out."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")), lambda s, p: F.struct(
        F.when(p == "..", s["at"] - 1).when(p.isin("", "."), s["at"]).otherwise(s["at"] + 1).alias("at"), (s["out"] | ((p == "..") & (s["at"] == 0))).alias("out")))
    return ~path.startswith("/") & ~depth["out"]


#: Lines of a file that lie together, and characters that go back to the JVM at once.
BLOCK, CHARS = 64, 1 << 20
_BREAK = re.compile(LINE_BREAK)


def lines_of(content: str) -> Iterator[str]:
    """Lines without their breaks; a break at the end makes no further line."""
    at = 0
    for m in _BREAK.finditer(content):
        yield content[at : m.start()]
        at = m.end()
    if at < len(content):
        yield content[at:]


def line_counts(files: DataFrame) -> DataFrame:
    """file_path, n: the number of lines of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(1 for _ in lines_of(c.as_py())) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(n, pa.int32())], ["file_path", "n"])

    return files.where("content is not null").select("path", "content").mapInArrow(run, "file_path string, n int")


def line_blocks(files: DataFrame) -> DataFrame:
    """file_path, block, lines: files cut into blocks of BLOCK lines, numbered from 0."""
    names = ["file_path", "block", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                lines, rows, size = lines_of(content.as_py()), [], 0
                for no in count():
                    block = list(islice(lines, BLOCK))
                    if block:
                        rows.append((no, block))
                        size += sum(map(len, block))
                    if rows and (not block or size > CHARS):
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names)
                        rows, size = [], 0
                    if not block:
                        break

    return files.where("content is not null").select("path", "content").mapInArrow(run, "file_path string, block int, lines array<string>")


def with_content(places: DataFrame, files: DataFrame) -> DataFrame:
    """places (file_path, line_start, line_end, ...) with content: these lines of the file, as far as it has them.

    Places meet the blocks of lines that they touch, so that a file's text is not laid beside each of its places.
    """
    keys = ["file_path", "line_start", "line_end"]
    first, base = F.greatest(F.lit(1), F.col("line_start")), F.col("block") * BLOCK
    no = lambda line: F.floor((line - 1) / BLOCK).cast("int")
    asked = places.select(*keys).distinct().where(F.col("line_end") >= first).withColumn("block", F.explode(F.sequence(no(first), no(F.col("line_end")))))
    begin = F.greatest(F.lit(1), first - base)
    lines = F.slice("lines", begin, F.least(F.lit(BLOCK), F.col("line_end") - base) - begin + 1)
    met = asked.join(merged(line_blocks(files)), ["file_path", "block"]).withColumn("lines", lines).where(F.size("lines") > 0)
    parts = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", F.array_join("lines", "\n").alias("text")))).alias("parts"))
    text = parts.select(*keys, F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("content"))
    return places.join(merged(text), keys, "left").withColumn("content", F.coalesce("content", F.lit("")))


def code_windows(places: DataFrame, files: DataFrame, radius: int | Column = 20) -> DataFrame:
    """places (file_path, line, ...) with line_start, line_end, content; places of unknown files, or outside, are left out.

    The window is cut to the file's lines; one that lies outside them, or of a negative radius, is empty.
    """
    r = F.lit(radius) if isinstance(radius, int) else radius
    at = places.where(inside(F.col("file_path"))).join(merged(line_counts(files)), "file_path")
    start = F.greatest(F.lit(1), F.col("line") - r)
    end = F.least(F.col("n"), F.col("line") + r)
    return with_content(at.withColumns({"line_start": start.cast("int"), "line_end": end.cast("int")}).drop("n"), files)


def checked_window(files: DataFrame, path: str, line: int, radius: int = 20) -> DataFrame:
    """One window; a path that leads out of the tree is an error."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path leads out of the tree: {path}")
    return code_windows(files.sparkSession.createDataFrame([(path, line)], "file_path string, line int"), files, radius)
