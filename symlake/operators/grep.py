"""Exact search: lines that a regular expression matches, with context, put together to chunks.

A context line belongs to the last match at or before it in its file, also where it
stands just before the next one; lines before the first match belong to that.  A
chunk's id comes from the lines that it has when its match is met.  Of the chunks in
order of path and line `max_results` are kept, and the last of them has no lines after
its match.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import uuid5

#: A group's name plays no part here, and is written in several ways.
NAMED_GROUP = re.compile(r"(?<!\\)\(\?P?<[A-Za-z_]\w*>")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text; a break at the end makes no further line."""
    cut = F.split("content", "\n")
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return files.select("path", F.posexplode(cut).alias("line", "text")).withColumn("line", F.col("line") + 1)


def compiled(spark: SparkSession, pattern: str) -> str | None:
    """The pattern as the JVM takes it; None if it is no valid regular expression, whose searches find nothing."""
    plain = NAMED_GROUP.sub("(", pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(plain)
    except IllegalArgumentException:
        return None
    return plain


def searched(files: DataFrame) -> DataFrame:
    """The files that a search looks at: none with a hidden part in the path, and none that holds a NUL."""
    return files.where(~F.col("path").rlike(r"(?:^|/)\.[^/]") & (F.instr("content", "\x00") == 0))


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, text of the lines that match."""
    pattern = compiled(files.sparkSession, pattern)
    if pattern is None:
        return lines(files).where("false")
    # a pattern without anchors that a line matches is one that the whole content matches
    rows = lines(files if re.search(r"[\^$]|\\[AzZbBGQ]|\(\?", pattern) else files.where(F.col("content").rlike(pattern)))
    return rows.where(F.col("text").rlike(pattern))


def chunks(files: DataFrame, pattern: str, context: int = 10, max_results: int = 50) -> DataFrame:
    """rank, id, path, line_start, line_end, content of the chunks of all files."""
    pattern = compiled(files.sparkSession, pattern) or "(?!)"
    # only files with a match go on: their lines are windowed, others never leave the scan
    kept = files.select("path", "content").withColumn("hits", F.filter(F.split("content", "\n"), lambda x: x.rlike(pattern))).where(F.size("hits") > 0)
    rows = lines(kept).withColumn("hit", F.col("text").rlike(pattern))
    at = F.when(F.col("hit"), F.col("line"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("path").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("prev", F.last(at, True).over(before)).withColumn("next", F.first(at, True).over(after))
    near = near.where((F.col("line") - F.col("prev") <= context) | (F.col("next") - F.col("line") <= context))
    own = near.withColumn("match", F.coalesce("prev", "next"))
    first = F.collect_list(F.when(F.col("line") <= F.col("match"), F.struct("line", "text")))
    every = F.collect_list(F.struct("line", "text"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), "\n")
    by = own.groupBy("path", "match").agg(first.alias("initial"), every.alias("all"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy("path", "match"))).where(F.col("rank") <= max_results)
    last = F.col("rank") == max_results
    start = F.array_min(F.transform("initial", lambda x: x["line"]))
    return by.select(
        "rank", uuid5(F.concat_ws(":", F.lit("ripgrep"), "path", start.cast("string"), F.col("match").cast("string"), text(F.col("initial")))).alias("id"), "path",
        start.cast("int").alias("line_start"), F.when(last, F.col("match")).otherwise(F.array_max(F.transform("all", lambda x: x["line"]))).cast("int").alias("line_end"),
        F.when(last, text(F.col("initial"))).otherwise(text(F.col("all"))).alias("content"),
    )


def hits(found: DataFrame, query_id: int = 0) -> DataFrame:
    """Chunks as search hits of one query; every score is 1."""
    return found.select(F.lit(query_id).cast("long").alias("query_id"), "rank", "id", F.lit(1.0).alias("score"), F.col("path").alias("file_path"), F.col("path").alias("symbol"), "content", F.lit("ripgrep").alias("source"), F.lit("ripgrep").alias("retrieval_method"), "line_start", "line_end")
