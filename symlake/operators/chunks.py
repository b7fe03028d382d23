"""Chunks, profiles, file summaries and payloads of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import split_lines, strip, unit_type, uuid5
from ..sources.store import merged
from .window import with_content

MOST_EDGES, MOST_NAMES = 20, 100


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A chunk for each symbol: its lines, and a profile line of its place and signature."""
    at = symbols.join(merged(files.select(F.col("path").alias("file_path"))), "file_path", "left_semi")
    out = with_content(at.withColumns({"line_start": F.col("start_line"), "line_end": F.col("end_line")}), files)
    first = F.element_at(split_lines(strip(F.col("content"))), 1)
    signature = F.when(strip(F.col("content")) == "", F.col("name")).otherwise(first)
    profile = F.concat(F.col("kind"), F.lit(" "), "qualified_name", F.lit(" in "), "file_path", F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(". Signature: "), signature)
    return out.select("id", unit_type(F.col("kind")).alias("unit_type"), F.col("qualified_name").alias("symbol_qualified_name"), "file_path", "language", "start_line", "end_line", "content", profile.alias("profile"), "ord")


def file_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A chunk for each file that names what it defines, in order; files without symbols say so."""
    names = symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))), lambda x: x["qualified_name"]), ", ").alias("names"))
    text = F.concat(F.lit("File "), "path", F.lit(" defines "), F.coalesce("names", F.lit("no symbols")), F.lit("."))
    out = files.select("path", "language").join(merged(names), "path", "left").withColumn("profile", text)
    return out.select(uuid5(F.concat("path", F.lit(":file_summary"))).alias("id"), F.lit("file_summary").alias("unit_type"), F.col("path").alias("symbol_qualified_name"), F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("profile").alias("content"), "profile")


def embedding_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding_text", F.concat_ws("\n", "profile", "content"))


def payloads(chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with embedding_text, the first edges of their symbol, and for files the number and names of symbols."""
    w = Window.partitionBy("src_symbol_id").orderBy("ord")
    first = edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MOST_EDGES)
    context = first.groupBy(F.col("src_symbol_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "edge_type", F.col("dst_symbol_id").alias("target"), "file_path", "line_start", "line_end", "confidence"))), lambda x: F.struct(*[x[c].alias(c) for c in ("edge_type", "target", "file_path", "line_start", "line_end", "confidence")])).alias("graph_context"))
    names = symbols.groupBy("file_path").agg(F.count("*").cast("int").alias("symbol_count"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))), lambda x: x["qualified_name"]), 1, MOST_NAMES).alias("defined_symbols"))
    is_file = F.col("unit_type") == "file_summary"
    out = embedding_text(chunks).join(merged(context), "id", "left").join(merged(names), "file_path", "left")
    return out.select(
        "id", "unit_type", "file_path", "language", F.col("symbol_qualified_name").alias("symbol"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "content", "profile", "embedding_text",
        F.when(~is_file, F.col("graph_context")).alias("graph_context"), F.when(is_file, F.coalesce("symbol_count", F.lit(0))).alias("symbol_count"), F.when(is_file, F.coalesce("defined_symbols", F.array().cast("array<string>"))).alias("defined_symbols"),
    )


def indexed(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All chunks, last wins by id: a symbol called file_summary gives way to its file's summary."""
    rows = symbol_chunks(symbols, files).unionByName(file_summaries(files, symbols).withColumn("ord", F.lit(2147483647)))
    w = Window.partitionBy("id").orderBy(F.desc("ord"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "ord")
