"""Symbols and edges from parsed rows: owners by an interval join over blocks of lines, targets by name within the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import call_edge_type, reads_config, uuid5
from ..sources.store import last_wins, merged

JAVA_OWNERS = ("class", "method", "constructor")


def occurrences(parsed: DataFrame) -> DataFrame:
    """Every symbol that was met, overloads included, with the id of its file and qualified name."""
    s = parsed.where("row_type = 'symbol'")
    return s.select(uuid5(F.concat_ws(":", "path", "qualified_name")).alias("id"), "qualified_name", F.col("path").alias("file_path"), "name", "kind", "language", "start_line", "end_line", "parent", "ord")


def symbols(parsed: DataFrame) -> DataFrame:
    """One row for each file and qualified name: of overloads the last."""
    return last_wins(occurrences(parsed), ["qualified_name", "file_path"], ["ord"])


def owned(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, order: list) -> DataFrame:
    """points with the innermost span around them: an equi-join on keys with a range, then the first by `order`.

    points need a unique column __point; spans' other columns come along.
    """
    inside = points.join(spans, keys).where(F.col(at).between(F.col(start), F.col(end)))
    w = Window.partitionBy("__point").orderBy(*order)
    return inside.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


#: Lines of the blocks that spans are cut into, by their length; spans over the last are cut into more of its blocks.
BLOCKS = (16, 128, 1024, 8192, 65536)


def line_owners(lines: DataFrame, spans: DataFrame, order: list[Column]) -> DataFrame:
    """lines (path, line) with owner, the columns of the innermost of the spans (path, s, e, ...) around each.

    A span lies in the few blocks of its own length that it touches, a line in one block of every length, and both meet by
    path, length and block.  So a line meets spans near to it that are about as long, and not those of its whole file.
    `order`: numbers, of which the smallest come first.
    """
    length = F.col("e") - F.col("s") + 1
    block = F.lit(BLOCKS[-1])
    for n in reversed(BLOCKS[:-1]):
        block = F.when(length <= n, n).otherwise(block)
    owner = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[c for c in spans.columns if c != "path"]).alias("owner")
    at = lambda c: F.floor(F.col(c) / F.col("size")).cast("int")
    cut = spans.where("s <= e").withColumn("size", block).select("path", "size", F.explode(F.sequence(at("s"), at("e"))).alias("block"), owner)
    asked = lines.select("path", "line").distinct().withColumn("size", F.explode(F.array(*map(F.lit, BLOCKS)))).withColumn("block", at("line"))
    met = asked.join(merged(cut), ["path", "size", "block"]).where(F.col("line").between(F.col("owner.s"), F.col("owner.e")))
    return met.groupBy("path", "line").agg(F.min("owner").alias("owner"))


def named_edges(parsed: DataFrame) -> DataFrame:
    """Edges between names: source (qualified), target, edge_type, file_path, lines, confidence, ord."""
    spans = occurrences(parsed).select(F.col("file_path").alias("path"), "language", F.col("qualified_name").alias("source"), F.col("name").alias("owner_name"), F.col("kind").alias("owner_kind"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("ord").alias("owner_ord"))
    facts = parsed.where("row_type = 'fact'").select("path", "language", F.col("kind").alias("fact"), F.col("name").alias("target"), F.col("start_line").alias("line"), F.col("end_line").alias("last"), "ord")
    # a use counts unless it names its owner or begins with a small letter
    begins = F.substring("target", 1, 1)
    small = (begins == F.lower(begins)) & (begins != F.upper(begins))
    facts = facts.where(F.col("language").isin("python", "java") & ((F.col("fact") != "reads") | reads_config(F.col("target"))) & ((F.col("fact") != "uses") | ~small))
    heading = (F.col("language") == "java") & (F.col("fact") == "imports")
    owning = spans.where((F.col("language") == "python") | F.col("owner_kind").isin(*JAVA_OWNERS)).drop("language", "owner_kind")
    inside = facts.where(~heading)
    owners = line_owners(inside, owning, [-F.col("s"), F.col("e"), F.col("owner_ord")]).select("path", "line", "owner.source", "owner.owner_name")
    body = inside.join(merged(owners), ["path", "line"])
    # imports belong to the first class of the file, or else to its first symbol
    is_class = F.col("owner_kind") == "class"
    first = F.struct(F.when(is_class, 0).otherwise(1).alias("a"), F.when(is_class, F.col("s")).alias("b"), "owner_ord", "source", "owner_name")
    heads = spans.where("language = 'java'").groupBy("path").agg(F.min(first).alias("h")).select("path", "h.source", "h.owner_name")
    owner = body.unionByName(facts.where(heading).join(merged(heads), "path"))
    kind = F.when(F.col("fact") == "call", call_edge_type(F.col("target"))).when(F.col("fact") == "reads", "reads_config").otherwise(F.col("fact"))
    keep = (F.col("fact") != "uses") | (F.col("target") != F.col("owner_name"))
    weight = F.when(F.col("fact") == "imports", 0.8).when(F.col("fact") == "inherits", 0.9).when(F.col("fact").isin("call", "calls"), 0.75).when(F.col("fact") == "reads", 0.55).otherwise(0.45)
    rows = owner.where(keep).select("source", "target", kind.alias("edge_type"), F.col("path").alias("file_path"), F.when(F.col("language") == "java", F.col("line")).alias("line_start"), F.when(F.col("language") == "java", F.col("last")).alias("line_end"), weight.alias("confidence"), "ord")
    w = Window.partitionBy("source", "target", "edge_type", "file_path", "line_start").orderBy("ord")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def edges(parsed: DataFrame) -> DataFrame:
    """Edges between ids; a target that no symbol of the same file has stays a name.  Edges carry ord for last-wins."""
    all_ = occurrences(parsed)
    # every symbol of a name has the same id, so that of the last stands for all
    by_qn = all_.select("file_path", "qualified_name", F.col("id").alias("qn_id")).distinct()
    by_name = last_wins(all_.select("file_path", "name", "ord", "id"), ["file_path", "name"], ["ord"]).select("file_path", F.col("name").alias("target"), F.col("id").alias("name_id"))
    e = named_edges(parsed)
    e = e.join(merged(by_qn.select("file_path", F.col("qualified_name").alias("source"), F.col("qn_id").alias("src_id"))), ["file_path", "source"], "left")
    # a call's bare name means the last symbol of that name; otherwise qualified names come first
    e = e.join(merged(by_name), ["file_path", "target"], "left").join(merged(by_qn.select("file_path", F.col("qualified_name").alias("target"), F.col("qn_id").alias("dst_id"))), ["file_path", "target"], "left")
    called = F.col("edge_type").isin("calls", "uses", "logs", "emits_metric", "queries_table")
    dst = F.when(called, F.coalesce("name_id", "dst_id", "target")).otherwise(F.coalesce("dst_id", "name_id", "target"))
    return e.select(F.coalesce("src_id", "source").alias("src_symbol_id"), dst.alias("dst_symbol_id"), "edge_type", "file_path", "line_start", "line_end", "confidence", "ord")


def edge_count(parsed: DataFrame, edges_: DataFrame) -> DataFrame:
    """n: outgoing edges counted for every occurrence of a symbol, so overloads count theirs each."""
    return occurrences(parsed).select("id").join(edges_.select(F.col("src_symbol_id").alias("id")), "id").agg(F.count("*").alias("n"))
