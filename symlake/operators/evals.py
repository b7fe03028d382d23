"""Measures of retrieval: recall, reciprocal rank, hits, compression; fault localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import token_count


def hit_matches(expected: Column) -> Column:
    """Whether a hit is what was expected: by symbol, by file or within its content."""
    return (F.col("symbol") == expected) | (F.col("file_path") == expected) | F.col("content").contains(expected)


def case_metrics(cases: DataFrame, hits: DataFrame, raw_tokens: Column, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """case_id, recall_at_k ..., mrr, hit_at_1, retrieved_tokens, context_compression_ratio.

    cases: case_id, expected (array); hits: case_id, rank, symbol, file_path, content; raw_tokens: of all there was to read.
    """
    wanted = cases.select("case_id", F.array_distinct("expected").alias("expected"))
    pairs = wanted.select("case_id", F.explode("expected").alias("item")).join(hits, "case_id").where(hit_matches(F.col("item")))
    found = pairs.groupBy("case_id").agg(F.min("rank").alias("first"), *[F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias(f"found_{k}") for k in ks])
    read = hits.groupBy("case_id").agg(F.sum(token_count(F.col("content"))).alias("retrieved_tokens"))
    n = F.size("expected")
    recall = [F.when(n > 0, F.coalesce(f"found_{k}", F.lit(0)) / n).otherwise(0.0).alias(f"recall_at_{k}") for k in ks]
    tokens = F.coalesce("retrieved_tokens", F.lit(0))
    return wanted.join(found, "case_id", "left").join(read, "case_id", "left").select(
        "case_id", *recall, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("hit_at_1"),
        tokens.cast("long").alias("retrieved_tokens"), F.when(tokens > 0, raw_tokens / tokens).otherwise(0.0).alias("context_compression_ratio"),
    )


def summary(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means that leave nulls out, for each group and (rollup) for all of them."""
    return metrics.rollup(*by).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("cases"))


def hit_summary(hits: DataFrame, most: int = 5) -> DataFrame:
    return hits.where(F.col("rank") <= most).select("query_id", "rank", "symbol", "file_path", "retrieval_method", "line_start", "line_end")


def method_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "retrieval_method").agg(F.count("*").alias("n"))


def ends_alike(a: Column, b: Column) -> Column:
    """Whether one of two names ends with the other."""
    return a.endswith(b) | b.endswith(a)


def ordered_unique(legs: list[DataFrame]) -> DataFrame:
    """case_id, rank, item: items of legs (case_id, ord, item) one after another, each once, at its first place; '' is left out."""
    rows = None
    for k, leg in enumerate(legs):
        part = leg.select("case_id", "item", F.struct(F.lit(k).alias("leg"), F.col("ord").cast("long").alias("ord")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.where("item is not null and item != ''").groupBy("case_id", "item").agg(F.min("at").alias("at"))
    return first.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("at", "item")).alias("rank"), "item")


def ranked_recall(cases: DataFrame, ranked: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """case_id and the share of expected items that end alike with one of the first k; 0 where none are expected."""
    wanted = cases.select("case_id", F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))).alias("wanted"))
    pairs = wanted.select("case_id", F.explode("wanted").alias("want")).join(ranked.where(F.col("rank") <= k), "case_id").where(ends_alike(F.col("item"), F.col("want")))
    found = pairs.groupBy("case_id").agg(F.count_distinct("want").alias("n"))
    return wanted.join(found, "case_id", "left").select("case_id", F.when(F.size("wanted") > 0, F.coalesce("n", F.lit(0)) / F.size("wanted")).otherwise(0.0).alias(name))


def reciprocal_rank(cases: DataFrame, ranked: DataFrame, column: str, name: str = "mrr") -> DataFrame:
    pairs = cases.select("case_id", F.explode(column).alias("want")).join(ranked, "case_id").where(ends_alike(F.col("item"), F.col("want")))
    found = pairs.groupBy("case_id").agg((1.0 / F.min("rank")).alias(name))
    return cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce(name, F.lit(0.0)).alias(name))


def localise(cases: DataFrame, hits: DataFrame, impact: dict[str, DataFrame] | None, raw_tokens: Column) -> DataFrame:
    """Metrics of fault localisation.  Impact frames carry case_id; method recall is null where no methods are labelled.

    cases: case_id, expected_files, expected_methods; hits: case_id, rank, symbol, file_path, content.
    """
    leg = lambda df, ord_, item: df.select("case_id", F.col(ord_).alias("ord") if isinstance(ord_, str) else ord_.alias("ord"), item.alias("item"))
    files, methods, texts = [leg(hits, "rank", F.col("file_path"))], [leg(hits, "rank", F.col("symbol"))], [hits.select("case_id", "content")]
    if impact:
        files += [leg(impact["files_affected"], "rank", F.col("file_path")), leg(impact["top_code_windows"], "rank", F.col("file_path"))]
        methods = [leg(impact["symbol"], F.lit(0), F.col("qualified_name")), leg(impact["direct_callers"], "rank", F.coalesce("src_symbol", "src_symbol_id")), *methods, leg(impact["related_methods"], "rank", F.col("symbol"))]
        texts.append(impact["top_code_windows"].select("case_id", "content"))
    by_file, by_method = ordered_unique(files), ordered_unique(methods)
    none = F.array().cast("array<string>")
    relevant = cases.withColumn("relevant", F.concat(F.coalesce("expected_methods", none), F.coalesce("expected_files", none)))
    both = ordered_unique([by_method.select("case_id", F.col("rank").alias("ord"), "item"), by_file.select("case_id", F.col("rank").alias("ord"), "item")])
    out = cases.select("case_id", F.size(F.coalesce("expected_methods", none)).alias("labelled"))
    for k in (1, 5, 10):
        out = out.join(ranked_recall(cases, by_file, "expected_files", k, f"file_recall_at_{k}"), "case_id")
    out = out.join(ranked_recall(cases, by_method, "expected_methods", 10, "m10"), "case_id").withColumn("method_recall_at_10", F.when(F.col("labelled") > 0, F.col("m10"))).drop("m10", "labelled")
    read = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    read = read.groupBy("case_id").agg(F.sum(token_count(F.col("content"))).alias("read"))
    out = out.join(reciprocal_rank(relevant, both, "relevant"), "case_id").join(read, "case_id", "left")
    return out.withColumn("context_compression_ratio", F.when(F.col("read") > 0, raw_tokens / F.col("read")).otherwise(0.0)).drop("read")
