"""Plans whose broadcasts or single tasks would grow with the tables."""

from pyspark.sql import functions as F

from symlake.operators import graph, vector
from symlake.plans import code  # noqa: F401
from symlake.plans.queries import QUERIES

EDGES = "src_symbol_id string, dst_symbol_id string, edge_type string, file_path string, line_start int, confidence double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_symbols_are_not_broadcast(spark):
    symbols = spark.createDataFrame([("a", "A", "class", "f", 1, 2)], "id string, qualified_name string, kind string, file_path string, start_line int, end_line int")
    df = graph.with_names(spark.createDataFrame([("a", "b", "calls", "f", 1, 0.5)], EDGES), symbols)
    assert "Broadcast" not in plan(df) and [(r.src_symbol, r.dst_symbol) for r in df.collect()] == [("A", None)]


def test_edges_are_read_once_for_both_ends(spark):
    edges = spark.createDataFrame([("a", "b", "calls", "f", 1, 0.5), ("b", "b", "uses", "f", 2, 0.4), ("c", "a", "uses", "f", 3, 0.9)], EDGES)
    df = graph.edges_of(spark.createDataFrame([("b",), ("a",)], "id string"), edges)
    assert "Union" not in plan(df) and sorted((r.id, r["rank"], r.src_symbol_id, r.dst_symbol_id) for r in df.collect()) == [("a", 1, "c", "a"), ("a", 2, "a", "b"), ("b", 1, "a", "b"), ("b", 2, "b", "b")]


def test_blocks_of_vectors_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("vec"))
    df = vector.search(rows.where("id < 5").withColumnRenamed("id", "query_id"), rows, 3)
    assert "Broadcast" not in plan(df) and df.count() == 15


def test_replies_are_dealt_before_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(code, "PARTS", 50)
    df = QUERIES["enrich_replies"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plan(df)
