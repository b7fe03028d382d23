"""Large source files: read in pieces, facts and windows met by blocks of lines, no broadcast of what comes of them."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from symlake.operators import parsing, symbols, window
from symlake.plans import code  # noqa: F401
from symlake.plans.queries import QUERIES

PY = '''"""doc
class NotAClass:
"""
import os
@deco(1,
2)
class A(B, c.D):
    def f(self): return g(lambda: h)(1)
x = (
1)
if TIMEOUT:
    y = 1
else:
    def k(): pass
try:
    z = retry
finally:
    q = f"""a
b {config}
"""
s = 'abc\\
def x(): pass'
async def co():
    await a.b.c()
'''
JAVA = """package a.b; import java.util.*;
@Ann({1,2}) public class A<T extends B<T>> extends C<D, E> implements F { int x = 1, y = foo(2); int[] z = {1,2}; A(int q) { super(q); } }
record R(int a) { R { check(a); } void u() { Runnable r = () -> { go(); }; } }
@interface Z { int v() default 1; }
int[] top = {1,2}; int other = call(); void free() { x(); }
class M { void b( { } class N { }
enum E2 { A, B; }
"""


def test_pieces_of_files_give_the_rows_of_the_whole():
    for newline in ("\n", "\r\n"):
        text = (PY * 3).replace("\n", newline)
        for size in (1, 7, 100):
            got = sorted(parsing.python_numbered(text, "x", size), key=lambda r: r[0])
            assert [n for n, _ in got] == list(range(len(got))) and [r for _, r in got] == [r for _, r in parsing.python_numbered(text, "x", 10**9)]
    for size in (1, 40):
        assert list(parsing.java_numbered(JAVA * 2, "x", size)) == list(parsing.java_numbered(JAVA * 2, "x", 10**9))
    with pytest.raises(SyntaxError) as e:
        next(parsing.python_numbered(PY + "x = 1\n" * 100 + "def (\n" + PY, "x", 10))
    assert e.value.lineno == PY.count("\n") + 101


def test_a_large_file_is_not_held_as_one_tree():
    text = "".join(f"class C{k}:\n    def run(self):\n        return f{k}()\n" for k in range(20_000))
    tracemalloc.start()
    n = sum(1 for _ in parsing.python_numbered(text, "x"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 80_000 and peak < 40e6  # the whole tree takes over 100 MB


def test_a_broken_large_file_is_left_out_whole(spark):
    files = [("a.py", "python", "x = 1\n" * 60_000 + "def ("), ("b.py", "python", "y = 1")]
    rows = parsing.parse(spark.createDataFrame(files, "path string, language string, content string"), "skip").collect()
    assert [r.name for r in rows] == ["y"]


def test_owners_by_blocks_against_all_pairs(spark):
    rnd = random.Random(1)
    spans = [("f", s, s + rnd.choice([0, 3, 15, 16, 200, 3000, 150_000]), k) for k, s in enumerate(rnd.randrange(1, 5000) for _ in range(300))]
    lines = [("f", rnd.randrange(1, 160_000 if k % 2 else 6000)) for k in range(300)] + [("g", 1)]
    order = [-F.col("s"), F.col("e"), F.col("k")]
    got = {(r.path, r.line): r.owner.k for r in symbols.line_owners(spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(spans, "path string, s int, e int, k int"), order).collect()}
    want = {(p, n): min((-s, e, k) for _, s, e, k in spans if s <= n <= e)[2] for p, n in lines if p == "f" and any(s <= n <= e for _, s, e, _ in spans)}
    assert got == want


def test_windows_over_blocks(spark):
    text = "".join(f"line {k}\n" for k in range(1, 501))
    places = spark.createDataFrame([("f", 250, 200), ("f", 64, 1), ("f", 500, 3), ("f", 9, 0)], "file_path string, line int, r int")
    got = {r.line: (r.line_start, r.line_end, r.content) for r in window.code_windows(places, spark.createDataFrame([("f", text)], "path string, content string"), F.col("r")).collect()}
    assert got == {n: (a, b, "\n".join(f"line {k}" for k in range(a, b + 1))) for n, a, b in ((250, 50, 450), (64, 63, 65), (500, 497, 500), (9, 9, 9))}


@pytest.mark.parametrize("name", ["python_edges", "java_edges", "vector_payloads", "code_chunks"])
def test_nothing_that_comes_of_files_is_broadcast(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_impact_are_of_all_symbols_and_calls(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    rows = QUERIES["impact_windows"](spark, "/root/testdata/sf0.001")
    assert {(r.reason.split(":")[0], r["count"]) for r in rows.withColumn("reason", F.split_part("reason", F.lit(":"), F.lit(1))).groupBy("reason").count().collect()} == {("target definition", 7 * parts), ("direct caller", 2 * parts)}
