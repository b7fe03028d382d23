"""Full text: postings and pairs are made within a row, scores are added up in places of bounded size."""

import random

from symlake.operators import fts
from symlake.plans.queries import QUERIES


def test_stored_postings_are_not_dealt_out(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))), rnd.choice([None, "b É b"])) for k in range(3000)]
    df = fts.stored(spark.createDataFrame(rows, "id long, x string, y string"), "id", ["x", "y"])
    want = {}
    for k, x, y in rows:
        cols = [x.split(), (y or "").lower().replace("é", "e").split()]
        for c, words in enumerate(cols):
            for pos, w in enumerate(words):
                want.setdefault((k, sum(map(len, cols)), c, w), []).append(pos)
    assert {(r.id, r.dl, r.col, r.term): r.positions for r in df.collect()} == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_tokens(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))) for k in range(500)] + [(900, None), (901, "")]
    df = fts.pairs(spark.createDataFrame(rows, "id long, text string"), "text")
    want = {}
    for _, t in rows:
        two = list(zip((t or "").split(), (t or "").split()[1:], strict=False))
        for p in set(two):
            docs, places = want.get(" ".join(p), (0, 0))
            want[" ".join(p)] = docs + 1, places + two.count(p)
    assert {r.phrase: (r.docs, r.places) for r in df.collect()} == want


def test_phrases_of_rows_of_one_id(spark, tmp_path):
    spark.createDataFrame([(1, "a b a b"), (1, "a b"), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["fts_phrase"](spark, str(tmp_path)).select("phrase", "docs", "places").collect()] == [("a b", 2, 4)]


def test_places_grow_with_the_pairs_and_both_ways_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"a w{k % 7} c_d {'a' * (k % 3 == 0)}") for k in range(60)], "id long, text string")
    queries = spark.createDataFrame([(k, f"a w{k % 9} c_d") for k in range(40)], "query_id long, text string")
    key = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    want = key(fts.scores(queries, rows, "id", ["text"]))
    small = key(fts.scores(queries, rows.where("id < 9"), "id", ["text"]))
    monkeypatch.setattr(fts, "PAIRS", 100)  # 2,400 pairs
    df = fts.scores(queries, rows, "id", ["text"])
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString() and key(df) == want
    monkeypatch.setattr(fts, "FEW", 3)  # neither side is few
    assert key(fts.scores(queries, rows, "id", ["text"])) == want
    monkeypatch.setattr(fts, "FEW", 119)  # queries are many, and rows few
    assert key(fts.scores(queries, rows.where("id < 9"), "id", ["text"])) == small
