"""Parsing, edges, chunks, the index, searches, impact, tools, enrichment and streaming on small trees."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from symlake.config import Settings
from symlake.functions import exprs
from symlake.indexing import index_files, index_tree
from symlake.operators import embed, enrich, evals, fts, fuse, graph, grep, parsing, symbols, tools, window
from symlake.search import Index
from symlake.sources import store
from symlake.sources.trees import bug_list, source_files, yaml_cases
from symlake.streaming import ingest

SERVICE = """RETRY_LIMIT = 3
TIMEOUT_SECONDS = 5


class Metrics:
    def increment(self, name):
        return name


def load_config():
    import os
    return {"retry": RETRY_LIMIT, "timeout": TIMEOUT_SECONDS}


def call_api():
    cfg = load_config()
    metrics.counter("calls")
    log.info("called")
    db.execute("select")
    return cfg
"""
JAVA = """package org.ex;

import java.util.List;

public class Retry extends Base implements Runnable {
    private final int limit;

    public Retry(int limit) {
        this.limit = limit;
    }

    public int delay(int n) {
        return helper(Config.LEVEL, n);
    }

    int helper(int a, int b) { return a; }
    int helper(String a) { return 0; }
}

class Base { }
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {"service.py": SERVICE, "src/main/java/org/ex/Retry.java": JAVA, "pkg/__init__.py": "", "pkg/_private/deep.py": "X = 1\n", "venv/broken.py": "def (", "notes.txt": "one\ntwo\nthree\nfour\nfive\n"}
    for p, c in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (root / "latin.py").write_bytes(b"NAME = 'caf\xe9'\n")
    return root


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    settings = Settings(index_path=str(tmp_path_factory.mktemp("index")))
    counts = index_tree(spark, str(tree), settings)
    return Index(spark, settings, str(tree)), counts


def test_source_tree(spark, tree):
    rows = {r.path: r for r in source_files(spark, str(tree)).collect()}
    assert sorted(rows) == ["latin.py", "pkg/__init__.py", "pkg/_private/deep.py", "service.py", "src/main/java/org/ex/Retry.java"]
    assert rows["pkg/__init__.py"].content == "" and "�" in rows["latin.py"].content and rows["src/main/java/org/ex/Retry.java"].language == "java"


def test_symbols_and_counts(index):
    ix, counts = index
    kinds = {r.qualified_name: r.kind for r in ix.table("symbols").collect()}
    assert kinds["Metrics.increment"] == "function" and kinds["RETRY_LIMIT"] == "variable"
    assert [kinds[f"org.ex.Retry{x}"] for x in ("", ".limit", ".Retry", ".delay", ".helper")] == ["class", "field", "constructor", "method", "method"]
    # overloads are counted each, but the last one stays
    assert counts["files"] == 5 and counts["symbols"] == len(kinds) + 1
    assert ix.table("symbols").where("name = 'helper'").first().start_line == 17
    assert {r.name: r.n for r in ix.store.counters().collect()}["symbols"] == len(kinds)


def test_edges(index):
    ix, _ = index
    e = {(r.src_symbol, r.edge_type, r.dst_symbol or r.dst_symbol_id) for r in graph.with_names(ix.table("symbol_edges"), ix.table("symbols")).collect()}
    assert {("call_api", "calls", "load_config"), ("call_api", "emits_metric", "metrics.counter"), ("call_api", "logs", "log.info"), ("call_api", "queries_table", "db.execute"), ("load_config", "reads_config", "RETRY_LIMIT"), ("load_config", "imports", "os")} <= e
    assert {("org.ex.Retry", "imports", "java.util.List"), ("org.ex.Retry", "inherits", "org.ex.Base"), ("org.ex.Retry", "inherits", "Runnable"), ("org.ex.Retry.delay", "calls", "org.ex.Retry.helper"), ("org.ex.Retry.delay", "uses", "Config")} <= e


def test_syntax_errors(spark):
    bad = spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", "x = 1"), ("c.md", "md", "#")], "path string, language string, content string")
    with pytest.raises(Exception, match="SyntaxError"):
        parsing.parse(bad).collect()
    assert [r.name for r in parsing.parse(bad, "skip").where("row_type = 'symbol'").collect()] == ["x"]


def test_search_and_impact(index):
    ix, _ = index
    hits, counts, errors = ix.search("load_config", 5)
    rows = hits.orderBy("rank").collect()
    assert not errors and counts["ripgrep"] >= 1 and counts["fts"] >= 1 and counts["vector"] == 5
    assert "load_config" in rows[0].content
    report = ix.impact("load_config")
    assert [c["src_symbol"] for c in report["direct_callers"]] == ["call_api"]
    assert report["files_affected"][0]["file_path"] == "service.py" and report["top_code_windows"][0]["reason"] == "target definition"
    assert ix.impact("no such symbol anywhere") is None and ix.explain("no such symbol anywhere") is None
    assert ix.window("notes.txt", 3, 1)["content"] == "two\nthree\nfour"
    with pytest.raises(ValueError):
        ix.window("../outside", 1)


def test_stored_postings_give_the_same_scores(index, spark):
    ix, _ = index
    asked = spark.createDataFrame([(0, "load_config retry"), (1, "TIMEOUT_SECONDS"), (2, "absent")], "query_id long, text string")
    key = lambda df: {(r.query_id, r.id): round(r.score, 9) for r in df.collect()}
    plain = key(fts.scores(asked, ix.table("chunks"), "id", fts.CHUNK_COLUMNS))
    assert plain and plain == key(fts.stored_scores(asked, ix.table("postings"), ix.table("chunks")))


def test_payloads_of_vectors(index):
    ix, _ = index
    rows = {r.symbol: r for r in ix.table("vectors").collect()}
    assert rows["service.py"].symbol_count == 6 and rows["service.py"].defined_symbols[0] == "RETRY_LIMIT" and rows["service.py"].graph_context is None
    context = rows["load_config"].graph_context
    assert ("reads_config", "service.py") in {(e.edge_type, e.file_path) for e in context} and rows["load_config"].symbol_count is None


def test_answers_of_tools(index, spark, tree):
    ix, _ = index
    t = tools.Tools(ix.table("chunks"), ix.table("symbols"), ix.table("symbol_edges"), source_files(spark, str(tree)), postings=ix.table("postings"))
    assert t.explain_symbol("load_config")["symbol"]["qualified_name"] == "load_config" and t.find_usages("load_config")["usages"]
    related = t.related_symbols("load_config")
    assert related["edges"] and related["related_symbol_ids"] == sorted(related["related_symbol_ids"]) and related["symbol"]["name"] == "load_config"
    assert t.find_usages("zzz no such") == {"symbol": "zzz no such", "usages": []} and t.explain_symbol("zzz no such") == {"symbol": "zzz no such", "edges": []}
    assert t.related_symbols("zzz no such") == {"symbol": "zzz no such", "related_symbol_ids": [], "edges": []}
    assert ix.related("load_config")["edges"] and ix.related("zzz no such") is None


def test_the_server_needs_its_library(index):
    from symlake import server

    ix, _ = index
    with pytest.raises(RuntimeError, match="mcp"):
        server.build(server.tools_of(ix))
    assert server.parser().parse_args(["--root", "r", "--max-results", "2"]).max_results == 2


def test_vector_search_that_cannot_work_is_an_error(index, spark):
    from pyspark.errors import PySparkException

    from symlake.operators import vector

    ix, _ = index
    ix.check_vectors()
    with pytest.raises(RuntimeError, match="no vectors"):
        Index(spark, Settings(index_path="/tmp/no-such-index")).check_vectors()
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<float>")
    with pytest.raises(PySparkException, match="dimension 3"):
        vector.search(rows.withColumnRenamed("id", "query_id"), rows, 1, 3).collect()
    with pytest.raises(ValueError, match="cobol"):
        parsing.parser_for("cobol")


def test_command_line(index, tree, capsys, tmp_path):
    from symlake import cli

    ix, _ = index
    path = ["--index-path", ix.settings.index_path]
    said = lambda *args: (cli.main([*path, *args]), json.loads(capsys.readouterr().out))[1]
    assert said("search", "load_config", "--no-vectors", "--limit", "3")[0]["retrieval_method"] == "fts"
    assert said("explain", "load_config")["symbol"]["name"] == "load_config" and said("find-usage", "load_config") and said("related", "load_config")["edges"]
    assert said("window", str(tree), "notes.txt", "3", "--radius", "1")["content"] == "two\nthree\nfour"
    assert said("search", "which timeout zzzqqq", "--no-vectors", "--limit", "1")[0]
    (tmp_path / "c.yml").write_text("- {bug_id: p_1b, project: p, query: load_config, expected_files: [service.py], expected_methods: [load_config]}\n")
    out = said("localise", str(tree), "--cases", str(tmp_path / "c.yml"), "--reuse-index", "--with-vectors")
    case = out["cases"][0]
    assert out["summary"]["file_recall_at_1"] == 1.0 and case["raw_retrieval_method_counts"]["vector"] > 0 and "content" not in case["impact"]["top_code_windows"][0]
    args = cli.parser().parse_args(["index", "r", "--llm-api-key", "k", "--llm-temperature", "0.5", "--llm-max-tokens", "9", "--embedding-batch-size", "4"])
    assert (args.llm_api_key, args.llm_temperature, args.llm_max_tokens, args.embedding_batch_size) == ("k", 0.5, 9, 4)
    assert cli.main(["--index-path", str(tmp_path / "none"), "localise", str(tree), "--cases", str(tmp_path / "c.yml"), "--reuse-index", "--with-vectors"]) == 2


def test_store_commits_all_tables_at_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "ix"))
    files = lambda *x: spark.createDataFrame([(p, "python", c, v) for p, c, v in x], "path string, language string, content string, version long")
    s.write("files", files(("a", "1", 1), ("b", "1", 1)))
    with pytest.raises(KeyError), s.commit():
        s.upsert("files", files(("a", "2", 2)))
        assert store.Store(spark, s.root).read("files").where("path = 'a'").first().content == "1"
        raise KeyError
    assert s.read("files").where("path = 'a'").first().content == "1"
    for k in range(5):
        s.upsert("files", files(("a", str(k), k)))
    assert sorted((r.path, r.content) for r in s.read("files").collect()) == [("a", "4"), ("b", "1")]
    assert len(s._manifests()) == store.KEPT and len(s._names("files")) <= store.KEPT + 1  # older folders are gone
    one, two = store.Store(spark, s.root), store.Store(spark, s.root)
    with pytest.raises(RuntimeError, match="another commit"), one.commit():
        two.upsert("files", files(("c", "x", 1)))
    old = spark.createDataFrame([("s", "d", "calls", "f")], "src_symbol_id string, dst_symbol_id string, edge_type string, file_path string")
    s.write("symbol_edges", old)
    assert s.read("symbol_edges").first().confidence == 1.0


def test_versions_do_not_go_back(spark):
    known = spark.createDataFrame([("a", 3), ("b", None)], "path string, version long")
    batch = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "path string, version long")
    assert sorted(r.path for r in ingest.newer(batch, known).collect()) == ["b", "c"]


def test_patterns_of_the_jvm(spark):
    files = spark.createDataFrame([("a", "héllo\nplain\n"), (".hidden/x", "héllo\n"), ("bin", "h\x00éllo\n")], "path string, content string")
    found = lambda p: [r.text for r in grep.matches(files.where("path = 'a'"), p).collect()]
    assert found(r"\p{L}+é?llo") == found(r"(?P<n>h)é") == found(r"(?<name_x>h)é") == found("^h.*o$") == ["héllo"] and found("(unclosed") == found("[z") == []
    assert [r.path for r in grep.searched(files).collect()] == ["a"]
    assert [r.path for r in grep.chunks(files, r"(?P<n>h)é", 1).orderBy("rank").collect()] == [".hidden/x", "a"]


def test_neighbours_and_names_against_plain_joins(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{k}", f"Q.{rng.choice('abAB_%')}{k % 7}é" if k % 9 else "x", f"f{k % 3}", rng.choice(["load", "Loader", "lo", "re_load", "x%y", "Éa"]) + str(k % 4), rng.choice(["class", "function", "field"]), rng.randint(1, 12)) for k in range(120)]
    s = spark.createDataFrame(rows, "id string, qualified_name string, file_path string, name string, kind string, start_line int")
    got = {(r.root, r["rank"], r.id) for r in graph.same_file_neighbours(s, s, 4).collect()}
    want = set()
    for root in rows:
        near = sorted((abs(x[5] - root[5]), x[5], x[0]) for x in rows if x[2] == root[2] and x[0] != root[0] and x[4] != "field")[:4]
        want |= {(root[0], n + 1, x[2]) for n, x in enumerate(near)}
    assert got == want
    asked = ["load", "LOAD1", "lo", "oad", "re_load", "x%y", "%", "q.a", "é", "Éa", "", "none of them", "x", "load"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    plain = s.join(queries, (F.col("name") == F.col("text")) | (F.col("qualified_name") == F.col("text")) | exprs.like_contains(F.col("name"), F.col("text")) | exprs.like_contains(F.col("qualified_name"), F.col("text")))
    assert {(r.query_id, r.id) for r in graph.find_symbols(queries, s, 1000).collect()} == {(r.query_id, r.id) for r in plain.collect()}


def test_bug_lists_from_text(spark, tmp_path):
    import sys

    from symlake.sources.trees import read_bug_list, run_bug_list

    text = '1,"a.B;c.D",t.T::m\nbug.id,x,y\n2,,\n3,e.F,\n'
    (tmp_path / "b.csv").write_text(text)
    want = [("1", ["a.B", "c.D"], ["t.T::m"]), ("3", ["e.F"], [])]
    rows = lambda df: sorted((r.bug_id, r.modified_classes, r.triggering_tests) for r in df.collect())
    assert rows(read_bug_list(spark, str(tmp_path / "b.csv"), "P")) == rows(run_bug_list(spark, [sys.executable, "-c", f"print({text!r})"], "P")) == want
    with pytest.raises(RuntimeError, match="ended with 3"):
        run_bug_list(spark, [sys.executable, "-c", "raise SystemExit(3)"], "P")


def test_reindexing_replaces_edges(spark, tmp_path):
    s = Settings(index_path=str(tmp_path), vectors=False)
    one = lambda text: spark.createDataFrame([("a.py", "python", text)], "path string, language string, content string")
    index_files(spark, one("def f():\n    g()\n"), s)
    index_files(spark, one("def f():\n    h()\n"), s)
    assert [r.dst_symbol_id for r in store.Store(spark, s.index_path).read("symbol_edges").collect()] == ["h"]


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"path": "a.py", "language": "python", "content": "def old(): pass\n", "version": 1}, {"path": "a.py", "language": "python", "content": "def new():\n    g()\n", "version": 2}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    s = Settings(index_path=str(tmp_path / "ix"), vectors=False)
    ingest.maintain(ingest.changes(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination(120)
    assert [r.name for r in store.Store(spark, s.index_path).read("symbols").collect()] == ["new"]


def test_tools_keep_to_their_limits(index, spark, tree):
    ix, _ = index
    t = tools.Tools(ix.table("chunks"), ix.table("symbols"), ix.table("symbol_edges"), source_files(spark, str(tree)), tools.Limits(3, 5, 12_000))
    answer = t.search_code("RETRY_LIMIT load_config", 10)
    hits = answer["results"]
    assert answer["query"] == "RETRY_LIMIT load_config"
    assert 0 < len(hits) <= 3 and all(len(h["content"].splitlines()) <= 5 for h in hits)
    assert len(t.code_window("service.py", 10, 50)["content"].splitlines()) <= 5
    assert tools.Tools(ix.table("chunks"), ix.table("symbols"), ix.table("symbol_edges"), source_files(spark, str(tree)), tools.Limits(3, 5, 20)).explain_symbol("call_api")["truncated"]


def test_bm25_equals_fts5(spark):
    """Scores of a public implementation of the same formula, phrases included."""
    rows = [(1, "retry delay config timeout"), (2, "delay retry"), (3, "the retry delay of retry_delay"), (4, "nothing here"), (5, "config and config or config")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, body)")
    con.executemany("insert into t values (?, ?)", rows)
    queries = [(0, "retry_delay config"), (1, "retry"), (2, "absent 123")]
    got = {(r.query_id, r.id): r.score for r in fts.scores(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(rows, "id long, body string"), "id", ["body"]).collect()}
    want = {}
    for q, match in ((0, '"retry delay" OR config'), (1, "retry")):
        want |= {(q, int(i)): s for i, s in con.execute("select id, bm25(t) from t where t match ?", (match,))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_grep_chunks(spark):
    lines = [f"line {k}" for k in range(1, 41)]
    lines[4] = lines[29] = "needle"
    files = spark.createDataFrame([("a", "\n".join(lines) + "\n"), ("b", "none\n")], "path string, content string")
    rows = [(r.rank, r.line_start, r.line_end) for r in grep.chunks(files, "needle", 2).orderBy("rank").collect()]
    # the lines before the second match belong to the first chunk
    assert rows == [(1, 3, 29), (2, 30, 32)]
    assert [(r.line_start, r.line_end) for r in grep.chunks(files, "needle", 2, 1).collect()] == [(3, 5)]
    assert grep.chunks(files, "(unclosed", 2).count() == 0


def test_rrf_ties_and_repeats(spark):
    schema = "query_id long, list_no int, rank int, weight double, id string, file_path string, symbol string, content string, source string, retrieval_method string, line_start int, line_end int"
    rows = [(0, 0, 1, 0.5, "a", "f", "s", "first", "x", "x", 1, 2), (0, 1, 1, 0.5, "b", "f", "s", "second", "y", "y", 1, 2), (0, 1, 2, 0.5, "c", "g", "s", "", "y", "y", None, None), (0, 1, 3, 0.5, "c", "g", "s", "", "y", "y", None, None), (0, 0, 2, 0.5, "d", "", "", "", "x", "x", None, None)]
    out = fuse.fuse(spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r.id, r.content) for r in out][0] == ("a", "first") and [r.id for r in out] == ["a", "c", "d"]
    assert abs(out[0].score - 1 / 61) < 1e-8


def test_bfs_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "r", "calls", "f", 1, 0.7), ("b", "a", "calls", "f", 2, 0.7), ("r", "a", "calls", "f", 3, 0.7), ("r", "r", "uses", "f", 4, 0.4)], "src_symbol_id string, dst_symbol_id string, edge_type string, file_path string, line_start int, confidence double")
    impacted, met = graph.reverse_bfs(spark.createDataFrame([("r",)], "id string"), e, 3)
    assert sorted((r.id, r.level) for r in impacted.collect()) == [("a", 1), ("b", 2)] and met.count() == 4
    assert [r.src_symbol_id for r in graph.calls_walk(spark.createDataFrame([("r",)], "id string"), e, 2, 10).orderBy("ord").collect()] == ["a", "b", "r"]


def test_windows_at_the_edges(spark):
    files = spark.createDataFrame([("f", "one\ntwo\r\nthree\x0cfour\n")], "path string, content string")
    places = spark.createDataFrame([("f", 1, 1), ("f", 4, 2), ("f", 9, 1), ("../f", 1, 1)], "file_path string, line int, r int")
    rows = {r.line: r.content for r in window.code_windows(places, files, F.col("r")).collect()}
    assert rows == {1: "one\ntwo", 4: "two\nthree\nfour", 9: ""}


REPLIES = {
    "describe": '```json\n{"description": " d ", "responsibilities": "one", "inputs": ["a", " ", "b"], "tags": ["x"]}\n```',
    "summarize": 'Sure: {"description": "later", "responsibilities": ["one", "two"], "outputs": 7} done',
}


def test_enrichment(spark):
    chunks = spark.createDataFrame([("1", "function_chunk", "f", "a.py", "python", 1, 2, "def f(): pass", "profile")], "id string, unit_type string, symbol_qualified_name string, file_path string, language string, start_line int, end_line int, content string, profile string")

    def client():
        def ask(prompt):
            if "generate_search_tags" in prompt:
                raise TimeoutError
            return REPLIES["describe" if "describe_symbol" in prompt else "summarize"]

        return ask

    out, profiles = enrich.enrich(chunks, client)
    p = profiles.first()
    assert (p.description, p.responsibilities, p.inputs, p.tags, p.outputs) == ("d", ["one", "two"], ["a", "b"], ["x"], [])
    assert out.first().profile == "profile\nd\nResponsibilities: one, two\nSearch tags: x\nInputs: a, b"
    same, none = enrich.enrich(chunks, lambda: lambda prompt: "no json at all")
    assert same.first().profile == "profile" and none.count() == 0
    assert enrich.enrich(chunks, None)[1] is None


def test_hash_embedding(spark):
    import hashlib
    import math

    texts = ["Retry the retry delay", "", "x"]
    rows = {r.id: r.vector for r in embed.hash_dense(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    for i, t in enumerate(texts):
        v = [0.0] * 384
        for w in t.lower().split():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 384] += 1 if h[4] % 2 == 0 else -1
        n = math.sqrt(sum(x * x for x in v)) or 1
        assert all(abs(a - b / n) < 1e-6 for a, b in zip(rows[i], v, strict=True))
    with pytest.raises(ValueError):
        embed.embed(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", "unknown")


def test_measures(spark):
    cases = spark.createDataFrame([(1, ["s1", "absent"]), (2, ["x"]), (3, [])], "case_id long, expected array<string>")
    hits = spark.createDataFrame([(1, 1, "a", "f", "w w"), (1, 2, "s1", "f", "w"), (2, 1, "b", "x", "")], "case_id long, rank int, symbol string, file_path string, content string")
    rows = {r.case_id: r for r in evals.case_metrics(cases, hits, F.lit(30)).collect()}
    assert (rows[1].recall_at_5, rows[1].mrr, rows[1].hit_at_1, rows[1].context_compression_ratio) == (0.5, 0.5, 0.0, 10.0)
    assert (rows[2].recall_at_5, rows[2].hit_at_1, rows[2].context_compression_ratio) == (1.0, 1.0, 0.0) and rows[3].mrr == 0.0
    metrics = spark.createDataFrame([("b", 1.0, None), ("b", 0.0, 1.0)], "bug string, a double, m double")
    assert {(r.bug, r.a, r.m) for r in evals.summary(metrics, ["bug"], ["a", "m"]).collect()} == {("b", 0.5, 1.0), (None, 0.5, 1.0)}


def test_localisation(spark):
    cases = spark.createDataFrame([("c", ["src/A.java"], ["A.run"])], "case_id string, expected_files array<string>, expected_methods array<string>")
    hits = spark.createDataFrame([("c", 1, "T.test", "test/T.java", "a b"), ("c", 2, "org.A.run", "src/A.java", "c")], "case_id string, rank int, symbol string, file_path string, content string")
    r = evals.localise(cases, hits, None, F.lit(30)).first()
    assert (r.file_recall_at_1, r.file_recall_at_5, r.method_recall_at_10, r.mrr, r.context_compression_ratio) == (0.0, 1.0, 1.0, 0.5, 10.0)


def test_small_things(spark, tmp_path):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    import uuid

    assert one(exprs.uuid5(F.lit("a.py:f"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a.py:f"))
    assert one(exprs.split_lines(F.lit("a\r\nb\u2028c\n"))) == ["a", "b", "c"]
    assert [one(exprs.looks_exact(F.lit(q))) for q in ("fooBar", "foo_bar", "how does it retry", "and/or", "MAX", "a.b")] == [True, True, False, True, True, True]
    (tmp_path / "c.yml").write_text("- id: a\n  expected: [x, y]\n- id: b\n")
    assert [tuple(r) for r in yaml_cases(spark, str(tmp_path / "c.yml"), "id string, expected array<string>").collect()] == [("a", ["x", "y"]), ("b", None)]
    bugs = bug_list(spark.createDataFrame([("P", "1", "a.B; c.D$E", "t.T::m"), ("P", "x", "a.B", ""), ("P", "2", "", "")], "project string, id string, classes string, tests string")).collect()
    assert [(r.bug_id, r.modified_classes) for r in bugs] == [("1", ["a.B", "c.D$E"])]
    s = Settings.of({"embedding_dimension": 8, "llm": {"enabled": True}, "exclude_dirs": ["x"]})
    assert (s.embeddings.dimensions, s.llm.enabled, s.exclude_dirs) == (8, True, ("x",)) and s.with_overrides(**{"llm.model": "m"}).llm.model == "m"


def test_owner_is_the_innermost(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 5, 8), ("g", "other", 1, 99)], "path string, name string, s int, e int")
    points = spark.createDataFrame([("f", 6, 0), ("f", 10, 1), ("f", 30, 2)], "path string, line int, __point int")
    got = {r.line: r.name for r in symbols.owned(points, spans, ["path"], "line", "s", "e", [F.desc("s"), "e"]).collect()}
    assert got == {6: "inner", 10: "outer"}


def test_evaluation_by_mode(index, spark):
    from symlake import evaluation

    ix, _ = index
    cases = spark.createDataFrame([("a", "load_config", ["load_config"], ["service.py"]), ("b", "nothing here matches zzz", ["absent"], None)], evaluation.CASES)
    metrics, means = evaluation.evaluate(ix, cases)
    rows = {(r["mode"], r.id): r for r in metrics.collect()}
    assert rows["fts", "a"].recall_at_5 == 1.0 and rows["fts", "a"].mrr == 1.0 and rows["ripgrep", "a"].recall_at_5 == 1.0 and rows["hybrid", "b"].mrr == 0.0
    assert {r["mode"]: r.cases for r in means.collect()} == {"fts": 2, "ripgrep": 2, "hybrid": 2, None: 6}


def test_fault_localisation_of_a_tree(spark, tree, tmp_path):
    from symlake import evaluation

    cases = spark.createDataFrame([("p1", "p", "load_config", None, ["service.py"], ["load_config"]), ("p2", "p", "helper", "no such symbol", ["Retry.java"], None)], evaluation.BUG_CASES)
    metrics, means = evaluation.benchmark(spark, cases, {"p1": str(tree), "p2": str(tree)}, Settings(index_path=str(tmp_path / "ix"), vectors=False))
    rows = {r.bug_id: r for r in metrics.collect()}
    assert rows["p1"].file_recall_at_1 == 1.0 and rows["p1"].method_recall_at_10 == 1.0 and rows["p2"].file_recall_at_5 == 1.0 and rows["p2"].method_recall_at_10 is None
    evaluation.write_json(str(tmp_path / "r.json"), {"cases": metrics, "summary": means})
    assert len(json.loads((tmp_path / "r.json").read_text())["summary"]) == 3
    evaluation.write_cases(str(tmp_path / "c.yml"), cases)
    assert yaml_cases(spark, str(tmp_path / "c.yml"), evaluation.BUG_CASES).count() == 2


def test_measures_of_a_tree_hold_no_list_twice(spark, tree, tmp_path):
    from symlake import evaluation

    settings = Settings(index_path=str(tmp_path / "ix"), vectors=False)
    index_tree(spark, str(tree), settings)
    asked = evaluation.numbered(spark.createDataFrame([("a", "load_config", None, None)], evaluation.CASES))
    by_mode = evaluation.hits_by_mode(Index(spark, settings, str(tree)), asked)
    plan = by_mode["hybrid"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and by_mode["hybrid"].count()
