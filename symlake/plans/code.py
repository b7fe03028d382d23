"""Registered queries over source files that are written from the driver's tables, so that SQL knows what is in them.

A Python file for each brand has, for each of its parts, a class with a method that calls a function, and that function,
which reads a setting.  A Java file for each brand has, for each part, a class with a field and two methods, one of which
calls the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import uuid5
from ..operators import chunks, enrich, evals, fts, graph, impact, parsing, symbols
from ..sources.store import kept, merged
from .queries import E_SQL, EDGE, EDGES, SYMBOLS, _BM25, _FIRST, _FUSED, _hybrid, _t, benchmark_queries, graph_edges, graph_symbols, query

#: Lines of a part in each file.
PY_LINES, JAVA_LINES = 8, 7


def _block(key: str, *lines: str) -> Column:
    """Lines with the part's key in place of #."""
    return F.concat(*[x for line in lines for x in [*[y for k, piece in enumerate(line.split("#")) for y in ([F.col(key)] if k else []) + [F.lit(piece)]], F.lit("\n")]])


def _written(spark, d) -> DataFrame:
    parts = _t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_partkey").cast("string").alias("k")).repartition("p_partkey")  # the table is a small file, its texts are not
    python = _block("k", "class C#:", "    def run(self):", "        return f#()", "", "", "def f#():", "    return TIMEOUT_#", "")
    java = _block("k", "class T# {", "    int size#;", "    int run#(int n) {", "        return help#(n);", "    }", "    int help#(int n) { return n; }", "}")
    rows = parts.select("p_brand", "p_partkey", F.explode(F.array(F.struct(F.lit("python").alias("language"), F.lit(".py").alias("suffix"), python.alias("text")), F.struct(F.lit("java").alias("language"), F.lit(".java").alias("suffix"), java.alias("text")))).alias("f")).select("p_brand", "p_partkey", "f.*")
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), "suffix")
    by = rows.groupBy(path.alias("path"), "language").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))).alias("all"))
    return by.select("path", "language", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("content"))


def _parsed(spark, d) -> DataFrame:
    return kept(parsing.parse(_written(spark, d)))  # read by several joins


_PARTS = "parts as (select p_partkey, p_partkey::varchar k, 'src/' || replace(p_brand, '#', '_') as stem, row_number() over (partition by p_brand order by p_partkey) - 1 as i from part)"
_PY = f"""{_PARTS}, py as (
  select stem || '.py' as file_path, 'python' as language, 'C' || k as qualified_name, 'C' || k as name, 'class' as kind, 8 * i + 1 as s, 8 * i + 3 as e, 3 * i as ord, 'class C' || k || ':' as head from parts
  union all select stem || '.py', 'python', 'C' || k || '.run', 'run', 'function', 8 * i + 2, 8 * i + 3, 3 * i + 1, 'def run(self):' from parts
  union all select stem || '.py', 'python', 'f' || k, 'f' || k, 'function', 8 * i + 6, 8 * i + 7, 3 * i + 2, 'def f' || k || '():' from parts)"""
_JAVA = """java as (
  select stem || '.java' as file_path, 'java' as language, 'T' || k as qualified_name, 'T' || k as name, 'class' as kind, 7 * i + 1 as s, 7 * i + 7 as e, 4 * i as ord, 'class T' || k || ' {' as head from parts
  union all select stem || '.java', 'java', 'T' || k || '.size' || k, 'size' || k, 'field', 7 * i + 2, 7 * i + 2, 4 * i + 1, 'int size' || k || ';' from parts
  union all select stem || '.java', 'java', 'T' || k || '.run' || k, 'run' || k, 'method', 7 * i + 3, 7 * i + 5, 4 * i + 2, 'int run' || k || '(int n) {' from parts
  union all select stem || '.java', 'java', 'T' || k || '.help' || k, 'help' || k, 'method', 7 * i + 6, 7 * i + 6, 4 * i + 3, 'int help' || k || '(int n) { return n; }' from parts)"""


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::int % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_ALL = f"{_PY}, {_JAVA}, code as (select * from py union all select * from java)"
_SYMBOL_ID = _uuid("file_path || ':' || qualified_name")


@query(f"with {_PY} select {_SYMBOL_ID} as id, qualified_name, file_path, name, kind, s::int as start_line, e::int as end_line from py")
def parse_python(spark, d):
    return symbols.symbols(_parsed(spark, d)).where("language = 'python'").select("id", "qualified_name", "file_path", "name", "kind", "start_line", "end_line")


@query(f"with {_PARTS}, {_JAVA} select {_SYMBOL_ID} as id, qualified_name, file_path, name, kind, s::int as start_line, e::int as end_line from java")
def parse_java(spark, d):
    return symbols.symbols(_parsed(spark, d)).where("language = 'java'").select("id", "qualified_name", "file_path", "name", "kind", "start_line", "end_line")


@query(f"""with {_PARTS} select 'C' || k || '.run' as source, 'f' || k as target, 'calls' as edge_type, stem || '.py' as file_path, 0.75::double as confidence from parts
union all select 'f' || k, 'TIMEOUT_' || k, 'reads_config', stem || '.py', 0.55 from parts""")
def python_edges(spark, d):
    return symbols.named_edges(_parsed(spark, d)).where("file_path like '%.py'").select("source", "target", "edge_type", "file_path", F.col("confidence").cast("double").alias("confidence"))


_JAVA_EDGES = f"""with {_PARTS} select {_uuid("stem || '.java:T' || k || '.run' || k")} as src_symbol_id, {_uuid("stem || '.java:T' || k || '.help' || k")} as dst_symbol_id, 'calls' as edge_type, stem || '.java' as file_path, (7 * i + 4)::int as line_start, 0.75::double as confidence from parts"""


@query(_JAVA_EDGES)
def java_edges(spark, d):
    """Edges with ids at both ends: a call is resolved to the method of its file."""
    return symbols.edges(_parsed(spark, d)).where("file_path like '%.java'").select("src_symbol_id", "dst_symbol_id", "edge_type", "file_path", "line_start", F.col("confidence").cast("double").alias("confidence"))


_CHUNKS = f"""with {_ALL} select {_SYMBOL_ID} as id, case kind when 'class' then 'class_chunk' when 'field' then 'symbol_profile' else 'function_chunk' end as unit_type, qualified_name as symbol,
  kind || ' ' || qualified_name || ' in ' || file_path || ' lines ' || s || '-' || e || '. Signature: ' || head as profile, (e - s + 1)::int as lines from code
union all select {_uuid("file_path || ':file_summary'")}, 'file_summary', file_path, 'File ' || file_path || ' defines ' || string_agg(qualified_name, ', ' order by ord) || '.', 1 from code group by file_path"""


@query(_CHUNKS)
def code_chunks(spark, d):
    """Chunks of symbols and of files, with their profiles."""
    found = symbols.symbols(_parsed(spark, d))
    out = chunks.indexed(_written(spark, d), found)
    return out.select("id", "unit_type", F.col("symbol_qualified_name").alias("symbol"), "profile", F.size(F.split("content", "\n")).alias("lines"))


@query(f"""with {_ALL}, n as (select file_path, count(*)::int as symbol_count, string_agg(qualified_name, ',' order by ord) filter (r <= 100) as defined from (select *, row_number() over (partition by file_path order by ord) r from code) group by 1)
select file_path as symbol, symbol_count, defined, null::varchar as context from n
union all select 'C' || k || '.run', null, null, 'calls:' || {_uuid("stem || '.py:f' || k")} from parts union all select 'f' || k, null, null, 'reads_config:TIMEOUT_' || k from parts
union all select 'T' || k || '.run' || k, null, null, 'calls:' || {_uuid("stem || '.java:T' || k || '.help' || k")} from parts""")
def vector_payloads(spark, d):
    """Payloads that say more than their chunk: edges of a symbol, number and names of a file's symbols."""
    parsed = _parsed(spark, d)
    found = symbols.symbols(parsed)
    out = chunks.payloads(chunks.indexed(_written(spark, d), found), found, symbols.edges(parsed))
    context = F.array_join(F.transform("graph_context", lambda x: F.concat_ws(":", x["edge_type"], x["target"])), ",")
    return out.where("graph_context is not null or symbol_count is not null").select("symbol", "symbol_count", F.array_join("defined_symbols", ",").alias("defined"), context.alias("context"))


#: Parts whose replies a task reads.
PARTS = 10_000


@query("""select 'part/' || p_partkey as id, p_name || ' is made' as description, [p_brand, p_type] as responsibilities, [p_type] as search_tags,
  p_name || ' is made' || chr(10) || 'Responsibilities: ' || p_brand || ', ' || p_type || chr(10) || 'Search tags: ' || p_type as profile from part where p_brand <> p_type""")
def enrich_replies(spark, d):
    """Replies of a model (fenced, with text around, broken), read, put together and written as a profile."""
    p = _t(spark, d, "part").where("p_brand != p_type")
    p = p.repartition(p.count() // PARTS + 1, "p_partkey")  # the table is a small file, its replies are many
    brand, kind = F.to_json(F.array("p_brand")), F.to_json(F.array("p_type"))
    text = F.to_json(F.struct(F.concat(F.lit("  "), "p_name", F.lit(" is made ")).alias("d")))
    described = F.concat(F.lit('```json\n{"description": '), F.substring(text, 6, 100000), F.lit("\n```"))
    listed = F.concat(F.lit('Here it is: {"description": "later", "responsibilities": '), brand, F.lit("} and so on"))
    tagged = F.concat(F.lit('{"responsibilities": '), F.to_json(F.array("p_brand", "p_type")), F.lit(', "tags": '), kind, F.lit(', "inputs": 7}'))
    replies = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.posexplode(F.array(described, listed, F.lit("no json {"), tagged, F.lit(None).cast("string"))).alias("n", "reply"))
    merged = enrich.merge(enrich.parse_replies(replies))
    return merged.select("id", "description", "responsibilities", "search_tags", enrich.profile_text().alias("profile"))


@query(f"""with {EDGES}, kinds as (select src_symbol_id, dst_symbol_id, case edge_type when 'calls' then 'logs' when 'uses' then 'queries_table' else 'reads_config' end as edge_type, file_path, line_start, confidence from edges),
best as (select *, row_number() over (partition by edge_type order by confidence desc, src_symbol_id, dst_symbol_id, file_path) as rank from kinds),
asked as (select item_id as query_id, case when regexp_matches(lower(text), 'metric|latency') then 'emits_metric' when contains(lower(text), 'log') then 'logs' when regexp_matches(lower(text), 'table|query|database') then 'queries_table' when regexp_matches(lower(text), 'config|timeout|retry') then 'reads_config' end as edge_type
  from (select item_id, case item_id % 3 when 0 then 'which log ' when 1 then 'what table ' else 'which timeout ' end || coalesce(text, '') as text from benchmark))
select query_id, rank, {E_SQL.replace('edge_type', 'best.edge_type')} from asked join best on asked.edge_type = best.edge_type where rank <= 20""")
def architecture_search(spark, d):
    e = graph_edges(spark, d).withColumn("edge_type", F.when(F.col("edge_type") == "calls", "logs").when(F.col("edge_type") == "uses", "queries_table").otherwise("reads_config"))
    begins = F.when(F.col("item_id") % 3 == 0, "which log ").when(F.col("item_id") % 3 == 1, "what table ").otherwise("which timeout ")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(begins, F.coalesce("text", F.lit(""))).alias("text"))
    return graph.architecture_search(asked, e).select("query_id", F.col("rank").cast("long").alias("rank"), *EDGE)


@query(_FUSED + ", h as (select * from ranked where rank <= 10) select query_id, retrieval_method, count(*) as n, min(rank) as first from h group by 1, 2")
def method_counts(spark, d):
    """How many of the fused hits each method gave, and the first of them."""
    hits = _hybrid(spark, d)[0]
    first = evals.hit_summary(hits, 10).groupBy("query_id", "retrieval_method").agg(F.min("rank").cast("long").alias("first"))
    return evals.method_counts(hits).join(first, ["query_id", "retrieval_method"]).select("query_id", "retrieval_method", "n", "first")


@query(_BM25 + " select query_id, rank, id, score from r where rank <= 10")
def stored_bm25(spark, d):
    """Full-text search over postings as an index stores them."""
    docs = _t(spark, d, "documents")
    found = fts.stored_scores(benchmark_queries(spark, d), fts.stored(docs, "doc_id", ["text"]), docs)
    return fts.best(found, 10).withColumn("rank", F.col("rank").cast("long"))


_PAIR = f"""with q as (select p_partkey as query_id, lower(split_part(p_name, ' ', 1)) as a, lower(split_part(p_name, ' ', 2)) as b from part where regexp_matches(p_name, '^[A-Za-z]+ [A-Za-z]+$')),
row_ as (select item_id as id, 'note ' || pa || '_' || pb || ' of ' || pb || ' and ' || pa as text from benchmark join (select p_partkey - 1 as k, lower(split_part(p_name, ' ', 1)) as pa, lower(split_part(p_name, ' ', 2)) as pb from part where regexp_matches(p_name, '^[A-Za-z]+ [A-Za-z]+$')) on k = item_id),
ts as (select id, string_split_regex(text, '[ _]') as t from row_), dl as (select id, len(t) dl from ts), stat as (select count(*)::double total, avg(dl) avgdl from dl),
pairs as (select id, unnest(t[1:len(t) - 1]) x, unnest(t[2:]) y from ts), f as (select query_id, id, count(*) f from q join pairs on x = a and y = b group by 1, 2),
idf as (select query_id, greatest(ln((any_value(total) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) idf from f, stat group by 1)
select query_id, id, round(-(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from f join idf using (query_id) join dl using (id), stat"""


@query(_PAIR)
def phrase_scores(spark, d):
    """Queries of one phrase: identifiers with an underscore stand for their words in a row."""
    two = _t(spark, d, "part").where(F.col("p_name").rlike("^[A-Za-z]+ [A-Za-z]+$")).select("p_partkey", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("b"))
    rows = _t(spark, d, "benchmark").join(two.withColumn("k", F.col("p_partkey") - 1), F.col("k") == F.col("item_id")).select(F.col("item_id").alias("id"), F.concat(F.lit("note "), "a", F.lit("_"), "b", F.lit(" of "), "b", F.lit(" and "), "a").alias("text"))
    asked = two.select(F.col("p_partkey").alias("query_id"), F.concat_ws("_", "a", "b").alias("text"))
    return fts.scores(asked, rows, "id", ["text"]).withColumn("score", F.round("score", 6))


@query(f"""with {SYMBOLS}, {EDGES}, roots as (select id as root, file_path as root_file from symbols where id like 'supplier/%'),
inc as (select root, e.*, {_FIRST.replace('ID', 'root').replace('file_path', 'e.file_path')} rank from roots join edges e on dst_symbol_id = root),
outg as (select root, e.*, row_number() over (partition by root order by confidence desc, line_start nulls first, src_symbol_id, dst_symbol_id, edge_type, e.file_path) rank from roots join edges e on src_symbol_id = root),
legs as (select root, root_file as file_path, 'target symbol is defined here' as reason, 2.0 as w, 0 as pos from roots
  union all select root, coalesce(s.file_path, c.file_path), 'direct caller', 1.5, 100 + rank from inc c left join symbols s on s.id = src_symbol_id where c.edge_type = 'calls' and rank <= 10
  union all select root, coalesce(s.file_path, c.file_path), 'incoming ' || edge_type || ' edge', 1.0, 200 + rank from inc c left join symbols s on s.id = src_symbol_id where rank <= 10
  union all select root, file_path, 'outgoing ' || edge_type || ' edge', 0.5, 300 + rank from outg where rank <= 10),
g as (select root, file_path, sum(w)::double as score from legs group by 1, 2), u as (select root, file_path, string_agg(reason, '; ' order by pos) as reasons from (select root, file_path, reason, min(pos) pos from legs group by 1, 2, 3) group by 1, 2)
select root, file_path, score, reasons from g join u using (root, file_path)""")
def outgoing_impact(spark, d):
    """Files that a change to a supplier reaches: suppliers have outgoing edges of several kinds, and a nation that calls them."""
    s = graph_symbols(spark, d)
    roots = s.where(F.col("id").startswith("supplier/"))
    out = impact.affected_files(roots, impact.fragments(roots, s, graph_edges(spark, d)))
    return out.select("root", "file_path", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""with {_ALL}, text_ as (
    select stem || '.py' as file_path, 8 * i as before, ['class C' || k || ':', '    def run(self):', '        return f' || k || '()', '', '', 'def f' || k || '():', '    return TIMEOUT_' || k, ''] as l from parts
    union all select stem || '.java', 7 * i, ['class T' || k || ' {{', '    int size' || k || ';', '    int run' || k || '(int n) {{', '        return help' || k || '(n);', '    }}', '    int help' || k || '(int n) {{ return n; }}', '}}'] from parts),
  lines as (select file_path, before + unnest(range(1, len(l) + 1)) as line, unnest(l) as text from text_), n as (select file_path, count(*) as n from lines group by 1),
  places as (select qualified_name as root, 1 as rank, 'target definition' as reason, file_path, s as line from code
    union all select 'f' || k, 2, 'direct caller: C' || k || '.run', stem || '.py', 8 * i + 2 from parts
    union all select 'T' || k || '.help' || k, 2, 'direct caller: T' || k || '.run' || k, stem || '.java', 7 * i + 4 from parts),
  w as (select root, rank, reason, file_path, greatest(1, line - 2) as s, least(n, line + 2) as e from places join n using (file_path)),
  each as (select *, unnest(range(s, e + 1)) as line from w)
select root, rank::bigint as rank, reason, file_path, s::int as line_start, e::int as line_end, string_agg(text, chr(10) order by line) as content from each join lines using (file_path, line) group by all""")
def impact_windows(spark, d):
    """The windows around every symbol of the written files, and around the calls of it."""
    parsed = _parsed(spark, d)
    s = kept(symbols.symbols(parsed))
    f = impact.fragments(s, s, symbols.edges(parsed).drop("ord"))
    out = impact.windows(s, f, _written(spark, d), 2).join(merged(s.select(F.col("id").alias("root"), F.col("qualified_name").alias("name"))), "root")
    return out.select(F.col("name").alias("root"), F.col("rank").cast("long").alias("rank"), "reason", "file_path", "line_start", "line_end", "content")


@query(f"with {_PARTS}, f as (select distinct stem from parts) select stem || '.py' as path, 'python' as language, {_uuid("stem || '.py:file_summary'")} as id from f union all select stem || '.java', 'java', {_uuid("stem || '.java:file_summary'")} from f")
def written_files(spark, d):
    """The files that these queries read, as an index knows them."""
    return _written(spark, d).select("path", "language", uuid5(F.concat("path", F.lit(":file_summary"))).alias("id"))
