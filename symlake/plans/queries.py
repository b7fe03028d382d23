"""Registered queries: the operators over the driver's tables, each with the same question as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import cases, embed, evals, fts, fuse, graph, grep, impact, symbols, tools, vector, window
from ..sources import store
from ..sources.trees import documents_as_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.col(col).cast("string"))


# A corpus: documents as files.  A graph: regions hold nations, nations suppliers, suppliers deliver parts.

FILES = "files as (select source || '/' || doc_id as path, lang as language, coalesce(text, '') as content, doc_id from documents)"
SYMBOLS = """symbols as (
  select 'part/' || p_partkey as id, p_brand || '.' || replace(p_name, ' ', '_') || '.' || p_partkey as qualified_name, p_type as file_path, p_name as name,
    case p_size % 4 when 0 then 'class' when 1 then 'function' when 2 then 'method' else 'field' end as kind, p_size as start_line, p_size + 5 as end_line from part
  union all select 'supplier/' || s_suppkey, 'Supplier.' || s_name, 'nation/' || s_nationkey, s_name, 'class', (s_suppkey % 100 + 1)::int, (s_suppkey % 100 + 10)::int from supplier
  union all select 'nation/' || n_nationkey, 'Nation.' || n_name, 'region/' || n_regionkey, n_name, 'class', 1, 5 from nation)"""
RAW_EDGES = """raw_edges as (
  select 'supplier/' || l_suppkey as src_symbol_id, 'part/' || l_partkey as dst_symbol_id, case l_returnflag when 'A' then 'calls' when 'N' then 'uses' else 'imports' end as edge_type,
    'status/' || l_linestatus as file_path, l_linenumber::int as line_start, round(1 - l_discount, 2) as confidence, l_orderkey, l_extendedprice from lineitem)"""
EDGES = (
    RAW_EDGES
    + """, edges as (
  select src_symbol_id, dst_symbol_id, edge_type, file_path, line_start, confidence from (
    select *, row_number() over (partition by src_symbol_id, dst_symbol_id, edge_type, file_path order by l_orderkey desc, line_start desc, l_extendedprice desc, confidence desc) k from raw_edges) where k = 1
  union all select 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'calls', 'nation', null, 1.0 from supplier
  union all select 'region/' || n_regionkey, 'nation/' || n_nationkey, 'inherits', 'region', null, 0.9 from nation)"""
)
LOOKUPS = "lookups as (select row_number() over (order by text) - 1 as query_id, text from (select distinct p_name as text from part union select n_name from nation))"
FOUND = """found as (
  select query_id, row_number() over (partition by query_id order by case when name = text or qualified_name = text then 0 else 1 end, qualified_name, file_path) as rank, symbols.*
  from lookups join symbols on name = text or qualified_name = text or name ilike '%' || text || '%' or qualified_name ilike '%' || text || '%')"""


def files(spark, d) -> DataFrame:
    return documents_as_files(_t(spark, d, "documents"))


def graph_symbols(spark, d) -> DataFrame:
    part = _t(spark, d, "part").select(_id("part", "p_partkey").alias("id"), F.concat_ws(".", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string")).alias("qualified_name"), F.col("p_type").alias("file_path"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 4 == 0, "class").when(F.col("p_size") % 4 == 1, "function").when(F.col("p_size") % 4 == 2, "method").otherwise("field").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))
    line = (F.col("s_suppkey") % 100).cast("int")
    supplier = _t(spark, d, "supplier").select(_id("supplier", "s_suppkey"), F.concat(F.lit("Supplier."), "s_name"), _id("nation", "s_nationkey"), "s_name", F.lit("class"), line + 1, line + 10)
    nation = _t(spark, d, "nation").select(_id("nation", "n_nationkey"), F.concat(F.lit("Nation."), "n_name"), _id("region", "n_regionkey"), "n_name", F.lit("class"), F.lit(1), F.lit(5))
    return part.union(supplier).union(nation)


def raw_edges(spark, d) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "uses").otherwise("imports")
    return _t(spark, d, "lineitem").select(_id("supplier", "l_suppkey").alias("src_symbol_id"), _id("part", "l_partkey").alias("dst_symbol_id"), kind.alias("edge_type"), _id("status", "l_linestatus").alias("file_path"), F.col("l_linenumber").cast("int").alias("line_start"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), "l_orderkey", "l_extendedprice")


def graph_edges(spark, d) -> DataFrame:
    e = store.last_wins(raw_edges(spark, d), ["src_symbol_id", "dst_symbol_id", "edge_type", "file_path"], ["l_orderkey", "line_start", "l_extendedprice", "confidence"]).drop("l_orderkey", "l_extendedprice")
    none = F.lit(None).cast("int")
    s = _t(spark, d, "supplier").select(_id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), F.lit("calls"), F.lit("nation"), none, F.lit(1.0))
    n = _t(spark, d, "nation").select(_id("region", "n_regionkey"), _id("nation", "n_nationkey"), F.lit("inherits"), F.lit("region"), none, F.lit(0.9))
    return e.union(s).union(n)


def lookups(spark, d) -> DataFrame:
    """Every name of a part or nation, as queries."""
    texts = _t(spark, d, "part").select(F.col("p_name").alias("text")).unionByName(_t(spark, d, "nation").select(F.col("n_name").alias("text"))).distinct()
    return texts.select((F.row_number().over(Window.orderBy("text")) - 1).cast("long").alias("query_id"), "text")


EDGE = ["src_symbol_id", "dst_symbol_id", "edge_type", "file_path", "line_start", "confidence"]
E_SQL = ", ".join(EDGE)

# ---------------------------------------------------------------- corpus


@query("select source || '/' || doc_id as path, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::bigint as tokens from documents")
def file_token_counts(spark, d):
    return files(spark, d).select("path", exprs.token_count(F.col("content")).cast("long").alias("tokens"))


@query("select lang as language, source, count(*) as files, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')))::bigint as tokens from documents group by rollup(lang, source)")
def language_rollup(spark, d):
    rows = _t(spark, d, "documents").select(F.col("lang").alias("language"), "source", exprs.token_count(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.rollup("language", "source").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("tokens"))


LINES = "lines as (select path, unnest(ls) as text, unnest(range(1, len(ls) + 1))::int as line from (select path, case when l[-1] = '' then l[1:len(l) - 1] else l end as ls from (select path, string_split(content, chr(10)) as l from files)))"


@query(f"with {FILES}, {LINES} select path, line, text from lines")
def doc_lines(spark, d):
    return grep.lines(files(spark, d)).select("path", "line", "text")


@query(f"with {FILES}, {LINES} select path, ((line - 1) // 5)::bigint as chunk, min(line) as line_start, max(line) as line_end, string_agg(text, chr(10) order by line) as content, case when count(*) = 5 then 'function_chunk' else 'symbol_profile' end as unit_type from lines group by 1, 2")
def line_chunks(spark, d):
    """Chunks of five lines, cut from arrays without a shuffle."""
    f = files(spark, d).select("path", F.split("content", "\n").alias("l")).withColumn("l", F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l"))).where(F.size("l") > 0)
    cut = f.select("path", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 5).cast("int"))).alias("chunk"))
    part = F.slice("l", F.col("chunk") * 5 + 1, 5)
    kind = exprs.unit_type(F.when(F.size(part) == 5, "function").otherwise("variable"))
    return cut.select("path", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 5 + 1).alias("line_start"), (F.col("chunk") * 5 + F.size(part)).alias("line_end"), F.array_join(part, "\n").alias("content"), kind.alias("unit_type"))


@query(f"with {SYMBOLS} select file_path, 'File ' || file_path || ' defines ' || string_agg(qualified_name, ', ' order by start_line, qualified_name) || '.' as profile, count(*) as symbols from symbols group by 1")
def file_summary(spark, d):
    by = graph_symbols(spark, d).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "qualified_name"))).alias("all"), F.count("*").alias("symbols"))
    return by.select("file_path", F.concat(F.lit("File "), "file_path", F.lit(" defines "), F.array_join(F.transform("all", lambda x: x["qualified_name"]), ", "), F.lit(".")).alias("profile"), "symbols")


@query(f"with {SYMBOLS} select id, kind || ' ' || qualified_name || ' in ' || file_path || ' lines ' || start_line || '-' || end_line || '. Signature: ' || name as profile, case when kind = 'class' then 'class_chunk' when kind in ('function', 'method') then 'function_chunk' else 'symbol_profile' end as unit_type from symbols")
def symbol_profiles(spark, d):
    s = graph_symbols(spark, d)
    return s.select("id", F.concat("kind", F.lit(" "), "qualified_name", F.lit(" in "), "file_path", F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(". Signature: "), "name").alias("profile"), exprs.unit_type(F.col("kind")).alias("unit_type"))


# ---------------------------------------------------------------- exact search and routing

PATTERN = r"[Ll]icen[cs]e|https?://|[A-Z]{6,}!!"


@query(f"with {FILES}, {LINES} select path, line, text from lines where regexp_matches(text, '{PATTERN}')")
def grep_matches(spark, d):
    return grep.matches(files(spark, d), PATTERN).select("path", "line", "text")


@query(
    f"""with {FILES}, {LINES}, h as (select *, regexp_matches(text, '[Ll]icen[cs]e') hit from lines),
n as (select *, max(case when hit then line end) over (partition by path order by line) prev, min(case when hit then line end) over (partition by path order by line desc) nxt from h),
o as (select path, line, text, coalesce(prev, nxt) as hit_line from n where line - prev <= 3 or nxt - line <= 3),
r as (select path, hit_line, min(line) s, max(line) e, string_agg(text, chr(10) order by line) content, string_agg(case when line <= hit_line then text end, chr(10) order by line) initial from o group by 1, 2),
k as (select *, row_number() over (order by path, hit_line) rank from r)
select rank, path, s::int as line_start, case when rank = 50 then hit_line else e end::int as line_end, case when rank = 50 then initial else content end as content from k where rank <= 50"""
)
def grep_context_chunks(spark, d):
    return grep.chunks(files(spark, d), "[Ll]icen[cs]e", context=3, max_results=50).select("rank", "path", "line_start", "line_end", "content").withColumn("rank", F.col("rank").cast("long"))


_EXACT_SQL = " or ".join(f"regexp_matches(text, '{p}')" for p in exprs.EXACT_PATTERNS)


@query(f"select conv_id, turn, role, e as is_exact, case when e then 0.70 else 0.25 end::double as ripgrep_weight, case when e then 0.20 else 0.35 end::double as fts_weight, case when e then 0.10 else 0.40 end::double as vector_weight from (select *, coalesce({_EXACT_SQL}, false) e from conversations)")
def query_router(spark, d):
    return fuse.route(_t(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))).select("conv_id", "turn", "role", "is_exact", "ripgrep_weight", "fts_weight", "vector_weight")


@query(f"select page_id, coalesce({_EXACT_SQL.replace('text,', 'url,')}, false) as is_exact from pages")
def url_router(spark, d):
    return _t(spark, d, "pages").select("page_id", exprs.looks_exact(F.coalesce("url", F.lit(""))).alias("is_exact"))


# ---------------------------------------------------------------- full text

_FOLD = f"translate(lower(coalesce(TEXT, '')), '{fts.MARKED}', '{fts.PLAIN}')"
_TOKENS = rf"regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')"
_BM25 = f"""with q as (select item_id as query_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as w from benchmark),
asked as (select query_id, key, count(*) times from (select query_id, array_to_string({_TOKENS.replace("TEXT", "w")}, ' ') key from q) where key <> '' group by 1, 2),
doc as (select doc_id as id, {_TOKENS.replace("TEXT", "text")} ts from documents), dl as (select id, len(ts) dl from doc),
f as (select id, key, count(*) f from (select id, unnest(ts) key from doc) where key in (select key from asked) group by 1, 2),
stat as (select count(*)::double total, avg(dl) avgdl from dl),
idf as (select key, greatest(ln((total - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) idf from f, stat group by key, total),
s as (select query_id, f.id, round(-sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score from f join idf using (key) join dl on dl.id = f.id join asked using (key), stat group by 1, 2),
r as (select query_id, row_number() over (partition by query_id order by score, id) as rank, id, score from s)"""


def benchmark_queries(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


@query(_BM25 + " select query_id, rank, id, score from r where rank <= 10")
def fts_bm25(spark, d):
    return fts.search(benchmark_queries(spark, d), _t(spark, d, "documents"), "doc_id", ["text"], 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with q as (select distinct lower(p_name) as phrase from part), doc as (select doc_id as id, {_TOKENS.replace("TEXT", "text")} ts from documents),
t as (select id, unnest(ts) as a, unnest(ts[2:]) as b from doc), p as (select id, a || ' ' || b as phrase, count(*) as f from t where b is not null group by 1, 2),
r as (select phrase, count(*) as docs, sum(f)::bigint as places from p group by 1 having count(*) > 1)
select phrase, docs, places, row_number() over (order by docs desc, places desc, phrase) as rank from r qualify rank <= 50"""
)
def fts_phrase(spark, d):
    """The phrases of two tokens that stand in most documents."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        by = fts.pairs(docs, "text").where("docs > 1")
    else:  # rows of one id count as one document
        toks = docs.select("id", fts.index_tokens(F.col("text")).alias("ts"))
        pairs = toks.where(F.size("ts") > 1).select("id", F.explode(F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("phrase"))
        by = pairs.groupBy("id", "phrase").agg(F.count("*").alias("f")).groupBy("phrase").agg(F.count("*").alias("docs"), F.sum("f").alias("places")).where("docs > 1")
    top = by.orderBy(F.desc("docs"), F.desc("places"), "phrase").limit(50)
    return top.select("phrase", "docs", "places", F.row_number().over(Window.orderBy(F.desc("docs"), F.desc("places"), "phrase")).cast("long").alias("rank"))


# ---------------------------------------------------------------- vectors

_HASH = """select id, idx, round(v / sqrt(sum(v * v) over (partition by id)), 9) as value from (
  select id, (('0x' || substr(h, 1, 8))::bigint % 384)::int as idx, sum(case when ('0x' || substr(h, 9, 2))::int % 2 = 0 then 1 else -1 end)::double as v
  from (select id, sha256(t) h from (select item_id as id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) t from benchmark)) group by 1, 2) where v <> 0"""


@query(_HASH)
def hash_embed(spark, d):
    return embed.hash_sparse(_t(spark, d, "benchmark"), "item_id", "text").select("id", "idx", F.round("value", 9).alias("value"))


@query(
    """with q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 50 = 0), v as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select query_id, id, round(list_cosine_similarity(qv, v), 6) as score from q, v)
select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, score from s qualify rank <= 10"""
)
def vector_topk(spark, d):
    e = _t(spark, d, "embeddings")
    out = vector.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- fusion

_LISTS = """lists as (
  select query_id, 1 as list_no, rank, id, 'doc/' || id as file_path from r where rank <= 10
  union all select query_id, 0, rank, id, file_path from (select item_id as query_id, row_number() over (partition by item_id order by doc_id) as rank, doc_id as id, 'doc/' || doc_id as file_path from benchmark b join documents d on contains(d.text, b.text)) where rank <= 50)"""


def _literal_hits(spark, d) -> DataFrame:
    """Documents that hold a benchmark text as it stands."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = reduce(DataFrame.unionByName, [_holding(docs, part) for part in _item_parts(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))])
    return graph.ranked(found.distinct(), ["query_id"], ["id"], 50)


def _item_parts(items: DataFrame, chars: int = 8 << 20):
    """(query_id, text) of the items in parts of a bounded number of characters."""
    part, size = [], 0
    for r in items.where("text is not null").select(F.col("query_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1])
        if size > chars:
            yield part
            part, size = [], 0
    yield part


def _holding(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """query_id, id of the items in docs (id, text), anywhere in a text; one pass with an automaton of all items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    everywhere = [i for i, t in items if not t]

    def run(batches):
        at: dict[str, list[int]] = {}
        for i, t in shared.value:
            if t:
                at.setdefault(t, []).append(i)
        automaton = ahocorasick.Automaton()
        for t, ids in at.items():
            automaton.add_word(t, tuple(ids))
        if at:
            automaton.make_automaton()
        for b in batches:
            hits = []
            for doc, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if text is not None:
                    ids = {i for _, some in automaton.iter(text) for i in some} if at else set()
                    hits += [(i, doc) for i in ids.union(everywhere)]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["query_id", "id"])

    return docs.mapInArrow(run, "query_id long, id long")


def _doc_hits(found: DataFrame, method: str) -> DataFrame:
    path = F.concat(F.lit("doc/"), F.col("id").cast("string"))
    none = F.lit(None).cast("int")
    return found.select("query_id", "rank", F.col("id").cast("string").alias("id"), F.lit(1.0).alias("score"), path.alias("file_path"), path.alias("symbol"), F.lit("").alias("content"), F.lit(method).alias("source"), F.lit(method).alias("retrieval_method"), none.alias("line_start"), none.alias("line_end"))


def _hybrid(spark, d, limit: int = 10):
    fts_hits = fts.search(benchmark_queries(spark, d), _t(spark, d, "documents"), "doc_id", ["text"], 10)
    return fuse.hybrid(benchmark_queries(spark, d), {"ripgrep": _doc_hits(_literal_hits(spark, d), "ripgrep"), "fts": _doc_hits(fts_hits, "fts")}, limit)


_ROUTED = f"routed as (select item_id as query_id, coalesce({_EXACT_SQL}, false) e from benchmark)"
_FUSED = f"""{_BM25}, {_LISTS}, {_ROUTED}, fused as (
  select query_id, file_path, round(sum(case when list_no = 0 then (case when e then 0.70 else 0.25 end) else (case when e then 0.20 else 0.35 end) end / (60 + rank)), 9) as score, min(list_no * 1000 + rank) as place
  from lists join routed using (query_id) group by 1, 2), ranked as (select query_id, row_number() over (partition by query_id order by score desc, place) as rank, file_path, score, case when place >= 1000 then 'fts' else 'ripgrep' end as retrieval_method from fused)"""


@query(_FUSED + " select query_id, rank, file_path, score, retrieval_method from ranked where rank <= 10")
def rrf_fusion(spark, d):
    return _hybrid(spark, d)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "file_path", "score", "retrieval_method")


@query(f"{_BM25}, {_LISTS}, n as (select query_id, list_no, count(*) n from lists group by 1, 2) select item_id as query_id, method, coalesce(n, 0) as n from benchmark cross join (values (0, 'ripgrep'), (1, 'fts'), (2, 'vector')) m(list_no, method) left join n on n.query_id = item_id and n.list_no = m.list_no")
def hybrid_counts(spark, d):
    return _hybrid(spark, d)[1]


# ---------------------------------------------------------------- graph


@query(f"with {SYMBOLS}, {LOOKUPS}, {FOUND} select query_id, rank, id, qualified_name, file_path from found where rank <= 10")
def find_symbols(spark, d):
    return graph.find_symbols(lookups(spark, d), graph_symbols(spark, d), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "qualified_name", "file_path")


_BEST_FIRST = "row_number() over (partition by ID order by confidence desc, edge_type, src_symbol_id, dst_symbol_id, file_path)"


def _nodes(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").select(_id("supplier", "s_suppkey").alias("id"))


def _of(direction):
    def run(spark, d):
        return graph.edges_of(_nodes(spark, d), graph_edges(spark, d), direction).select("id", F.col("rank").cast("long").alias("rank"), *EDGE)

    return run


for _name, _on in (("in", "dst_symbol_id = id"), ("out", "src_symbol_id = id"), ("both", "(src_symbol_id = id or dst_symbol_id = id)")):
    QUERIES[f"symbol_edges_{_name}"] = _of(_name)
    ORACLE[f"symbol_edges_{_name}"] = f"with {EDGES}, nodes as (select 'supplier/' || s_suppkey as id from supplier) select id, {_BEST_FIRST.replace('ID', 'id')} as rank, {E_SQL} from nodes join edges on {_on}"


@query(f"with {EDGES} select {E_SQL} from edges where edge_type = 'calls' order by confidence desc, src_symbol_id, dst_symbol_id, file_path limit 1000")
def edges_by_type(spark, d):
    return graph.edges_by_type(graph_edges(spark, d), "calls", 1000).select(*EDGE)


@query(f"with {SYMBOLS}, {EDGES} select {', '.join('e.' + c for c in EDGE)}, s.qualified_name as src_symbol, s.kind as src_kind, s.file_path as src_file_path, s.start_line as src_start_line, t.qualified_name as dst_symbol from edges e left join symbols s on s.id = src_symbol_id left join symbols t on t.id = dst_symbol_id")
def edges_with_names(spark, d):
    return graph.with_names(graph_edges(spark, d), graph_symbols(spark, d)).select(*EDGE, "src_symbol", "src_kind", "src_file_path", "src_start_line", "dst_symbol")


@query(f"with {SYMBOLS}, {LOOKUPS}, {FOUND}, {EDGES} select query_id, id, qualified_name, src_symbol_id, dst_symbol_id, edge_type, confidence, {_BEST_FIRST.replace('ID', 'query_id')} as rank from found left join (select * rename (file_path as edge_file) from edges) e on src_symbol_id = id or dst_symbol_id = id where found.rank = 1".replace("dst_symbol_id, file_path) as rank", "dst_symbol_id, edge_file) as rank"))
def explain_symbol(spark, d):
    out = graph.explain(lookups(spark, d), graph_symbols(spark, d), graph_edges(spark, d))
    return out.select("query_id", "id", "qualified_name", "src_symbol_id", "dst_symbol_id", "edge_type", "confidence", F.coalesce(F.col("rank"), F.lit(1)).cast("long").alias("rank"))


@query(f"with {SYMBOLS}, {LOOKUPS}, {FOUND}, {EDGES}, u as (select query_id, found.rank as symbol_rank, e.*, {_BEST_FIRST.replace('ID', 'query_id, found.rank').replace('file_path', 'e.file_path')} as edge_rank from found join edges e on dst_symbol_id = id where found.rank <= 10) select query_id, row_number() over (partition by query_id order by symbol_rank, edge_rank) as rank, {E_SQL} from u")
def find_usage(spark, d):
    return graph.usages(lookups(spark, d), graph_symbols(spark, d), graph_edges(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), *EDGE)


@query(f"with {SYMBOLS}, {LOOKUPS}, {FOUND}, {EDGES}, b as (select query_id, id, case when src_symbol_id <> id then src_symbol_id else dst_symbol_id end as other, {_BEST_FIRST.replace('ID', 'query_id').replace('file_path', 'e.file_path')} as k from found join edges e on src_symbol_id = id or dst_symbol_id = id where found.rank = 1) select query_id, string_agg(other, ',' order by other) as related from (select distinct query_id, other from b where k <= 20) group by 1")
def related_symbols(spark, d):
    return graph.related(lookups(spark, d), graph_symbols(spark, d), graph_edges(spark, d), 20).where(F.size("related") > 0).select("query_id", F.array_join("related", ",").alias("related"))


@query(f"with {EDGES}, roots as (select 'part/' || p_partkey as root from part), one as (select distinct root, src_symbol_id as id from roots join edges on dst_symbol_id = root), two as (select distinct one.root, src_symbol_id as id from one join edges on dst_symbol_id = one.id) select root, id, 1 as level from one union all select root, id, 2 from two where (root, id) not in (select (root, id) from one) and id <> root")
def impact_bfs(spark, d):
    roots = _t(spark, d, "part").select(_id("part", "p_partkey").alias("id"))
    return graph.reverse_bfs(roots, graph_edges(spark, d), 2)[0].select("root", "id", "level")


@query(
    f"""with {EDGES}, roots as (select 'part/' || p_partkey as root from part), c as (select *, row_number() over (partition by dst_symbol_id order by confidence desc, line_start nulls first, src_symbol_id, file_path) er from edges where edge_type = 'calls'),
c5 as (select * from c where er <= 5), one as (select root, 1 as level, 1::bigint as place, er, src_symbol_id, dst_symbol_id from roots join c5 on dst_symbol_id = root),
f as (select root, id, row_number() over (partition by root order by met) place from (select root, src_symbol_id id, min(er) met from one group by 1, 2) where id <> root),
two as (select f.root, 2 as level, place, er, src_symbol_id, dst_symbol_id from f join c5 on dst_symbol_id = f.id),
a as (select *, row_number() over (partition by root order by level, place, er) ord from (select * from one union all select * from two))
select root, ord, level, src_symbol_id, dst_symbol_id from a where ord <= 5"""
)
def impact_calls_walk(spark, d):
    roots = _t(spark, d, "part").select(_id("part", "p_partkey").alias("id"))
    return graph.calls_walk(roots, graph_edges(spark, d), 2, 5).select("root", F.col("ord").cast("long").alias("ord"), "level", "src_symbol_id", "dst_symbol_id")


def _roots(spark, d) -> DataFrame:
    return graph_symbols(spark, d).where(F.col("id").startswith("part/"))


_FIRST = "row_number() over (partition by ID order by confidence desc, line_start nulls first, src_symbol_id, dst_symbol_id, file_path)"
_LEGS = f"""{SYMBOLS}, {EDGES}, roots as (select id as root, file_path as root_file, start_line as root_line from symbols where id like 'part/%'),
inc as (select root, edges.*, row_number() over (partition by root order by confidence desc, line_start nulls first, src_symbol_id, dst_symbol_id, edge_type, file_path) rank from roots join edges on dst_symbol_id = root),
cal as (select root, edges.*, row_number() over (partition by root order by confidence desc, line_start nulls first, src_symbol_id, dst_symbol_id, edge_type, file_path) rank from roots join edges on dst_symbol_id = root where edge_type = 'calls'),
outg as (select root, edges.*, row_number() over (partition by root order by confidence desc, line_start nulls first, src_symbol_id, dst_symbol_id, edge_type, file_path) rank from roots join edges on src_symbol_id = root),
near as (select root, s.id, qualified_name, s.file_path, row_number() over (partition by root order by abs(start_line - root_line), start_line, s.id) rank from roots join symbols s on s.file_path = root_file and s.id <> root where kind in ('function', 'async_function', 'method', 'constructor', 'class'))"""


@query(
    f"""with {_LEGS}, legs as (select root, root_file as file_path, 'target symbol is defined here' as reason, 2.0 as w, 0 as pos from roots
  union all select root, coalesce(s.file_path, c.file_path), 'direct caller', 1.5, 100 + rank from cal c left join symbols s on s.id = src_symbol_id where rank <= 10
  union all select root, coalesce(s.file_path, c.file_path), 'incoming ' || edge_type || ' edge', 1.0, 200 + rank from inc c left join symbols s on s.id = src_symbol_id where rank <= 10
  union all select root, file_path, 'outgoing ' || edge_type || ' edge', 0.5, 300 + rank from outg where rank <= 10),
g as (select root, file_path, sum(w)::double as score from legs group by 1, 2), u as (select root, file_path, string_agg(reason, '; ' order by pos) as reasons from (select root, file_path, reason, min(pos) pos from legs group by 1, 2, 3) group by 1, 2)
select root, file_path, score, reasons, row_number() over (partition by root order by score desc, file_path) as rank from g join u using (root, file_path)"""
)
def affected_files(spark, d):
    roots, s = _roots(spark, d), graph_symbols(spark, d)
    out = impact.affected_files(roots, impact.fragments(roots, s, graph_edges(spark, d)))
    return out.select("root", "file_path", "score", F.array_join("reasons", "; ").alias("reasons"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {_LEGS}, legs as (select root, src_symbol_id as symbol_id, 'incoming ' || edge_type as relation, rank as pos from inc where rank <= 10
  union all select root, dst_symbol_id, 'outgoing ' || edge_type, 100 + rank from outg where rank <= 10 union all select root, id, 'same file', 200 + rank from near where rank <= 10),
g as (select root, symbol_id, min(pos) as pos from legs where symbol_id <> root group by 1, 2), u as (select root, symbol_id, string_agg(relation, '; ' order by pos) as relations from (select root, symbol_id, relation, min(pos) pos from legs group by 1, 2, 3) group by 1, 2)
select root, symbol_id, relations, row_number() over (partition by root order by g.pos) as rank from g join u using (root, symbol_id) qualify rank <= 10"""
)
def related_methods(spark, d):
    roots, s = _roots(spark, d), graph_symbols(spark, d)
    out = impact.related_methods(roots, impact.fragments(roots, s, graph_edges(spark, d)))
    return out.select("root", "symbol_id", F.array_join("relations", "; ").alias("relations"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_LEGS}, n as (select root, count(*) filter (rank <= 10) as callers from cal group by 1), k as (select id as root, kind from symbols where id like 'part/%') select root, (case when coalesce(callers, 0) > 0 then 1 else 0 end + case when kind in ('method', 'function') and coalesce(callers, 0) = 0 then 1 else 0 end + case when k.root in (select root from inc) then 1 else 0 end)::int as notes from k left join n using (root)")
def risk_notes(spark, d):
    """The number of notes: parts have no outgoing edges or tests, and an incoming edge always brings in another file."""
    roots, s = _roots(spark, d), graph_symbols(spark, d)
    f = impact.fragments(roots, s, graph_edges(spark, d))
    return impact.risk_notes(roots, f, impact.affected_files(roots, f)).select("root", F.size("notes").alias("notes"))


@query(f"with {_LEGS} select root, rank, id, qualified_name from near where rank <= 10")
def same_file_neighbours(spark, d):
    return graph.same_file_neighbours(_roots(spark, d), graph_symbols(spark, d), 10).select("root", F.col("rank").cast("long").alias("rank"), "id", "qualified_name")


@query(
    f"""with {EDGES}, asked as (select page_id as query_id, case when regexp_matches(lower(url), 'metric|latency') then 'emits_metric' when contains(lower(url), 'log') then 'logs' when regexp_matches(lower(url), 'table|query|database') then 'queries_table' when regexp_matches(lower(url), 'config|timeout|retry') then 'reads_config' end as edge_type from pages)
select query_id, edge_type from asked where edge_type is not null"""
)
def architecture_route(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("query_id"), graph.architecture_route(F.col("url")).alias("edge_type")).where("edge_type is not null")


# ---------------------------------------------------------------- intervals, upserts, windows, budgets


@query(
    """with s as (select user_id, ts as s, ts + interval 1 day as e, event_id as owner from events where event_type = 'signup'), p as (select user_id, ts, event_id from events where event_type = 'error')
select event_id, owner from (select p.event_id, owner, row_number() over (partition by p.event_id order by s desc, e, owner) k from p join s on p.user_id = s.user_id and ts between s and e) where k = 1"""
)
def line_owner(spark, d):
    e = _t(spark, d, "events")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 1 day")).alias("e"), F.col("event_id").alias("owner"))
    points = e.where("event_type = 'error'").select("user_id", "ts", "event_id", F.col("event_id").alias("__point"))
    return symbols.owned(points, spans, ["user_id"], "ts", "s", "e", [F.desc("s"), "e", "owner"]).select("event_id", "owner")


@query(f"with {EDGES} select {E_SQL} from edges where src_symbol_id like 'supplier/%'")
def dedupe_last_wins(spark, d):
    return store.last_wins(raw_edges(spark, d), ["src_symbol_id", "dst_symbol_id", "edge_type", "file_path"], ["l_orderkey", "line_start", "l_extendedprice", "confidence"]).select(*EDGE)


@query("select c_custkey as id, c_name as name, c_mktsegment as segment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') union all select o_custkey, 'updated', o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) k from orders where o_orderstatus = 'P') where k = 1")
def upsert_by_key(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit("updated").alias("name"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("ord"))
    return store.upsert(old, new, ["id"]).select("id", "name", "segment")


@query(f"with {EDGES} select {E_SQL} from edges where file_path <> 'status/F' union all select src_symbol_id, dst_symbol_id, 'replaced', 'status/F', null, 1.0 from (select distinct src_symbol_id, dst_symbol_id from edges where file_path = 'status/F')")
def replace_by_file(spark, d):
    e = graph_edges(spark, d)
    new = e.where("file_path = 'status/F'").select("src_symbol_id", "dst_symbol_id").distinct().select("*", F.lit("replaced").alias("edge_type"), F.lit("status/F").alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(1.0).alias("confidence"))
    return store.replace_by_file(e, new, spark.createDataFrame([("status/F",)], "file_path string")).select(*EDGE)


@query(
    r"""with w as (select source || '/' || doc_id as file_path, (doc_id % 7)::int as line, case when l[-1] = '' then l[1:len(l) - 1] else l end as l from (select *, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') as l from documents))
select file_path, greatest(1, line - 2)::int as line_start, least(len(l), line + 2)::int as line_end, array_to_string(l[greatest(1, line - 2):least(len(l), line + 2)], chr(10)) as content from w"""
)
def code_window(spark, d):
    places = _t(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 7).cast("int").alias("line"))
    return window.code_windows(places, files(spark, d), 2).select("file_path", "line_start", "line_end", "content")


@query("select doc_id, case when length(t) > 2000 then '{\"truncated\":true' else t end as answer, length(t) > 2000 as truncated from (select doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:40], chr(10)) as t from documents)")
def budget_truncate(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, tools.MAX_LINES), "\n").alias("answer"))
    out = tools.fit_budget(docs, "answer", tools.Limits(chars=2000))
    return out.select("doc_id", F.when(F.col("truncated"), F.substring("answer", 1, 17)).otherwise(F.col("answer")).alias("answer"), "truncated")


@query(
    """with h as (select source || '/' || doc_id as path, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || doc_id || ':file_summary')) as h from documents)
select path, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h"""
)
def uuid5_ids(spark, d):
    return files(spark, d).select("path", exprs.uuid5(F.concat("path", F.lit(":file_summary"))).alias("id"))


@query("select event_id, (props::json ->> 'k')::int as k, len(json_keys(props::json))::int as n from events")
def json_profile(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.size(F.json_object_keys("props")).alias("n"))


# ---------------------------------------------------------------- measures


def _case_hits(spark, d) -> DataFrame:
    top = fts.search(benchmark_queries(spark, d), _t(spark, d, "documents"), "doc_id", ["text"], 10)
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))
    return top.join(docs, "id").select(F.col("query_id").alias("case_id"), "rank", F.col("file_path").alias("symbol"), "file_path", "content")


_WORDS = "len(list_filter(regexp_split_to_array(TEXT, '\\s+'), lambda x: x <> ''))"
_MEASURED = f"""{_BM25}, hit as (select r.query_id, rank, d.text as content from r join documents d on d.doc_id = r.id where rank <= 10), m as (
  select b.item_id as case_id, min(case when contains(content, b.text) then rank end) as first, count(case when contains(content, b.text) and rank <= 5 then 1 end) as n5, count(case when contains(content, b.text) then 1 end) as n10, coalesce(sum({_WORDS.replace("TEXT", "content")}), 0)::bigint as read
  from benchmark b left join hit on hit.query_id = b.item_id group by 1), total as (select sum({_WORDS.replace("TEXT", "coalesce(text, '')")}) as n from documents)"""


def _measured(spark, d) -> DataFrame:
    wanted = _t(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.array("text").alias("expected"))
    total = files(spark, d).agg(F.sum(exprs.token_count(F.col("content"))).alias("n")).first().n or 0
    return evals.case_metrics(wanted, _case_hits(spark, d), F.lit(total))


@query(_MEASURED + " select case_id, least(n5, 1)::double as recall_at_5, least(n10, 1)::double as recall_at_10, round(coalesce(1.0 / first, 0), 6)::double as mrr from m")
def eval_recall_mrr(spark, d):
    return _measured(spark, d).select("case_id", F.col("recall_at_5").cast("double").alias("recall_at_5"), F.col("recall_at_10").cast("double").alias("recall_at_10"), F.round("mrr", 6).alias("mrr"))


@query(_MEASURED + " select case_id, (case when first = 1 then 1 else 0 end)::double as hit_at_1, read as retrieved_tokens, round(case when read > 0 then n / read else 0 end, 6)::double as context_compression_ratio from m, total")
def eval_hit_compression(spark, d):
    return _measured(spark, d).select("case_id", "hit_at_1", "retrieved_tokens", F.round("context_compression_ratio", 6).alias("context_compression_ratio"))


@query(_MEASURED + ", l as (select m.*, length(text) > 200 as long from m join benchmark on item_id = case_id) select long, round(avg(least(n10, 1)), 6)::double as recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6)::double as mrr, count(*) as cases from l group by rollup(long)")
def eval_summary(spark, d):
    m = _measured(spark, d).join(_t(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (F.length("text") > 200).alias("long")), "case_id")
    return evals.summary(m, ["long"], ["recall_at_10", "mrr"]).select("long", F.round("recall_at_10", 6).alias("recall_at_10"), F.round("mrr", 6).alias("mrr"), "cases")


@query("""with a as (select o_custkey as case_id, 0 as leg, o_orderkey as ord, o_orderpriority as item from orders), b as (select c_custkey, 1, c_custkey, c_mktsegment from customer), u as (select * from a union all select * from b),
f as (select case_id, item, min(leg * 1000000000 + ord) as pos from u where item <> '' group by 1, 2), r as (select case_id, item, row_number() over (partition by case_id order by pos, item) as rank from f)
select c_custkey as case_id, coalesce(round(1.0 / min(rank), 6), 0)::double as mrr from customer left join r on case_id = c_custkey and (item like '%' || c_mktsegment or c_mktsegment like '%' || item) group by 1""")
def localisation_rank(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("item"))
    c = _t(spark, d, "customer")
    ranked = evals.ordered_unique([o, c.select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("item"))])
    return evals.reciprocal_rank(c.select(F.col("c_custkey").alias("case_id"), F.array("c_mktsegment").alias("want")), ranked, "want").select("case_id", F.round("mrr", 6).alias("mrr"))


@query("""with b as (select p_partkey, p_type as project, 'org.' || lower(p_type) || '.' || replace(p_name, ' ', '$') as cls, 'org.test.' || replace(p_name, ' ', '') || 'Test::test' || p_size as tst from part),
t as (select *, split_part(split_part(cls, '.', -1), '$', -1) as s, split_part(split_part(tst, '::', 1), '.', -1) as tc, split_part(tst, '::', 2) as tm from b)
select project || '_' || p_partkey || 'b' as bug_id, s || ' ' || tc || ' ' || tm as query, s as impact_symbol, 'src/main/java/' || replace(cls, '.', '/') || '.java' as expected_file from t""")
def case_builder(spark, d):
    name = F.col("p_name")
    bugs = _t(spark, d, "part").select(F.col("p_type").alias("project"), F.col("p_partkey").cast("string").alias("bug_id"), F.array(F.concat(F.lit("org."), F.lower("p_type"), F.lit("."), F.replace(name, F.lit(" "), F.lit("$")))).alias("modified_classes"),
        F.array(F.concat(F.lit("org.test."), F.replace(name, F.lit(" "), F.lit("")), F.lit("Test::test"), F.col("p_size").cast("string"))).alias("triggering_tests"))
    return cases.build(bugs).select("bug_id", "query", "impact_symbol", F.element_at("expected_files", 1).alias("expected_file"))
