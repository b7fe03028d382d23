"""Graph lookups over symbols and typed edges; every operator takes frames, so batches cost one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import like_contains
from ..sources.store import merged

NEIGHBOUR_KINDS = ("function", "async_function", "method", "constructor", "class")
#: Words of a question and the kind of edges that answers it; the first that fits counts.
ROUTES = (("metric|latency", "emits_metric"), ("log", "logs"), ("table|query|database", "queries_table"), ("config|timeout|retry", "reads_config"))


def ranked(df: DataFrame, by: list[str], order: list, limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within `by`; with a limit only the first ones (pruned before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


#: Letters that a needle must have in a row to be looked up by trigrams, and needles that are looked for by a loop at once.
GRAM, LOOPED = 3, 10_000


def _grams(text: Column) -> Column:
    """The runs of GRAM characters of a text, letters folded."""
    t = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda k: F.substring(t, k, F.lit(GRAM))))


def few(rows: DataFrame) -> bool:
    """Whether there are so few rows that every task may hold them."""
    return rows.limit(LOOPED + 1).count() <= LOOPED


def find_symbols(queries: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rank and the symbol's columns: equal names first, then by qualified name and file.

    A query that holds no wildcard is matched as a substring; % and _ in it are wildcards.  Equal names come from an
    equi-join.  A needle of GRAM characters or more without wildcards meets the names that hold its rarest run of GRAM
    characters, and is verified there; others (short, with wildcards, or with letters that fold to several) meet all names.
    """
    q = F.col("query")
    asked = queries.select("query_id", F.col("text").alias("query")).where("query is not null")
    texts = asked.select("query").distinct()
    names = symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("held")).where("held is not null").distinct()
    plain = (F.length("query") >= GRAM) & q.rlike(r"^[\x20-\x7e]+$") & ~q.rlike(r"[%_\\]")
    grams = names.where(F.length("held") >= GRAM).select("held", F.explode(_grams(F.col("held"))).alias("gram"))
    wanted = texts.where(plain).select("query", F.explode(_grams(q)).alias("gram"))
    often = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("query", "g.gram")
    by_gram = grams.join(rarest, "gram").where(like_contains(F.col("held"), q)).select("query", "held")
    odd = texts.where(~plain)
    odd = F.broadcast(odd) if few(odd) else odd
    by_loop = names.join(odd, like_contains(F.col("held"), q) | (F.col("held") == q)).select("query", "held")
    equal = names.join(texts, F.col("held") == q).select("query", "held")
    holds = by_gram.unionByName(by_loop).unionByName(equal).distinct()
    by_name = holds.join(merged(symbols.withColumn("held", F.col("name"))), "held")
    by_qualified = holds.join(merged(symbols.withColumn("held", F.col("qualified_name"))), "held").where(~F.col("name").eqNullSafe(F.col("held")))
    both = by_name.unionByName(by_qualified).drop("held").dropDuplicates()
    exact = (F.col("name") == q) | (F.col("qualified_name") == q)
    columns = symbols.columns
    found = both.join(asked, "query").withColumn("inexact", F.when(exact, 0).otherwise(1))
    return ranked(found, ["query_id"], ["inexact", "qualified_name", "file_path"], limit).select("query_id", "rank", *columns)


def edges_of(ids: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """edges that touch the ids (id, and whatever goes along), best first; an edge from an id to itself stands once."""
    src, dst = F.col("src_symbol_id"), F.col("dst_symbol_id")
    ends = {"in": dst, "out": src, "both": F.explode(F.array_distinct(F.array(src, dst)))}  # edges are read once for both ends
    if direction not in ends:
        raise ValueError(f"unknown direction: {direction}")
    out = edges.withColumn("__end", ends[direction]).join(F.broadcast(ids) if few(ids) else merged(ids), F.col("__end") == F.col("id"))
    return ranked(out.select(*ids.columns, *edges.columns), ["id"], [F.desc("confidence"), "edge_type", "src_symbol_id", "dst_symbol_id", "file_path"])


def edges_by_type(edges: DataFrame, edge_type: str | Column, limit: int | None = None) -> DataFrame:
    out = edges.where(F.col("edge_type") == edge_type).orderBy(F.desc("confidence"), "src_symbol_id", "dst_symbol_id", "file_path")
    return out if limit is None else out.limit(limit)


def explain(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The best symbol of each query with its edges in both directions; symbols without edges have nulls."""
    best = _cut(find_symbols(queries, symbols, 1).drop("rank").withColumnRenamed("file_path", "symbol_file"))
    found = edges_of(best.select("id").distinct(), edges)
    return best.join(found, "id", "left")


def usages(queries: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Incoming edges of up to `most` symbols that match a query, in the order of symbols and then of edges."""
    matched = _cut(find_symbols(queries, symbols, most).select("query_id", F.col("rank").alias("symbol_rank"), "id"))
    found = edges_of(matched.select("id").distinct(), edges, "in").withColumnRenamed("rank", "edge_rank")
    out = matched.join(found, "id")
    return ranked(out, ["query_id"], ["symbol_rank", "edge_rank"])


def related(queries: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, the best symbol (symbol), related (the other ends of its first edges, in order) and these edges (edges)."""
    best = _cut(find_symbols(queries, symbols, 1).drop("rank").select("query_id", "id", F.struct(*symbols.columns).alias("symbol")))
    found = edges_of(best.select("id").distinct(), edges).where(F.col("rank") <= limit)
    other = F.when(F.col("src_symbol_id") != F.col("id"), F.col("src_symbol_id")).otherwise(F.col("dst_symbol_id"))
    by = found.withColumn("other", other).groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("related"), F.array_sort(F.collect_list(F.struct("rank", *edges.columns))).alias("edges"))
    none = F.array().cast("array<string>")
    return best.join(by, "id", "left").select("query_id", "symbol", F.coalesce("related", none).alias("related"), F.coalesce("edges", F.array().cast(by.schema["edges"].dataType)).alias("edges"))


def with_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with what is known of both ends."""
    s = symbols.select(F.col("id").alias("src_symbol_id"), F.col("qualified_name").alias("src_symbol"), F.col("kind").alias("src_kind"), F.col("file_path").alias("src_file_path"), F.col("start_line").alias("src_start_line"), F.col("end_line").alias("src_end_line"))
    d = symbols.select(F.col("id").alias("dst_symbol_id"), F.col("qualified_name").alias("dst_symbol"))
    return edges.join(merged(s), "src_symbol_id", "left").join(merged(d), "dst_symbol_id", "left")


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session has a folder for it, to keep the plan of a loop short."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def reverse_bfs(roots: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(impacted, edges) of a breadth-first walk against the edges from each root (root, id = root).

    impacted: root, id, level of what was reached, roots excepted; edges: root, level and every edge met, those to
    vertices seen before included.
    """
    edges = _cut(edges) if depth > 1 else edges  # read at each level
    visited = frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    met = None
    for level in range(1, depth + 1):
        hit = frontier.select("root", F.col("id").alias("dst_symbol_id")).join(edges, "dst_symbol_id").withColumn("level", F.lit(level))
        met = hit if met is None else met.unionByName(hit)
        frontier = _cut(hit.select("root", F.col("src_symbol_id").alias("id")).distinct().join(visited, ["root", "id"], "left_anti").withColumn("level", F.lit(level)))
        visited = visited.unionByName(frontier)
        if level < depth and frontier.isEmpty():
            break
    return visited.where("level > 0"), met if met is not None else edges.where("false").withColumns({"root": F.lit(None).cast("string"), "level": F.lit(0)})


def calls_walk(roots: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 10) -> DataFrame:
    """root, ord, level and edge: walks `calls` edges backwards, the first `limit` of each vertex, and keeps `limit` in all.

    The order is level, place of the vertex in its level, place of the edge; a vertex has the place of its first meeting.
    """
    calls = ranked(edges.where("edge_type = 'calls'"), ["dst_symbol_id"], [F.desc("confidence"), F.asc_nulls_first("line_start"), "src_symbol_id", "file_path"], limit, "edge_rank")
    calls = _cut(calls) if depth > 1 else calls  # read at each level
    visited = frontier = roots.select(F.col("id").alias("root"), "id", F.lit(1).cast("long").alias("place"))
    met = None
    for level in range(1, depth + 1):
        hit = frontier.select("root", "place", F.col("id").alias("dst_symbol_id")).join(calls, "dst_symbol_id").withColumn("level", F.lit(level))
        met = hit if met is None else met.unionByName(hit)
        new = hit.groupBy("root", F.col("src_symbol_id").alias("id")).agg(F.min(F.struct("place", "edge_rank")).alias("at")).join(visited, ["root", "id"], "left_anti")
        frontier = _cut(ranked(new, ["root"], ["at"], None, "n").select("root", "id", F.col("n").cast("long").alias("place")))
        visited = visited.unionByName(frontier)
        if level < depth and frontier.isEmpty():
            break
    return ranked(met, ["root"], ["level", "place", "edge_rank"], limit, "ord").drop("place", "edge_rank")


def same_file_neighbours(roots: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """root, rank, id ... of the callables and classes nearest by line in the file of each root.

    Symbols of a file are numbered once by line.  The nearest of a place (file, line) are among the last ones before it
    and the first ones from it on, so each place meets 2 x limit symbols, by their numbers, and not its whole file.
    """
    r = roots.select(F.col("id").alias("root"), "file_path", F.col("start_line").alias("line"))
    callables = symbols.where(F.col("kind").isin(*NEIGHBOUR_KINDS) & F.col("file_path").isNotNull())
    w = Window.partitionBy("file_path")
    # of one line the smaller id is nearer from both sides, so symbols before a place are numbered with ids falling
    numbers = F.array(F.struct(F.lit(0).alias("side"), F.row_number().over(w.orderBy("start_line", F.desc("id"))).alias("no")), F.struct(F.lit(1).alias("side"), F.row_number().over(w.orderBy("start_line", "id")).alias("no")))
    numbered = callables.withColumn("n", numbers).withColumn("n", F.explode("n")).select("*", "n.side", "n.no").drop("n")
    at = callables.groupBy("file_path", F.col("start_line").alias("line")).agg(F.count("*").alias("n")).unionByName(r.select("file_path", "line", F.lit(0).cast("long").alias("n")).distinct())
    at = at.groupBy("file_path", "line").agg(F.sum("n").alias("n"))
    before = (F.sum("n").over(w.orderBy("line")) - F.col("n")).cast("int")
    places = at.withColumn("before", before).join(merged(r.select("file_path", "line").distinct()), ["file_path", "line"], "left_semi")
    span = lambda side, first, last: F.transform(F.sequence(first, last), lambda k: F.struct(F.lit(side).alias("side"), k.alias("no")))
    asked = places.withColumn("n", F.explode(F.concat(span(0, F.col("before") - limit, F.col("before")), span(1, F.col("before") + 1, F.col("before") + limit + 1)))).select("file_path", "line", "n.side", "n.no")
    near = numbered.join(merged(asked), ["file_path", "side", "no"]).drop("side", "no")
    order = [F.abs(F.col("start_line") - F.col("line")), "start_line", "id"]
    near = ranked(near, ["file_path", "line"], order, limit + 1)  # one of them may be the root
    found = near.drop("rank").join(merged(r), ["file_path", "line"]).where("id != root")
    return ranked(found, ["root"], order, limit).drop("line")


def architecture_route(question: Column) -> Column:
    """The kind of edges that a question asks for; null if none."""
    q = F.lower(question)
    out = F.when(q.rlike(ROUTES[0][0]), ROUTES[0][1])
    for words, kind in ROUTES[1:]:
        out = out.when(q.rlike(words), kind)
    return out


def architecture_search(queries: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, rank and edge: the best edges of the kind that each question asks for."""
    asked = queries.select("query_id", architecture_route(F.col("text")).alias("edge_type")).where("edge_type is not null")
    # every kind is ranked once, however many questions ask for it
    best = ranked(edges, ["edge_type"], [F.desc("confidence"), "src_symbol_id", "dst_symbol_id", "file_path"], limit)
    return asked.join(best, "edge_type")
