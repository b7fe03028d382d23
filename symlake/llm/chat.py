"""Chat formatting by quotation linking, in DataFrame functions only.

Lines have a quote level (the number of leading >); lines of one level that follow each
other are a run.  The quoted runs of a message, at every level, and each of their lines
are normalised, hashed and joined to earlier messages of the conversation that hold the
passage as a line, a run or a whole of their own text.  A message replies to the message
that its shallowest linking level quotes: by a whole run if one is found, or else by
lines, so that a quotation of some lines, with a line that names the author, or around
deeper quotations links as well; of several messages that fit, to the latest.  Messages
are ordered by the first message of their thread and then by turn, stripped of quotes,
and written as chat text in parts of PART messages.

Nothing joins message to message: originals are reduced to the passages that are quoted
at all, and the latest earlier one is found by a window in two levels (turns are cut
into ranges), so a long conversation or a common line isn't gathered in one task.

Defined results: null texts and roles count as empty; a message without text above its
quotes has an empty body; messages with the same conversation and turn all stay, in
order of role and body; a null conv_id is a conversation without links; n_parts says
how many rows a conversation has, part 0 being the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settled

PART, RANGE = 200, 64


def _level(line: Column) -> Column:
    """Quote level of a line: how many > stand before its text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), r"[ \t]", ""))


def _content(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*>)+", "")


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Two control characters mark runs; where a text holds them, they stand as a third one with a letter meanwhile.
_HIDE = (("\x03", "\x03c"), ("\x02", "\x03b"), ("\x01", "\x03a"))
_SHOW = tuple((b, a) for a, b in reversed(_HIDE))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, quoted (level, by_line, hash), own (hashes of the lines, runs and whole of the own text)."""
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(_level(x).alias("level"), _content(x).alias("text")))
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), lines.alias("lines"))
    # a run begins where the level changes; \x02 stands before it, and \x01 after its level.  Lines are zipped with
    # the lines before them: an index into the array within a lambda would compute the array anew for each line
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("text"))), F.slice("lines", 1, F.size("lines") - 1))
    mark = lambda x, p: F.when(x["level"] != p["level"], F.concat(F.lit("\x02"), x["level"].cast("string"), F.lit("\x01"))).otherwise(F.lit("\n"))
    joined = F.array_join(F.zip_with("lines", before, lambda x, p: F.concat(mark(x, p), _replaced(x["text"], _HIDE))), "")
    cut = F.transform(F.split(F.substring(joined, 2, 2147483647), "\x02"), lambda r: F.struct(F.substring_index(r, "\x01", 1).cast("int").alias("level"), _replaced(F.substring_index(r, "\x01", -1), _SHOW).alias("text")))
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    m = m.select("conv_id", "turn", "role", F.regexp_replace(body, r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("body"), _normalised("lines").alias("lines"), _normalised(cut).alias("runs"))
    passage = lambda by: lambda r: F.struct(r["level"].alias("level"), F.lit(by).alias("by_line"), F.xxhash64(r["text"]).alias("hash"))
    held = lambda c, deep: F.filter(c, lambda r: (r["level"] > 0 if deep else r["level"] == 0) & (r["text"] != ""))
    quoted = F.array_distinct(F.concat(F.transform(held("runs", True), passage(0)), F.transform(held("lines", True), passage(1))))
    whole = F.filter(F.array(_normal(F.col("body"))), lambda t: t != "")
    own = F.array_distinct(F.transform(F.concat(F.transform(held("lines", False), lambda r: r["text"]), F.transform(held("runs", False), lambda r: r["text"]), whole), lambda t: F.xxhash64(t)))
    return m.select("conv_id", "turn", "role", "body", quoted.alias("quoted"), own.alias("own"))


def _normalised(pieces: Column | str) -> Column:
    return F.transform(pieces, lambda r: F.struct(r["level"].alias("level"), _normal(r["text"]).alias("text")))


def links(m: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to of parsed messages that quote an earlier message of their conversation."""
    passages = m.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    originals = m.select("conv_id", "turn", F.explode("own").alias("hash"))
    originals = originals.join(passages.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    # the latest original before each quotation: within its range of turns, or else the last of the ranges before
    none = lambda kind: F.lit(None).cast(kind)
    both = originals.withColumns({"level": none("int"), "by_line": none("int")}).unionByName(passages).withColumn("range", F.floor(F.col("turn") / RANGE))
    earlier = Window.partitionBy("conv_id", "hash", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)).where("level is not null")
    last = originals.groupBy("conv_id", "hash", F.floor(F.col("turn") / RANGE).alias("range")).agg(F.max("turn").alias("last"))
    spans = last.unionByName(near.select("conv_id", "hash", "range", none("long").alias("last"))).groupBy("conv_id", "hash", "range").agg(F.max("last").alias("last"))
    far = spans.select("conv_id", "hash", "range", F.max("last").over(Window.partitionBy("conv_id", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    found = near.join(far, ["conv_id", "hash", "range"], "left").withColumn("to", F.coalesce("near", "far")).where("to is not null")
    return found.groupBy("conv_id", "turn").agg((-F.min(F.struct("level", "by_line", (-F.col("to")).alias("to")))["to"]).alias("reply_to"))


def threads(found: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, reply_to, root: the first message of the thread, by doubling steps along the links."""
    now = scratch.write(found.withColumn("root", F.col("reply_to")))
    while True:
        step = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("beyond"))
        nxt = scratch.write(now.join(step, ["conv_id", "root"], "left").select("conv_id", "turn", "reply_to", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, part, n_parts, n_messages, n_replies, replies, text: conversations without quotes in reply order."""
    spark = messages.sparkSession
    scratch = Scratch(spark)
    m = scratch.write(parsed(messages))
    root = threads(links(m), scratch)
    m = m.select("conv_id", "turn", "role", "body").join(root, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    cell = F.floor(F.col("root") / RANGE)
    m = m.withColumn("cell", cell)
    counts = m.groupBy("conv_id", "cell").agg(F.count("*").alias("n"))
    by_conv = Window.partitionBy("conv_id")
    all_ = F.sum("n").over(by_conv)
    before = counts.select(F.col("conv_id").alias("c"), F.col("cell").alias("k"), (F.sum("n").over(by_conv.orderBy("cell")) - F.col("n")).alias("before"), F.ceil(all_ / PART).cast("long").alias("n_parts"))
    order = Window.partitionBy("conv_id", "cell").orderBy("root", "turn", "role", "body")
    placed = m.withColumn("place", F.row_number().over(order)).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("cell").eqNullSafe(F.col("k")))
    placed = placed.withColumn("place", F.col("before") + F.col("place") - 1)
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / PART).cast("long").alias("part")).agg(F.first("n_parts").alias("n_parts"), F.array_sort(F.collect_list(F.struct("place", "role", "body", "turn", "reply_to"))).alias("all"))
    written = F.array_join(F.transform("all", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["body"])), "\n")
    linked = F.filter("all", lambda x: x["reply_to"].isNotNull())
    replies = F.array_join(F.transform(linked, lambda x: F.concat_ws(">", x["turn"].cast("string"), x["reply_to"].cast("string"))), ",")
    out = settled(spark, parts.select("conv_id", "part", "n_parts", F.size("all").cast("long").alias("n_messages"), F.size(linked).cast("long").alias("n_replies"), replies.alias("replies"), written.alias("text")))
    scratch.drop()
    return out


#: The same in DuckDB; recursion follows the links.
ORACLE = r"""
with recursive m as (
  select row_number() over () id, conv_id, turn, coalesce(role, '') as role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) ls from conversations
), l as (
  select id, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)*)', 1), '[ \t]', '', 'g')) lv, regexp_replace(x, '^(?:[ \t]*>)+', '') t
  from (select id, conv_id, turn, unnest(ls) x, unnest(range(len(ls))) i from m)
), g as (
  select *, sum(b) over (partition by id order by i) r from (select *, case when lag(lv) over (partition by id order by i) = lv then 0 else 1 end b from l)
), runs as (
  select id, any_value(conv_id) conv_id, any_value(turn) turn, any_value(lv) lv, string_agg(t, chr(10) order by i) t from g group by id, r
), bodies as (
  select id, regexp_replace(string_agg(t, chr(10) order by i), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') body from l where lv = 0 group by id
), n as (
  select conv_id, turn, lv, by_line, lower(trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g'))) t from (
    select conv_id, turn, lv, 0 by_line, t from runs union all select conv_id, turn, lv, 1, t from l union all select conv_id, turn, 0, 2, body from bodies join m using (id))
), p as (
  select distinct conv_id, turn, lv, by_line, t from n where lv > 0 and t <> ''
), o as (
  select distinct conv_id, turn, t from n where lv = 0 and t <> ''
), link as (
  select conv_id, turn, reply_to from (
    select p.conv_id, p.turn, o.turn reply_to, row_number() over (partition by p.conv_id, p.turn order by lv, by_line, o.turn desc) k from p join o on p.conv_id = o.conv_id and p.t = o.t and o.turn < p.turn) where k = 1
), walk as (
  select conv_id, turn, reply_to as upto from link union all select w.conv_id, w.turn, k.reply_to from walk w join link k on w.conv_id = k.conv_id and w.upto = k.turn
), root as (
  select conv_id, turn, min(upto) root from walk group by 1, 2
), placed as (
  select m.conv_id, m.turn, m.role, coalesce(body, '') body, reply_to, row_number() over (partition by m.conv_id order by coalesce(root, m.turn) nulls first, m.turn nulls first, m.role, coalesce(body, '')) - 1 place, count(*) over (partition by m.conv_id) as n
  from m left join bodies using (id) left join link k on k.conv_id = m.conv_id and k.turn = m.turn left join root r on r.conv_id = m.conv_id and r.turn = m.turn
)
select conv_id, place // 200 as part, ((any_value(n) + 199) // 200)::bigint as n_parts, count(*) n_messages, count(reply_to) n_replies,
  coalesce(string_agg(case when reply_to is not null then turn::varchar || '>' || reply_to::varchar end, ',' order by place), '') replies,
  string_agg('<|' || role || '|>' || chr(10) || body, chr(10) order by place) as text
from placed group by 1, 2
"""
