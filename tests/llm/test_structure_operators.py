"""op3, op5, op9, op10, op6 and the pipeline's near-duplicate stage, against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from symlake.llm import chat, neardup, sharding, simhash, suffix, topk
from symlake.llm.common import Scratch


def removed_by_hand(documents):
    count = Counter(t[k : k + 200] for _, x in documents for t in [(x or "").encode()] for k in range(len(t) - 199))
    out = []
    for i, x in documents:
        t, end, cover = (x or "").encode(), 0, []
        for k in range(len(t)):
            if k + 200 <= len(t) and count[t[k : k + 200]] > 1:
                end = k + 200
            cover.append(k < end)
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(t), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, documents):
    assert sorted(map(tuple, suffix.removed(docs).collect())) == removed_by_hand(documents)


@pytest.mark.parametrize("hot", [0, 2])
def test_suffix_dedup_of_hot_anchors(docs, documents, hot, spark):
    scratch = Scratch(spark)
    plain = suffix.repeated_spans(docs.select("doc_id", "text"), scratch)
    split = suffix.repeated_spans(docs.select("doc_id", "text"), scratch, hot=hot)
    cover = lambda df: {(r.rid, k) for r in df.collect() for k in range(r.lo, r.hi + 1)}
    assert cover(plain) == cover(split)
    scratch.drop()


def test_suffix_dedup_of_a_very_common_passage(spark):
    """A passage in 20,000 texts: its groups of contexts are dealt out, and every byte that a repeated string covers goes."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(230)
    rows = [(k, letters(rng.randint(0, 40)) + passage + letters(rng.randint(0, 40))) for k in range(20_000)]
    got = sorted(map(tuple, suffix.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()))
    assert got == removed_by_hand(rows)


def test_suffix_dedup_keeps_rows_and_columns(docs, documents):
    out = suffix.deduplicated(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(documents) and rows[400].text is None and rows[404].text == "x" and rows[403].text == ""
    assert rows[300].text != dict(documents)[300] and rows[300].key == "key300"


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(500):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 60))], np.int64)
        assert suffix.suffix_array(s, 1, 10**9).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())


def test_anchors_cover_every_start():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abc ") for _ in range(suffix.BLOCK + 5000))
    starts = np.concatenate([np.arange(lo, hi + 1) for x in suffix.anchors(text) for lo, hi in zip(x[-2], x[-1], strict=True)])
    assert (np.sort(starts) == np.arange(len(text) - 199)).all()


def by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    names = sorted(set(fps.values()))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in fps.items()}


def test_simhash_groups(docs, documents):
    fps = {i: by_hand(t) for i, t in documents}
    comp = components_by_hand(fps)
    assert sorted(map(tuple, simhash.group(docs).collect())) == sorted((i, simhash._signed(fps[i]), comp[i]) for i, _ in documents)


def test_simhash_of_null_and_repeated_ids(spark, monkeypatch):
    """Fingerprints link whatever ids their rows have; ids only name the components."""
    table = {"a": 0, "b": 7, "c": 63, "d": (1 << 64) - 1, "e": 1, "f": (1 << 64) - 2}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs.selectExpr("doc_id", "fp"))
    rows = lambda *x: spark.createDataFrame([(i, simhash._signed(table[k])) for i, k in x], "doc_id long, fp long")
    chain = simhash.group(rows((1, "a"), (None, "b"), (2, "c"))).collect()
    assert {r.component_id for r in chain} == {1} and len(chain) == 3
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.group(rows((5, "a"), (5, "d"), (2, "e"), (9, "f"))).collect())
    assert got == sorted([(5, 0, 2), (2, 1, 2), (5, -1, 5), (9, -2, 5)])
    assert [r.component_id for r in simhash.group(rows((None, "a"))).collect()] == [None]


@pytest.mark.parametrize("large", [4, 512])
def test_simhash_links_of_planted_fingerprints(spark, large):
    """Balls of fingerprints around centres, chains, and strangers; also with buckets that are cut again."""
    rng, fps = random.Random(1), []
    for _ in range(4):
        c = rng.getrandbits(64)
        fps += [c] + [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(60)]
    x = rng.getrandbits(64)
    for k in range(0, 60, 3):
        x ^= 7 << k
        fps.append(x)
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(100)]))
    ids = dict(enumerate(fps))
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in ids.items()], "fp long, node long")
    scratch = Scratch(spark)
    pairs = simhash.links(nodes.select("fp"), scratch, 3, large).collect()
    number = {simhash._signed(f): i for i, f in ids.items()}
    edges = spark.createDataFrame([(number[r.a], number[r.b]) for r in pairs], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    assert {i: got.get(i, i) for i in ids} == components_by_hand(ids)
    scratch.drop()


def test_near_duplicates_against_all_pairs(docs, documents):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in documents}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = neardup.distinct_documents(docs)
    assert out.columns == docs.columns
    got = sorted(r.doc_id for r in out.collect())
    want = sorted({find(i) for i in sets})
    assert set(want) <= set(got) and len(got) - len(want) <= 1  # a pair is missed in one of twenty cases or less


def _random_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(words) // 10), edits):  # far enough apart that each changes five shingles
        out[10 * k + 5] = f"x{rng.randrange(10**9)}"
    return out


def test_near_duplicates_at_the_bound(spark):
    """Pairs of similarity 0.8 to 0.82, by appended text and by scattered edits; none may be missed."""
    rng, rows = random.Random(5), []
    for k in range(400):
        words = _random_words(rng, 200)
        other = words + _random_words(rng, 49) if k % 2 else _edited(rng, words, 4)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(kept - set(range(0, 800, 2))) == []
    assert len(kept) == 400


def _smallest_of_groups(rows):
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in sets}


def test_near_duplicates_within_loose_families(spark):
    """Buckets whose members are mostly less similar than the bound: the pairs above it must be found all the same."""
    rng, rows = random.Random(6), []
    base = _random_words(rng, 200)
    family = [_edited(rng, base, 5) for _ in range(300)]
    rows = [(k, " ".join(w)) for k, w in enumerate(family)]
    rows += [(1000 + k, " ".join(w[:98] + ["y"] + w[99:])) for k, w in enumerate(family[:40])]
    kept = {r.doc_id for r in neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(_smallest_of_groups(rows))


def test_near_duplicates_of_one_bucket(spark):
    """A hub that is compared first and fails must not hide the pair behind it."""
    rng, rows = random.Random(7), []
    for k in range(20):
        base = _random_words(rng, 200)
        near = _edited(rng, base, 6)
        rows += [(10 * k + j, " ".join(w)) for j, w in enumerate([*(_edited(rng, base, 6) for _ in range(7)), near, near[:98] + ["y"] + near[99:]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", neardup._rid())
    scratch = Scratch(spark)
    texts = scratch.write(docs.selectExpr("doc_id as node", "rid"))
    entries = texts.selectExpr("node div 10 as key", "node")
    got = {(r.node, r.root) for r in neardup._components(docs, entries, texts, scratch).collect()}
    assert got >= {(10 * k + 8, 10 * k + 7) for k in range(20)} and len(got) <= 40
    scratch.drop()


def test_sharding_is_the_heaps(docs, documents):
    rows = sharding.assign(docs).collect()
    groups = defaultdict(int)
    for _, t in documents:
        groups[t or ""] += len((t or "").encode()) + 8
    loads, heap = [0] * 24, [(0, k) for k in range(24)]
    for size in sorted(groups.values(), reverse=True):
        load, k = heap[0]
        loads[k] = load + size
        heapq.heapreplace(heap, (load + size, k))
    text, got, slots, where = dict(documents), Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        got[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[raw].add(r.shard)
    assert len(rows) == len(documents) and sorted(got[k] for k in range(24)) == sorted(loads)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in where.values())


def test_deal_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        loads = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        size, count = rng.randint(1, 9), rng.randint(0, 200)
        one, heap = [0] * len(loads), [(x, k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            one[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        mine = list(loads)
        got = sharding.deal(mine, size, count)
        assert sum(got) == count and sorted(mine) == sorted(x + size * n for x, n in zip(loads, one, strict=True))


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = {k: (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist() for k in range(400)}
    for k in range(100, 160):
        vecs[k] = vecs[100]  # equal vectors: ties go to the smaller id
    rows = [(k, v, "a") for k, v in vecs.items()] + [(500, None, "b"), (550, [1.0, None] + [0.0] * 6, "c"), (600, [float("nan")] + [0.0] * 7, "d"), (650, [float("inf")] + [0.0] * 7, "e"), (700, [0.0] * 8, "f"), (750, [1.0, 2.0], "g"), (None, [1.0] * 8, "h")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")
    ints = {k: np.floor(256 * np.array(v)).astype(np.int64) for k, v in [*vecs.items(), (700, [0.0] * 8)]}
    want = set()
    for q in [k for k in ints if k % 50 == 0]:
        best = sorted(((-int(ints[q] @ ints[k]), k) for k in ints if k != q))[:5]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(best)}
    for bucket in (64, 4096):
        assert set(map(tuple, topk.search(frame, 5, bucket=bucket, block=4).collect())) == want
        assert set(map(tuple, topk.search(frame, 5, bucket=bucket, block=4, first=20).collect())) == want
    assert topk.search(frame.where("false")).count() == 0


def test_topk_of_very_large_components(spark):
    """Components whose products are beyond doubles' whole numbers, or beyond a long, take part."""
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**40, 5.0]), (2, [1e300, 0.0]), (3, [-1e308, 1e308]), (4, [1.5, 2.0**-9])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, first=1, bucket=2).collect()}
    whole = lambda v: [int(np.clip(np.floor(256 * x), -1.7976931348623157e308, 1.7976931348623157e308)) for x in v]
    with np.errstate(over="ignore"):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(rows[0][1]), whole(v), strict=True)))), i) for i, v in rows[1:])
    assert [got[0, n + 1] for n in range(4)] == [(i, -s) for s, i in scores]


def test_topk_pruning_never_drops(spark):
    rng = np.random.default_rng(4)
    vecs = np.floor(256 * rng.normal(size=(300, 6))).astype(np.int64)
    b = topk.Bucket(vecs, [[k] for k in range(300)])
    for q in vecs[:40]:
        s = b.vecs @ q
        bound = float(np.sort(s)[-5])
        assert set(np.flatnonzero(s >= bound)) <= set(b.candidates(q, bound).tolist())


def test_chat_equals_its_sql(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are   YOU?\nFine."), (1, 2, "user", "Other topic"), (1, 3, "x", ">> how are you?\n> Fine.\nGood"), (1, 4, "user", None), (1, 5, None, "> Other topic\n\nyes\n> > nested"), (1, 5, None, "> Other topic\n\nyes\n> > nested")]
    rows += [(2, 0, "user", ">>> x\n"), (2, 1, "a", ""), (None, 0, "u", "> q"), (3, None, "u", "t"), (4, 0, "u", "a\nb\r\nc"), (4, 1, "v", "> a\n> b\nok"), (4, 2, "v", ">a\r\n>b\r\n> c\nok"), (4, 100, "v", "> ok"), (4, 200, "w", "> ok\n> zz")]
    rows += [(9, k, "u", f"> line {k * 7 % 50}\nm" if k % 3 == 0 else f"line {k % 50}") for k in range(500)]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(chat.ORACLE).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert any(r.n_replies for r in got)


def test_chat_links_partial_and_nested_quotes(spark):
    """Some lines of a message, a line that names the author, and quotations around deeper ones link too; control characters stay."""
    rows = [
        (1, 0, "a", "first line\nsecond line\nthird line"), (1, 1, "b", "> second line\n> third line\nyes"), (1, 2, "c", "> Ann wrote:\n> second line\nno"),
        (1, 3, "d", "> Ben wrote:\n>> second line\n> yes\nfine"), (1, 4, "e", "> unknown\n>> Ben wrote\n>>> third line\nok"), (1, 5, "f", "> not there at all\nhm"), (1, 6, "g", "x\x01y\x02z\x03w"), (1, 7, "h", "> x\x01y\x02z\x03w\nq"),
    ]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert sorted(got.replies.split(",")) == ["1>0", "2>0", "3>1", "4>0", "7>6"] and "x\x01y\x02z\x03w" in got.text and got.n_parts == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_with_many_quotes_equals_its_sql(spark, seed):
    """Generated conversations whose messages quote whole messages, parts and quotations, at several levels."""
    rng, rows = random.Random(seed), []
    for conv in range(40):
        said: list[str] = []
        for turn in range(rng.choice((1, 5, 30, 250))):
            lines = [" ".join(rng.choice(("amber", "Stone", "is", "old", "> x", "a > b")) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]
            quoted = []
            for _ in range(rng.choice((0, 0, 1, 2))):
                old = rng.choice(said).split("\n") if said else ["nothing"]
                a = rng.randrange(len(old))
                quoted += [rng.choice((">", "> ", " >")) + x for x in old[a : a + rng.randint(1, 5)]]
            said.append("\n".join(quoted + lines))
            rows.append((conv, turn + rng.randint(0, 1), rng.choice(("user", "assistant")), said[-1]))
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, con.sql(chat.ORACLE).fetchall()), key=key)
    assert sum(r.n_replies for r in got) > 300


def test_chat_strips_quotes_and_handles_nothing(spark):
    schema = "conv_id long, turn long, role string, text string, hash string, level string"
    long = "\n".join("> word" for _ in range(20_000)) + "\nown"
    out = chat.conversations(spark.createDataFrame([(1, 0, "u", "word", "", ""), (1, 1, "v", long, "", "")], schema)).collect()
    assert [(r.n_messages, r.text) for r in out] == [(2, "<|u|>\nword\n<|v|>\nown")]
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0


def test_empty_tables(empty):
    for out in (suffix.removed(empty), simhash.group(empty), sharding.assign(empty), neardup.distinct_documents(empty), suffix.deduplicated(empty)):
        assert out.count() == 0
