"""op7, op8, op2, op4, op1: each against the library, a brute-force version or held-out rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symlake.llm import bpe, decontaminate, licences, quality, toxicity
from symlake.llm.common import crc_held_out

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_bpe_equals_the_library(docs, documents):
    ref = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id, r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect())
    want = []
    for i, t in documents:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        text = ref.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_round_trip(docs, documents):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH).withColumn("text", __import__("pyspark").sql.functions.lit(1)), PATH).collect()}
    assert back == {i: t or "" for i, t in documents}


def test_bpe_strange_strings(vocabulary):
    ref, rng = Tokenizer.from_file(PATH), random.Random(2)
    e = bpe.Encoder(vocabulary, bpe.Transducer.build({}))
    alphabet = "ab \t\n\r\x0b\x0c\x1c\x85\xa0　'sé日1٣!?<|endoftext|>́\U0001f600​\x00"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        s += "<|endoftext|>" + s if rng.random() < 0.2 else ""
        ids, raw = e.encode([s])[0]
        assert bpe.ids_of(ids) == ref.encode(s, add_special_tokens=False).ids, repr(s)
        assert raw == s.encode()


def test_long_words_merge_alike(vocabulary):
    rng = random.Random(0)
    for _ in range(200):
        w = bytes(rng.choice(b"theationed \xc3\xa9ing") for _ in range(rng.randint(1, 150)))
        assert vocabulary.merge(w) == vocabulary._merge_long([vocabulary.byte_ids[x] for x in w])


def test_unknown_words_are_merged_at_once(vocabulary, monkeypatch):
    rng = random.Random(8)
    words = [w.encode() for w in ("".join(rng.choice("aeinrst é’字") for _ in range(rng.randint(1, 40))) for _ in range(3000))] + [b"a", b"aaaa", bytes(range(256))]
    assert vocabulary.merge_all(words) == [vocabulary.merge(w) for w in words] and vocabulary.merge_all([]) == []
    text = " ".join("".join(rng.choice("aeinrst") for _ in range(9)) for _ in range(500))
    monkeypatch.setattr(vocabulary, "merge", lambda word: pytest.fail("a short word was merged on its own"))
    ids, _ = bpe.Encoder(vocabulary, bpe.Transducer.build({})).encode([text])[0]
    assert bpe.ids_of(ids) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_words_are_cut_as_by_the_pattern():
    whole, rng = bpe.regex.compile(bpe.SPLIT), random.Random(9)
    every = [chr(x) for x in range(0x30000) if not 0xD800 <= x < 0xE000]
    texts = [f"a{x} {x}{x}1  {x}\n" for x in every]
    texts += ["".join(rng.choice(" \n\t'stmdrevl\x1c\x85\xa0aé٣²½Ⅷ一😀_-!\u3000\ud7fb\ue000") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    assert [t for t in texts if bpe.cut(t) != whole.findall(t)] == []


def test_transducer_is_minimal_and_reads_back(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tops", "top", "stops", "stop", "tap", "taps", ""])}
    t = bpe.Transducer.build(words)
    t.save(str(tmp_path / "a"))
    t = bpe.Transducer.open(str(tmp_path / "a"))
    assert len(t.final) == 7  # suffixes are shared
    found = t.find([*words, b"tip", b"stopsx", b"st"])
    assert [t.outputs(k) for k in found[:7]] == list(words.values()) and found[7:].tolist() == [-1, -1, -1]


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        data = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": data["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": data["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary(json.dumps(data | change))


def test_licences_base_places(docs, documents):
    got = sorted(tuple(r)[:6] for r in licences.scan(docs).collect())
    base, want = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}, []
    for i, t in documents:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, v) for p, v in base.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at}))))
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_licences_repeated_in_one_text(spark):
    """Every notice of a text is reported, not only the best of its template."""
    notice, other = "Released under the MIT License.", "word " * 60
    texts = spark.createDataFrame([(1, f"{notice} {other}{notice} {other}{notice}"), (2, notice + " " + notice)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan(texts).collect()}
    assert [(s.label, s.first, s.last) for s in rows[1].spans] == [("mit", 0, 4), ("mit", 65, 69), ("mit", 130, 134)]
    assert [(s.label, s.first, s.last) for s in rows[2].spans] == [("mit", 0, 4), ("mit", 5, 9)]


def _best_cover(words, template):
    """Words of a template that its best chain of matches covers, by trying all maximal common runs."""
    n, m = len(words), len(template)
    runs = []
    for i in range(n):
        for j in range(m):
            if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                k = 0
                while i + k < n and j + k < m and words[i + k] == template[j + k]:
                    k += 1
                if k >= licences.MIN_MATCH:
                    runs.append((i, j, k))
    best: dict = {}
    for i, j, k in sorted(runs):
        before = [best[r] for r in best if 0 <= i - r[0] - r[2] <= licences.MAX_GAP and 0 <= j - r[1] - r[2] <= licences.MAX_GAP]
        best[i, j, k] = k + max(before, default=0)
    return max(best.values(), default=0)


def test_licences_labels_against_brute_force():
    """Whole licences with words changed, left out or put in; labels and scores as by trying all chains."""
    rng, scanner = random.Random(9), licences.Scanner()
    whole = {t: licences.words_of(text.encode()) for t, (_, text) in enumerate(licences.TEMPLATES)}
    for _ in range(60):
        words = list(whole[rng.randrange(len(whole))])
        for _ in range(rng.choice((0, 1, 3, 10))):
            k = rng.randrange(len(words) or 1)
            words[k : k + rng.randint(0, 2)] = [b"xx"] * rng.randint(0, 2)
        words = [b"before"] * rng.randint(0, 5) + words + [b"after"] * rng.randint(0, 5)
        got = scanner.scan(b" ".join(words))
        cover = {t: _best_cover(words, w) / len(w) for t, w in whole.items()}
        want = {licences.TEMPLATES[t][0] for t, c in cover.items() if c >= licences.MIN_COVER}
        assert want <= set(got["labels"].split(",")) | set(got["base_labels"].split(",")) | {""}
        assert set(got["labels"].split(",")) - {""} == want | (set(got["base_labels"].split(",")) - {""})
        assert got["score"] == (1.0 if got["n_base"] else max(cover.values()))


def test_licences_whole_texts(spark):
    rows = [(k, text.upper()) for k, (_, text) in enumerate(licences.TEMPLATES)] + [(100, (licences.TEMPLATES[-10][1] + "\n") * 300)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == 1.0 for k, (label, _) in enumerate(licences.TEMPLATES))
    assert sum(s.label == "mit" and s.covered == 1.0 for s in got[100].spans) >= 300


def test_licences_labels_and_spans(docs):
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert (rows[406].labels, rows[406].score) == ("mit", 1.0)
    assert rows[407].labels == "cc-by,cc-by-nc,reserved"
    assert [(s.label, s.first, s.last) for s in rows[406].spans] == [("mit", 0, 4)]
    assert rows[1].labels == "" and 0 <= rows[1].score < licences.MIN_COVER


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        query = [rng.randrange(5) for _ in range(20)]
        known = {tuple(t[a:z]) for t in texts for a in range(len(t)) for z in range(a + 1, len(t) + 1)}
        longest = [max((n for n in range(1, 21 - k) if tuple(query[k : k + n]) in known), default=0) for k in range(20)]
        want = [(k, n) for k, n in enumerate(longest) if n >= 2 and not (k and longest[k - 1] == n + 1)]
        assert licences.SuffixAutomaton(texts).maximal_matches(query, 2) == want


def test_myers_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 40))) for a in (1, 0))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.myers(p, t) == (min(row), row.index(min(row)))


def test_decontamination_within_budget(spark, docs, documents):
    rng = random.Random(6)
    text = dict(documents)
    item = text[300][:200]
    edited = list(item)
    for k in rng.sample(range(200), len(item) // decontaminate.EDIT_EVERY // 2):
        edited[k] = "#"
    items = spark.createDataFrame([(1, item), (2, "".join(edited)), (3, None), (4, ""), (5, "the"), (6, "nothing like this stands in any of the documents at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, items).collect()}
    assert got[300, 1] == 0 and 0 < got[300, 2] <= len(item) // 16
    assert {i for i, _ in got} == {300}
    kept = [r.doc_id for r in decontaminate.clean(docs, items).collect()]
    assert sorted(kept) == sorted(i for i, _ in documents if i != 300)
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_decontamination_finds_items_by_text(spark):
    """Items without an id, items that share an id, and short ones that are whole lines; repeated rows of items count once."""
    a, b = "amber stone is older than the river valley", "the quartz grove haven lies beyond every hill"
    docs = spark.createDataFrame([(1, f"so {a} then"), (2, f"or {b} now"), (3, "Yes it is.\n  Amber   Stone \nend"), (4, "the amber stone is"), (None, a), (6, "y" * 100_000 + a)], "doc_id long, text string")
    items = spark.createDataFrame([(None, a, 1), (7, a, 2), (7, b, 3), (7, b, 3), (8, "amber stone", 4), (9, "y", 5)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(docs, items).collect()), key=str)
    want = [(1, None, 0), (1, 7, 0), (2, 7, 0), (3, 8, 0), (None, None, 0), (None, 7, 0), (6, None, 0), (6, 7, 0)]
    assert got == sorted(want, key=str)
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [4]


def test_decontamination_against_every_distance(spark):
    """Every item against every place of every text, by dynamic programming."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    items = [(k, letters(rng.randint(24, 60))) for k in range(12)]
    docs = []
    for k in range(60):
        t = list(items[rng.randrange(12)][1])
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(t))
            t[p : p + rng.randint(0, 1)] = rng.choice(("", "x", "a"))
        docs.append((k, letters(rng.randint(0, 20)) + "".join(t) + letters(rng.randint(0, 20))))
    want = set()
    for d, t in docs:
        for i, x in items:
            p, line = decontaminate.normal(x), decontaminate.normal(t)
            row = [0] * (len(line) + 1)
            for n, c in enumerate(p):
                new = [n + 1]
                for j, e in enumerate(line):
                    new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
                row = new
            if len(p) >= decontaminate.MIN_ITEM and min(row) <= len(p) // decontaminate.EDIT_EVERY:
                want.add((d, i, min(row), row.index(min(row))))
    got = {(r.doc_id, r.item_id, r.distance, r.place_end) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(want) > 10


def test_decontamination_of_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.leaks(empty, none).count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_fuzzy_trie_against_edit_distance():
    rng, terms = random.Random(7), [toxicity.Term("idiot", 4.0), toxicity.Term("worthless", 4.0), toxicity.Term("scum", 3.0), toxicity.Term("lowei", 2.0, True)]
    trie = toxicity.FuzzyTrie(terms)
    words = ["idiot", "idi0t", "idot", "idiiot", "worthles", "wrthlss", "worthlesss", "scum", "scun", "loweiung", "low", "loweiidiot", "xidiot"]
    words += ["".join(rng.choice("idotwrhlesu") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for w in words:
        fits = [(0, -t.weight) for t in terms if t.begins and w.startswith(t.text)] + [(edits(w, t.text), -t.weight) for t in terms if not t.begins and edits(w, t.text) <= t.edits]
        found = trie.match(w)
        assert (found is None) == (not fits), w
        if found:
            assert (found[1], -terms[found[0]].weight) == min(fits), w


def test_context_tells_quotation_from_abuse():
    s = toxicity.Scorer([toxicity.Term("idiot", 4.0)])
    abuse, quoted, none = s.batch(["you are an idiot", 'the report said "what an idiot" they wrote', None])
    assert abuse[0][3] > 1 > quoted[0][3] and none == []


def test_quotation_marks_open_and_close():
    s = toxicity.Scorer([toxicity.Term("idiot", 4.0)])
    context = lambda t: s.batch([t])[0][0][3]
    assert context("you idiot") == context("i don’t care you idiot it’s over") == context('he wrote "hi" then: you idiot "bye"') == 1.25
    assert all(context(t) < 1 for t in ("“an idiot” i heard", "«idiot»", "„idiot“", "they shouted ‘don’t be an idiot’ again", "> you idiot", "he said you idiot"))
    assert context('an "idiot\nand "so on') == 1.0
    assert toxicity.quotations('a "b" c “d „e” f” «g') == [(2, 4), (8, 16)]


def test_a_text_longer_than_what_is_held_at_once(monkeypatch):
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 50)
    s = toxicity.Scorer([toxicity.Term("idiot", 4.0)])
    text = "a word and " * 40 + "idiot " + "b " * 100 + "idiot"
    assert "".join(toxicity.parts_of(text)) == text and len(s.batch([text, None, "idiot"])[0]) == 2 and len(s.batch(["x", "idiot"])[1]) == 1


def test_the_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 3)
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", 4.0)])
    assert [trie.match(w) for w in ("idiot", "idoit", "idiiot", "stone", "idiot")] == [(0, 0), None, (0, 1), None, (0, 0)] and len(trie.sets) < 60


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of which some are abusive (words, misspelled words, a stem with endings) and some are shouted junk."""
    from .conftest import prose

    rng, rows = random.Random(8), []
    for k in range(600):
        toxic, junk = k % 5 == 0, k % 4 == 0
        words = prose(rng, rng.randint(30, 120)).split(" ")
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "worthlesss", "grubbel" + rng.choice(["en", "ig", "ung", "t"])]))
        text = " ".join(words)
        rows.append((k, text.upper().replace(" ", "!! ") if junk else text, int(toxic), int(not junk)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic", "quality")


def held_accuracy(out, labels, name):
    y = {r.doc_id: r[name] for r in labels.collect()}
    rows = [r for r in out.collect() if r.held_out]
    assert rows and all(r.held_out == crc_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == y[r.doc_id] for r in rows])


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    assert held_accuracy(toxicity.score(docs, labels), labels, "toxic") > 0.97


def test_toxicity_scores_against_a_plain_version(labelled):
    """The query's scores from the fitted model, with every word compared with every term by edit distance."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.score, r.n_hits) for r in toxicity.score(docs, labels).collect()}
    fuzzy = toxicity.Scorer(model.terms)

    def best(w):
        fits = [(0, -t.weight, n) for n, t in enumerate(model.terms) if t.begins and w.startswith(t.text)]
        fits += [(d, -t.weight, n) for n, t in enumerate(model.terms) if not t.begins and abs(len(t.text) - len(w)) <= t.edits and (d := edits(w, t.text)) <= t.edits]
        return (min(fits)[2], min(fits)[0]) if fits else None

    for r in docs.where("doc_id < 60").collect():
        low = r.text.lower()
        known = {w: m for w in set(toxicity.WORD.findall(low)) if (m := best(w))}
        found = fuzzy._windows(low, known)
        x = np.array([fuzzy.features(found)])
        assert got[r.doc_id][1] == len(found) and abs(got[r.doc_id][0] - float(model.probability(x)[0])) < 1e-12


def test_quality_against_a_direct_solution(labelled):
    """The partition-summed equations give the ridge solution of all labelled rows at once."""
    from pyspark.sql import functions as F

    docs, labels = labelled
    y = {r.doc_id: r.quality for r in labels.collect() if not crc_held_out(r.doc_id)}
    rows = [(quality.statistics(r.text.encode()), y[r.doc_id]) for r in docs.collect() if r.doc_id in y]
    x = np.array([r[0] for r in rows], np.float32).astype(float)
    frame = quality.document_statistics(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").where(~quality.held_out())
    model = quality.fit(frame.select("x", "y").repartition(5))
    t = np.array([r[1] for r in rows], float)
    z = model.features(x)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6, atol=1e-5)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(t) / quality.FEATURES * np.eye(z.shape[1]), z.T @ t)
    assert np.allclose(model.raw(x), z @ beta, atol=1e-6)
    raw = z @ beta
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    some = np.unique(at)
    level = quality.isotonic(np.array([(at == b).sum() for b in some], float), np.array([t[at == b].sum() for b in some]))
    assert np.allclose(model.levels, level, atol=1e-9)


def test_quality_of_a_repeated_id(spark, labelled):
    """Which text of a labelled id is learnt from does not depend on the order of rows."""
    docs, labels = labelled
    twice = docs.unionByName(docs.where("doc_id % 7 = 1").selectExpr("doc_id", "upper(text) as text"))
    one, two = ({(r.doc_id, r.score) for r in quality.score(twice.repartition(n), labels).collect()} for n in (1, 6))
    assert {(i, round(s, 9)) for i, s in one} == {(i, round(s, 9)) for i, s in two}


def test_quality_held_out(labelled):
    docs, labels = labelled
    assert held_accuracy(quality.score(docs, labels), labels, "quality") > 0.97


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_edge_cases(operator, docs, documents, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(k, 1, 1) for k in range(20)] + [(None, 1, 0)], "doc_id long, toxic int, quality int")
    for labels in (none, one):
        rows = operator.score(docs, labels).collect()
        assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents) and all(0 <= r.score <= 1 for r in rows)
        assert operator.score(empty, labels).count() == 0


def test_accepted_keeps_columns(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.accepted(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_isotonic_is_monotone_and_keeps_the_sum():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 9, 200).astype(float)
    t = np.minimum(c, rng.integers(0, 9, 200))
    y = quality.isotonic(c, t)
    assert (np.diff(y) >= 0).all() and np.isclose((y * c).sum(), t.sum())


def test_empty_tables(empty):
    assert bpe.encode(empty, PATH).count() == 0
    assert licences.scan(empty).count() == 0
