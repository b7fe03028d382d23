"""The pipeline against a brute-force version of its stages on a small corpus."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import prose


def corpus():
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(60, 160))) for k in range(60)]
    toxic = {k for k in range(0, 60, 6)}
    rows = [(k, t + (" you idiot, worthless moron and scum" if k in toxic else "")) for k, t in rows]
    rows += [(100 + k, rows[k + 1][1]) for k in range(4)]  # copies
    rows += [(110 + k, rows[k + 13][1] + " end") for k in range(4)]  # near copies
    passage = prose(rng, 60)
    rows += [(120 + k, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40)) for k in range(5)]
    item = prose(rng, 30)
    rows += [(130, prose(rng, 20) + "\n" + item + "\n" + prose(rng, 20)), (131, None), (132, "")]
    return rows, toxic, [(1, item), (2, prose(rng, 30))]


def cut_repeats(rows):
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    out = []
    for i, t in raw.items():
        end, kept = 0, bytearray()
        for k in range(len(t)):
            if k + 200 <= len(t) and count[t[k : k + 200]] > 1:
                end = k + 200
            if k >= end:
                kept.append(t[k])
        out.append((i, kept.decode("utf-8", "ignore")))
    return out


def by_hand(rows, toxic, items):
    rows = [(i, t) for i, t in rows if i not in toxic]
    sets = {i: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))} for i, t in rows}
    gone = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = cut_repeats([(i, t) for i, t in rows if i not in gone])
    flat = lambda t: " ".join(t.lower().split())
    rows = [(i, t) for i, t in rows if not any(flat(x) in flat(t) for _, x in items)]
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: ref.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, toxic, items = corpus()
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == by_hand(rows, toxic, items)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, _, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        given = docs.where("false") if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns and (out.count() == 0) == empty
