import random

import pytest

WORDS = "the of and to in is that for with as was it be by on are from this have not amber basil cedar delta ember flint grove haven ivory jetty knoll lemon maple north ocean pearl quartz river stone tulip umber velvet willow xenon yarrow zephyr".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(".,\n") if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


@pytest.fixture(scope="session")
def documents():
    """Rows of doc_id, text: prose, copies, near copies, shared passages, licences, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(1, 300))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(8)]
    for k in range(10):
        words = rows[20 + k][1].split(" ")
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + k, " ".join(words)))
    passage = prose(rng, 70)
    rows += [(300 + k, prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 30)) for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "ab" * 400), (404, "É" * 150 + "x" + "É" * 150), (405, prose(rng, 6000)), (406, "Released under the MIT License."), (407, "Licensed under CC BY-NC 4.0. All rights reserved; all rights reserved!"), (408, "a\x00b<|endoftext|>c  d e")]
    return rows + rows[5:7] + [(400, None)]


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The same as a frame, with further columns whose names operators use within."""
    clash = ["key", "rid", "size", "shard", "slot", "score", "raw", "spans", "fp", "node", "rank", "n", "row", "hash", "x", "y"]
    wide = [(i, t, *[f"{c}{i}" for c in clash]) for i, t in documents]
    return spark.createDataFrame(wide, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
