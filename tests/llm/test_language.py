import random
import unicodedata
import zlib

import numpy as np
import pytest

from pixelplan.llm import language

SEEDS = {"xx": ["the", "and", "tion", "er", "on", "wh"], "yy": ["der", "und", "schö", "keit", "ein", "ä"], "zz": ["que", "ción", "los", "ñ", "ar", "ie"]}


def sentence(r, name):
    return " ".join("".join(r.choices(SEEDS[name], k=r.randint(1, 3))) for _ in range(r.randint(8, 60)))


def rows():
    r = random.Random(1)
    out = []
    for i in range(600):
        name = r.choice(list(SEEDS))
        out.append((i, sentence(r, name), name if i % 9 else None, "s"))
    special = [None, "", "123 !!", "é", "xyzzy " * 30000, "the and " * 20000]
    return out + [(1000 + k, t, "yy" if k % 2 else None, "s") for k, t in enumerate(special)] + [(None, "der und ein", "yy", "s"), (1, out[1][1], out[1][2], "s")]


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    truth = {i: (t, name) for i, t, name, _ in data}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tested = [i for i in range(600) if got[i].held_out and truth[i][1]]
    assert len(tested) > 80 and np.mean([got[i].lang_pred == truth[i][1] for i in tested]) > 0.99
    assert not any(got[i].rejected for i in range(600))
    assert [got[1000 + k].lang_pred for k in range(3)] == ["und"] * 3 and all(got[1000 + k].score == 0 and got[1000 + k].rejected for k in range(3))
    assert got[1003].lang_pred in SEEDS and got[1004].rejected and got[1005].lang_pred in SEEDS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.digest(docs).collect()] == [("und", 0.0)]
    assert language.digest(docs.limit(0)).count() == 0


def plain_counts(text):
    """Buckets of all n-grams of the text with one blank for each run of other characters."""
    out = np.zeros(language.BUCKETS, np.int64)
    flat = " ".join(["", *"".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(), ""])
    for n in language.GRAMS:
        for i in range(len(flat) - n + 1):
            code = n
            for c in flat[i : i + n]:
                code = (code * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out[int(language.mix(np.array([code], np.uint64))[0] >> np.uint64(40)) % language.BUCKETS] += 1
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 9, 1 << 18])
def test_counts_of_parts_are_those_of_the_whole(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    r = random.Random(3)
    for text in ["Abc 1 dé\n" * 5, "a", "..a", "a..", " 12 ab", "ΑΣ ΣΑ ΑΣ", "12345678 x", *("".join(r.choices("aB é1.Σ", k=r.randint(1, 40))) for _ in range(40))]:
        got = language.gram_counts(text)
        if any(unicodedata.category(c)[0] == "L" for c in text):
            assert (got == plain_counts(text)).all(), text
        else:
            assert got is None
    assert language.gram_counts("  12") is None and language.gram_counts("") is None


def test_predictions_equal_brute_force(spark):
    data = [x for x in rows() if x[0] is not None and x[0] < 60]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string").repartition(2)
    model = language.fit(docs.where(~language.held_out()))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, t, *_ in data:
        v = np.log1p(plain_counts(t)) * model.idf
        likeness = model.centroids @ (v / np.sqrt((v**2).sum()))
        best = int(np.argmax(likeness))
        assert got[i].lang_pred == model.labels[model.owner[best]] and abs(got[i].score - likeness[best]) < 1e-4
