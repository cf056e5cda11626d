import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pixelplan.llm import decontaminate
from pixelplan.llm.text import utf8, word_hashes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else "")
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for window, own in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def corpus():
    r = random.Random(11)
    vocabulary = ["The", "of", "straße", "x1", "tion", "ñu", "and", "a", "42", "erst"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n)) + r.choice([".", "!\n", ""])
    items = [(k, text(r.randint(1, 40))) for k in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "erst"), (94, "of the ñu"), (None, "x1 42"), (95, text(13)), (95, text(14))]
    texts = [None, "", "---", "erst", "OF THE ñu", "x1-42"]
    for _ in range(150):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + r.randint(10, 16)]).upper() if r.random() < 0.3 else " ".join(w[a:]), text(r.randint(0, 60))]
        texts.append(" ".join(parts))
    return [*texts, "and " * 60000 + items[0][1]], items


@pytest.mark.parametrize("most_bits", [27, 10])
def test_equals_brute_force(spark, most_bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(most_bits, 16))
    monkeypatch.setattr(decontaminate, "MOST_BITS", most_bits)  # few bits let many places through to the join
    texts, items = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[9]])], "doc_id long, text string, h1 int").repartition(3)
    bench = spark.createDataFrame([(k, t, "q") for k, t in items], "item_id long, text string, words string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.find_contamination(docs, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    want = brute(texts, items)
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == want[9]
    assert sum(w[4] for w in want) > 30


def test_no_items_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tuple(decontaminate.find_contamination(docs, bench.limit(0)).first())[:4] == (1, 3, 0, 0)
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_clean_rows_stay_as_they_are(spark):
    texts, items = corpus()
    rows = [(None if i % 4 else 7, t, i, "x") for i, t in enumerate([*texts, texts[9], "clean words only"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 int, row string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    want = [i for i, w in enumerate(brute([t for _, t, *_ in rows], items)) if not w[4]]
    assert sorted(r.h1 for r in kept.collect()) == want
    assert all(rows[r.h1] == tuple(r) for r in kept.collect())
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_each_window_is_filed_under_its_rarest_shingle(spark):
    words, first = word_hashes(*utf8(pa.array(["a b c d e f g h i j k l m", "x y"])))
    window, place, size, hashes = decontaminate.window_shingles(words, first)
    assert size.tolist() == [2] + [3] * 11 and sorted(place[window == 0].tolist()) == [*range(11)]
    held = spark.createDataFrame([(int(w), 0, int(p), int(z), int(h)) for w, p, z, h in zip(window, place, size, hashes.view(np.int64), strict=True)], "w1 long, w2 long, place int, size int, shingle long")
    own = hashes.view(np.int64)[window == 0][np.argsort(place[window == 0])]
    frequency = spark.createDataFrame([(int(h), 1 if k == 4 else 5) for k, h in enumerate(own)], "shingle long, n long")
    assert [(r.w1, r.place, r.shingle) for r in decontaminate.rarest(held, frequency).collect()] == [(0, 4, int(own[4]))]


def test_bitmap(spark):
    r = np.random.default_rng(1)
    members, others = (r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(3) for n in (3000, 100000))
    found = decontaminate.bitmap(spark.createDataFrame([(int(x),) for x in members.view(np.int64)], "shingle long"), "shingle").value
    assert found.find(members).tolist() == [*range(3000)] and len(found.find(others)) < 100
    assert len(found.bits) <= 1 << decontaminate.MOST_BITS - 3
