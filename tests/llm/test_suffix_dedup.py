import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pixelplan.llm import suffix_dedup


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + width] for raw in raws for i in range(len(raw) - width + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "ofé", "straße", "and", "mañana", "x", "tionly", "erst"]
    passages = [" ".join(r.choices(words, k=r.randint(5, 90))) for _ in range(12)]
    texts = [None, "", "short", "a" * 700, "a" * 260, "ab" * 300]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else "".join(r.choices("abcdefgh ü", k=r.randint(1, 300))))
        texts.append("\n".join(parts))
    base = "".join(r.choices("abcdefgh ü", k=3000))
    for _ in range(25):  # near copies
        at = r.randrange(2900)
        texts.append(base[:at] + r.choice("XYZ") * r.randint(0, 3) + base[at + r.randint(0, 3) :])
    return [*texts, texts[10], texts[10]]


@pytest.mark.parametrize(("group", "seed"), [(2000, 1), (3, 2)])
def test_equals_brute_force(spark, group, seed):
    texts = corpus(seed)
    rows = [(i if i else None, t, "kept?") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, group=group)).collect()}
    want = brute(texts, 200)
    assert len(got) == len(texts)
    assert [got[i if i else None] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 10000


def test_rows_that_share_ids(spark):
    texts = corpus(3)
    texts = [*texts, *[texts[40]] * 30, *[texts[41] + "!"] * 30, "tail of its own " * 3]
    names = ("h1", "h2", "spans", "rest", "text", "_h", "_id", "on", "c0", "kept")
    rows = [(None if i % 3 else 7, *["v"] * 4, t, *["v"] * 5, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names).replace("h1 string", "doc_id long, h1 string", 1) + ", n int").repartition(3)
    found = suffix_dedup.remove_repeats(docs)
    assert found.columns == [c for c in docs.columns if c != "kept"] + ["kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.n: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)
    assert {r.n: r.text for r in found.collect()} == dict(enumerate(texts))


def test_long_row_in_pieces(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choices("abcd", k=6000)).encode()
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 900)
    found = suffix_dedup.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    covered = sorted(p for lo, hi in zip(found["lo"], found["hi"], strict=True) for p in range(lo, hi + 1))
    assert covered == list(range(len(text) - 199))
    monkeypatch.undo()
    whole = suffix_dedup.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert {*found["anchor"]} == {*whole["anchor"]}


def test_no_rows_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(empty)).count() == 0
    twice = spark.createDataFrame([(1, "z9" * 100 + "q")] * 2, "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()] == [201, 201]
