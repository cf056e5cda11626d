import random
import re

import numpy as np
import pyarrow as pa

from pixelplan.llm import text


def texts():
    r = random.Random(2)
    alphabet = "abZ09é日😀 .,-\n\t\x7f{}@`"
    return [None, "", " ", "a", "é", *("".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(300)), "word " * 5000]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words_are_those_of_the_pattern():
    column = pa.array(texts())
    low, start, end, first = text.word_spans(*text.utf8(column))
    raw = low.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)] for x, y in zip(first, first[1:], strict=False)]
    assert got == [words(t) for t in texts()]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    column = pa.array(texts())
    hashes, first = text.word_hashes(*text.utf8(column))
    seen = {}
    for own, a, b in zip((words(t) for t in texts()), first, first[1:], strict=False):
        for w, h in zip(own, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len({*seen.values()}) == len(seen)
    monkeypatch.setattr(text, "SLICE_BYTES", 50)  # long rows in parts
    again, same = text.word_hashes(*text.utf8(column))
    assert (again == hashes).all() and (same == first).all()


def test_slices_keep_rows_and_bounds():
    batch = pa.RecordBatch.from_arrays([pa.array(texts()), pa.array(range(len(texts())))], ["t", "k"])
    parts = list(text.slices(iter([batch, batch.slice(0, 0)]), "t", 100))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(len(texts())))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["t"].to_pylist()) <= 100 for p in parts)


def test_sliced_and_large_columns():
    column = pa.array(["ab", None, "cde", "é"])
    for c in (column, column.cast(pa.large_string()), pa.chunked_array([column])):
        data, rows = text.utf8(c[1:])
        assert data.tobytes() == "cdeé".encode() and rows.tolist() == [0, 0, 3, 5]


def test_ranges():
    which, numbers = text.expand(np.array([5, 0, 9]), np.array([2, 0, 3]))
    assert which.tolist() == [0, 0, 2, 2, 2] and numbers.tolist() == [5, 6, 9, 10, 11]
