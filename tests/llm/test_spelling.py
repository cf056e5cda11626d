import random
import re
import zlib
from collections import Counter

import pytest

from pixelplan.llm import spelling


def counted(rows, letters=7, occurrences=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= occurrences}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n, ratio=10):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, nears = {}, {}
    for w in n:
        own = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(size, []) if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        nears[w], form[w] = len(own), best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], nears[w], n[form[w]] if form[w] is not None else None)
    return out


def got(spark, n, **settings):
    found = spelling.group_variants(spark.createDataFrame([*n.items()], "word string, n long"), **settings).collect()
    assert len({x.word for x in found}) == len(found)
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in found}


@pytest.mark.parametrize(("block", "few"), [(4096, 8), (5, 2)])
def test_equals_all_pairs(spark, block, few):
    r = random.Random(block)
    n = {"".join(r.choices("abé", k=r.choice([0, 1, 2, 3, 5, 6, 7, 8]))): 10 ** r.randint(0, 4) for _ in range(700)}
    n |= {x: r.randint(1, 500) for w in ("bookkeeping", "aaaaaaaaaaaa", "x" * 3000) for x in (w, w[:-1], w[1:], w + "s", "s" + w, w[:5] + "q" + w[6:], w[:5] + w[4:])}
    assert got(spark, n, block=block, few=few) == plain(n)


def test_first_difference_decides():
    r = random.Random(1)
    for _ in range(4000):
        a, b = sorted(("".join(r.choices("ab", k=r.randint(0, 6))) for _ in "ab"), key=len)
        if a != b and len(b) - len(a) < 2:
            assert sum(spelling.near(a, b, d, d + 1) for d in range(len(a) + 1) if a[:d] == b[:d]) == near(a, b)


def test_words_of_texts(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcÀÿ×EF", k=r.randint(4, 12))) for _ in range(40)]
    rows = [(i if i else None, r.choice([None, "", " ".join(r.choices(vocabulary, k=300)) + "ab1cdefghij_", "Wörterbuch wörterbuch"])) for i in range(60)]
    rows += [(5, "Wiederholung wiederholung WIEDERHOLUNG")] * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    assert {x.word: x.n for x in spelling.count_words(docs).collect()} == counted(rows)
    found = spelling.group_variants(spelling.count_words(docs))
    assert {x.word: tuple(x[1:]) for x in found.collect()} == plain(counted(rows))


def test_chain_of_forms_ties_and_no_words(spark):
    n = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefgx": 10, "abcdefx": 9}
    assert got(spark, n) == plain(n)
    assert got(spark, {}) == {}
