import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pixelplan.llm import minhash
from pixelplan.llm.text import utf8, word_hashes


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """class of each row by exact similarities of all pairs"""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if None not in (a[1], b[1]) and (a[1] == b[1] or similarity(bags[i], bags[j]) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (name, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(name)
    return [(min((x for x in ids[find(i)] if x is not None), default=None), len(ids[find(i)])) for i in range(len(rows))]


def corpus():
    r = random.Random(3)
    words = [a + b for a in ("the", "er", "ion", "Str", "ñu") for b in ("s", "a", "on", "le", "", "ße", "ka")]
    passage = r.choices(words, k=60)
    rows = [None, "", "one", "one", "One two", "###", " ".join(["same"] * 50), " ".join(["same"] * 55), " ".join(["same"] * 80)]
    base = r.choices(words, k=150)
    for k in range(70):  # a chain and a star of edits around one text, some of them too far from each other
        copy = list(base)
        for _ in range(r.randint(0, 4) + k % 4):
            copy[r.randrange(150)] = "edit%d" % r.randrange(1000)
        rows.append(" ".join(copy))
    for _ in range(40):  # a common passage alone makes no near copy
        rows.append(" ".join(passage + r.choices(words, k=r.randint(18, 60))))
    for _ in range(30):
        rows.append(" ".join(r.choices(words, k=r.randint(1, 80))))
    return [(i, t) for i, t in enumerate(rows)] + [(3, "one"), (None, "one"), (3, "two words"), (None, "other words"), (None, None), (None, None), (12, " ".join(base)), (12, "lone text under a used id")]


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = r.integers(0, 9, 400), r.integers(0, 9, 400)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = wa > 0, wb > 0
    slots = 4096
    both = minhash.signatures(np.repeat([0, 1], [a.sum(), b.sum()]), np.concatenate([h[a], h[b]]), np.concatenate([wa[a], wb[b]]), 2, slots)
    assert abs((both[0] == both[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / slots)
    alone = minhash.signatures(np.zeros(a.sum(), int), h[a], wa[a], 1, slots)
    assert (alone[0] == both[0]).all()


def test_bags_count_copies():
    row, hashes, count = minhash.multisets(*word_hashes(*utf8(pa.array(["a b c d e a b c d e", None, "A, b c d e!"]))))
    assert row.tolist() == [0] * 5 + [2] and sorted(count.tolist()) == [1, 1, 1, 1, 1, 2]
    assert hashes[5] in hashes[:5]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, class_id string, n int").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in minhash.find_classes(docs).collect())
    assert got == Counter((r[0], *c) for r, c in zip(rows, brute(rows), strict=True))


def test_one_row_of_each_class_stays(spark):
    rows = corpus() + [(5, "t1 alone"), (5, "t2 shared"), (3, "t2 shared"), (9, "t3"), (9, "t3"), (None, "n1"), (None, "n1"), (None, "n2")]
    docs = spark.createDataFrame([(t, i, "h", k) for k, (i, t) in enumerate(rows)], "text string, doc_id long, h1 string, row int").repartition(4)
    kept = minhash.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(rows[r.row] == (r.doc_id, r.text) for r in got)
    root = brute(rows)
    names = {}  # the classes, by what find_classes says of a text
    for (i, t), (c, n) in zip(rows, root, strict=True):
        if t is not None:
            names.setdefault(t, (c, n))
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)
    known = [r for r in got if r.text is not None]
    assert all(r.doc_id == names[r.text][0] for r in known)
    assert len(known) == len({*_classes_of(rows)})


def _classes_of(rows):
    """The classes of texts that are not null, each as its set of rows."""
    root, bags = list(range(len(rows))), [bag(t) for _, t in rows]
    find = lambda i: i if root[i] == i else find(root[i])
    known = [i for i, (_, t) in enumerate(rows) if t is not None]
    for i in known:
        for j in known:
            if j < i and (rows[i][1] == rows[j][1] or similarity(bags[i], bags[j]) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in known}


def test_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 2, 3), (2, "a b c d e f", 2, 3)], "doc_id long, text string, own int, row int")
    assert [tuple(r) for r in minhash.drop_copies(docs).collect()] == [(1, "a b c d e f", 2, 3)]
    assert minhash.drop_copies(docs.limit(0)).count() == 0


def test_no_rows(spark):
    assert minhash.find_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x.node: x.root for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
