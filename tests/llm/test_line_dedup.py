import hashlib
import random

import pytest

from pixelplan.llm import line_dedup


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def plain(rows, at_least, first_stays=False):
    """For each (id, text): its lines, those dropped and the digest of the rest."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    holders, first = {}, {}
    for d in docs:
        for j, line in enumerate(d[1].split("\n")):
            holders.setdefault(key(line), set()).add(d)
            first.setdefault(key(line), (d, j))
    out = {}
    for d in docs:
        lines = d[1].split("\n")
        stay = [x for j, x in enumerate(lines) if not key(x) or len(holders[key(x)]) < at_least or (first_stays and first[key(x)] == (d, j))]
        out[d] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def some(seed, n):
    r = random.Random(seed)
    common = ["Subscribe", " subscribe\t", "ÄRGER", "ärger", "", "  ", "Cookies &c.", "x" * 3000]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.4 else f"line {r.randint(0, 80)}" if r.random() < 0.7 else f"own {i} {r.random()}" for _ in range(r.choice([0, 1, 5, 30]))]
        rows.append((i, r.choice([None, "", "\n".join(lines), "\n".join(lines) + "\n", "\n" * 5])))
    return rows


def got(spark, rows, at_least, first_stays=False, parts=8):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, at_least=at_least, first_stays=first_stays))
        return sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in found.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("at_least", [1, 2, 10])
@pytest.mark.parametrize("first_stays", [False, True])
def test_equals_plain(spark, at_least, first_stays):
    rows = some(at_least, 150)
    assert got(spark, rows, at_least, first_stays) == plain(rows, at_least, first_stays)


@pytest.mark.parametrize("first_stays", [False, True])
def test_one_line_in_all_documents_over_many_partitions(spark, monkeypatch, first_stays):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = [(i, "Same\nsame\n" + ("twice\n" * 3 if i < 12 else "") + f"own {i}") for i in range(400)]
        for at_least in (10, 12, 13, 400, 401):
            assert got(spark, rows, at_least, first_stays, 37) == plain(rows, at_least, first_stays)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, "a\nb"), (None, "a\nc"), (1, "a"), (1, "a"), (1, "a\nx"), (2, None)]
    assert got(spark, rows, 4) == plain(rows, 4)
    assert got(spark, [], 10) == []


def test_other_columns_and_bitmaps(spark):
    rows = [(f"d{i}", "menu\nown %d" % i, i, "x") for i in range(12)]
    docs = spark.createDataFrame(rows, "key string, body string, id int, doc string")
    bitmaps = line_dedup.keep_bitmaps(docs, "key", "body").collect()
    assert len(bitmaps) == 12 and all(line_dedup.kept_lines(b.keep, 2).tolist() == [False, True] for b in bitmaps)
    kept = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, "key", "body"), "key", "body")
    assert {(x.key, x.kept) for x in kept.collect()} == {(f"d{i}", f"own {i}") for i in range(12)}
