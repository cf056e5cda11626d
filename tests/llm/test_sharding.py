import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelplan.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4097])
def test_permutation(n):
    got = sharding.permute(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n >= 1000:
        assert (got == np.arange(n)).mean() < 0.02
        assert [*sharding.permute(np.array([n - 1, 5]), n)] == [got[-1], got[5]]


def test_shards(spark):
    rows = [(i if i % 50 else None, ("té" * (i % 7)) if i % 11 else None, "s") for i in range(1003)] + [(7, "hot", "s")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = sharding.digest(sharding.assign_shards(docs.repartition(7))).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = sharding.digest(sharding.assign_shards(docs.repartition(3))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))  # however the rows are stored


def test_no_rows_and_one(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.assign_shards(docs).collect()] == [(0, 0)]


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_permute(x, n, key, rounds):
    """One number through the rounds, again and again until it lands below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    while True:
        left, right = x >> half, x % 2**half
        for k in range(1, rounds + 1):
            left, right = right, left ^ plain_mix((right + plain_mix((k * 0x9E3779B97F4A7C15 + key) % 2**64)) % 2**64) % 2**half
        x = left << half | right
        if x < n:
            return x


def test_permutation_equals_the_plain_rounds():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        got = sharding.permute(np.arange(n), n, 77, 5).tolist()
        assert got == [plain_permute(x, n, 77, 5) for x in range(n)] and sorted(got) == list(range(n))


def test_result_equals_brute_force(spark):
    texts = [None, "", "a", "é" * 3, *(f"text {k % 9}" for k in range(40))]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    facts = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    want = []
    for number, (known, i, crc, size) in enumerate(facts):
        place = plain_permute(number, len(rows), sharding.KEY, sharding.ROUNDS)
        want.append((i if known else None, size, crc, place % 24, place // 24))
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.digest(sharding.assign_shards(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
