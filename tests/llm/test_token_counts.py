import random

import numpy as np
import public_tokenizers
import pytest

from pixelplan.llm import token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(ids, end):
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out, n


@pytest.mark.parametrize("scanned", [1, 3, 256])
def test_blocks_are_stitched(spark, scanned, monkeypatch):
    monkeypatch.setattr(token_counts, "SCANNED", scanned)
    r = random.Random(1)
    rows, want = [], []
    for file in range(12):
        ids = r.choices([1, 2, 9], weights=[5, 5, [0, 0.2, 1, 9][file % 4]], k=r.randint(0, 90))
        blocks = [ids[k : k + 7] for k in range(0, len(ids), 7)]
        rows += [(file, b, np.array(x, "<u2").tobytes(), "n") for b, x in enumerate(blocks)]
        done, rest = brute(ids, 9)
        want += [(file, k, n) for k, n in enumerate([*done, *[rest] * (rest > 0)])]
    blocks = spark.createDataFrame([*rows, (99, 0, None, "n"), (99, 1, b"", "n")], "file int, block long, ids binary, name string").repartition(5)
    got = sorted((x.file, x.document, x.n_tokens) for x in token_counts.count_tokens(blocks, end=9).collect())
    assert got == want


def test_flat_files(spark, tmp_path):
    r = random.Random(2)
    want = []
    for name, width in (("a", 2), ("b", 2), ("c", 2)):
        ids = r.choices(range(20), k=r.randint(1, 500))
        np.array(ids, f"<u{width}").tofile(tmp_path / f"{name}.bin")
        done, rest = brute(ids, 3)
        want += [(name, k, n) for k, n in enumerate([*done, *[rest] * (rest > 0)])]
    (tmp_path / "d.bin").touch()
    got = token_counts.count_tokens(token_counts.read_blocks(spark, str(tmp_path), block=16), end=3)
    assert sorted((x.file[-5], x.document, x.n_tokens) for x in got.collect()) == want


def test_files_hold_ids_and_ends_only(spark, tmp_path):
    texts = ["a b", None, "c d e", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    place = f"file:{tmp_path}/tokens"
    (name,) = {(r.file, r.document, r.id) for r in token_counts.write_files(docs, RANKS, place).collect() if r.document == 3}
    with open(RANKS, "rb") as file:
        encoding = token_counts._encoding(file.read(), public_tokenizers.PATTERN)
    want = [x for t in texts for x in (*encoding.encode_ordinary(t or ""), token_counts.END)]
    assert name[2] == 3 and np.fromfile(f"{tmp_path}/tokens/{name[0]}", "<u2").tolist() == want


def test_documents(spark):
    texts = [None, "", "a b", "naïve\n\nline", "<|endoftext|> is text", "word " * 4000, "word " * 4000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, file int").repartition(2)
    with open(RANKS, "rb") as file:
        encoding = token_counts._encoding(file.read(), public_tokenizers.PATTERN)
    got = token_counts.digest(docs, RANKS, block=256)
    assert sorted(((x.doc_id, x.n_tokens) for x in got.collect()), key=str) == sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (None, "null id")]), key=str)
    assert token_counts.digest(docs.limit(0), RANKS).count() == 0
