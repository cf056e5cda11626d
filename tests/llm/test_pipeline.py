import random

import pytest
import sentencepiece

import corpus_pipeline

SEEDS = {"en": ["the", "and", "tion", "er", "on", "wh", "es"], "de": ["der", "und", "schö", "keit", "ein", "ä", "be"], "fr": ["que", "eau", "les", "é", "oi", "ment"]}


def prose(r, lang, n):
    return " ".join("".join(r.choices(SEEDS[lang], k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(8)
    rows = [(i, prose(r, lang := r.choice(list(SEEDS)), r.randint(60, 150)), lang, f"s{i % 3}") for i in range(150)]
    texts = {i: t for i, t, *_ in rows}
    items = [(k, prose(r, "en", 40)) for k in range(3)]
    passage = prose(r, "en", 60)
    edited = texts[3].split()
    edited[7] = "zz"
    rows += [
        (1000, None, "en", "s"), (1001, "123 %", "en", "s"), (1002, "", None, "s"),
        (1003, texts[3], "en", "s"), (1004, " ".join(edited), "en", "s"), (1004, " ".join(edited), "en", "s"),
        (1005, items[0][1] + " " + prose(r, "en", 30), "en", "s"), (1006, prose(r, "en", 2000) + " " + items[1][1], "en", "s"),
        (1007, prose(r, "en", 90) + " " + passage + " " + prose(r, "en", 90), "en", "s"), (1008, prose(r, "en", 120) + " " + passage, "en", "s"),
        (None, prose(r, "de", 70), "de", "s"),
    ]
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, passage


def test_each_stage_takes_effect(spark, sf_dir):
    place, rows, passage = sf_dir
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept = [None, *sorted({i for i, *_ in rows if i is not None})]
    gone = [{1000, 1001, 1002}, {1003, 1004}, set(), {1005}]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:4], gone, strict=True):
        docs = stage(spark, docs, place)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = [i for i in kept if i not in out]
        got = [r.doc_id for r in docs.collect()]
        assert {*got} == {*kept}, name
    assert len(got) == len(kept)
    texts = {r.doc_id: r for r in docs.collect()}
    whole = {i: t for i, t, *_ in rows}
    assert passage not in texts[1007].text and passage not in texts[1008].text
    assert len(texts[1007].text) <= len(whole[1007]) - len(passage) and texts[1007].n_chars == len(texts[1007].text)
    assert all(texts[i].text == whole[i] for i in kept if i not in (1007, 1008))


def test_result(spark, sf_dir):
    place, rows, _ = sf_dir
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, place).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    whole = {i: t for i, t, *_ in rows}
    assert len(got) == 150 + 4 and all(r.agrees in (True, None) for r in got.values())
    assert all(got[i].n_tokens == len(library.encode(whole[i])) + 1 for i in (0, 3, 77, 1006))


def test_repeated_ids_and_further_columns(spark, tmp_path):
    r = random.Random(12)
    t = [prose(r, "en", 80) for _ in range(6)]
    rows = [(5, t[0]), (5, t[1]), (3, t[1]), (9, t[2]), (9, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (7, None), (8, "")] + [(100 + i, prose(r, "de", 60)) for i in range(20)]
    place = str(tmp_path)
    docs = spark.createDataFrame([(*x, "en", "s", 1, "h", 2, "r") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, h1 string, spans int, row string")
    docs.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    left = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, place)
        assert left.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(((x.doc_id, x.text) for x in left.collect() if (x.doc_id or 0) < 100), key=str)
    assert got == sorted([(5, t[0]), (3, t[1]), (9, t[2]), (None, t[3]), (None, t[4])], key=str)
    assert corpus_pipeline.run(spark, place).count() == len(got) + 20


def test_no_rows(spark, tmp_path):
    place = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, place).count() == 0
    assert corpus_pipeline.run(spark, place).count() == 0


def test_all_stages_in_a_chain_equal_plain_versions(spark):
    """The smallest given tables: near copies, repeats, contamination and ids by plain loops, after the language stage's own choice."""
    import hashlib
    from collections import Counter

    from tests.llm.test_decontaminate import brute as contaminated
    from tests.llm.test_minhash import brute as classes

    place = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{place}/documents.parquet")
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, docs, place).collect())
    assert len(left) > 100
    left = [row for row, (first, _) in zip(left, classes(left), strict=True) if row[0] == first]
    raws = [t.encode() for _, t in left]
    seen = Counter(raw[i : i + 200] for raw in raws for i in range(len(raw) - 199))
    cut = []
    for (doc, text), raw in zip(left, raws, strict=True):
        gone = {k for i in range(len(raw) - 199) if seen[raw[i : i + 200]] > 1 for k in range(i, i + 200)}
        kept = bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
        if not gone or kept.strip():
            cut.append((doc, kept if gone else text))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
    clean = [row for row, found in zip(cut, contaminated([t for _, t in cut], items), strict=True) if not found[4]]
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for doc, text in clean:
        ids = library.encode(text, add_eos=True)
        want[doc] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = corpus_pipeline.run(spark, place).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_null_texts_and_a_benchmark_without_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(1, None), (2, None), (3, ""), *((10 + i, prose(r, "en", 80)) for i in range(12))]
    spark.createDataFrame([(*x, "en", None, None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {10 + i for i in range(12)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 15
