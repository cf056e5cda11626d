import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelplan.llm import sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return sentencepiece_bpe.Vocabulary(file.read())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab cdE.,\n▁'é😀0123  (){}", max_size=200)))
def test_equals_library(text):
    with open(PATH, "rb") as file:
        v = _once(file)
    ids = v.library.encode(text, out_type=int, add_eos=True)
    flat, offsets, read = v.both([text, "", text])
    assert read == [v.library.decode(ids), "", v.library.decode(ids)]
    assert flat.tolist() == [*ids, v.end, *ids] and offsets.tolist() == [0, len(ids), len(ids) + 1, 2 * len(ids) + 1]
    words = v.words.findall(v.prefix + text.replace(" ", sentencepiece_bpe.SPACE)) if text else []
    assert [k for w in words for k in v.merge(w)] == ids[:-1]
    assert v.decode(ids) == v.library.decode(ids)


_kept = []


def _once(file):
    if not _kept:
        _kept.append(sentencepiece_bpe.Vocabulary(file.read()))
    return _kept[0]


def test_words_are_forgotten(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "WORDS_KEPT", 10)
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(500))
    for t in (text, text[:90], text, "x" * 20000):
        assert vocabulary.encode([t])[0].tolist() == vocabulary.library.encode(t, out_type=int, add_eos=True)


def test_digest(spark):
    texts = [None, "", " a  b", "naïve\nline", "日本語", "y" * 3000, "word " * 4000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in sentencepiece_bpe.digest(sentencepiece_bpe.encode_texts(docs, PATH, check_every=1)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", out_type=int, add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)
    assert sentencepiece_bpe.encode_texts(docs.limit(0), PATH).count() == 0


def test_every_row_is_checked(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(200)], "doc_id long, text string")
    assert {r.agrees for r in sentencepiece_bpe.encode_texts(docs, PATH).collect()} == {True}


def test_library_wins_where_it_differs():
    with open(PATH, "rb") as file:
        wrong = sentencepiece_bpe.Vocabulary(file.read())
    texts = ["abc def %d" % i for i in range(40)]
    ids = wrong.library.encode(texts, out_type=int, add_eos=True)
    flat, _, read, agrees = sentencepiece_bpe.checked(wrong, texts, 4)
    assert flat.tolist() == [k for x in ids for k in x] and read == texts and {*agrees} == {True, None}
    wrong.flat = wrong.flat.copy()
    wrong.flat[wrong.starts[wrong.known["▁abc"]]] += 1
    flat, _, read, agrees = sentencepiece_bpe.checked(wrong, texts, 4)
    assert flat.tolist() == [k for x in ids for k in x] and read == texts and {*agrees} == {False}
