import random
import re

from pixelplan.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def corpus():
    r = random.Random(6)
    words = ["mit", "license", "apache", "general", "public", "the", "LICENSE", "Mit", "x", "ß", "gnu"]
    texts = [None, "", "mit-license", "MIT\nLicense", "mitlicense", "general public", "license general public license mit"]
    texts += [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(200)] + ["the x " * 30000 + "Apache License"]
    mit = next(t for label, t, _ in licenses.TEMPLATES if label == "mit")
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    return texts, ["intro words. " + mit.capitalize() + ", and so on", mit.replace("sublicense", "relicense"), mit[:100], bsd + "\n" + "y " * 40 + "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "rights all reserved"]


def test_base_phrases_equal_brute_force(spark):
    texts, more = corpus()
    texts += more
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate([*texts, texts[-1]])], "doc_id long, text string, labels string").repartition(3)
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert {*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    n = len(texts) - len(more)
    assert [got[n + k].labels for k in range(len(more))] == ["mit", "mit", "", "bsd,mit", "cc-by-nc", "reserved", ""]
    assert got[n].base_labels == "" and got[n + 1].score < 1
    assert got[len(texts)][1:] == got[len(texts) - 1][1:]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_one_variant_in_all_texts(spark):
    whole = {label: t for label, t, _ in licenses.TEMPLATES}
    mit = whole["mit"].replace(" and to permit persons to whom the software is furnished to do so", "")
    isc = whole["isc"].removeprefix("permission to use copy modify ")
    docs = spark.createDataFrame([(i, f"file {i} " + (isc if i % 2 else mit) if i < 20 else f"plain text {i}") for i in range(1000)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs)).collect()}
    assert [got[i] for i in range(1000)] == ["mit", "isc"] * 10 + [""] * 980


def labels_of(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(licenses.scan(docs)).collect()}
    return [got[i] for i in range(len(texts))]


def test_words_out_of_order_make_no_licence(spark):
    r = random.Random(9)
    texts, strewn = [], []
    long = [x for x in licenses.TEMPLATES if len(x[1].split()) > 12]
    for _, text, keys in long:
        parts, rest = [k for k in keys], text
        for k in keys:
            assert k in text
            rest = rest.replace(k, " ", 1)
        for _ in range(20):
            own = [*parts, *rest.split()]
            r.shuffle(own)
            texts.append(" ".join(own))
        strewn.append(" ".join(w + " " + " ".join(f"w{r.randrange(500)}" for _ in range(60)) for w in text.split()))
    assert len(long) == 9
    found = labels_of(spark, texts)
    assert [x[0] for x in found] == [brute(t)[4] for t in texts]
    assert {x[0] for x in labels_of(spark, strewn)} == {""}
    assert labels_of(spark, ["a cc by nc picture", "the end"]) == [("", 0.0), ("", 0.0)]


def plain_share(text, template, keys):
    """The share of a template that stands in order in runs of three, over the whole of a short text, all words equally rare."""
    w, t = re.findall(r"[a-z0-9]+", text.lower()), template.split()
    if not all(any(w[i : i + len(k.split())] == k.split() for i in range(len(w))) for k in keys):
        return 0.0
    run = {(i + d, j + d) for i in range(len(t) - 2) for j in range(len(w) - 2) if t[i : i + 3] == w[j : j + 3] for d in range(3)}
    best = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
    for i in range(len(t)):
        for j in range(len(w)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + ((i, j) in run))
    return best[-1][-1] / len(t)


def test_labels_equal_brute_force(spark):
    r = random.Random(2)
    texts = []
    for _ in range(150):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 1 + len(words) // 8)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["odd"], [words[at]]])
        texts.append(" ".join(words))
    index = licenses.Index({}, 0)  # no weights: mere words count
    for text in texts:
        words, first = licenses.word_hashes(*licenses.utf8(licenses.pa.array([text])))
        got = index.scan(words, first)[0][0]
        want = {}
        for label, template, keys in licenses.TEMPLATES:
            share = plain_share(text, template, keys)
            if share >= licenses.COVER:
                want[label] = max(share, want.get(label, 0))
        got = {k: v for k, v in got.items() if k not in PHRASES.values() or v < 1 or k in want}
        for k in {*got, *want}:
            if k in PHRASES.values() and k not in want:
                assert brute(text)[1] > 0
            elif got.get(k) != 1.0 or k not in PHRASES.values():
                assert abs(got[k] - want[k]) < 1e-9, (text, k)


def test_notices_titles_and_identifiers_in_hundreds_of_texts(spark):
    r = random.Random(8)
    known = licenses.templates()
    pool = sorted({w for t in known for w in t.words})
    texts = []
    for k in range(400):
        own = [r.choices(pool, k=r.randint(0, 30))]
        for t in r.sample(known, r.randint(0, 3)):
            own += [t.words, r.choices(pool, k=r.randint(1, 30))]
        sep = r.choice([" ", "\n", ", ", "-"])
        texts.append(sep.join(w.upper() if k % 3 == 0 else w for part in own for w in part))
    texts += ["SPDX-License-Identifier: MIT", "Mozilla Public License, version 2.0", "(Creative Commons Attribution-ShareAlike 4.0)", "// SPDX-License-Identifier: GPL-2.0-or-later", "Boost Software License - Version 1.0", "Eclipse Public License v 2.0", "zlib License", "SPDX identifiers, MIT", "a license of Eclipse, public"]
    got = {x.doc_id: x.labels.split(",") for x in licenses.digest(licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4))).collect()}
    for i, text in enumerate(texts[:400]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        stands = lambda p: any(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1))
        assert {t.label for t in known if stands(t.words)} <= {*got[i]}, text
        assert {*got[i]} - {""} <= {t.label for t in known if all(stands(key) for key in t.keys)}, text
    assert [got[400 + k] for k in range(9)] == [["mit"], ["mpl"], ["cc-by-sa"], ["gpl"], ["bsl"], ["epl"], ["zlib"], [""], [""]]
