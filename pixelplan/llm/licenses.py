"""License scans by a positional index of rare licence words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import expand, slices, utf8, word_hashes

# The phrases that the contract names, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known passages of public licences, each with its label and the phrases that must stand in it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted", "appear in all copies"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "retain the above copyright notice"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["you may not use this file except in compliance"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["you can redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["subject to the terms of the mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released into the public domain"]),
    ("cc-by-nc", "licensed under cc by nc", ["licensed under cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["licensed under cc by sa"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]

# Further notices of public licences, in the same form.
NOTICES = [
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ["without any express or implied warranty", "permission is granted to anyone to use this software for any purpose"]),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ["covered by this license the software to use reproduce display distribute"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at", ["under the terms of the eclipse public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", ["you should have received a copy of the gnu general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["you should have received a copy of the gnu lesser general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["you should have received a copy of the gnu affero general public license"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["shall be included in all copies or substantial portions of the software"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["licensed under a creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["licensed under a creative commons attribution 4 0"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["licensed under a creative commons attribution noncommercial"]),
]

# Titles of public licences and the identifiers of the software package data exchange, with their labels.
TITLES = [
    ("mpl", "mozilla public license version 2 0"), ("mpl", "mozilla public license version 1 1"), ("mpl", "mozilla public license 2 0"),
    ("epl", "eclipse public license version 1 0"), ("epl", "eclipse public license v 1 0"), ("epl", "eclipse public license v 2 0"), ("epl", "eclipse public license 2 0"),
    ("bsl", "boost software license version 1 0"), ("zlib", "zlib license"), ("isc", "isc license"), ("bsd", "bsd 2 clause license"), ("bsd", "bsd 3 clause license"), ("unlicense", "the unlicense"),
    ("lgpl", "gnu lesser general public license version 2 1"), ("lgpl", "gnu lesser general public license version 3"), ("agpl", "gnu affero general public license version 3"), ("gfdl", "gnu free documentation license"), ("artistic", "artistic license 2 0"),
    ("cddl", "common development and distribution license"), ("eupl", "european union public licence"), ("busl", "business source license 1 1"), ("sspl", "server side public license"),
    ("psf", "python software foundation license"), ("afl", "academic free license"), ("postgresql", "postgresql license"), ("ofl", "sil open font license"),
    ("cc0", "creative commons zero"), ("cc0", "cc0 1 0 universal"), ("cc-by", "creative commons attribution 4 0"), ("cc-by-sa", "creative commons attribution sharealike 4 0"), ("cc-by-sa", "creative commons attribution sharealike 3 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0"), ("cc-by-nd", "creative commons attribution noderivatives 4 0"),
]
IDENTIFIERS = "0BSD AFL-3.0 AGPL-3.0 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 BUSL-1.1 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 OFL-1.1 PostgreSQL PSF-2.0 SSPL-1.0 Unlicense WTFPL Zlib".split()


def _identified() -> list[tuple[str, str, list[str]]]:
    """A template for each identifier after its tag, labelled as the identifier without its version."""
    out = []
    for name in IDENTIFIERS:
        words = name.lower().replace("-", " ").replace(".", " ")
        label = "-".join(w for w in name.lower().split("-") if not w[0].isdigit() or w == "0bsd").removesuffix("-clause")
        phrase = f"spdx license identifier {words}"
        out.append((label, phrase, [phrase]))
    return out

#: Words that a passage may have gained or lost on the way to a mandatory phrase.
SLACK = 6
#: Share of a template that must stand in order, in runs of so many words at least: by rarity and by mere words.
COVER = 0.6
RUN = 3


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[list[str]]
    base: bool


def templates() -> list[Template]:
    """Each base phrase is a template of its own that must stand exactly."""
    return [Template(label, phrase.split(), [phrase.split()], True) for phrase, label in BASE.items()] + [Template(label, text.split(), [k.split() for k in keys], False) for label, text, keys in [*TEMPLATES, *NOTICES, *((label, text, [text]) for label, text in TITLES), *_identified()]]


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes(*utf8(pa.array([" ".join(words)])))[0]


class Index:
    """Postings (word, template, place) of the rarest word of each mandatory phrase, by inverse document frequency over the scanned texts.

    A template needs all its phrases, so no passage that has them is lost, whatever other words it lacks.
    """

    def __init__(self, frequency: dict[int, int], rows: int):
        self.all = templates()
        self.words = [_hashes(t.words) for t in self.all]
        self.keys = [[_hashes(k) for k in t.keys] for t in self.all]
        # A word of no text tells nothing about a passage: it weighs nothing in the cover.
        count = lambda h: np.array([frequency.get(int(x), 0) for x in h.view(np.int64)])
        self.rarity = [np.where(count(h) > 0, np.log((1 + rows) / (1 + count(h))) + 1e-3, 0.0) for h in self.words]
        postings = []
        for t, h in enumerate(self.words):
            df = count(h)
            for key in self.keys[t]:
                begin = next(k for k in range(len(h)) if (h[k : k + len(key)] == key[: len(h) - k]).all() and k + len(key) <= len(h))
                at = begin + int(df[begin : begin + len(key)].argmin())
                postings.append((int(h[at]), t, at, begin, len(key)))
        postings.sort()
        self.key = np.array([p[0] for p in postings], np.uint64)
        self.template = np.array([p[1] for p in postings])
        self.place = np.array([p[2] for p in postings])
        self.phrases = [(begin, self.words[t][begin : begin + n]) for _, t, _, begin, n in postings]
        self.seen = np.zeros(1 << 16, np.bool_)
        self.seen[self.key & np.uint64(65535)] = True

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, template and start (word of the batch) of every posting that a rare word of a text meets and whose phrase stands there."""
        at = np.flatnonzero(self.seen[words & np.uint64(65535)])
        lo, hi = np.searchsorted(self.key, words[at]), np.searchsorted(self.key, words[at], "right")
        which, posting = expand(lo, hi - lo)
        at = at[which]
        row = np.searchsorted(first, at, "right") - 1
        start = at - self.place[posting]
        good = np.zeros(len(at), np.bool_)
        for p in np.unique(posting):
            begin, phrase = self.phrases[p]
            own = np.flatnonzero(posting == p)
            s = start[own] + begin
            own = own[(s >= first[row[own]]) & (s + len(phrase) <= first[row[own] + 1])]
            good[own] = (words[(start[own] + begin)[:, None] + np.arange(len(phrase))] == phrase).all(axis=1)
        return row[good], self.template[posting[good]], start[good]

    def scan(self, words: np.ndarray, first: np.ndarray) -> tuple[list[dict[str, float]], list[set[str]], np.ndarray, np.ndarray]:
        """For each row the labels with their scores and those of base phrases; row and first word of each place of a base phrase."""
        row, template, start = self.candidates(words, first)
        base = np.array([t.base for t in self.all])
        labels: list[dict[str, float]] = [{} for _ in range(len(first) - 1)]
        base_labels: list[set[str]] = [set() for _ in range(len(first) - 1)]
        base_row, base_at = [], []
        for t in np.unique(template[base[template]]):
            own = template == t
            r, s, h = row[own], start[own], self.words[t]
            fits = (s >= first[r]) & (s + len(h) <= first[r + 1])
            r, s = r[fits], s[fits]
            good = (words[s[:, None] + np.arange(len(h))] == h).all(axis=1)
            base_row.append(r[good])
            base_at.append(s[good])
            for x in np.unique(r[good]).tolist():
                labels[x][self.all[t].label] = 1.0
                base_labels[x].add(self.all[t].label)
        # The other templates: postings whose starts lie within the slack of the first make one candidate.
        own = ~base[template]
        order = np.lexsort((start[own], template[own], row[own]))
        row, template, start = row[own][order], template[own][order], start[own][order]
        for a, b in self._groups(row, template, start):
            r, t = int(row[a]), int(template[a])
            if labels[r].get(self.all[t].label, 0.0) >= 1.0:
                continue
            lo, hi = max(int(first[r]), int(start[a]) - SLACK), min(int(first[r + 1]), int(start[b - 1]) + len(self.words[t]) + SLACK)
            score = self._verify(words[lo:hi], t)
            if score >= COVER:
                labels[r][self.all[t].label] = max(score, labels[r].get(self.all[t].label, 0.0))
        none = np.zeros(0, np.int64)
        return labels, base_labels, np.concatenate([none, *base_row]), np.concatenate([none, *base_at])

    @staticmethod
    def _groups(row: np.ndarray, template: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of sorted postings of one row and template; each posting begins one that reaches as far as the slack."""
        edges = np.concatenate([np.flatnonzero((np.diff(row) != 0) | (np.diff(template) != 0)) + 1, [len(row)]])
        out, a = [], 0
        for stop in edges.tolist():
            end = a
            while a < stop:
                reach = a + int(np.searchsorted(start[a:stop], start[a] + SLACK, "right"))
                if reach > end:  # else it lies within the one before
                    out.append((a, reach))
                    end = reach
                a += max(1, int(np.searchsorted(start[a:stop], start[a], "right")))
            a = stop
        return out

    def _verify(self, words: np.ndarray, t: int) -> float:
        """0 if a mandatory phrase is missing, else the share of the template that stands there in order, in runs of RUN words or more.

        The least of the share weighted by rarity and that of mere words: the heaviest common subsequence of the
        template and the window whose steps lie in runs of equal words.
        """
        whole = self.words[t]
        for key in self.keys[t]:
            n = len(words) - len(key) + 1
            if n <= 0 or not np.all([words[k : k + n] == key[k] for k in range(len(key))], axis=0).any():
                return 0.0
        same = whole[:, None] == words[None, :]
        run = np.zeros_like(same)
        n = min(RUN, len(whole))
        if len(words) >= n:
            full = np.all([same[k : len(whole) - n + 1 + k, k : len(words) - n + 1 + k] for k in range(n)], axis=0)
            for k in range(n):
                run[k : len(whole) - n + 1 + k, k : len(words) - n + 1 + k] |= full
        scores = []
        for weight in (self.rarity[t], np.ones(len(whole))):
            best = np.zeros(len(words) + 1)
            for k in range(len(whole)):
                best[1:] = np.maximum(best[1:], best[:-1] + weight[k] * run[k])
                np.maximum.accumulate(best, out=best)
            scores.append(min(1.0, best[-1] / weight.sum()) if weight.sum() > 0 else 1.0)
        return float(min(scores))


def _frequencies(rows: DataFrame) -> tuple[dict[int, int], int]:
    """In how many texts each word of the templates stands, and the number of rows, counted in one pass."""
    vocabulary = np.unique(np.concatenate([_hashes(t.words) for t in templates()]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(vocabulary), np.int64), 0
        for batch in slices(batches, "text"):
            seen += batch.num_rows
            words, first = word_hashes(*utf8(batch["text"]))
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            held = np.flatnonzero(vocabulary[at] == words)
            pairs = np.unique((np.searchsorted(first, held, "right") - 1) * len(vocabulary) + at[held])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary.view(np.int64), None], pa.int64()), pa.array([*total, seen], pa.int64())], ["word", "n"])

    found = rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in found}
    return frequency, frequency.pop(None, 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their
    starts (null if none), base_labels and labels sorted arrays of the base phrases' labels and of all that
    were found; score is that of the surest label, 1 for a base phrase, 0 for none. A template needs its phrases
    and its words in order: words strewn or shuffled do not make it. Rarity is counted over all of docs, in one
    pass and for the words of the templates only. Null and empty texts have no words; equal and repeated rows
    have equal results of their own; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(Index(*_frequencies(rows)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in slices(batches, "text"):
            words, first = word_hashes(*utf8(batch["text"]))
            labels, base, row, at = x.scan(words, first)
            n = batch.num_rows
            at = at - first[row]
            count = np.bincount(row, minlength=n)
            least, most = np.full(n, 1 << 62), np.full(n, -1)
            np.minimum.at(least, row, at)
            np.maximum.at(most, row, at)
            some = count > 0
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(np.diff(first)), pa.array(count), pa.array(least, mask=~some), pa.array(most, mask=~some), pa.array([sorted(own) for own in base], pa.list_(pa.string())), pa.array([sorted(own) for own in labels], pa.list_(pa.string())), pa.array([max(own.values(), default=0.0) for own in labels], pa.float64())],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract, from scan."""
    return scanned.withColumns({c: F.concat_ws(",", c) for c in ("base_labels", "labels")})
