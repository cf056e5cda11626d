"""Language identification by the nearest of several TF-IDF centroids of character n-grams per language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .text import mix, release, slices

#: Buckets that n-grams of 1 to 3 characters are hashed to.
BUCKETS = 1 << 13
GRAMS = (1, 2, 3)
#: Labelled texts that a language's centroids are fitted on at most (in the mean; drawn by a hash of the id).
SAMPLE = 1500
CENTROIDS = 4
#: Characters of a text that are turned into n-grams at once; long texts are added up.
BLOCK = 1 << 18
#: Texts whose vectors are in memory at once when predicting.
TEXTS = 128
UNDETERMINED = "und"
#: A text is rejected if it is less like its nearest centroid than this share of what the least like 1 in 1000
#: of the texts that the language was learned from is.
REJECT_SHARE = 0.3

_STEP = np.uint64(0x9E3779B97F4A7C15)
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letter:
        _letter.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.bool_, 0x110000))
    return _letter[0]


def gram_counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams stand in a text, in lower case, with one blank for each run of other characters; None if it has no letter.

    Long texts are counted piece by piece: a piece begins with the last characters of the one before, of which
    no n-gram is counted twice, so the counts are those of the whole text.
    """
    text = text.lower()
    total, carried = None, np.full(1, 32, np.uint32)  # one blank before the first letter
    for k in range(0, len(text) + 1, BLOCK):
        points = np.frombuffer(text[k : k + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[points]
        points = np.where(letter, points, np.uint32(32))
        if k + BLOCK > len(text):  # and one after the last
            points, letter = np.append(points, np.uint32(32)), np.append(letter, False)
        before = np.concatenate([carried[-1:] != 32, letter[:-1]])
        points = np.concatenate([carried, points[letter | before]])
        had = len(carried)
        if total is None:
            if not letter.any():
                continue
            total, had = np.zeros(BUCKETS, np.int64), 0
        points = points.astype(np.uint64)
        for n in GRAMS:
            own = points[max(0, had - n + 1) :]
            code = np.full(max(0, len(own) - n + 1), n, np.uint64)
            for j in range(n):
                code = code * _STEP + own[j : j + len(code)]
            total += np.bincount((mix(code) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        carried = points[-(max(GRAMS) - 1) :].astype(np.uint32)
    return total


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # the label of each centroid
    least: np.ndarray  # for each label, the similarity below which a text is rejected


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors, made in place of the counts (float32)."""
    out = np.log1p(counts, out=counts)
    out *= idf
    out /= np.maximum(np.sqrt(np.einsum("...j,...j->...", out, out))[..., None], 1e-12)
    return out


def cluster(points: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on the sphere, begun from points far from each other."""
    r = np.random.default_rng(seed)
    chosen = [int(r.integers(len(points)))]
    nearest = points @ points[chosen[0]]
    while len(chosen) < min(k, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    centres = points[chosen].copy()
    for _ in range(10):
        own = np.argmax(points @ centres.T, axis=1)
        member = (own == np.arange(len(centres))[:, None]).astype(np.float32)
        some = member.any(axis=1)
        centres[some] = member[some] @ points
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows of labelled that have a label and a text with a letter.

    Of each label the texts of about `sample` rows are used, or all if it has fewer: those with the lowest hashes of the
    text, in proportion to the label's rows, so a label with many rows is no larger group; a text that repeats under a
    label is taken once. Nothing but text and label has a say. What comes back to the driver are the centroids, one
    array of 8192 numbers each.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("draw"), F.xxhash64(F.lit("b"), text).alias("other"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    shares = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    drawn = rows.where(F.col("draw") < F.element_at(shares, F.col("label"))).groupBy("label", "draw", "other").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            labels, out = batch["label"].to_pylist(), []
            for name, t in zip(labels, batch["text"].to_pylist(), strict=True):
                counts = gram_counts(t)
                if counts is not None:
                    k = np.flatnonzero(counts)
                    out.append((name, k.astype(np.int32).tobytes(), counts[k].astype(np.int32).tobytes()))
            names, places, numbers = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], ["label", "at", "n"])

    counted = cut(drawn.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(count, "label string, at binary, n binary"))

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in batch["at"].to_pylist():
                total[np.frombuffer(at, np.int32)] += 1
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([rows], pa.int64())], ["df", "rows"])

    parts = counted.select("at").coalesce(32).mapInArrow(document_frequency, "df binary, rows long").collect()
    n = sum(r["rows"] for r in parts)
    df = sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def centres(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros((table.num_rows, BUCKETS), np.float32)
        for k, (at, number) in enumerate(zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True)):
            counts[k, np.frombuffer(at, np.int32)] = np.frombuffer(number, np.int32)
        points = vectors(counts, shared.value)
        found = cluster(points, centroids)
        least = float(np.quantile((points @ found.T).max(axis=1), 0.001))
        counts = points = None
        release()
        return pa.table({"label": [key[0].as_py()] * len(found), "centre": [c.tobytes() for c in found], "least": [least] * len(found)}, schema=pa.schema([("label", pa.string()), ("centre", pa.binary()), ("least", pa.float64())]))

    found = sorted(counted.groupBy("label").applyInArrow(centres, "label string, centre binary, least double").collect(), key=lambda r: (r["label"], r["centre"]))
    names = sorted({r["label"] for r in found})
    least = {r["label"]: r["least"] for r in found}
    table = np.array([np.frombuffer(r["centre"], np.float32) for r in found]).reshape(-1, BUCKETS)
    return Model(names, idf, table, np.array([names.index(r["label"]) for r in found], np.int64), REJECT_SHARE * np.array([least[x] for x in names]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: its id, lang_pred, score and rejected.

    lang_pred is the label of the nearest centroid, score the cosine to it. A text that is null or has no
    letter, and every text if nothing was learned, has `und` and 0 and is rejected. A text that is further from
    its centroid than the label's limit keeps its prediction but is rejected too. Of equally near labels the
    first in order is taken; equal texts have equal results. Other columns are read only if carry names them,
    and then come as they are in a struct `rest` beside `text`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            names, scores, rejected = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, np.bool_)
            for begin in range(0, batch.num_rows if m.labels else 0, TEXTS):
                counted = ((k, gram_counts(t)) for k, t in enumerate(batch["text"].slice(begin, TEXTS).to_pylist(), begin) if t)
                own = [(k, counts) for k, counts in counted if counts is not None]
                if not own:
                    continue
                counts = np.empty((len(own), BUCKETS), np.float32)
                for row, (_, c) in enumerate(own):
                    counts[row] = c
                likeness = vectors(counts, m.idf) @ m.centroids.T
                best = np.argmax(likeness, axis=1)
                for (k, _), b, s in zip(own, best.tolist(), likeness[np.arange(len(own)), best].tolist(), strict=True):
                    names[k], scores[k] = m.labels[m.owner[b]], min(1.0, max(0.0, s))
                    rejected[k] = s < m.least[m.owner[b]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected), *(batch[c] for c in kept)], ["id", "lang_pred", "score", "rejected", *kept])

    kept = ("text", "rest") if carry else ()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    kinds = f", text string, rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean{kinds}").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from. A row without an id is not one of them, as it has no checksum."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract: fitted on the rows that are not held out, applied to all."""
    predicted = predict(docs, fit(docs.where(~held_out(id_col)), id_col), id_col)
    return predicted.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
