"""Lines that many documents share: hashes in range partitions, sorted by document and position, streamed once.

The outcome is a compressed bitmap for each document that loses a line, not its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .text import slices

#: Documents from which on a line is dropped.
DOCUMENTS = 10

# A line in a run of equal lines: goes for sure, goes if the run's other partitions say so, or tells of a run that may go on elsewhere.
_GOES, _OPEN, _RUN = 0, 1, 2


def key_of(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased (bytes know no other letters)."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has a key: its 128-bit hash, the document, its number of lines and the line's place."""
    for batch in slices(batches, "text"):
        row, place, n, found = [], [], [], []
        for k, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
            lines = (text or b"").split(b"\n")
            for j, line in enumerate(lines):
                key = key_of(line)
                if key:
                    row.append(k)
                    place.append(j)
                    n.append(len(lines))
                    found.append(xxhash.xxh3_128_digest(key))
        h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        own = [batch[c].take(pa.array(row, pa.int64())) for c in ("id", "doc")]
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *own, pa.array(place, pa.int32()), pa.array(n, pa.int32())], ["h1", "h2", "id", "doc", "place", "n"])


def _stream(batches: Iterator[pa.RecordBatch], at_least: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Of sorted lines those that go. Kept in mind are one run's lines until it has enough documents, then only that it has.

    The first and the last run of a partition may go on in others: their lines stay open unless this part alone has enough
    documents, and each tells of itself.
    """
    part = TaskContext.get().partitionId()
    rest: pa.RecordBatch | None = None  # the lines of the last run, if it has too few documents so far
    run = None  # [h1, h2, first document, last document, documents, the partition's first run?] of the last run
    opened = False

    def out(batch: pa.RecordBatch, kind: int, lead: np.ndarray) -> pa.RecordBatch:
        many = batch.num_rows
        new = [pa.array(np.full(many, kind, np.int32)), pa.array(np.full(many, part, np.int32)), pa.array(lead), pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in _LINE), *new], [*_LINE, *_MORE])

    def told(run: list) -> pa.RecordBatch:
        line = [pa.array([run[0]]), pa.array([run[1]]), pa.nulls(1, kinds["id"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())]
        return pa.RecordBatch.from_arrays([*line, pa.array([_RUN], pa.int32()), pa.array([part], pa.int32()), pa.array([False]), pa.array([run[4]]), pa.array([run[2]]), pa.array([run[3]])], [*_LINE, *_MORE])

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = {c: batch.schema.field(c).type for c in _LINE}
        carried = rest.num_rows if rest is not None else 0
        if carried:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        rest = None
        h1, h2, doc = (batch[c].to_numpy() for c in ("h1", "h2", "doc"))
        fresh = np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)])
        new_doc = fresh | np.concatenate([[True], np.diff(doc) != 0])
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], len(h1))
        docs = np.add.reduceat(new_doc.astype(np.int64), begins)
        goes_on = run is not None and not carried and run[0] == h1[0] and run[1] == h2[0]
        if run is not None and not carried and not goes_on:  # the run before ended with its batch, decided
            if run[5]:
                yield told(run)
            run = None
        lead = fresh.copy()
        if goes_on:
            docs[0] += run[4] - (run[3] == doc[0])
            lead[0] = False
        firsts = np.zeros(len(begins), np.bool_)  # is it the partition's first run?
        firsts[0] = run[5] if run is not None else not opened
        opened = True
        began = doc[begins].copy()
        if run is not None:
            began[0] = run[2]
        enough, last = docs >= at_least, len(begins) - 1
        which = np.repeat(np.arange(len(begins)), ends - begins)
        sure = enough[which]
        if first_stays:
            held = lead & sure  # a run's first line stays, or has to ask if it is the partition's first
            ask = held & firsts[which]
            if ask.any():
                at = pa.array(np.flatnonzero(ask))
                yield out(batch.take(at), _OPEN, np.ones(len(at), np.bool_))
            sure &= ~held
        at = np.flatnonzero(sure)
        if len(at):
            yield out(batch.take(pa.array(at)), _GOES, lead[at])
        if firsts[0] and last > 0:
            if not enough[0]:
                yield out(batch.slice(0, ends[0]), _OPEN, lead[: ends[0]])
            yield told([int(h1[0]), int(h2[0]), int(began[0]), int(doc[ends[0] - 1]), int(docs[0]), True])
        k = begins[last]
        run = [int(h1[k]), int(h2[k]), int(began[last]), int(doc[-1]), int(docs[last]), bool(firsts[last])]
        if not enough[last]:
            rest = batch.slice(k)
    if run is not None:
        if rest is not None:
            lead = np.zeros(rest.num_rows, np.bool_)
            lead[0] = True
            yield out(rest, _OPEN, lead)
        yield told(run)


_LINE = ("h1", "h2", "id", "doc", "place", "n")
_MORE = ("kind", "part", "lead", "docs", "doc_first", "doc_last")


def repeated_lines(rows: DataFrame, scratch: Scratch, at_least: int, first_stays: bool) -> DataFrame:
    """id, doc, n, place of the lines that go, of rows (id, doc, text)."""
    kind = rows.schema["id"].dataType.simpleString()
    lines = rows.mapInArrow(_lines, f"h1 long, h2 long, id {kind}, doc long, place int, n int")
    order = ["h1", "h2", "id", "doc", "place"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = placed.mapInArrow(lambda batches: _stream(batches, at_least, first_stays), f"h1 long, h2 long, id {kind}, doc long, place int, n int, kind int, part int, lead boolean, docs long, doc_first long, doc_last long")
    found = scratch.keep("lines", found)
    # Runs at the borders of partitions, two a partition at most: a document on both sides of a border counts once.
    own = Window.partitionBy("h1", "h2").orderBy("part")
    runs = found.where(F.col("kind") == _RUN).withColumn("docs", F.col("docs") - F.coalesce((F.lag("doc_last").over(own) == F.col("doc_first")).cast("int"), F.lit(0)))
    runs = runs.groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min("part").alias("begin")).where(F.col("total") >= at_least)
    stays = F.lit(first_stays) & F.col("lead") & (F.col("part") == F.col("begin"))
    opened = found.where(F.col("kind") == _OPEN).join(runs, ["h1", "h2"]).where(~stays)
    return found.where(F.col("kind") == _GOES).select("id", "doc", "n", "place").unionByName(opened.select("id", "doc", "n", "place"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for n, places in zip(batch["n"].to_pylist(), batch["places"].to_pylist(), strict=True):
            keep = np.ones(n, np.bool_)
            keep[places] = False
            made.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["doc"], pa.array(made, pa.binary())], ["id", "doc", "keep"])


def kept_lines(bitmap: bytes, n: int) -> np.ndarray:
    """Which of a document's n lines a bitmap keeps."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(np.bool_)


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select("id", F.xxhash64("id", F.coalesce("text", F.lit(""))).alias("doc"), "text")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", at_least: int = DOCUMENTS, first_stays: bool = False) -> DataFrame:
    """For each document that loses lines: id, doc (a hash of id and text) and keep, a bit for each line (zlib over packed bits).

    Lines end at \\n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased, and lines
    without a key stay. Lines of one key that stand in at least `at_least` documents go, all of them or, if
    first_stays, all but the first by id, document and place. A document is an id with its text: rows that
    repeat are one document and share a bitmap; rows of one id with different texts are several. Null ids are ids.
    A null or empty text has one empty line. An empty table gives none. Columns may have any names.

    A line that stands in a great part of all rows is spread over partitions, as ranges are cut by document too; each
    task streams its range and remembers the lines of one run in fewer than `at_least` documents. A document's
    bitmap is put together from the places of its lines alone.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = _rows(docs, id_col, text)
    gone = repeated_lines(rows, scratch, at_least, first_stays)
    kind = rows.schema["id"].dataType.simpleString()
    return gone.groupBy("id", "doc", "n").agg(F.collect_set("place").alias("places")).mapInArrow(_bits, f"id {kind}, doc long, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines, dropped, kept, digests = [], [], [], []
        for text, bitmap in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["keep"].to_pylist(), strict=True):
            own = (text or b"").split(b"\n")
            if bitmap is not None:
                left = [*compress(own, kept_lines(bitmap, len(own)))]
            else:
                left = own
            said = b"\n".join(left)
            lines.append(len(own))
            dropped.append(len(own) - len(left))
            kept.append(said)
            digests.append(hashlib.sha256(said).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests), batch["keep"]], ["id", "n_lines", "n_dropped", "kept", "kept_sha256", "keep"])


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_lines (before), n_dropped, kept (text), kept_sha256 and keep (null: all lines stay) of every row of docs.

    Rows of one document, however many, find its bitmap by a join whose hot partitions Spark splits at run time.
    """
    rows = _rows(docs, id_col, text)
    kind = rows.schema["id"].dataType.simpleString()
    own = bitmaps.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "keep")
    joined = rows.join(own, (F.col("doc") == F.col("_doc")) & F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "keep")
    found = joined.mapInArrow(_applied, f"id {kind}, n_lines long, n_dropped long, kept string, kept_sha256 string, keep binary")
    return found.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", at_least: int = DOCUMENTS) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 and the bitmap of every document."""
    return without_lines(docs, keep_bitmaps(docs, id_col, text, at_least), id_col, text).select(id_col, "n_lines", "n_dropped", "kept_sha256", "keep")
