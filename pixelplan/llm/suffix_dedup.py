"""Exact removal of repeated byte strings by column-wise construction of a multi-document suffix order.

The construction inserts one symbol of every document each round, from right to left, and updates the order
of the suffixes (whose preceding symbols are the collection's Burrows-Wheeler transform) and the common
prefixes of neighbours. Rounds over whole documents would number as many as the longest document has bytes,
each of them a pass over the corpus. Three things make that fit:

* Each window of `width` bytes has an anchor, the smallest hash among its spans of `span` bytes (the leftmost
  of equals). Equal windows have equal anchors at equal offsets, so windows are compared only where their
  anchors' bytes are the same, and most of the corpus needs no construction at all.
* Windows that share one anchor are a run of at most width + (width - span) bytes. Where all runs of an anchor
  are equal (by 64-bit hashes of the anchor and of the run) they are settled by counting, without an order.
* The remaining runs are aligned at their anchors. Equal windows then start in the same column, so a round
  compares suffixes that start in one column, and the rounds number as many as an aligned run has columns.

The runs of an anchor travel in sorted shuffle files and are read in order, a bounded number at a time. An
anchor with more runs than that is dealt to several groups; what each group finds distinct is then counted
across groups, so no pair is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut as cut_lineage
from .text import SLICE_BYTES, Rolling, expand, mix, packed, release, slices, unpacked, utf8

#: Bytes of the strings that are removed wherever they start twice.
WIDTH = 200
#: Bytes of an anchor.
SPAN = 64
#: Runs of one anchor that are ordered together; more are dealt to several groups.
GROUP = 2000
#: Runs that a task orders at once.
CHUNK = 16000

_PLACE_BITS = 24


def runs(data: np.ndarray, rows: np.ndarray, width: int = WIDTH, span: int = SPAN) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, lo and hi (first and last window, from the row's start), anchor, key, same.

    key is a hash of the anchor's bytes, same one of all the run's bytes and the anchor's place in them.
    """
    parts = []
    most = max(SLICE_BYTES, 4 * width)
    for begin, end, row in _pieces(rows, most, width):
        piece = _runs(data[begin:end], rows[row : row + 2] - begin if end - begin < rows[row + 1] - rows[row] else rows[row:] - begin, width, span)
        piece["row"] += row
        piece |= {k: piece[k] + begin - rows[piece["row"]] for k in ("lo", "hi", "anchor")}
        parts.append(piece)
    names = ("row", "lo", "hi", "anchor", "key", "same")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _pieces(rows: np.ndarray, most: int, width: int) -> Iterator[tuple[int, int, int]]:
    """The buffer as a whole, or a single long row in parts that overlap by width - 1 bytes."""
    if len(rows) != 2 or rows[1] - rows[0] <= most:
        yield int(rows[0]), int(rows[-1]), 0
        return
    for begin in range(int(rows[0]), int(rows[1]) - width + 1, most - width + 1):
        yield begin, min(begin + most, int(rows[1])), 0


def _runs(data: np.ndarray, rows: np.ndarray, width: int, span: int) -> dict[str, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0:
        return {"row": none, "lo": none, "hi": none, "anchor": none, "key": none, "same": none}
    rolling = Rolling(data)
    every = rolling.every(span)
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    least = (every & ~low_bits) | np.arange(len(every), dtype=np.uint64)  # equal hashes: the leftmost
    size, many = 1, width - span + 1
    while size * 2 <= many:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (many - size)], least[many - size :])
    anchor = (least & low_bits).astype(np.int64)
    ends = np.clip(np.minimum(rows, len(data)), 0, None)
    valid = np.ones(n + 1, np.bool_)
    valid[n] = False
    lo_bad, hi_bad = np.maximum(ends[1:] - width + 1, ends[:-1]), np.minimum(ends[1:], n)
    _, bad = expand(lo_bad, np.maximum(0, hi_bad - lo_bad))
    valid[bad] = False
    at = np.flatnonzero(valid[:n])
    if not len(at):
        return {"row": none, "lo": none, "hi": none, "anchor": none, "key": none, "same": none}
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor[at]) != 0)) + 1
    lo, hi = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    anchor = anchor[lo]
    same = mix(rolling.spans(lo, hi + width) ^ mix((anchor - lo + (hi - lo) * 4096).astype(np.uint64)))
    return {"row": np.searchsorted(rows, lo, "right") - 1, "lo": lo, "hi": hi, "anchor": anchor, "key": every[anchor].view(np.int64), "same": same.view(np.int64)}


def repeats(strings: list[bytes], anchors: np.ndarray, width: int = WIDTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of these strings, aligned at their anchors, begin more than one of them.

    Returns a table (string, offset of the window) of booleans, and one of the windows that come first among
    their equals in the final orders; offsets count from the left edge of the alignment, width - span columns
    before the anchor.

    Round c inserts the symbol in column c of every string before the suffixes that start in column c + 1:
    a stable sort by that symbol gives the new order, and two neighbours with the same symbol share one more
    than the least common prefix between them in the old order.
    """
    m, edge = len(strings), width - span
    columns = edge + width
    grid = np.full((columns, m), 256, np.int16)
    for i, s in enumerate(strings):
        at = edge - anchors[i]
        grid[at : at + len(s), i] = np.frombuffer(s, np.uint8)
    order, common = np.arange(m), np.zeros(m + 1, np.int64)  # common[k]: of the strings at k - 1 and k
    twice, leads = np.zeros((edge + 1, m), np.bool_), np.zeros((edge + 1, m), np.bool_)
    for c in range(columns - 1, -1, -1):
        symbol = grid[c][order]
        place = np.argsort(symbol, kind="stable")
        fresh = np.zeros(m + 1, np.int64)
        if m > 1:
            ranges = np.empty(2 * (m - 1), np.int64)
            ranges[0::2], ranges[1::2] = place[:-1] + 1, place[1:] + 1
            symbol = symbol[place]
            alike = (symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)
            ranges = ranges.reshape(-1, 2)[alike].ravel()
            if len(ranges):
                fresh[1:m][alike] = np.minimum.reduceat(common, ranges)[0::2] + 1
        order, common = order[place], fresh
        if c <= edge:
            before, after = common[:m] >= width, common[1:] >= width
            twice[c][order] = before | after
            leads[c][order] = after & ~before
    return twice.T, leads.T


def find_repeats(docs: DataFrame, text: str, width: int = WIDTH, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """Spans (lo, hi: bytes from the text's start) that repeated strings cover, by the text's hashes h1 and h2.

    A row for each group of neighbouring windows of a distinct text, unmerged: h1, h2, spans (array of lo, hi, lo,
    hi ...). A text that stands in several rows is worked on once; it is covered from end to end.
    """
    rows = docs.select(*_named(F.col(text)), F.col(text).alias("text")).where("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            r = runs(*utf8(batch["text"]), width, span)
            at = pa.array(r["row"])
            where = r["lo"] << 24 | (r["hi"] - r["lo"]) << 12 | r["anchor"] - r["lo"]
            yield pa.RecordBatch.from_arrays([pa.array(r["key"]), pa.array(r["same"]), batch["h1"].take(at), batch["h2"].take(at), pa.array(where)], ["key", "same", "h1", "h2", "where"])

    found = rows.mapInArrow(cut, "key long, same long, h1 long, h2 long, where long")
    shared = found.groupBy("key").agg(F.count("*").alias("n"), F.min("same").alias("a"), F.max("same").alias("b")).where("n > 1").select("key", F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.ceil(F.col("n") / group)).cast("int").alias("groups"))
    # Kept first, so that it is a shuffle of its own and Spark splits the partition of an anchor that very many runs have.
    shared = cut_lineage(shared)
    # One entry for each run whose anchor stands elsewhere too, once for each text; groups is 0 where all its runs are equal.
    joined = found.select("key", "h1", "h2", "where").join(shared, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("where", "groups", "key")).alias("runs"))
    once = packed(rows, "text").groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    held = joined.join(once, ["h1", "h2"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal runs and repeated texts become spans at once; the other runs go on with their bytes."""
        for batch in unpacked(batches, "text"):
            data, first = utf8(batch["text"])
            lists = batch["runs"]
            flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            where, groups, key = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            lo, n, anchor = where >> 24, where >> 12 & 4095, where & 4095
            end = lo + n + width
            done = groups == 0
            size, again = np.diff(first), np.flatnonzero(batch["copies"].to_numpy() > 1)
            again = again[size[again] >= width]
            spans = _by_row(np.concatenate([row[done], again]), np.concatenate([lo[done], np.zeros(len(again), np.int64)]), np.concatenate([end[done], size[again]]), batch.num_rows)
            take = pa.array([k for k, x in enumerate(spans) if x is not None], pa.int64())
            k = len(take)
            if k:
                yield _records(batch["h1"].take(take), batch["h2"].take(take), pa.array([x for x in spans if x is not None], pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()))
            rest = np.flatnonzero(~done)
            if len(rest):
                take = pa.array(row[rest])
                salt = mix((lo[rest] * 31).astype(np.uint64) ^ batch["h1"].take(take).to_numpy().view(np.uint64)) % groups[rest].astype(np.uint64)
                begin, stop = first[row[rest]] + lo[rest], first[row[rest]] + end[rest]
                raw = data.tobytes()
                yield _records(batch["h1"].take(take), batch["h2"].take(take), pa.array(np.column_stack([lo[rest], anchor[rest], groups[rest].astype(np.int64)]).tolist(), pa.list_(pa.int64())), pa.array(key[rest]), pa.array(salt.view(np.int64)), pa.array([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()))

    shape = "h1 long, h2 long, spans array<long>, key long, salt long, bytes binary"
    settled = held.mapInArrow(settle, shape).repartition("key", "salt", F.when(F.col("key").isNull(), F.col("h1"))).sortWithinPartitions("key", "salt")

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes on finished spans, orders the other runs, some whole groups at a time."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            free = batch.filter(pa.compute.is_null(batch["key"]))
            if free.num_rows:
                yield pa.RecordBatch.from_arrays([free["h1"], free["h2"], free["spans"], *(pa.nulls(free.num_rows, pa.int64()) for _ in range(4))], _OUT)
            own = batch.filter(pa.compute.is_valid(batch["key"]))
            if not own.num_rows:
                continue
            waiting.append(own)
            if sum(b.num_rows for b in waiting) >= CHUNK:
                table = pa.Table.from_batches(waiting).combine_chunks()
                key, salt = table["key"].to_numpy(), table["salt"].to_numpy()
                last = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1 if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
                if last:
                    yield from _ordered(table.slice(0, last), width, span)
                waiting = table.slice(last).to_batches()
        if waiting:
            yield from _ordered(pa.Table.from_batches(waiting), width, span)
        release()

    made = cut_lineage(settled.mapInArrow(construct, "h1 long, h2 long, spans array<long>, w1 long, w2 long, at long, n long"))
    spans = made.where("w1 is null").select("h1", "h2", "spans")
    windows = made.where("w1 is not null").select("h1", "h2", "w1", "w2", "at", "n")
    across = cut_lineage(windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1"))
    more = windows.where("n = 1").join(across, ["w1", "w2"]).select("h1", "h2", F.array("at", F.col("at") + width).alias("spans"))
    return spans.unionByName(more)


def _named(text):
    """Two hashes that a text is known by."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("b"), text).alias("h2")


_OUT = ["h1", "h2", "spans", "w1", "w2", "at", "n"]


def _records(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["h1", "h2", "spans", "key", "salt", "bytes"])


def merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans without overlap that cover the same; touching spans become one."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(lo[1:] > end[:-1]) + 1
    return lo[np.concatenate([[0], cut])], end[np.concatenate([cut - 1, [len(end) - 1]])]


def _by_row(row: np.ndarray, lo: np.ndarray, end: np.ndarray, n: int) -> list[list[int] | None]:
    out: list[list[int] | None] = [None] * n
    order = np.argsort(row, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
        out[int(row[group[0]])] = np.column_stack(merged(lo[group], end[group])).ravel().tolist()
    return out


def _ordered(table: pa.Table, width: int, span: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    facts = np.array(table["spans"].to_pylist(), np.int64).reshape(-1, 3)
    lo, anchor, groups = facts.T
    strings = table["bytes"].to_pylist()
    size = np.array([len(s) for s in strings]) - width + 1
    twice, leads = repeats(strings, anchor, width, span)
    left = width - span - anchor
    many, shape = groups > 1, np.arange(twice.shape[1])[None, :]
    own = (shape >= left[:, None]) & (shape < (left + size)[:, None])
    row, column = np.nonzero(twice & own)
    start = lo[row] + column - left[row]
    spans = _by_row(row, start, start + width, len(strings))
    keep = pa.array([k for k, s in enumerate(spans) if s is not None], pa.int64())
    ids, h = table["h1"].combine_chunks(), table["h2"].combine_chunks()
    if len(keep):
        nulls = [pa.nulls(len(keep), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([ids.take(keep), h.take(keep), pa.array([s for s in spans if s is not None], pa.list_(pa.int64())), *nulls], _OUT)
    row, column = np.nonzero(own & many[:, None] & (leads | ~twice))
    for part in range(0, len(row), 1 << 16):
        r, c = row[part : part + (1 << 16)], column[part : part + (1 << 16)]
        digests = np.frombuffer(b"".join(hashlib.md5(strings[i][k : k + width], usedforsecurity=False).digest() for i, k in zip(r.tolist(), (c - left[r]).tolist(), strict=True)), np.int64).reshape(-1, 2)
        at = pa.array(r)
        yield pa.RecordBatch.from_arrays([ids.take(at), h.take(at), pa.nulls(len(r), pa.list_(pa.int64())), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(lo[r] + c - left[r]), pa.array(np.where(leads[r, c], 2, 1).astype(np.int64))], _OUT)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """docs with columns kept (binary: the text's UTF-8 bytes without repeats), n_bytes, n_removed and n_spans.

    A byte goes if a string of `width` bytes covers it that also starts anywhere else in the table, in the
    same text or another. Null and empty texts and those of fewer than width bytes have no such string and
    are kept whole (null as no bytes). Repeated rows are documents of their own, so their strings start
    twice; rows are told apart by their texts only, so ids may be null or repeat. All columns of docs are
    returned, whatever their names, but for any that are called kept, n_bytes, n_removed or n_spans. An empty
    table gives none.
    """
    spans = find_repeats(docs, text, width, span, group).groupBy("h1", "h2").agg(F.collect_list("spans").alias("spans"))
    others = [f for f in docs.schema.fields if f.name not in ("kept", "n_bytes", "n_removed", "n_spans", text)]
    rest = F.struct(F.lit(True).alias("on"), *(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)))
    rows = docs.select(*_named(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text"), rest.alias("rest"))
    joined = packed(rows, "text").join(cut_lineage(spans), ["h1", "h2"], "left").select("rest", "text", "spans")
    shape = f"rest {joined.schema['rest'].dataType.simpleString()}, text string, kept binary, n_bytes long, n_removed long, n_spans long"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            whole = [None if x is None else tool.decompress(x) for x in batch["text"].to_pylist()]
            kept, facts = [], []
            for raw, found in zip(whole, batch["spans"].to_pylist(), strict=True):
                raw = raw or b""
                if not found:
                    kept.append(raw)
                    facts.append((len(raw), 0, 0))
                    continue
                s = np.concatenate([np.array(x, np.int64) for x in found]).reshape(-1, 2)
                lo, end = merged(s[:, 0], s[:, 1])
                edges = [0, *np.column_stack([lo, end]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
                facts.append((len(raw), int((end - lo).sum()), len(lo)))
            n = np.array(facts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array(whole, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()), *(pa.array(n[:, k].copy()) for k in range(3))], ["rest", "text", "kept", "n_bytes", "n_removed", "n_spans"])

    out = joined.mapInArrow(strip, shape)
    place = {f.name: F.col(f"rest.c{k}") for k, f in enumerate(others)} | {text: F.col("text")}
    return out.select(*(place[c].alias(c) for c in docs.columns if c in place), "kept", "n_bytes", "n_removed", "n_spans")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what remove_repeats keeps as their text, and n_removed; halves of characters at an edge are left out.

    Null and empty texts stay as they are. Of rows with one text all lose the same, so a long text that repeats is emptied in all
    its rows. Columns may have any names but those of the result; an empty table gives none.
    """
    cleaned = remove_repeats(docs, text)
    whole = F.col("kept").cast("string")
    valid = F.when(F.is_valid_utf8(whole), whole).otherwise(F.translate(F.make_valid_utf8(whole), "\ufffd", ""))
    return cleaned.withColumn(text, F.when(F.col(text).isNull() | (F.col("n_removed") == 0), F.col(text)).otherwise(valid)).drop("kept", "n_bytes", "n_spans")


def digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from remove_repeats."""
    return cleaned.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
