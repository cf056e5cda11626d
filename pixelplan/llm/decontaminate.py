"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window holds all its shingles, so of its shingles in order of rarity the necessary prefix is the first: each
window is joined by its rarest shingle alone, bounded by place and length, and then compared word by word. Both
sides are tables: items become windows in tasks, rarity is counted in one pass over the texts, and only places
whose shingle passes a bitmap of bounded size are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .text import expand, shingles, slices, utf8, word_hashes, word_spans

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Words of the shingles that are ordered by rarity (fewer in a window of fewer words).
SHINGLE = 3
#: Bits of the bitmap of shingles: so many for each, within these bounds; the largest is 16 MB.
BITS_EACH = 256
LEAST_BITS, MOST_BITS = 16, 27
_PART_BITS = 16

_BEFORE = WINDOW - SHINGLE
_AROUND = _BEFORE + WINDOW


def item_windows(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each row: their row, where they begin and how many words they have."""
    many = np.diff(first)
    size = np.minimum(many, WINDOW)
    row, start = expand(first[:-1], np.where(size > 0, many - size + 1, 0))
    return row, start, size[row]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 17):
        words, first = word_hashes(*utf8(batch["text"]))
        row, start, size = item_windows(words, first)
        _, at = expand(start, size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(words[at].view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(row)), lists], ["item", "words"])


def window_shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of windows: window, place in it, size and hash."""
    many = np.diff(first)
    parts = []
    for size in range(1, SHINGLE + 1):
        own = np.flatnonzero(many == size if size < SHINGLE else many >= size)
        which, at = expand(first[:-1][own], many[own] - size + 1)
        window = own[which]
        parts.append((window, at - first[:-1][window], np.full(len(at), size), shingles(words, size)[at]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = np.asarray(batch["words"].offsets).astype(np.int64)
        words = batch["words"].values.to_numpy().view(np.uint64)
        window, at, size, hashes = window_shingles(words, first)
        take = pa.array(window)
        yield pa.RecordBatch.from_arrays([batch["w1"].take(take), batch["w2"].take(take), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(hashes.view(np.int64))], ["w1", "w2", "place", "size", "shingle"])


class Bitmap:
    """Turns away nearly all hashes that are not in a set: each member has two bits of a map of bounded size."""

    def __init__(self, power: int, bits: np.ndarray):
        self.power, self.bits = power, bits

    def at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> np.uint64(64 - self.power), (hashes >> np.uint64(8)) & np.uint64((1 << self.power) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that may be members."""
        one, two = self.at(hashes)
        held = np.flatnonzero(self.bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
        two = two[held]
        return held[(self.bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(np.bool_)]


def bitmap(members: DataFrame, column: str) -> Broadcast:
    """The bitmap of a column of hashes. Parts of it are made in tasks; what comes to the driver is no larger than the map."""
    count = members.count()
    power = min(MOST_BITS, max(LEAST_BITS, int(max(1, count * BITS_EACH) - 1).bit_length()))
    part = min(power, _PART_BITS)
    h = F.col(column)
    one, two = F.shiftrightunsigned(h, 64 - power), F.shiftright(h, 8).bitwiseAND(F.lit((1 << power) - 1))
    slots = members.select(F.explode(F.array(one, two)).alias("slot")).distinct()
    parts = slots.groupBy(F.shiftright("slot", part).alias("part")).agg(F.collect_list(F.col("slot").bitwiseAND(F.lit((1 << part) - 1)).cast("int")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch["at"]:
                bits = np.zeros(1 << part, np.bool_)
                bits[at.values.to_numpy()] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(out, pa.binary())], ["part", "bits"])

    bits = np.zeros(1 << power >> 3, np.uint8)
    for r in parts.mapInArrow(pack, "part long, bits binary").toLocalIterator():
        begin = r["part"] << part >> 3
        bits[begin : begin + (1 << part >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return members.sparkSession.sparkContext.broadcast(Bitmap(power, bits))


def _standing(words: np.ndarray, first: np.ndarray, sizes: list[int], bits: Bitmap) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of shingle the row, first word and hash of the places whose shingle may be a member."""
    for size in sizes:
        hashes = shingles(words, size)
        at = bits.find(hashes)
        row = np.searchsorted(first, at, "right") - 1
        inside = at + size <= first[row + 1]
        yield row[inside], at[inside], hashes[at[inside]]


def _counted(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: Bitmap) -> Iterator[pa.RecordBatch]:
    """In how many texts of a slice each shingle stands."""
    for batch in slices(batches, "text"):
        words, first = word_hashes(*utf8(batch["text"]))
        for row, _, hashes in _standing(words, first, sizes, bits):
            order = np.lexsort((row, hashes))
            row, hashes = row[order], hashes[order]
            fresh = np.ones(len(row), np.bool_)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            own, n = np.unique(hashes[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["shingle", "n"])


def _places(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: Bitmap) -> Iterator[pa.RecordBatch]:
    """The places where a window may stand, each with the words around it: zero outside of the text."""
    for batch in slices(batches, "text"):
        words, first = word_hashes(*utf8(batch["text"]))
        padded = np.concatenate([np.zeros(_BEFORE, np.uint64), words, np.zeros(WINDOW, np.uint64)])
        for row, at, hashes in _standing(words, first, sizes, bits):
            for k in range(0, len(row), 1 << 13):
                r, a = row[k : k + (1 << 13)], at[k : k + (1 << 13)]
                around = padded[a[:, None] + np.arange(_AROUND)].view(np.int64).ravel()
                take = pa.array(r)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(around) + 1, _AROUND, dtype=np.int32)), pa.array(around))
                yield pa.RecordBatch.from_arrays(
                    [batch["h1"].take(take), batch["h2"].take(take), pa.array(first[r + 1] - first[r]), pa.array(a - first[r]), pa.array(hashes[k : k + (1 << 13)].view(np.int64)), lists],
                    ["h1", "h2", "n_words", "at", "shingle", "around"],
                )


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch["id"], batch["h1"], batch["h2"], pa.array(np.diff(word_spans(*utf8(batch["text"]))[3]))], ["id", "h1", "h2", "n_words"])


def rarest(held: DataFrame, frequency: DataFrame) -> DataFrame:
    """Of each window (w1, w2) the shingle that the fewest texts have, of equals the first; windows with a shingle of no text are left out."""
    known = held.join(frequency, "shingle", "left").groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("least"))
    return known.where("least.n > 0").select("w1", "w2", "least.place", "least.shingle")


def _hit_texts(known: DataFrame, bench: DataFrame, item_id: str, item_text: str) -> DataFrame | None:
    """For each distinct text (h1, h2) of known in which a window stands: n_words, n_hit, n_items, items; None if there is no window."""
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    every = items.mapInArrow(_windows, "item string, words array<long>").withColumns({"w1": F.xxhash64("words"), "w2": F.xxhash64(F.lit("b"), "words")})
    windows = cut(every.groupBy("w1", "w2").agg(F.first("words").alias("words")))
    held = cut(windows.mapInArrow(_shingled, "w1 long, w2 long, place int, size int, shingle long"))
    sizes = sorted(r["size"] for r in held.select("size").distinct().collect())  # 1 to 3
    if not sizes:
        return None
    bits = bitmap(held.select("shingle").distinct(), "shingle")
    counted = known.select("text").mapInArrow(lambda batches: _counted(batches, sizes, bits.value), "shingle long, n long")
    # Small sides are kept before a join: so each side is a shuffle of its own, of which Spark splits the hot partitions.
    frequency = cut(counted.groupBy("shingle").agg(F.sum("n").alias("n")))
    prefix = cut(rarest(held, frequency).join(windows, ["w1", "w2"]).withColumn("size", F.size("words")))
    chosen = bitmap(prefix.select("shingle").distinct(), "shingle")
    places = known.select("h1", "h2", "text").mapInArrow(lambda batches: _places(batches, sizes, chosen.value), "h1 long, h2 long, n_words long, at long, shingle long, around array<long>")
    start = F.col("at") - F.col("place")
    bounded = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    equal = F.slice("around", F.lit(_BEFORE + 1) - F.col("place"), F.col("size")) == F.col("words")
    found = cut(places.join(prefix, "shingle").where(bounded & equal).select("h1", "h2", "n_words", start.alias("start"), "size", "w1", "w2").distinct())
    spans = found.select("h1", "h2", "n_words", "start", "size").distinct()
    words = spans.select("h1", "h2", "n_words", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).distinct()
    hit = words.groupBy("h1", "h2").agg(F.first("n_words").alias("n_words"), F.count("*").alias("n_hit"))
    pairs = cut(every.select("w1", "w2", "item").distinct())
    own = found.select("h1", "h2", "w1", "w2").distinct().join(pairs, ["w1", "w2"]).select("h1", "h2", "item").distinct()
    own = own.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return cut(hit.join(own, ["h1", "h2"]).withColumn("n_items", F.size("items").cast("long")))


def _named(text):
    """Two hashes that a text is known by."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("b"), text)}


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_words, n_hit, n_items, items (sorted ids of items of which a window stands in it).

    A window is 13 consecutive words of an item, or all words of a shorter one; a word of a text within any
    occurrence of a window is hit. Shingles are ordered by the number of rows of docs that have them. Words are
    told apart by 64-bit hashes, texts by 128 bits.

    Null and empty texts and items have no words and no windows; an item's null id reads as an empty
    string. Items with equal windows all count; repeated rows each get their own result, whatever their ids. Other
    columns are not read, so names that clash do not matter. Empty tables of either kind are no fault.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumns(_named(F.col("text")))
    hit = _hit_texts(rows.where("text is not null"), bench, item_id, item_text)
    sized = rows.mapInArrow(_counted_words, f"id {rows.schema['id'].dataType.simpleString()}, h1 long, h2 long, n_words long")
    none = F.array().cast("array<string>")
    if hit is None:
        out = sized.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items"))
    else:
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_hit", "n_items")}
        out = sized.join(hit.drop("n_words"), ["h1", "h2"], "left").withColumns(zero | {"items": F.coalesce("items", none)}).select("id", "n_words", "n_hit", "n_items", "items")
    return out.withColumnRenamed("id", id_col)


def contaminated():
    """By the contract's rule: a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not contaminated; null texts stay.

    Repeated rows stay or go each; a benchmark without rows or words drops nothing, an empty table gives none. Columns may have
    any names.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")).withColumns(_named(F.col(f"row.`{text}`")))
    known = rows.select("h1", "h2", F.col(f"row.`{text}`").alias("text")).where("text is not null")
    hit = _hit_texts(known, bench, item_id, item_text)
    if hit is None:
        return docs
    return rows.join(cut(hit.where(contaminated()).select("h1", "h2")), ["h1", "h2"], "left_anti").select("row.*").toDF(*columns)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from find_contamination."""
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256)).withColumn("contaminated", contaminated()).drop("items")
