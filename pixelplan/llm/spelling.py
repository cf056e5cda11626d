"""Words of one spelling apart: dictionaries sorted forwards and backwards, scanned block by block.

One edit leaves a half of a word as it is, so two near words stand in one block of the dictionary sorted by beginnings or of
that sorted by endings. A block is a length m, the range lo <= d < hi of places where its words may first
differ, and the letters that such words then share: lo at the beginning and m - hi at the end. Each pair belongs to
one block only, by its first difference; a large block is cut into two halves of its range, time and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Letters and occurrences that a word needs, and how many times more frequent its form is.
LETTERS = 7
OCCURRENCES = 2
RATIO = 10
#: Words of a block from which on Spark cuts it, and those that are compared one by one in a task.
BLOCK = 4096
FEW = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelled(doc_id: Column, word: Column) -> Column:
    """word without one code point where 31 divides h = crc32(`doc_id:word`): the one at h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased and misspelled() here and there.

    Only words of so many code points and occurrences, over all texts, are returned. Null texts have none, a null id counts
    as empty. Runs that are too short are left out at once: a misspelled word is shorter than its run.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), 0)).alias("run"))
    word = misspelled(F.col("id"), F.translate("run", _UPPER, _LOWER))
    return rows.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _key(word: Column, m: Column, lo: Column, hi: Column) -> Column:
    """The block's name: what its words share, the end read backwards."""
    begin, end = F.substr(word, F.lit(1), lo), F.substr(F.reverse(word), F.lit(1), F.greatest(m - hi, F.lit(0)))
    return F.concat_ws(",", m.cast("string"), lo.cast("string"), hi.cast("string"), begin, end)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where("lo < hi").withColumn("key", _key(*(F.col(c) for c in ("word", "m", "lo", "hi"))))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / F.lit(2)).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.lo", "h.hi"))


def near(a: str, b: str, lo: int, hi: int) -> bool:
    """Is b, which is no shorter, one edit away from a, and is their first difference at lo <= d < hi?"""
    m, d = len(a), lo
    stop = min(hi, m)
    while d < stop and a[d] == b[d]:
        d += 1
    if d == stop:
        return stop < hi and len(b) == m + 1
    return b[d + 1 :] == (a[d + 1 :] if len(b) == m else a[d:])


def pairs_of(words: list[tuple[str, int]], m: int, lo: int, hi: int, few: int = FEW) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """The near pairs of a block; larger ones are cut in halves, down to one place, where few words can share all else."""
    if len(words) <= few or hi - lo == 1:
        short = [w for w in words if len(w[0]) == m]
        for k, a in enumerate(short):
            for b in short[k + 1 :]:
                if near(a[0], b[0], lo, hi):
                    yield a, b
        for a in short:
            for b in words:
                if len(b[0]) > m and near(a[0], b[0], lo, hi):
                    yield a, b
        return
    mid = (lo + hi) // 2
    for x, y in ((lo, mid), (mid, hi)):
        blocks: dict[tuple[str, str], list] = {}
        for w in words:
            word = w[0]
            blocks.setdefault((word[lo:x], word[len(word) - max(m - y, 0) :]), []).append(w)
        for own in blocks.values():
            if len(own) > 1:
                yield from pairs_of(own, m, x, y, few)


def _scanned(batches: Iterator[pa.RecordBatch], few: int) -> Iterator[pa.RecordBatch]:
    """Both directions of each near pair, of rows sorted by block: a block is in mind at a time."""
    names = ["word", "other", "n_other"]
    key, own, m, lo, hi = None, [], 0, 0, 0
    found: tuple[list, list, list] = ([], [], [])

    def scan() -> None:
        if len(own) > 1:
            for (a, n_a), (b, n_b) in pairs_of(own, m, lo, hi, few):
                for column, values in zip(found, ((a, b), (b, a), (n_b, n_a)), strict=True):
                    column.extend(values)

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], names)
        for column in found:
            column.clear()
        return made

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("key", "word", "n", "m", "lo", "hi")]
        for k, word, n, *where in zip(*columns, strict=True):
            if k != key:
                scan()
                key, own, (m, lo, hi) = k, [], where
            own.append((word, n))
        if len(found[0]) > 1 << 14:
            yield out()
    scan()
    yield out()


def near_pairs(words: DataFrame, scratch: Scratch, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """word, other, n_other: every two words (word, n; distinct) that one inserted, deleted or replaced code point parts, both ways.

    A word of L code points stands in the blocks of m = L, with words as long as or one longer than itself, and of m = L - 1. Blocks
    of more than `block` words are cut by Spark until none is left or one place is: so no task holds a large block.
    """
    size, half = F.length("word"), F.floor(F.col("m") / F.lit(2)).cast("int")
    of = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m >= 0")
    ranges = F.array(F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    rows, done, k = _keyed(of.select("word", "n", "m", F.explode(ranges).alias("h")).select("word", "n", "m", "h.lo", "h.hi")), [], 0
    while True:
        large = scratch.keep(f"large{k}", rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > block).select("key"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = scratch.keep(f"cut{k}", _halved(rows.join(large, "key", "left_semi")))
        k += 1
    for own in done:
        rows = rows.unionByName(own)
    # Equal keys are one range: blocks are whole, and of bounded size.
    placed = rows.repartitionByRange("key").sortWithinPartitions("key", "word")
    return placed.select("key", "word", "n", "m", "lo", "hi").mapInArrow(lambda batches: _scanned(batches, few), "word string, other string, n_other long")


def group_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n; distinct words).

    Two words are near if exactly one inserted, deleted or replaced code point parts them. form: the near word of largest n (of equal n
    the least in code-point order), if that n is `ratio` times the word's n or more, else null. root: what forms lead to
    in the end, the word itself if it has none; n grows along them, so they end. n_near counts near words, form_n is the form's
    n or null. Null words are left out, an empty word is a word; an empty table gives none. Other columns are not read.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.keep("words", words.where("word is not null").select("word", F.col("n").cast("long").alias("n")))
    best = near_pairs(words, scratch, block, few).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    has = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    known = scratch.keep("known", known)
    roots, k = known.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:  # each step doubles how far a root looks
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(f"roots{k}", roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if k:
            scratch.drop(f"roots{k - 1}")
        roots, k = step.select("word", "root"), k + 1
        if step.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
