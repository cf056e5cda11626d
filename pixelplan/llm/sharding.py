"""Shards and slots from a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .text import mix

SHARDS = 24
#: Rounds of the permutation, and the key that makes another shuffle.
ROUNDS = 6
KEY = 20240229

_INDEX_BITS = 33


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n - 1, computed for each number alone.

    Halves of equal width make a permutation of the least power of 4 that holds n; a number that lands at n or
    above is permuted again until it lands below, which it must, as it is on a cycle that began below.
    """
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walking] = left << half | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with row_number (0 to n - 1, in this order over the whole table), and n.

    The rows are dealt by ranges of the order, which a tie-breaker makes unique, so that equal keys can lie in
    several ranges; they are kept there once, and each then has its range's offset plus its place in it. Only
    the ranges' sizes go through the driver. Rows equal in all of the order are numbered in any way, nulls
    come first, an empty table has no rows and n is 0. Names that begin with an underscore are for this function: df must have none.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _INDEX_BITS)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_p long, _start long")
    numbered = kept.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return numbered.withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))).drop("_p", "_start", "_at"), total


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """One row for each row of docs: its id, size, text_crc32, row_number, shard and slot.

    Rows are numbered in order of id and then of the text's checksum and size, so the result depends on the
    rows only and not on how they are stored. Number r of n goes to place permute(r, n), which is slot
    place // shards of shard place % shards: the shards' row counts differ by one at most and slots have no
    gaps. Null texts have 0 bytes and the checksum of none; null ids come first; repeated rows have places of
    their own. Other columns are not read.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered, total = number_rows(slim, "id", "text_crc32", "size")

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, key))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def digest(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from assign_shards."""
    return assigned.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
