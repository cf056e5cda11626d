"""Repair of conversations: the cheapest edits that give (system)? (user assistant)+, by a DP shared along a trie of signatures.

Rows become a narrow table with a number each, in the order of conversations and turns; a conversation is cut at numbers
into blocks, so none is one task however long. A block's signature has one letter a row for role and fault.
Signatures are read from the last row on and sorted; what two neighbours share is a path of one trie, whose layers
(the cost to go from each state) are computed once, and a signature's edits are read off along its path at its end.
Blocks of one conversation are tied together by scans over their costs and states.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import slices

#: Rows of a block, and parts of a conversation that one group of a scan holds.
BLOCK = 1024
FAN = 1024
#: Costs of the edits, and of leaving a truncated row in.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

_SPACE = " \t\n\x0b\x0c\r"
# States: nothing yet, after a system's, a user's, an assistant's row; the state after the next user's or assistant's row,
# after a row that is kept, and the cost to go at the end.
_NEXT = (2, 2, 3, 2)
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
_END = (0, 2 * INSERT, INSERT, 0)
_NEVER = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults put in, by crc32(`conv_id:turn`) % 20, nulls of which are one space.

    0 drops the row (here: gone is true, role and text are null), 1 empties the text, 2 takes . ! ? out, 3 repeats
    the row, 4 makes the user speak. Null roles and texts become one space first. conv names the conversation
    by a string that is never null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("_d"))
    conv = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).when(F.col("_d") > 0, F.col("text"))
    role = F.when(F.col("_d") == 4, "user").when(F.col("_d") > 0, F.col("role"))
    out = rows.select(conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def undamaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as they are, in the shape of damaged()."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"), "turn", said("role"), said("text"), F.lit(False).alias("gone"))


def _same() -> Column:
    """What tells apart rows of one turn, and finds rows that were there before: their order is by this digest."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows that are left, narrow: conv, turn, same, mark (letter of role and fault), number, in order of conversations and turns.

    Numbers come from range partitions and their sizes. Equal rows are told apart for the partitioning only, so not even
    they must share a task.
    """
    bare = F.trim(F.col("text"), F.lit(_SPACE))
    role = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    mark = F.when(bare == "", F.concat(F.lit("b"), role)).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), F.concat(F.lit("."), role)).otherwise(F.concat(F.lit("t"), role))
    order = ["conv", "turn", "same", "_any"]
    narrow = rows.where("not gone").select("conv", F.col("turn").cast("long").alias("turn"), _same().alias("same"), mark.alias("mark")).withColumn("_any", F.monotonically_increasing_id())
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_any")
    placed = scratch.keep("placed", placed.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = {p: n for p, n in placed.groupBy("_part").count().collect()}  # one row a partition
    begin = np.cumsum([0, *(sizes[p] for p in sorted(sizes))])
    starts = rows.sparkSession.createDataFrame(list(zip(sorted(sizes), begin.tolist(), strict=False)), "_part int, _start long")
    number = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").select("conv", "turn", "same", "mark", number.alias("number"))


def _blocks(numbered: DataFrame, block: int) -> DataFrame:
    """conv, at, signature and what adds up over a conversation: its rows in runs of at most `block`.

    A block's last row is also sent to the next block, which needs it for pairs of roles and repeated turns.
    """
    first = numbered.groupBy("conv", "same").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    at = F.floor(F.col("number") / F.lit(block)).cast("long")
    fault, role = F.substring("mark", 1, 1), F.substring("mark", 2, 1)
    letter = F.when(fault == "b", "b").when(F.col("first").isNull(), "d").when(fault == "t", F.upper(role)).otherwise(role)
    rows = numbered.join(first, "number", "left").select("conv", "number", "turn", role.alias("role"), letter.alias("letter"), F.explode(F.when((F.col("number") + 1) % block == 0, F.array(at, at + 1)).otherwise(F.array(at))).alias("at"))
    held = rows.groupBy("conv", "at").agg(F.array_sort(F.collect_list(F.struct("number", "turn", "role", "letter"))).alias("all")).where(F.get("all", F.size("all") - 1)["number"] >= F.col("at") * block)
    own = F.filter("all", lambda x: x["number"] >= F.col("at") * block)
    before = F.when(F.col("all")[0]["number"] < F.col("at") * block, F.col("all")).otherwise(F.concat(F.array(F.lit(None).cast("struct<number:bigint,turn:bigint,role:string,letter:string>")), "all"))
    held = held.select("conv", "at", own.alias("own"), F.slice(before, 1, F.size("own")).alias("before"), F.array_join(F.transform(own, lambda x: x["letter"]), "").alias("signature"))
    pairs = F.arrays_zip(F.col("before").alias("p"), F.col("own").alias("q"))
    many = lambda condition: F.size(F.filter(pairs, condition)).cast("long")
    has = lambda letters: (F.length("signature") - F.length(F.translate("signature", letters, ""))).cast("long")
    legal = lambda x: F.concat(x["p"]["role"], x["q"]["role"]).isin("su", "ua", "au")
    return held.select(
        "conv", "at", "signature", has("b").alias("blank"), has("d").alias("duplicate"), has("SUAO").alias("truncated"),
        many(lambda x: x["p"].isNotNull() & ~legal(x)).alias("illegal"), many(lambda x: x["q"]["turn"].isNotNull() & ~F.coalesce(x["p"]["turn"].eqNullSafe(x["q"]["turn"]), F.lit(False))).alias("turns"),
        F.array_min(F.transform("own", lambda x: x["turn"])).alias("low"), F.array_max(F.transform("own", lambda x: x["turn"])).alias("high"),
    )


def before(letter: str, after: tuple) -> tuple:
    """The layer before a row: the cost to go from each state, from the layer after it."""
    held = []
    for state in range(4):
        best = DELETE + after[state]
        if letter != "x":
            extra, to = TRUNCATED * letter.isupper(), _KEPT[letter.lower()][state]
            best = min(best, REROLE + extra + after[_NEXT[state]], best if to is None else extra + after[to])
        held.append(best)
    user, assistant = min(held[2], INSERT + held[3]), min(held[3], INSERT + held[2])
    return min(held[0], INSERT + user), min(held[1], INSERT + user), user, assistant


def walked(layers: list[tuple], letters: str, state: int, last: bool) -> tuple[int, str]:
    """The cheapest edits from a state on, of equal ones the least in ASCII, and the state that they end in.

    layers: the last letter's first. At each step the least letter that loses nothing is right: no edits of equal cost
    are the beginning of others.
    """
    edits, k = [], len(letters)
    for letter in letters:
        now, after = layers[k], layers[k - 1]
        k -= 1
        while now[state] != DELETE + after[state] and now[state] == INSERT + now[_NEXT[state]]:
            edits.append("I")
            state = _NEXT[state]
        to = None if letter == "x" else _KEPT[letter.lower()][state]
        extra = TRUNCATED * letter.isupper()
        if now[state] == DELETE + after[state]:
            edits.append("D")
        elif to is not None and now[state] == extra + after[to]:
            edits.append("K")
            state = to
        else:
            edits.append("R")
            state = _NEXT[state]
    while last and layers[0][state]:
        edits.append("I")
        state = _NEXT[state]
    return state, "".join(edits)


_ASKED = "ends array<long>, reversed string, last boolean, starts array<int>"
_SOLVED = f"{_ASKED}, costs array<long>, answers array<struct<start: int, stop: int, edits: string, cost: long>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for sorted (ends, reversed signature): the stack holds the layers of the path to the present signature."""
    ends, path, layers = None, "", []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if tuple(row["ends"]) != ends:
                ends, path = tuple(row["ends"]), ""
                layers = [ends]
            shared = len(os.path.commonprefix([path, row["reversed"]]))
            del layers[shared + 1 :]
            for letter in row["reversed"][shared:]:
                layers.append(before(letter, layers[-1]))
            path = row["reversed"]
            answers = []
            for start in row["starts"]:
                stop, edits = walked(layers, path[::-1], start, row["last"])
                answers.append({"start": start, "stop": stop, "edits": edits, "cost": layers[-1][start] - (0 if row["last"] else ends[stop])})
            out.append({**row, "costs": list(layers[-1]), "answers": answers})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.string()), ("cost", pa.int64())]))
        yield pa.RecordBatch.from_pylist(out, pa.schema([("ends", pa.list_(pa.int64())), ("reversed", pa.string()), ("last", pa.bool_()), ("starts", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("answers", kind)]))


def solved(asked: DataFrame) -> DataFrame:
    """costs and answers of distinct signatures (ends, reversed, last, starts): sorted, so neighbours share their path in the trie."""
    order = ["ends", "reversed", "last", "starts"]
    return asked.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_solve, _SOLVED)


def _scan(parts: DataFrame, scratch: Scratch, name: str, compose: Callable, apply: Callable, start: tuple, backwards: bool, fan: int) -> DataFrame:
    """For parts (conv, at, part) of sequences: outer, what start becomes by all parts after (or before) each, in order.

    Parts are put together in groups of `fan` until no sequence has more, and the results handed down again.
    """

    def whole(table: pd.DataFrame) -> pd.DataFrame:
        rows = table.sort_values("at")
        total = None
        for part in rows["part"]:
            total = list(part) if total is None else compose(total, list(part))
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "at": rows["at"].iloc[:1] // fan, "part": [total]})

    def handed(table: pd.DataFrame) -> pd.DataFrame:
        rows = table.sort_values("at", ascending=not backwards)
        now, out = list(rows["outer"].iloc[0]), []
        for part in rows["part"]:
            out.append(now)
            now = apply(list(part), now)
        return pd.DataFrame({"conv": rows["conv"].to_numpy(), "at": rows["at"].to_numpy(), "outer": out})

    levels, above = [parts], F.floor(F.col("at") / F.lit(fan)).cast("long").alias("above")
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > fan:
        up = levels[-1].groupBy("conv", above).applyInPandas(lambda t: whole(t), "conv string, at long, part array<long>")
        levels.append(scratch.keep(f"{name}_{len(levels)}", up))
    found = levels.pop().withColumn("outer", F.array(*map(F.lit, start)).cast("array<long>")).groupBy("conv").applyInPandas(handed, "conv string, at long, outer array<long>")
    while levels:
        given = found.select("conv", F.col("at").alias("above"), "outer")
        found = levels.pop().withColumn("above", above).join(given, ["conv", "above"]).groupBy("conv", "above").applyInPandas(handed, "conv string, at long, outer array<long>")
    return found


def _product(a: list, b: list) -> list:
    """Costs through two blocks, from each state to each."""
    x, y = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), _NEVER).ravel().tolist()


def _through(part: list, after: list) -> list:
    return (np.reshape(part, (4, 4)) + np.asarray(after)[None, :]).min(axis=1).tolist()


def _edits(blocks: DataFrame, scratch: Scratch, fan: int) -> DataFrame:
    """edits and cost of each block (conv, at), in the cheapest repair of its whole conversation."""
    reversed_ = F.reverse(F.translate("signature", "bd", "xx")).alias("reversed")
    several = blocks.groupBy("conv").agg(F.min("at").alias("_first"), F.max("at").alias("_last")).where("_first < _last")
    end, every = F.array(*map(F.lit, _END)).cast("array<long>"), F.array(*map(F.lit, range(4)))
    one = blocks.join(several, "conv", "left_anti").select("conv", "at", end.alias("ends"), reversed_, F.lit(True).alias("last"), F.array(F.lit(0)).alias("starts"))
    long_ = scratch.keep("long", blocks.join(several, "conv").select("conv", "at", reversed_, (F.col("at") == F.col("_first")).alias("first"), (F.col("at") == F.col("_last")).alias("last")))
    if long_.isEmpty():
        asked, starts = one, None
    else:
        # Costs of a block from each state to each: its layers for ends of which one state costs nothing and the others cannot be.
        units = F.array(*(F.array(*(F.lit(0 if i == j else _NEVER) for j in range(4))).cast("array<long>") for i in range(4)))
        ask = long_.select(F.explode(units).alias("ends"), "reversed", F.lit(False).alias("last"), F.array().cast("array<int>").alias("starts"))
        columns = F.array_sort(F.collect_list(F.struct(F.array_position("ends", F.lit(0).cast("long")).alias("to"), "costs")))
        cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.transform("columns", lambda c: F.least(F.get(c["costs"], s), F.lit(_NEVER)))))
        tables = solved(ask).groupBy("reversed").agg(columns.alias("columns")).select("reversed", cells.alias("part"))
        parts = scratch.keep("parts", long_.join(tables, "reversed").select("conv", "at", "part"))
        ends = _scan(parts, scratch, "costs", _product, _through, _END, True, fan)
        least = F.array_min("outer")
        ends = ends.select("conv", "at", F.transform("outer", lambda x: x - least).alias("ends"))
        rest = scratch.keep("ends", long_.join(ends, ["conv", "at"]).select("conv", "at", "ends", "reversed", "last", F.when(F.col("first"), F.array(F.lit(0))).otherwise(every).alias("starts")))
        asked, starts = scratch.keep("asked", one.unionByName(rest)), rest
    answers = asked.join(solved(asked), ["ends", "reversed", "last", "starts"]).select("conv", "at", "answers")
    if starts is None:
        return answers.select("conv", "at", F.col("answers")[0]["edits"].alias("edits"), F.col("answers")[0]["cost"].alias("cost"))
    answers = scratch.keep("answers", answers)
    # The state that each block begins in: what the blocks before it make of the first state.
    stops = answers.join(starts.select("conv", "at"), ["conv", "at"]).select("conv", "at", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.coalesce(F.get(F.transform(F.filter("answers", lambda x: x["start"] == s), lambda x: x["stop"]), F.lit(0)), F.lit(0)).cast("long")).alias("part"))
    begun = _scan(scratch.keep("stops", stops), scratch, "states", lambda a, b: [b[s] for s in a], lambda f, s: [f[s[0]]], (0,), False, fan)
    picked = answers.join(begun, ["conv", "at"], "left").withColumn("answer", F.filter("answers", lambda x: x["start"] == F.coalesce(F.col("outer")[0], F.lit(0)))[0])
    return picked.select("conv", "at", F.col("answer.edits").alias("edits"), F.col("answer.cost").alias("cost"))


_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns", "cost")
_OUT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation of the stream: its blocks' sums and edits come first, then its rows in order."""

    def __init__(self, conv: str):
        self.conv, self.sums, self.pieces = conv, dict.fromkeys(_SUMS, 0), []
        self.low = self.high = self.edits = None
        self.at, self.expected, self.hash, self.empty = 0, "user", hashlib.sha256(), True

    def block(self, row: dict) -> None:
        for name in _SUMS:
            self.sums[name] += row[name]
        self.pieces.append(row["edits"])
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else min(self.low, row["low"])
            self.high = row["high"] if self.high is None else max(self.high, row["high"])

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        self.expected = "assistant" if role[0] == "u" else "user"

    def inserted(self) -> None:
        if self.edits is None:
            self.edits = "".join(self.pieces)
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.say(self.expected, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self.say(role if edit == "K" else self.expected, text)

    def result(self) -> dict:
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv": self.conv, "gaps": gaps, **{n: self.sums[n] for n in _SUMS if n != "turns"}, "audit": self.edits, "repaired_sha256": self.hash.hexdigest()}


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations, of rows sorted by conv, kind (blocks first), at, turn, same."""
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split(" ") for x in _OUT.split(", "))])
    now, done = None, []
    for batch in slices(batches, "text"):
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv:
                done += [now.result()] if now else []
                now = _Conversation(row["conv"])
            if row["kind"] == 0:
                now.block(row)
            elif row["role"] is not None:
                now.row(row["role"], row["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.result()], schema)


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each conversation: its faults, and the cheapest edits that give it roles (s?(ua)+)? by their initials.

    rows is of damaged() or undamaged(). Rows are taken by turn, nulls first; those of one turn by the digest of role and
    text. Each row's first fault counts: blank (white space only), duplicate (role and text were there before),
    truncated (the last character that is no white space is not . ! ?). K keeps a row, R makes it a user's or
    assistant's (2), D deletes it (3; a must for blank and duplicate rows), I inserts an empty user's or
    assistant's row (2); a truncated row that stays adds 1. Of equal costs the edits least in ASCII count.

    Returns conv_id, gaps (turns missing between the first and the last, nulls aside), blank, duplicate, truncated, illegal
    (adjacent initials other than su, ua, au), cost, audit (the edits' initials) and repaired_sha256 (of
    `role:text`, joined by newlines). A conversation without rows has zeros, no edits and the digest of nothing.
    A row whose role's initial is not s, u or a cannot be kept; an empty role has none. Null conv_ids are one
    conversation. Repeated rows are duplicates. An empty table gives none; only the four columns are read, so others
    may have any names.

    Texts are shuffled once, for the digest alone, which is serial by its nature: it takes its conversation's rows in a
    stream of bounded memory. All else of a long conversation is done block by block.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    blocks = scratch.keep("blocks", _blocks(_numbered(rows, scratch), block))
    scratch.drop("placed")
    edits = _edits(blocks, scratch, fan)
    told = blocks.join(edits, ["conv", "at"]).select("conv", F.lit(0).alias("kind"), "at", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("same"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_SUMS, "low", "high", "edits")
    none = lambda c: F.lit(None).cast("string" if c == "edits" else "long").alias(c)
    texts = rows.select("conv", F.lit(1).alias("kind"), none("at"), F.col("turn").cast("long").alias("turn"), _same().alias("same"), "role", "text", *map(none, (*_SUMS, "low", "high", "edits")))
    order = ["conv", "kind", "at", "turn", "same"]
    return told.unionByName(texts).repartition("conv").sortWithinPartitions(*order).drop("turn", "same").mapInArrow(_told, _OUT)


def digest(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """repair() of damaged() conversations, by conv_id of the table's own type."""
    found = repair(damaged(conversations), block, fan)
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv").startswith("+"), F.col("conv").substr(F.lit(2), F.length("conv"))).cast(kind)
    return found.select(conv_id.alias("conv_id"), *found.columns[1:])
