"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets, bands and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import expand, mix, packed, shingles, slices, unpacked, utf8, word_hashes

#: Words of a shingle, and the weighted Jaccard similarity from which two texts are linked.
SHINGLE = 5
SIMILARITY = 0.8
#: 36 bands of 7 slots: texts of similarity 0.8 share a band with probability 0.9998, of 0.4 with 0.06.
BANDS = 36
ROWS = 7
#: Bytes and rows of text that are signed at once, and parts that a node's lookups are dealt to in components.
SIGNED_BYTES = 1 << 18
SIGNED_ROWS = 1024
SALT = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OCCURRENCE = np.uint64(0xC2B2AE3D27D4EB4F)


def multisets(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles and how often each stands in it: row, hash and count, sorted by row and hash."""
    hashes = shingles(words, size)
    row = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
    inside = np.arange(len(hashes)) + size <= first[row + 1]
    row, hashes = row[inside], hashes[inside]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(hashes) != 0)])) if len(row) else np.zeros(0, np.int64)
    return row[fresh], hashes[fresh], np.diff(np.concatenate([fresh, [len(row)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """BagMinHash: for each row and slot the earliest point of its elements' Poisson processes; infinite for no element.

    The weight axis is cut at 1, 2, 4, 8 ...; each interval of each element has a process of its own, whose
    rate is the interval's length, and whose points also have a height in the interval and a slot. A bag has
    the points below its weights. The last interval of a weight may reach beyond it: only points that are low
    enough count there, and none has to be made for each unit of weight. Points come in order of time, and an
    interval is done when its next point is later than all slots of its row. Two bags agree in a slot with the
    probability of their weighted Jaccard similarity.
    """
    level = np.ceil(np.log2(weight)).astype(np.int64)
    level[weight == 1] = 0
    node, k = expand(np.zeros(len(level), np.int64), level + 1)  # intervals (0, 1], (1, 2], (2, 4], ...
    low = np.where(k == 0, 0, 2.0 ** (k - 1))
    width = np.where(k == 0, 1, low)
    part = np.minimum(1.0, (weight[node] - low) / width)
    seed, owner, rate = mix(hashes[node] ^ mix(k.astype(np.uint64) + _OCCURRENCE)), row[node], width * slots
    out = np.full(rows * slots, np.inf)
    # A row needs about slots * (ln slots + 1) points in all: so many are made at once for each interval.
    total = np.bincount(row, weights=weight, minlength=rows)
    batch = 1 << np.clip(np.ceil(np.log2(slots * 5.0 / np.maximum(total, 1))), 0, 9).astype(np.int64)
    for many in np.unique(batch[np.unique(owner)]) if len(owner) else []:
        time, done = np.zeros(len(seed)), 0
        live = np.flatnonzero(batch[owner] == many)
        while len(live):
            for piece in np.array_split(live, max(1, len(live) * int(many) >> 18)):
                j = (np.arange(many, dtype=np.uint64) + np.uint64(done + 1)) * _STEP
                point = mix(seed[piece][:, None] + j[None, :])
                gap = -np.log(_uniform(point)) / rate[piece][:, None]
                gap[:, 0] += time[piece]
                at = np.cumsum(gap, axis=1)  # one after another, so that every split of the rounds gives equal sums
                time[piece] = at[:, -1]
                other = mix(point ^ _OCCURRENCE)
                counts = np.broadcast_to((part[piece] >= 1)[:, None], at.shape) | (_uniform(mix(other + _STEP)) <= part[piece][:, None]) if (part[piece] < 1).any() else np.True_
                cell = owner[piece][:, None] * slots + (other % np.uint64(slots)).astype(np.int64)
                good = np.broadcast_to((at < out[cell]) & counts, at.shape)
                np.minimum.at(out, cell[good], at[good])
            done += int(many)
            latest = out.reshape(rows, slots).max(axis=1)
            live = live[time[live] < latest[owner[live]]]
    return out.reshape(rows, slots)


def bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, k])
    return out


def _signed(batches: Iterator[pa.RecordBatch], n_bands: int, n_rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each row its text's number of shingles and its bands; null for all but the first of equal texts of a slice."""
    for batch in slices(batches, "text", SIGNED_BYTES, SIGNED_ROWS):
        names = np.column_stack([batch["h1"].to_numpy(), batch["h2"].to_numpy()])
        fresh = np.sort(np.unique(names, axis=0, return_index=True)[1])
        row, hashes, weight = multisets(*word_hashes(*utf8(batch["text"].take(pa.array(fresh)))), size)
        own = np.unique(row)
        keys = bands(signatures(np.searchsorted(own, row), hashes, weight, len(own), n_bands * n_rows), n_bands, n_rows)
        n, many = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        n[fresh] = np.bincount(row, weights=weight, minlength=len(fresh))
        many[fresh[own]] = n_bands
        offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)), mask=pa.array(many == 0))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "h1", "h2")), pa.array(n, mask=many == 0), lists], ["id", "h1", "h2", "n", "keys"])


def _bags(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each packed text's multiset as a set: the k-th copy of a shingle is an element of its own, of 32 bits."""
    for batch in unpacked(batches, "text"):
        row, hashes, weight = multisets(*word_hashes(*utf8(batch["text"])), size)
        which, copy = expand(np.zeros(len(weight), np.int64), weight)
        element = (mix(hashes[which] + copy.astype(np.uint64) * _OCCURRENCE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        offsets = np.searchsorted(row[which], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch["node"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(element))], ["node", "bag"])


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of edges (a, b): node, root, the smallest node; nodes without an edge are left out.

    Alternates two steps on the whole set of edges (a above b): every larger neighbour of a node is linked to the
    smallest node around, then every smaller one is, until each root has a star. Edges are kept dealt by their
    larger node, which has few of them; the smaller one, which may have very many, is only looked up, with a salt.
    A round's edges are removed once those of the next are written. Raises if `most` rounds do not settle; the
    rounds number about the logarithm of the longest chain, and nothing is dropped.
    """
    scratch = scratch or Scratch(edges.sparkSession, name)
    now = scratch.keep(f"{name}0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").repartition("a").distinct())
    before = _sums(now)
    for k in range(1, most + 1):
        # The smallest node around b is its own smallest smaller neighbour, or b: a is linked to it instead of to b.
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        dealt = least.select(F.col("a").alias("b"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        large = now.withColumn("salt", F.pmod(F.hash("a"), F.lit(SALT))).join(dealt, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")).repartition("a").distinct()
        # Then all smaller neighbours of a, and a, are linked to the smallest of them.
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        links = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = scratch.keep(f"{name}{k}", small.select(F.explode(links).alias("e")).select("e.a", "e.b").where("a <> b").repartition("a").distinct())
        scratch.drop(f"{name}{k - 1}")
        sums = _sums(now)
        if sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = sums
    raise RuntimeError(f"components did not settle in {most} rounds")


def _sums(edges: DataFrame) -> tuple:
    """Tells whether two sets of edges are the same."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _similar(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    a, b = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    return pairs.join(a, "a").join(b, "b").where(both >= F.lit(similarity) * (F.size("bag_a") + F.size("bag_b") - both)).select("a", "b")


def _prefixes(bags: DataFrame, similarity: float) -> DataFrame:
    """The elements of each bag that two similar bags must have one of in common: node, n, key (element), at (its place).

    Elements are ordered by how many of these bags have them, then by themselves; similar bags share one among
    the first n - similarity * n + 1. Elements of one bag only come first and are needed for the places alone.
    """
    each = bags.select("node", F.size("bag").alias("n"), F.explode("bag").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(shared, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    placed = held.select("node", "n", (F.col("n") - F.size("own")).alias("before"), F.posexplode("own").alias("k", "e"))
    placed = placed.select("node", "n", F.col("e.key").alias("key"), (F.col("before") + F.col("k")).alias("at"))
    return placed.where(F.col("n") - F.col("at") >= F.lit(similarity) * F.col("n") - 1e-9)


def _classes(known: DataFrame, n_bands: int, n_rows: int, size: int, similarity: float) -> DataFrame:
    """For each distinct text of known (id, h1, h2, text without nulls), by its hashes: class_id, class_size and first.

    A text is a node of its own whatever ids it stands under: nodes are numbers given to the distinct texts once. Tables
    of a step are removed when the steps that read them are done.
    """
    scratch = Scratch(known.sparkSession, "minhash")
    kind = known.schema["id"].dataType.simpleString()
    signed = known.mapInArrow(lambda batches: _signed(batches, n_bands, n_rows, size), f"id {kind}, h1 long, h2 long, n long, keys array<long>")
    texts = signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n", True).alias("n"), F.first("keys", True).alias("keys"))
    # Nodes follow the ids, so that the text that came first leads its copies.
    order = [F.col("id").asc_nulls_last(), "h1", "h2"]
    signs = scratch.keep("signs", texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    texts = scratch.keep("texts", signs.select("node", "h1", "h2", "id", "copies"))
    banded = signs.where("keys is not null").select("node", "n", F.explode("keys").alias("key"))
    # Small sides are kept before a join: so each side is a shuffle of its own, of which Spark splits the hot partitions.
    buckets = scratch.keep("buckets", banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other"), F.min_by("n", "node").alias("n_leader")).where("leader < other").drop("other"))
    members = scratch.keep("members", banded.join(buckets, "key"))
    scratch.drop("signs", "buckets")
    needed = members.select("node").distinct().join(texts.select("node", "h1", "h2"), "node")
    once = packed(known.select("h1", "h2", "text"), "text").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    bags = scratch.keep("bags", needed.join(once, ["h1", "h2"]).select("node", "text").mapInArrow(lambda batches: _bags(batches, size), "node long, bag array<int>"))

    near = F.least("n", "n_leader") >= F.lit(similarity) * F.greatest("n", "n_leader")
    tried = members.where(near).where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    edges = scratch.keep("edges", _similar(tried, bags, similarity))
    root = components(edges, scratch)
    rest = _open(members, root, scratch, "torn").select("node").distinct()
    prefixes = scratch.keep("prefixes", _prefixes(bags.join(rest, "node", "left_semi"), similarity))
    scratch.drop("members", "torn")
    for step in ("heads", "all"):
        parts = scratch.keep(f"parts_{step}", _open(prefixes, root, scratch, f"torn_{step}"))
        scratch.drop(f"torn_{step}")
        if parts.isEmpty():
            break
        heads = scratch.keep(f"first_{step}", parts.groupBy("key", "root").agg(F.min("node").alias("head")))
        if step == "all":
            ours = other = parts.join(heads, ["key", "root"]).where("node <> head").drop("head")
        else:
            ours, other = parts, parts.join(heads.withColumnRenamed("head", "node"), ["key", "root", "node"], "left_semi")
        more = scratch.keep(f"edges_{step}", _similar(_candidates(ours, other, similarity), bags, similarity))
        scratch.drop(f"parts_{step}", f"first_{step}")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            root = components(edges, scratch, f"components_{step}_")
    scratch.drop("bags", "prefixes")

    linked = texts.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    head = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "h1", "h2")).alias("head")
    classes = scratch.keep("classes", linked.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), head))
    out = linked.join(classes, "root").select("h1", "h2", "class_id", "class_size", ((F.col("head.h1") == F.col("h1")) & (F.col("head.h2") == F.col("h2"))).alias("first"))
    return scratch.keep("out", out)


def _candidates(ours: DataFrame, other: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots that share an element from which on enough may be in common.

    At their first common element two bags have at most what is left of either in common. That bounds the size of a
    partner from both sides, and sizes go by steps of a twentieth: a row is sent to the steps that its partners may have and
    both steps are keys, so of the many texts that share a passage only those meet that may be similar.
    """
    step = lambda n: F.floor(F.log(1.05, n)).cast("int")
    share = similarity / (1 + similarity)

    def sent(rows: DataFrame, mine: str, theirs: str, s: str) -> DataFrame:
        left = F.col("n") - F.col("at")
        low, high = F.ceil(F.lit(similarity) * F.col("n") - 1e-6), F.floor(F.least(left / F.lit(share) - F.col("n"), F.col("n") / F.lit(similarity)) + 1e-6)
        steps = F.when(high >= low, F.sequence(step(low), step(high))).otherwise(F.array().cast("array<int>"))
        return rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "at")), step(F.col("n")).alias(mine), F.explode(steps).alias(theirs))

    enough = F.least(F.expr("n_a - at_a"), F.expr("n_b - at_b")) >= F.lit(share) * F.expr("n_a + n_b") - 1e-9
    pairs = sent(ours, "step_a", "step_b", "a").join(sent(other, "step_b", "step_a", "b"), ["key", "step_a", "step_b"]).where((F.col("root_a") != F.col("root_b")) & enough)
    return pairs.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _open(members: DataFrame, root: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of members (key, node) with their node's root, of keys whose nodes have several; those keys are kept under name."""
    parts = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = scratch.keep(name, parts.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key"))
    return parts.join(keys, "key", "left_semi")


def _named(text: str):
    """Two hashes that a text is known by."""
    return F.xxhash64(text), F.xxhash64(F.lit("b"), text)


def find_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_bands: int = BANDS, n_rows: int = ROWS, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: its id, class_id (the smallest id of its class) and class_size (rows).

    Texts are linked if the multisets of their runs of `size` words have a weighted Jaccard similarity of at
    least `similarity` (words: runs of letters, digits and non-ASCII characters, A-Z lower-cased); classes are
    what links connect. Equal texts are one class, whatever their ids; different texts under one id are not
    linked by it. A text of fewer words has no shingle and is linked with equal texts only. Null ids are left
    out of class_id, which is null if a class has no other; a null text is a class of its own (class_id: its
    id). Repeated rows share their class and are counted each; other columns are not read, so names that clash
    do not matter. An empty table gives none.

    Candidates are the texts that share a band. In each band's bucket all are compared with the bucket's
    first. Where that leaves unlinked parts, the texts in them are joined by their rarest shingles, which
    similar texts must share, with bounds on what can follow: each part's smallest is compared with the texts
    of other parts, and then what is left between parts. So no pair that shares a band is lost, within a linked
    part not all pairs are made, and between parts only those that may be similar.
    """
    h1, h2 = _named("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumns({"h1": h1, "h2": h2})
    classes = _classes(rows.where("text is not null"), n_bands, n_rows, size, similarity)
    out = rows.where("text is not null").select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "class_id", "class_size")
    bare = rows.where("text is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(bare).withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns as they are, but one of each class of find_classes: the one with the smallest id.

    Rows are told apart by id and text, so different texts under one id are kept or dropped each for itself.
    Of a class without ids, of several similar texts under its smallest id, and of repeated rows, one stays.
    Rows with a null text stay. settings are those of find_classes. Columns may have any names.
    """
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    h1, h2 = _named(f"row.`{text}`")
    rows = docs.select(row.alias("row")).withColumns({"h1": h1, "h2": h2, "own": F.xxhash64(f"row.`{id_col}`")})
    known = rows.where(F.col(f"row.`{text}`").isNotNull())
    given = known.select(F.col(f"row.`{id_col}`").alias("id"), "h1", "h2", F.col(f"row.`{text}`").alias("text"))
    classes = _classes(given, **({"n_bands": BANDS, "n_rows": ROWS, "size": SHINGLE, "similarity": SIMILARITY} | settings))
    first = classes.where("first").select("h1", "h2", F.xxhash64("class_id").alias("own"))
    # Repeated rows are one before the shuffle, and the rows of one text are dealt by their ids: no key is hot.
    single = known.groupBy("h1", "h2", "own").agg(F.first("row").alias("row"))
    kept = single.join(first, ["h1", "h2", "own"], "left_semi").select("row.*")
    return kept.unionByName(rows.where(F.col(f"row.`{text}`").isNull()).select("row.*")).toDF(*columns)
