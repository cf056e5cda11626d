"""Segmentation of chips into crowns: peaks, components, watershed and outlines.

Chips, or chunks with a border, are the groups: each has a bounded number of pixels, whatever the image's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept


def components(pixels: DataFrame, key: str, width: int) -> DataFrame:
    """component: the smallest r * width + c among the pixels that 4-neighbours connect within a chip."""

    def label(table: pd.DataFrame) -> pd.DataFrame:
        ids = (table["r"] * width + table["c"]).tolist()
        root = {i: i for i in ids}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i in ids:
            for j in (i + width, i + 1 if (i + 1) % width else -1):
                if j in root:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return pd.DataFrame({key: table[key], "r": table["r"], "c": table["c"], "component": [find(i) for i in ids]})

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.select(key, "r", "c").groupBy(key).applyInPandas(label, f"{key} {kind}, r int, c int, component int")


def _runs(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pixels sorted by rows and columns: the run of neighbours in a row that each is of, and pairs of runs that touch."""
    fresh = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(c) != 1)])
    run = np.cumsum(fresh) - 1
    place = r.astype(np.int64) * (1 << 32) + c
    below = np.searchsorted(place, place + (1 << 32))
    touch = below < len(place)
    touch[touch] = place[below[touch]] == place[touch] + (1 << 32)
    pairs = np.unique(np.column_stack([run[touch], run[below[touch]]]), axis=0)
    return run, pairs[:, 0], pairs[:, 1]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the things 0 to n - 1 that each is connected with by pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def components_across(pixels: DataFrame, width: int, chunk: int) -> DataFrame:
    """component: the smallest r * width + c among the pixels (r, c) of one raster that 4-neighbours connect, of any size.

    Each chunk labels its own pixels. Pixels at its lower and right edges meet their neighbours in the next chunks; these
    contacts are the links of a small graph of labels, whose components rename the labels. So no task holds
    more than a chunk, however far a component reaches. Repeated pixels are one.
    """
    from .graph import connected

    def label(table: pd.DataFrame) -> pd.DataFrame:
        rows = table[["r", "c"]].drop_duplicates().sort_values(["r", "c"])
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        run, a, b = _runs(r, c)
        first = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
        root = joined(len(first), a, b)[run]
        return pd.DataFrame({"r": r, "c": c, "own": r[first[root]].astype(np.int64) * width + c[first[root]]})

    chunks = [F.floor(F.col(x) / F.lit(chunk)).cast("int").alias(f"k_{x}") for x in ("r", "c")]
    own = kept(pixels.select("r", "c", *chunks).groupBy("k_r", "k_c").applyInPandas(label, "r int, c int, own long"))
    edge = lambda at: F.pmod(F.col(at), F.lit(chunk)) == chunk - 1
    ahead = own.where(edge("r")).select((F.col("r") + 1).alias("r"), "c", F.col("own").alias("a")).unionByName(own.where(edge("c")).select("r", (F.col("c") + 1).alias("c"), F.col("own").alias("a")))
    first = own.where((F.pmod("r", F.lit(chunk)) == 0) | (F.pmod("c", F.lit(chunk)) == 0)).select("r", "c", F.col("own").alias("b"))
    root = connected(ahead.join(first, ["r", "c"]).select("a", "b").distinct())
    return own.join(root.withColumnRenamed("node", "own"), "own", "left").select("r", "c", F.coalesce("root", "own").alias("component"))


def _square_best(rows: DataFrame, key: str, reach: int) -> DataFrame:
    """rank of the best (least) rank within reach of each pixel (key, r, c, rank): along rows, then along columns."""
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d")
    wide = rows.select(key, "r", "c", "rank", around).groupBy(key, "r", (F.col("c") + F.col("_d")).alias("c")).agg(F.min("rank").alias("rank"))
    return wide.select(key, "r", "c", "rank", around).groupBy(key, (F.col("r") + F.col("_d")).alias("r"), "c").agg(F.min("rank").alias("best"))


def _flat(inner: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Maxima where a raster is all of one height: only pixels that no cross of five covers, in place of all."""
    box = F.max("r") - F.min("r") + F.max("c") - F.min("c")
    flat = inner.groupBy(key).agg(F.count("*").alias("_n"), box.alias("_box")).join(top.groupBy(key).agg(F.count("*").alias("_tops")), key).where("_n = _tops and _box > 0").select(key)
    flat = kept(flat)
    own = inner.join(flat, key, "left_semi")
    cross = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))).alias("_s")
    reach = lambda rows: rows.select(key, "r", "c", cross).select(key, (F.col("r") + F.col("_s.y")).alias("r"), (F.col("c") + F.col("_s.x")).alias("c"))
    centres = reach(own).groupBy(key, "r", "c").count().where("count = 5").drop("count")
    return top.join(flat, key, "left_anti").unionByName(own.join(reach(centres).distinct(), [key, "r", "c"], "left_anti"))


def spaced_peaks(pixels: DataFrame, key: str, height: int, width: int, threshold: float, min_distance: int) -> DataFrame:
    """The peaks (key, r, c, v) of rasters of this extent, as peaks() finds them, without a group for a raster.

    Maxima come from a separable neighbourhood maximum. Of maxima nearer than min_distance the higher, then the first by
    row and column, stays: in rounds, one stays if it is the best of those left around it, and what is too near to it goes.
    A round looks at what is left only; one can only wait for a better one nearby, so rounds end.
    """
    from .raster import focal_max

    d = min_distance
    inner = kept(pixels.where(F.col("v") >= threshold).where(F.col("r").between(d, height - d - 1) & F.col("c").between(d, width - d - 1)).select(key, "r", "c", "v"))
    left = kept(_flat(inner, kept(focal_max(inner, key, d)), key).where(F.col("v") > threshold))
    if d == 1:
        return left
    done = []
    while not left.isEmpty():
        ranked = left.withColumn("rank", F.struct((-F.col("v")).alias("v"), "r", "c"))
        best = kept(ranked.join(_square_best(ranked, key, d - 1), [key, "r", "c"]).where(F.col("rank") == F.col("best")).select(key, "r", "c", "v"))
        done.append(best)
        # A peak that stays is sent to its cell of edge d and those around; they are few, as they lie d apart.
        cell = lambda at: F.floor(F.col(at) / F.lit(d))
        side = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        sent = best.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), side.alias("_y")).select("*", side.alias("_x"))
        sent = sent.select(key, "_r", "_c", (cell("_r") + F.col("_y")).alias("_i"), (cell("_c") + F.col("_x")).alias("_j"))
        near = (F.abs(F.col("r") - F.col("_r")) < d) & (F.abs(F.col("c") - F.col("_c")) < d)
        gone = left.withColumns({"_i": cell("r"), "_j": cell("c")}).join(sent, [key, "_i", "_j"]).where(near).select(key, "r", "c").distinct()
        left = kept(left.join(gone, [key, "r", "c"], "left_anti"))
    return reduce(DataFrame.unionByName, done, left)


def chip(edge: int) -> Callable:
    """The extent of chips that all have this edge."""
    return lambda key: (0, edge, 0, edge)


def _grid(table: pd.DataFrame, extent: Callable | None) -> tuple[np.ndarray, int, int]:
    """The values of a group over its extent (first row, end of rows, first column, end of columns), or over the box of its pixels."""
    r, c = table["r"].to_numpy(), table["c"].to_numpy()
    r0, r1, c0, c1 = extent(table.iloc[0, 0]) if extent else (int(r.min()), int(r.max()) + 1, int(c.min()), int(c.max()) + 1)
    grid = np.full((r1 - r0, c1 - c0), -np.inf)
    grid[r - r0, c - c0] = table["v"]
    return grid, r0, c0


def _square_max(grid: np.ndarray, radius: int) -> np.ndarray:
    """The largest value of the square around each place, rows first and then columns."""
    for axis in (0, 1):
        wide = np.pad(grid, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        grid = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis=axis).max(axis=-1)
    return grid


def _opened(mask: np.ndarray) -> np.ndarray:
    """The crosses of five places that fit into a mask."""
    wide = np.pad(mask, 1)
    cross = lambda m: (m[1:-1, 1:-1], m[:-2, 1:-1], m[2:, 1:-1], m[1:-1, :-2], m[1:-1, 2:])
    return np.logical_or.reduce(cross(np.pad(np.logical_and.reduce(cross(wide)), 1)))


def peaks(grid: np.ndarray, mask: np.ndarray, min_distance: int, threshold: float) -> list[tuple[int, int]]:
    """Local maxima of the mask that are above the threshold, as image libraries find them within one region.

    Places nearer to the extent's edge than min_distance do not count, nor does what lies outside of the box of
    the others. A maximum is no less than all of the square around it; of those nearer to each other than
    min_distance the higher, then the first, stays. In a region of one height only places that no cross of five
    covers are maxima.
    """
    d = min_distance
    inner = np.zeros_like(mask)
    inner[d : mask.shape[0] - d, d : mask.shape[1] - d] = mask[d : mask.shape[0] - d, d : mask.shape[1] - d]
    if not inner.any():
        return []
    rows, columns = np.flatnonzero(inner.any(axis=1)), np.flatnonzero(inner.any(axis=0))
    r0, c0 = int(rows[0]), int(columns[0])
    own = mask[r0 : rows[-1] + 1, c0 : columns[-1] + 1]
    part = np.where(own, grid[r0 : rows[-1] + 1, c0 : columns[-1] + 1], -np.inf)
    top = part == _square_max(part, d)
    if part.size > 1 and top[own].all():
        top = own ^ _opened(own)
    found = np.argwhere(top & own & (part > threshold))
    found = found[np.argsort(-part[tuple(found.T)], kind="stable")]
    kept, taken = [], np.zeros(own.shape, np.bool_)
    for r, c in found.tolist():
        if not taken[r, c]:
            kept.append((r + r0, c + c0))
            taken[max(0, r - d + 1) : r + d, max(0, c - d + 1) : c + d] = True
    return sorted(kept)


def markers(shape: tuple[int, int], seeds: list[tuple[int, int]]) -> np.ndarray:
    """Labels 1, 2 ... of seeds in order of rows and columns; seeds side by side share one."""
    out, left, label = np.zeros(shape, np.int32), set(seeds), 0
    for seed in seeds:
        if seed in left:
            label += 1
            stack = [seed]
            left.discard(seed)
            while stack:
                r, c = stack.pop()
                out[r, c] = label
                for near in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                    if near in left:
                        left.discard(near)
                        stack.append(near)
    return out


def flood(grid: np.ndarray, mask: np.ndarray, seeds: list[tuple[int, int]]) -> np.ndarray:
    """Labels of the mask's pixels that 4-neighbours connect to a seed: the highest pixel first, of equals the one reached first."""
    labels = markers(grid.shape, seeds)
    queue, age = [], 0
    for r, c in seeds:
        heapq.heappush(queue, (-grid[r, c], age, r, c))
        age += 1
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < grid.shape[0] and 0 <= x < grid.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = labels[r, c]
                heapq.heappush(queue, (-grid[y, x], age, y, x))
                age += 1
    return labels


def watershed(pixels: DataFrame, key: str, threshold: float, min_distance: int, extent: Callable | None = None) -> DataFrame:
    """label of each pixel v >= threshold that a peak's basin reaches, numbered within a chip by the peaks' rows and columns.

    A group is one chip or bordered chunk; extent tells its rows and columns by its key, without which the box of its
    pixels counts.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _grid(table, extent)
        mask = grid >= threshold
        labels = flood(grid, mask, peaks(grid, mask, min_distance, threshold))
        r, c = np.nonzero(labels)
        return pd.DataFrame({key: table[key].iloc[0], "label": labels[r, c], "r": (r + r0).astype(np.int32), "c": (c + c0).astype(np.int32)})

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.where(F.col("v") >= threshold).select(key, "r", "c", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, label int, r int, c int")


def crowns_from_dtm(dtm: DataFrame, key: str, threshold: float, min_distance: int, pixel_area: float, min_area: float, extent: Callable | None = None) -> DataFrame:
    """Crowns of a distance transform: watershed, then areas and boxes, small ones left out."""
    from .raster import zonal_stats

    labelled = watershed(dtm, key, threshold, min_distance, extent)
    return zonal_stats(labelled, key, "label", pixel_area=pixel_area).where(F.col("area_m2") >= min_area)


def chunked_crowns(dtm: DataFrame, height: int, width: int, chunk: int, border: int, threshold: float, min_distance: int, pixel_area: float, min_area: float) -> DataFrame:
    """Crowns of one large raster (r, c, v): pixels go to every chunk whose bordered window holds them, chunks are
    segmented alone, and a crown is kept by the chunk that its centre lies in, so each is kept once."""
    from .grids import chunks_of, owner

    def window(key: str) -> tuple[int, int, int, int]:
        k_r, k_c = map(int, key.split(","))
        return max(0, k_r * chunk - border), min(height, (k_r + 1) * chunk + border), max(0, k_c * chunk - border), min(width, (k_c + 1) * chunk + border)

    sent = dtm.where(F.col("v") >= threshold).withColumn("k_r", F.explode(chunks_of(F.col("r"), F.lit(height), chunk, border)))
    sent = sent.withColumn("k_c", F.explode(chunks_of(F.col("c"), F.lit(width), chunk, border))).withColumn("chunk", F.concat_ws(",", "k_r", "k_c"))
    found = crowns_from_dtm(sent, "chunk", threshold, min_distance, pixel_area, min_area, window)
    return found.where(F.col("chunk") == F.concat_ws(",", owner(F.col("centre_r"), chunk), owner(F.col("centre_c"), chunk)))


#: Sides of a pixel in the order of their walk, with the pixel on the right: how far their first corner lies from the pixel's place.
_WALK = (("top", 0, 0), ("right", 0, 1), ("bottom", 1, 1), ("left", 1, 0))


#: Labels are walked in blocks of so many rows and columns, a power of two, which bounds what a task holds.
BLOCK_BITS = 9

# For each side: the pixels of its three ways on, same, ahead and beyond, and their sides.
_AHEAD, _BEYOND = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 1), (1, 1), (1, -1), (-1, -1))
_ON = tuple(((0, 0, (k + 1) % 4), (*_AHEAD[k], k), (*_BEYOND[k], (k + 3) % 4)) for k in range(4))


def _ways_on(block: np.ndarray, r: np.ndarray, c: np.ndarray, k: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For different sides in order of block, row, column and side: each one's way on, and whether it is not known in its block (it is its own then)."""
    code = lambda r, c, k: ((block << bits | r & (1 << bits) - 1) << bits | c & (1 << bits) - 1) << 2 | k
    own, ways = code(r, c, k), np.array(_ON)
    to, left = np.arange(len(own)), np.ones(len(own), np.bool_)
    open_ = np.zeros(len(own), np.bool_)
    for n in range(3):
        dr, dc, side = ways[k, n].T
        within = ((r + dr) >> bits == r >> bits) & ((c + dc) >> bits == c >> bits)
        want = code(r + dr, c + dc, side)
        at = np.minimum(np.searchsorted(own, want), len(own) - 1)
        there = left & within & (own[at] == want)
        to[there] = at[there]
        open_ |= left & ~within
        left &= within & ~there
    return to, open_ | left


def _rounds(to: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By doubling: the least side of each side's ring, how far it is ahead, and whether the walk is open."""
    low, now = np.arange(len(to)), to
    while True:
        least, ends = np.minimum(low, low[now]), open_ | open_[now]
        if (least == low).all() and (ends == open_).all():
            break
        low, open_, now = least, ends, now[now]
    still = open_ | (low == np.arange(len(to)))
    now, far = np.where(still, np.arange(len(to)), to), np.where(still, 0, 1)
    while (now != low)[~open_].any():
        far, now = far + far[now], now[now]
    return low, far, open_


def _walked(edges: DataFrame, key: str) -> DataFrame:
    """The rings of labels that lie within a block: key, label, ring, at, x, y, the last three as arrays in order of at. Kept.

    Sides are dealt out by label and block and come to a task in order; it walks all rings of the blocks at hand together. The
    sides of rings that leave their block are rows without a ring, a block's in one: at is the side, x and y the pixel's place.
    """
    bits, kind = BLOCK_BITS, {x: edges.schema[x].dataType.simpleString() for x in (key, "label", "r", "c")}
    side = F.array_position(F.array(*(F.lit(name) for name, *_ in _WALK)), F.col("side")).cast("int") - 1
    rows = edges.select(key, "label", "r", "c", side.alias("side")).dropna().where("side >= 0")
    order = [key, "label", F.shiftright("r", bits), F.shiftright("c", bits)]
    names = ["ring", "at", "x", "y"]

    def places(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("r", "c", "side")]

    def fresh(batch: pa.RecordBatch) -> np.ndarray:
        """Whether a row is of another block than the row before."""
        r, c, _ = places(batch)
        new = (np.diff(r >> bits) != 0) | (np.diff(c >> bits) != 0)
        for x in (key, "label"):
            new |= pc.not_equal(batch[x][1:], batch[x][:-1]).to_numpy(zero_copy_only=False)
        return np.concatenate([[True], new])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                joint = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch
                last = int(np.flatnonzero(fresh(joint))[-1]) - bool(held)
                if last >= 0 and held:
                    yield from walked(pa.concat_batches([*held, batch.slice(0, last)]))
                    held = []
                elif last > 0:
                    yield from walked(batch.slice(0, last))
                held.append(batch.slice(max(0, last)))
        if held:
            yield from walked(pa.concat_batches(held))

    def walked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        r, c, k = places(batch)
        block = np.cumsum(fresh(batch)) - 1
        # Repeated sides are walked once; what stands for them is repeated.
        by = np.lexsort((k, c, r, block))
        new = np.concatenate([[True], np.logical_or.reduce([np.diff(x[by]) != 0 for x in (block, r, c, k)])])
        one, times = by[new], np.diff(np.append(np.flatnonzero(new), len(by)))
        r, c, k, block = r[one], c[one], k[one], block[one]
        low, far, open_ = _rounds(*_ways_on(block, r, c, k, bits))
        n = np.bincount(low[~open_], minlength=len(low))
        at = (n[low] - far) % np.maximum(n[low], 1)
        step = np.array([(y, x) for _, y, x in _WALK])[k]
        place = np.empty(n.sum(), np.int64)
        place[((np.cumsum(n) - n)[low] + at)[~open_]] = np.flatnonzero(~open_)
        firsts = np.flatnonzero(n)
        yield from table(batch, one[firsts], r[firsts] * (1 << 33) + c[firsts] * 4 + k[firsts], low, place, times, (at, c + step[:, 1], r + step[:, 0]))
        rest = np.flatnonzero(open_)
        yield from table(batch, one[rest[np.concatenate([[True], np.diff(block[rest]) != 0])]] if len(rest) else one[:0], None, block, rest, times, (k, c, r))

    def table(batch: pa.RecordBatch, first: np.ndarray, ring: np.ndarray | None, group: np.ndarray, place: np.ndarray, times: np.ndarray, values: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """A row for each of the groups, whose members are at places one after another."""
        if not len(first):
            return
        each = np.repeat(place, times[place])
        ends = np.append(np.flatnonzero(np.concatenate([[True], np.diff(group[each]) != 0])), len(each)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[each]).cast(t)) for v, t in zip(values, (pa.int32(), batch.schema.field("c").type, batch.schema.field("r").type), strict=True)]
        number = pa.nulls(len(first), pa.int64()) if ring is None else pa.array(ring)
        yield pa.RecordBatch.from_arrays([*(batch[x].take(pa.array(first)) for x in (key, "label")), number, *lists], [key, "label", *names])

    ordered = rows.repartition(*order).sortWithinPartitions(*order)
    return kept(ordered.mapInArrow(walk, f"{key} {kind[key]}, label {kind['label']}, ring long, at array<int>, x array<{kind['c']}>, y array<{kind['r']}>"))


def _open_sides(walked: DataFrame, key: str) -> DataFrame:
    """The sides that _walked() leaves, as edges."""
    each = walked.where("ring is null").select(key, "label", F.inline(F.arrays_zip("at", "x", "y")))
    return each.select(key, "label", F.col("y").alias("r"), F.col("x").alias("c"), F.array(*(F.lit(name) for name, *_ in _WALK))[F.col("at")].alias("side"))


def corners(edges: DataFrame, key: str) -> DataFrame:
    """The outlines of labels corner by corner, from their sides: key, label, ring, at (from 0), x, y.

    A side is followed by the next side of its pixel, else by the same side of the pixel ahead, else by the side before of the one
    beyond: whichever there is, in this order, so pixels that touch at a corner only stay apart. Rings within a block are walked
    by tasks, longer ones by joins. ring is the number of its least side, r * 2 ** 33 + c * 4 + side (top, right, bottom,
    left: 0 to 3).
    """
    walked = _walked(edges, key)
    own = walked.where("ring is not null").select(key, "label", "ring", F.inline(F.arrays_zip("at", "x", "y"))).withColumn("at", F.col("at").cast("long"))
    rest = _open_sides(walked, key)
    return own if rest.isEmpty() else own.unionByName(_doubled(rest, key))


def whole_rings(edges: DataFrame, key: str) -> DataFrame:
    """The outlines of corners() with a row for each: key, label, ring, x, y, of all corners in order."""
    walked = _walked(edges, key)
    own = walked.where("ring is not null").select(key, "label", "ring", "x", "y")
    rest = _open_sides(walked, key)
    if rest.isEmpty():
        return own
    long = _doubled(rest, key).groupBy(key, "label", "ring").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    return own.unionByName(long.select(key, "label", "ring", F.col("p.x").alias("x"), F.col("p.y").alias("y")))


def _doubled(edges: DataFrame, key: str) -> DataFrame:
    """corners() of rings of any length, by joins.

    Rings are found by doubling: each side looks twice as far in each round, first for the least side of its ring, which names
    it, then for how far it is from there. Rounds are about the logarithm of the longest ring, and no label or ring is a group.
    """
    number = lambda r, c, side: r.cast("long") * (1 << 33) + c.cast("long") * 4 + side
    r, c = F.col("r"), F.col("c")
    rows = None
    for k, (name, y, x) in enumerate(_WALK):
        ways = F.array(*(F.struct(F.lit(n).alias("n"), number(r + dy, c + dx, side).alias("to")) for n, (dy, dx, side) in enumerate(_ON[k])))
        own = edges.where(F.col("side") == name).select(key, "label", number(r, c, F.lit(k)).alias("id"), (r + y).alias("y"), (c + x).alias("x"), ways.alias("ways"))
        rows = own if rows is None else rows.unionByName(own)
    rows = kept(rows)
    tried = rows.select(key, "label", "id", F.explode("ways").alias("w")).select(key, "label", "id", "w.n", F.col("w.to").alias("to"))
    there = rows.select(key, "label", F.col("id").alias("to"))
    follow = tried.join(there, [key, "label", "to"]).groupBy(key, "label", "id").agg(F.min_by("to", "n").alias("to"))

    def ahead_of(now: DataFrame, *columns: str) -> DataFrame:
        """now with what the side it points to says."""
        other = now.select(key, "label", F.col("id").alias("to"), *(F.col(x).alias(f"_{x}") for x in ("to", *columns)))
        return now.join(other, [key, "label", "to"])

    now = follow = kept(follow)
    now = now.withColumn("low", F.least("id", "to"))
    while True:
        now = kept(ahead_of(now, "low").select(key, "label", "id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")))
        if now.where("moved").isEmpty():
            break
    ring = now.select(key, "label", "id", F.col("low").alias("ring"))
    first = F.col("id") == F.col("ring")
    now = follow.join(ring, [key, "label", "id"]).select(key, "label", "id", "ring", F.when(first, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("far"))
    while True:
        now = kept(ahead_of(now, "far").select(key, "label", "id", "ring", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far")))
        if now.where("to <> ring").isEmpty():
            break
    size = now.groupBy(key, "label", "ring").agg(F.count("*").alias("n"))
    placed = now.join(size, [key, "label", "ring"]).select(key, "label", "id", "ring", ((F.col("n") - F.col("far")) % F.col("n")).alias("at"))
    return placed.join(rows, [key, "label", "id"]).select(key, "label", "ring", "at", "x", "y")


#: Way of a label's side from corner to corner, with the label on the right: y and x of both ends from the pixel's place.
_WAYS = {"top": (0, 0, 0, 1), "right": (0, 1, 1, 1), "bottom": (1, 1, 1, 0), "left": (1, 0, 0, 0)}


def _stitched(sides: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """The closed rings of a label's sides (r, c, side), by their least corners (y, x)."""
    out: dict[tuple[int, int], list] = {}
    for r, c, side in sides:
        a, b, y, x = _WAYS[side]
        out.setdefault((r + a, c + b), []).append((r + y, c + x))
    found = []
    for start in sorted(out):
        while start in out:
            at, ring, last = start, [start], None
            while True:
                ways = out[at]
                if len(ways) > 1 and last:  # where two pixels touch at a corner: turn right, to stay with the same pixel
                    dy, dx = at[0] - last[0], at[1] - last[1]
                    ways.sort(key=lambda p: (p[0] - at[0], p[1] - at[1]) != (dx, -dy))  # noqa: B023
                to = ways.pop(0)
                if not ways:
                    del out[at]
                last, at = at, to
                ring.append(at)
                if at == start:
                    break
            found.append(ring)
    return found


def rings(edges: DataFrame, key: str) -> DataFrame:
    """The outlines of labels as closed rings of pixel corners, from their edges: key, label, ring (from 0), points.

    Sides are directed with the label on the right, so each corner's way on is another side. A label's sides are in one
    partition, one after another, and a task holds those of the label at hand. Outer rings and holes are told apart by the
    sign of their area.
    """
    rows = edges.select(key, F.col("label").cast("int").alias("label"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "side")
    ordered = rows.repartition(key, "label").sortWithinPartitions(key, "label")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            done = []
            for own, label, *side in zip(*(batch[c].to_pylist() for c in (key, "label", "r", "c", "side")), strict=True):
                if (own, label) != at:
                    if held:
                        done.append((at, _stitched(held)))
                    at, held = (own, label), []
                held.append(side)
            if done:
                yield table(done, batch.schema.field(key).type)
        if held:
            yield table([(at, _stitched(held))], batch.schema.field(key).type)

    def table(done: list, kind: pa.DataType) -> pa.RecordBatch:
        own = [(*at, k) for at, found in done for k in range(len(found))]
        each = [ring for _, found in done for ring in found]
        points = np.array([p for ring in each for p in ring], np.float64).reshape(-1, 2)
        places = pa.StructArray.from_arrays([pa.array(points[:, 1]), pa.array(points[:, 0])], ["x", "y"])
        ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
        names = [pa.array([row[i] for row in own], t) for i, t in enumerate((kind, pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*names, pa.ListArray.from_arrays(ends, places)], [key, "label", "ring", "points"])

    kind = edges.schema[key].dataType.simpleString()
    return ordered.mapInArrow(walk, f"{key} {kind}, label int, ring int, points array<struct<x: double, y: double>>")


def outlines(rings_: DataFrame, key: str) -> DataFrame:
    """One value a label of rings(): polygons, each an outline and its holes, by their first corners.

    A ring's direction tells whether it is an outline or a hole. A hole belongs to the smallest outline of its label whose box
    holds its box and that holds its first side's pixel; boxes are compared first, and labels without holes are not joined.
    """
    from ..functions import rings as ring

    points, sized = F.col("points"), ring.signed_area(F.col("points"))
    placed = rings_.select(key, "label", "points", sized.alias("_size"), *ring.bounds(points))
    outer = placed.where("_size > 0").withColumn("_shell", F.monotonically_increasing_id())
    outer = kept(outer)
    first, second = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    # The pixel on the right of a hole's first side is the label's: its middle lies in the outline.
    side = F.struct((second["x"] - first["x"]).alias("x"), (second["y"] - first["y"]).alias("y"))
    holes = placed.where("_size < 0").withColumn("_s", side).withColumns({"_x": (first["x"] + second["x"]) / 2 - F.col("_s.y") / 2, "_y": (first["y"] + second["y"]) / 2 + F.col("_s.x") / 2})
    holes = holes.select(key, "label", F.col("points").alias("hole"), "_x", "_y", *(F.col(c).alias(f"h_{c}") for c in ("min_x", "max_x", "min_y", "max_y"))).withColumn("_hole", F.monotonically_increasing_id())
    near = F.expr("min_x <= h_min_x and max_x >= h_max_x and min_y <= h_min_y and max_y >= h_max_y")
    found = kept(holes).join(outer, [key, "label"]).where(near).where(ring.contains(points, F.col("_x"), F.col("_y")))
    own = found.groupBy("_hole").agg(F.min_by("_shell", "_size").alias("_shell"), F.first("hole").alias("hole")).groupBy("_shell").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    whole = outer.join(own, "_shell", "left").select(key, "label", F.concat(F.array("points"), F.coalesce("holes", F.array().cast(placed.schema["points"].dataType.simpleString().join(("array<", ">"))))).alias("polygon"))
    return whole.groupBy(key, "label").agg(F.array_sort(F.collect_list("polygon")).alias("polygons"))
