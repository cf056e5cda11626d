"""Augmentation of square chips: places are mapped and values are expressions; only smoothing and bending shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from . import raster

TURNS = ("same", "flip_h", "flip_v", "transpose", "rot90", "rot180", "rot270")


def _places(n: int) -> Column:
    r, c, last = F.col("r"), F.col("c"), F.lit(n - 1)
    moved = {"same": (r, c), "flip_h": (r, last - c), "flip_v": (last - r, c), "transpose": (c, r), "rot90": (last - c, r), "rot180": (last - r, last - c), "rot270": (c, last - r)}
    return F.array(*(F.struct(F.lit(k).alias("turn"), moved[k][0].alias("r"), moved[k][1].alias("c")) for k in TURNS))


def turned(pixels: DataFrame, key: str, n: int, *values: str) -> DataFrame:
    """Every chip in all turns; image and label values move together."""
    return pixels.select(key, *values, F.explode(_places(n)).alias("p")).select(key, "p.turn", "p.r", "p.c", *values)


def brightened(value: Column, factor: float, gamma: float) -> Column:
    """A value of 0 to 255 with its brightness and gamma changed, cut off at both ends."""
    x = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.lit(255.0) * factor)), F.lit(gamma))
    return F.floor(x * 255 + F.lit(0.5)).cast("int")


def contrasted(value: Column, contrast: float, offset: float) -> Column:
    """A value of 0 to 255 stretched around the middle and shifted, cut off at both ends."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value - 127.5) * contrast + F.lit(127.5 + offset) + F.lit(0.5)).cast("int")))


def fogged(value: Column, share: float) -> Column:
    """A value of 0 to 255 of which a share is replaced by white."""
    return F.floor(value * F.lit(1 - share) + F.lit(255 * share) + F.lit(0.5)).cast("int")


def punched(value: Column, holes: list[tuple[int, int, int, int]], fill: int = 0) -> Column:
    """The fill value inside of holes: first row, end of rows, first column, end of columns."""
    inside = F.lit(False)
    for r0, r1, c0, c1 in holes:
        inside = inside | F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)
    return F.when(inside, F.lit(fill)).otherwise(value)


def shaded(value: Column, ring: Column, factor: float) -> Column:
    """Values whose pixel's centre lies in a ring, darker by a factor."""
    return F.when(rings.contains(ring, F.col("c") + F.lit(0.5), F.col("r") + F.lit(0.5)), F.floor(value * factor).cast("int")).otherwise(value)


def blurred(pixels: DataFrame, key: str, n: int, weights: tuple[int, ...] = (1, 2, 1)) -> DataFrame:
    """Chips of n x n smoothed by a separable kernel with mirrored borders: each value is sent to the places around it, weighted, and sums combine before the shuffle."""
    half, total = len(weights) // 2, sum(weights)
    near = F.explode(F.array(*(F.struct(F.lit(d - half).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights))))
    wide = raster.padded(pixels.select(key, "r", "c", "v"), key, n, half)
    rows = wide.select(key, "r", "c", "v", near.alias("a")).groupBy(key, F.col("r"), (F.col("c") + F.col("a.d")).alias("c")).agg(F.sum(F.col("v") * F.col("a.w")).alias("v"))
    both = rows.where(F.col("c").between(0, n - 1)).select(key, "r", "c", "v", near.alias("a")).groupBy(key, (F.col("r") + F.col("a.d")).alias("r"), "c").agg(F.sum(F.col("v") * F.col("a.w")).alias("v"))
    return both.where(F.col("r").between(0, n - 1)).select(key, "r", "c", F.floor(F.col("v") / F.lit(total * total) + F.lit(0.5)).cast("int").alias("v"))


def moved(pixels: DataFrame, key: str, n: int, degrees: float = 0.0, scale: float = 1.0, down: float = 0.0, right: float = 0.0) -> DataFrame:
    """Chips turned about their middle, scaled and shifted: each place takes the nearest pixel of the place it comes from; places without one are left out.

    Where each of the n x n places comes from is the same for all chips: a table of that size, which is sent to all.
    """
    spark, middle = pixels.sparkSession, F.lit((n - 1) / 2)
    cos, sin = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    places = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    y, x = F.col("r") - middle - F.lit(down), F.col("c") - middle - F.lit(right)
    source = lambda a: F.floor(a / F.lit(scale) + middle + F.lit(0.5)).cast("int")
    places = places.select("r", "c", source(y * cos - x * sin).alias("_r"), source(y * sin + x * cos).alias("_c"))
    values = [c for c in pixels.columns if c not in ("r", "c")]
    from_ = pixels.select(*values, F.col("r").alias("_r"), F.col("c").alias("_c"))
    return from_.join(F.broadcast(places), ["_r", "_c"]).select(*values, "r", "c")


# The multiplier and the modulus of a linear congruential generator.
_MULTIPLIER, _MODULUS = 48271, 2147483647


def drawn(key: Column, place: Column, seed: int) -> Column:
    """A number of -1 to 1 that depends on the key, the place and the seed alone."""
    first = F.pmod(F.pmod(key.cast("long"), F.lit(_MODULUS)) * _MULTIPLIER + F.lit(seed * 40503), F.lit(_MODULUS))
    second = F.pmod(first * _MULTIPLIER + place.cast("long") + 1, F.lit(_MODULUS))
    return F.pmod(second * _MULTIPLIER, F.lit(_MODULUS)) / F.lit(float(_MODULUS)) * 2 - 1


def _mirrored(i: Column, n: int) -> Column:
    """The place of 0 to n - 1 that any place shows, mirrored at both ends as often as needed."""
    turn = F.pmod(i, F.lit(max(1, 2 * (n - 1))))
    return F.least(turn, F.lit(2 * (n - 1)) - turn).cast("int")


def gathered(pixels: DataFrame, sources: DataFrame, key: str, n: int) -> DataFrame:
    """key, r, c, v: for each of sources (key, r, c, y, x) the value of chips of n x n at (y, x), weighed from the four pixels around.

    The four places and their weights are rows that meet the pixels by equality; places outside are mirrored.
    The size of sent rows is far from what is guessed from the files, so neither side is broadcast.
    """
    y0, x0 = F.floor("y"), F.floor("x")
    down, right = F.col("y") - y0, F.col("x") - x0
    four = [(y0 + a, x0 + b, (down if a else 1 - down) * (right if b else 1 - right)) for a in (0, 1) for b in (0, 1)]
    near = F.explode(F.array(*(F.struct(_mirrored(y, n).alias("r"), _mirrored(x, n).alias("c"), w.alias("w")) for y, x, w in four)))
    sent = sources.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), near.alias("p")).select(key, "_r", "_c", "p.*").where("w > 0")
    found = sent.hint("merge").join(pixels.select(key, "r", "c", "v"), [key, "r", "c"])
    return found.groupBy(key, F.col("_r").alias("r"), F.col("_c").alias("c")).agg(F.floor(F.sum(F.col("v") * F.col("w")) + F.lit(0.5)).cast("int").alias("v"))


def _every_place(pixels: DataFrame, key: str, n: int) -> DataFrame:
    place = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_at")
    return pixels.select(key).distinct().select(key, place).select(key, F.expr(f"cast(_at div {n} as int)").alias("r"), (F.col("_at") % n).cast("int").alias("c"), "_at")


#: Edge of the largest chips of which each is read within a task; larger ones meet their places by joins.
CHIP = 512
_BLOCK = 1 << 20  # places that a task bends at once, at least a chip's


def _drawn(key: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """drawn() for arrays of whole numbers."""
    first = (key % _MODULUS * _MULTIPLIER + seed * 40503) % _MODULUS
    return (first * _MULTIPLIER + place + 1) % _MODULUS * _MULTIPLIER % _MODULUS / _MODULUS * 2 - 1


def _read(grid: np.ndarray, there: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chips (chip, row, column) the values at (y, x), weighed from the four pixels around, and whether any of these is there."""
    n = grid.shape[1]
    chip, y0, x0 = np.arange(len(grid))[:, None, None], np.floor(y), np.floor(x)
    value, any_ = np.zeros(y.shape), np.zeros(y.shape, np.bool_)
    for a in (0, 1):
        for b in (0, 1):
            w = (y - y0 if a else 1 - (y - y0)) * (x - x0 if b else 1 - (x - x0))
            r, c = ((i.astype(np.int64) % max(1, 2 * (n - 1))) for i in (y0 + a, x0 + b))
            r, c = np.minimum(r, 2 * (n - 1) - r), np.minimum(c, 2 * (n - 1) - c)
            value += np.where(w > 0, grid[chip, r, c] * w, 0.0)
            any_ |= there[chip, r, c] & (w > 0)
    return value, any_


def _bent(pixels: DataFrame, key: str, n: int, places: Callable) -> DataFrame:
    """key, r, c, v: chips of n x n read at the places (y, x) that places(keys) gives, arrays by chip, row and column.

    A chip's pixels are in one partition, one after another; a task holds one batch of rows and the chip at hand. Places
    that show no pixel have no row, and repeated pixels add up, as in gathered().
    """
    own = pixels.where(F.col(key).isNotNull() & F.col("r").between(0, n - 1) & F.col("c").between(0, n - 1))
    own = own.select(key, F.col(key).cast("long").alias("_k"), (F.col("r") * n + F.col("c")).cast("int").alias("_at"), F.col("v").cast("double").alias("v"))
    kind = pixels.schema[key].dataType.simpleString()

    def chips(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        chip = rows[key].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(chip, prepend=-1))
        ends = np.append(first, len(chip))
        at, k = rows["_at"].to_numpy(), rows["_k"].to_numpy()[first]
        v = rows["v"].to_numpy(zero_copy_only=False)
        many = max(1, _BLOCK // (n * n))
        for i in range(0, len(first), many):
            low, high, m = ends[i], ends[min(i + many, len(first))], min(many, len(first) - i)
            to, values = (chip[low:high] - i) * (n * n) + at[low:high], v[low:high]
            known = ~np.isnan(values)
            count = lambda of, w=None: np.bincount(of, w, m * n * n).reshape(m, n, n)
            y, x = (np.broadcast_to(p, (m, n, n)) for p in places(k[i : i + m]))
            grid = count(to[known], values[known])
            value, there = _read(grid, count(to) > 0, y, x)
            valued = there if known.all() else _read(grid, count(to[known]) > 0, y, x)[1]
            of, r, c = np.nonzero(there)
            out = pa.array(np.floor(value[there] + 0.5).astype(np.int32), mask=~valued[there])
            yield pa.RecordBatch.from_arrays([rows[key].combine_chunks().take(pa.array(first[i + of])), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), out], [key, "r", "c", "v"])

    def bend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            chip = batch[key].dictionary_encode().indices.to_numpy()
            cut = int(np.searchsorted(chip, chip[-1]))
            if held and (cut or held[-1][key][-1] != batch[key][0]):
                yield from chips(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from chips(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from chips(pa.Table.from_batches(held))

    return own.repartition(key).sortWithinPartitions(key).mapInArrow(bend, f"{key} {kind}, r int, c int, v int")


def elastic(pixels: DataFrame, key: str, n: int, alpha: float = 50.0, sigma: float = 5.0, seed: int = 42) -> DataFrame:
    """Chips of n x n bent by a smooth random field: each place takes the value at its own place plus alpha times the field.

    The field is drawn for each chip and place and smoothed by a Gaussian of sigma, along rows and then along columns, with
    mirrored borders. In chips up to CHIP a place mirrored into the kernel's reach adds to the weight of its image; in larger
    ones each number is sent to the places around it with its weight, and sums combine before the shuffle.
    """
    reach = max(1, int(3 * sigma + 0.5))
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    if n <= CHIP:
        table = np.zeros((n, n))  # weight of each place (row) in each smoothed place (column)
        for to in range(n):
            for d, w in zip(range(-reach, reach + 1), weights, strict=True):
                turn = (to + d) % max(1, 2 * (n - 1))
                table[min(turn, 2 * (n - 1) - turn), to] += w

        def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.arange(n * n).reshape(1, n, n)
            field = [table.T @ (_drawn(keys[:, None, None], at, seed + k) @ table) for k in (0, 1)]
            return np.arange(n)[:, None] + alpha * field[0], np.arange(n) + alpha * field[1]

        return _bent(pixels, key, n, places)
    drawn_ = _every_place(pixels, key, n).withColumns({"y": drawn(F.col(key), F.col("_at"), seed), "x": drawn(F.col(key), F.col("_at"), seed + 1)})

    def smoothed(rows: DataFrame, along: str) -> DataFrame:
        # A place and its images within reach of an edge, each sent along the kernel.
        kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)))
        at = F.col(along)
        shown = F.filter(F.array(at, F.when((at > 0) & (at <= reach), -at), F.when((at < n - 1) & (at >= n - 1 - reach), 2 * (n - 1) - at)), lambda i: i.isNotNull())
        moved_ = rows.select(key, "r", "c", "y", "x", F.explode(shown).alias("_i")).select("*", F.explode(kernel).alias("k")).withColumn(along, F.col("_i") + F.col("k.d")).where(F.col(along).between(0, n - 1))
        return moved_.groupBy(key, "r", "c").agg(F.sum(F.col("y") * F.col("k.w")).alias("y"), F.sum(F.col("x") * F.col("k.w")).alias("x"))

    field = smoothed(smoothed(drawn_.select(key, "r", "c", "y", "x"), "c"), "r")
    return gathered(pixels, field.select(key, "r", "c", (F.col("r") + F.col("y") * F.lit(alpha)).alias("y"), (F.col("c") + F.col("x") * F.lit(alpha)).alias("x")), key, n)


def grid_distorted(pixels: DataFrame, key: str, n: int, steps: int = 5, limit: float = 0.3, seed: int = 42) -> DataFrame:
    """Chips of n x n whose rows and columns are stretched and squeezed in steps: n // steps pixels each, by factors of 1 - limit to 1 + limit.

    Within a step places are spread evenly from where the step before ended to where it ends; a step that is cut off
    by the far edge ends there.
    """
    size = n // steps
    cells = -(-n // size)

    if n <= CHIP:

        def spread(keys: np.ndarray, which: int) -> np.ndarray:
            factors = 1 + limit * _drawn(keys[:, None], np.arange(cells), seed + 2 + which)
            begins = np.cumsum(np.column_stack([np.zeros(len(keys)), factors * size]), axis=1)
            at = np.arange(n)
            cell = at // size
            whole = (cell + 1) * size <= n
            begin, end = begins[:, cell], np.where(whole, begins[:, cell] + factors[:, cell] * size, float(n))
            count = np.where(whole, size, n - cell * size)
            return np.where(count > 1, begin + (end - begin) * (at - cell * size) / np.maximum(1, count - 1), begin)

        return _bent(pixels, key, n, lambda keys: (spread(keys, 0)[:, :, None], spread(keys, 1)[:, None, :]))

    def along(at: Column, which: int) -> Column:
        factors = F.array(*(1 + F.lit(limit) * drawn(F.col(key), F.lit(k), seed + 2 + which) for k in range(cells)))
        cell = F.floor(at / F.lit(size)).cast("int")
        begin = F.aggregate(F.slice(factors, F.lit(1), cell), F.lit(0.0), lambda s, f: s + f * size)
        whole = (cell + 1) * size <= n
        end, count = F.when(whole, begin + F.get(factors, cell) * size).otherwise(F.lit(float(n))), F.when(whole, F.lit(size)).otherwise(F.lit(n) - cell * size)
        return F.when(count > 1, begin + (end - begin) * (at - cell * size) / (count - 1)).otherwise(begin)

    places = _every_place(pixels, key, n)
    return gathered(pixels, places.select(key, "r", "c", along(F.col("r"), 0).alias("y"), along(F.col("c"), 1).alias("x")), key, n)
