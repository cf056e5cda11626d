"""Bent and stretched chips against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelplan.operators import augment

M = 2147483647


def draw(key, place, seed):
    h = (key % M * 48271 + seed * 40503) % M
    return (h * 48271 + place + 1) % M * 48271 % M / M * 2 - 1


def mirror(i, n):
    t = i % max(1, 2 * (n - 1))
    return min(t, 2 * (n - 1) - t)


def bilinear(chip, y, x):
    n, y0, x0 = len(chip), math.floor(y), math.floor(x)
    return sum(chip[mirror(y0 + a, n)][mirror(x0 + b, n)] * abs(1 - a - (y - y0)) * abs(1 - b - (x - x0)) for a in (0, 1) for b in (0, 1))


def chips(spark, n, keys):
    r = np.random.default_rng(n)
    own = {k: r.integers(0, 255, (n, n)).tolist() for k in keys}
    return own, spark.createDataFrame([(k, y, x, own[k][y][x]) for k in keys for y in range(n) for x in range(n)], "chip long, r int, c int, v int")


@pytest.mark.parametrize(("n", "alpha", "sigma"), [(9, 3.0, 1.5), (70, 20.0, 2.0)])
def test_elastic(spark, n, alpha, sigma):
    own, rows = chips(spark, n, [3] if n > 64 else [0, 5])
    reach = int(3 * sigma + 0.5)
    w = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    w /= w.sum()
    got = {(x.chip, x.r, x.c): x.v for x in augment.elastic(rows, "chip", n, alpha, sigma, seed=7).collect()}
    assert len(got) == len(own) * n * n
    for k, chip in own.items():
        field = []
        for seed in (7, 8):
            f = np.array([[draw(k, y * n + x, seed) for x in range(n)] for y in range(n)])
            wide = np.pad(f, reach, mode="reflect")
            wide = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, wide)
            field.append(np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, wide))
        off = [(y, x) for y in range(n) for x in range(n) if abs(got[k, y, x] - bilinear(chip, y + alpha * field[0][y, x], x + alpha * field[1][y, x])) > 0.5 + 1e-6]
        assert not off


def test_grid(spark):
    n, steps = 11, 3
    own, rows = chips(spark, n, [1, 2])
    size, cells = n // steps, -(-n // (n // steps))

    def along(k, at, which):
        f = [1 + 0.3 * draw(k, j, 44 + which) for j in range(cells)]
        cell = at // size
        begin = sum(f[:cell]) * size
        end, count = (begin + f[cell] * size, size) if (cell + 1) * size <= n else (n, n - cell * size)
        return begin + (end - begin) * (at - cell * size) / (count - 1) if count > 1 else begin

    got = {(x.chip, x.r, x.c): x.v for x in augment.grid_distorted(rows, "chip", n, steps).collect()}
    assert len(got) == 2 * n * n
    for (k, y, x), v in got.items():
        assert abs(v - bilinear(own[k], along(k, y, 0), along(k, x, 1))) <= 0.5 + 1e-6


@pytest.mark.parametrize("bend", [lambda rows: augment.elastic(rows, "chip", 9, 3.0, 1.5), lambda rows: augment.grid_distorted(rows, "chip", 9, 2)])
def test_chips_within_tasks_equal_those_by_joins(spark, monkeypatch, bend):
    _, rows = chips(spark, 9, range(150))
    holes = rows.where("chip % 3 > 0 or r <> 4").where("chip % 5 > 0 or r > 6 and c > 6").withColumn("v", F.when(F.expr("chip % 7 > 0 or r > 2"), F.col("v")))
    odd = spark.createDataFrame([(None, 1, 1, 9), (1, -1, 3, 9), (1, 2, 9, 9), (2, 3, 3, 50)], rows.schema)  # without a chip, outside, twice
    rows = holes.unionByName(odd).repartition(5)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # chips of 81 rows reach over batches
    try:
        inside = bend(rows)
        assert "Join" not in inside._jdf.queryExecution().toString()
        inside = sorted(map(tuple, inside.collect()), key=str)
    finally:
        rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(augment, "CHIP", 0)
    joined = bend(rows)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert inside == sorted(map(tuple, joined.collect()), key=str)
