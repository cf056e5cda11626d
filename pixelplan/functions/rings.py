"""Areas, centroids, bounds and containment of polygons given as closed rings: arrays of struct<x: double, y: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Each edge as its cross product and the sums of its ends."""
    nexts = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), nexts, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))


def _sum(edges: Column, of) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + of(e))


def signed_area(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, c: s + c) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Null for rings without area."""
    edges, twice = _edges(ring), signed_area(ring) * 6
    return F.try_divide(_sum(edges, lambda e: e["x"] * e["c"]), twice), F.try_divide(_sum(edges, lambda e: e["y"] * e["c"]), twice)


def bounds(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [f(v).alias(f"{n}_{c}") for v, c in ((xs, "x"), (ys, "y")) for f, n in ((F.array_min, "min"), (F.array_max, "max"))]


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times."""
    nexts = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), nexts, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crossed = F.filter(pairs, lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < F.coalesce(F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]), F.lit(0.0)) + e["p"]["x"]))
    return F.size(crossed) % 2 == 1


def self_crossing(ring: Column) -> Column:
    """Whether two edges that are no neighbours cross properly (rings of few points: every pair is looked at)."""
    n = F.size(ring) - 1
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    at = lambda i: F.element_at(ring, i.cast("int"))
    cross = lambda i, j: (turn(at(i), at(i + 1), at(j)) * turn(at(i), at(i + 1), at(j + 1)) < 0) & (turn(at(j), at(j + 1), at(i)) * turn(at(j), at(j + 1), at(i + 1)) < 0)
    return F.when(n < 4, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), n), lambda i: F.exists(F.sequence(F.lit(1), n), lambda j: (j > i) & cross(i, j))))
