"""Rings on pixels and in the plane, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelplan.functions import mercator
from pixelplan.operators import raster, repair, vector
from pixelplan.sources import projections as src

RINGS = "key int, part int, ring array<struct<x: double, y: double>>"


def inside(ring, x, y):
    crossed = 0
    for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
        crossed += (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px
    return crossed % 2 == 1


def star(r, key, part, n=None):
    cx, cy, size = r.uniform(-20, 40), r.uniform(-20, 40), r.uniform(2, 25)
    angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n or r.randint(3, 9)))
    ring = [(cx + size * math.cos(a), cy + size * math.sin(a)) for a in (angles if r.random() < 0.5 else angles[::-1])]
    return key, part, ring + ring[:1]


def table(spark, rows):
    return spark.createDataFrame([(k, p, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, p, ring in rows], RINGS)


def test_pixels_of_rings(spark):
    r = random.Random(1)
    rows = [star(r, k, p) for k in range(6) for p in range(4)] + [(9, 0, [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5), (0.5, 0.5)]), (9, 1, []), (9, 2, [(1, 1)])]
    want = sorted((k, p, y, x) for k, p, ring in rows for y in range(-50, 70) for x in range(-50, 70) if inside(ring, x + 0.5, y + 0.5))
    df = table(spark, rows)
    assert sorted(tuple(x) for x in vector.rasterized(df).collect()) == want
    assert vector.union_area(df).first().area == len({w[2:] for w in want})
    assert vector.union_area(df.limit(0)).first().area == 0


def test_covered_area_does_not_depend_on_cells_and_is_right(spark):
    r = random.Random(5)
    rows = [star(r, k, p) for k in range(5) for p in range(6)]
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    rows += [(10, 0, square), (10, 1, square[::-1]), (10, 2, [(x + 5, y) for x, y in square]), (10, 3, [(x / 2 + 2, y / 2 + 2) for x, y in square]), (11, 0, [(0, 0), (8, 0), (4, 6), (0, 0)]), (11, 1, [(0, 6), (8, 6), (4, 0), (0, 6)])]
    df = table(spark, rows)
    found = [{x.key: x.area for x in vector.covered_area(df, "key", cell=cell).collect()} for cell in (7.0, 500.0)]
    for k, area in found[0].items():
        assert math.isclose(area, found[1][k], rel_tol=1e-9)
    assert math.isclose(found[0][10], 150) and math.isclose(found[0][11], 36)
    step = 0.2
    for k in range(5):
        own = [ring for key, _, ring in rows if key == k]
        dots = sum(any(inside(ring, x * step + 0.1, y * step + 0.1) for ring in own) for x in range(-250, 350) for y in range(-250, 350))
        assert abs(dots * step * step - found[0][k]) < 0.01 * found[0][k] + 2


def test_places_need_a_known_system(spark):
    rows = spark.createDataFrame([(-122.0, 47.81, "EPSG:4326"), (0.0, 0.0, None), (0.0, 0.0, "EPSG:9999"), (500000.0, 5e6, "EPSG:32610")], "x double, y double, crs string")
    east, north = mercator.reprojected(F.col("x"), F.col("y"), F.col("crs"), 32610)
    placed = rows.select(east.alias("e"), north.alias("n"), "crs")
    assert tuple(placed.where("crs = 'EPSG:32610'").first())[:2] == (500000.0, 5e6)
    assert 574000 < placed.where("crs = 'EPSG:4326'").first().e < 576000
    for bad in ("crs is null", "crs = 'EPSG:9999'"):
        with pytest.raises(Exception, match="coordinate system"):
            placed.where(bad).collect()


def test_sizes_must_agree_and_bare_rasters_count(spark):
    a = spark.createDataFrame([(1, 8, 8), (2, 8, 9)], "k int, h int, w int")
    assert raster.same_extent(a, a, "k").count() == 2
    with pytest.raises(Exception, match="sizes differ: 2"):
        raster.same_extent(a, a.replace(9, 7, "w"), "k").collect()
    dtm = spark.createDataFrame([(1, 50.0), (1, 0.0)], "k int, dtm double")
    got = {x.k: (x.crown_pixels, x.low, x.coverage_pct) for x in raster.coverage(dtm, "k", 4, a).collect()}
    assert got == {1: (1, 50.0, 25.0), 2: (0, None, 0.0)}


def turns(ring, x, y):
    n = 0
    for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            n += 1 if qy > py else -1
    return n


def test_repaired_rings_hold_what_they_turn_around():
    r = random.Random(7)
    for k in range(120):
        grid = k % 2
        ring = [(r.randint(0, 6), r.randint(0, 6)) if grid else (r.uniform(0, 6), r.uniform(0, 6)) for _ in range(r.randint(3, 9))]
        ring.append(ring[0])
        polygons = repair.polygons_of(ring)
        for _ in range(200):
            x, y = r.uniform(0, 6), r.uniform(0, 6)
            held = sum(inside(p[0], x, y) and not any(inside(h, x, y) for h in p[1:]) for p in polygons)
            assert held == (turns(ring, x, y) != 0), (ring, x, y)
        for polygon in polygons:
            for own in polygon:
                assert own[0] == own[-1] and all(repair.polygons_of(own[:1] + own[1:])) and len({*own[:-1]}) == len(own) - 1


def test_bow_tie_spike_repeated_points_and_holes(spark):
    tie = [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
    spike = [(0, 0), (4, 0), (4, 4), (9, 4), (4, 4), (0, 4), (0, 0)]
    twice = [(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]
    round_ = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2), (0, 0)]  # goes around a hole
    flat = [(0, 0), (3, 0), (0, 0), (3, 0), (0, 0)]
    rows = [(k, 0, ring) for k, ring in enumerate((tie, spike, twice, round_, flat, [(0, 0), (3, 0), (0, 3), (0, 0)]))]
    df = table(spark, rows)
    assert sorted(x.key for x in repair.invalid(df, "key").collect()) == [0, 1, 3, 4]
    got = {}
    for x in repair.repaired(df, "key", "part").withColumn("area", repair.area(F.col("rings"))).collect():
        got.setdefault(x.key, []).append((x.piece, round(x.area, 9), len(x.rings)))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 4, 1), (1, 4, 1)], 1: [(0, 16, 1)], 2: [(0, 16, 1)], 3: [(0, 32, 2)], 5: [(0, 4.5, 1)]}
    assert repair.polygons_of([]) == repair.polygons_of([(1, 1)]) == []


def test_rings_in_many_layers_are_swept_along_the_rim_only(spark):
    r = np.random.default_rng(8)
    boxes = [(*r.integers(0, 40, 2).tolist(), *r.integers(60, 100, 2).tolist()) for _ in range(300)]
    rows = [(1, [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]) for a, b, c, d in boxes]
    parts_ = spark.createDataFrame([*rows, *rows[:50], (None, rows[0][1])], "site int, ring array<struct<x: double, y: double>>")
    covered = np.zeros((100, 100), np.bool_)
    for a, b, c, d in boxes:
        covered[b:d, a:c] = True
    found = vector.covered_area(parts_, "site", cell=32.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(x.site, round(x.area, 6)) for x in found.collect()] == [(1, float(covered.sum()))]
    cells, whole = vector._cells(parts_, ("site",), 32.0)
    assert whole.groupBy().sum("area").first()[0] > 0.8 * covered.sum() and cells.groupBy("i", "j", "s").count().agg({"count": "max"}).first()[0] <= vector.FEW_RINGS


def test_short_rings_are_repaired_in_their_rows(spark):
    bow, square = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(None, 0, bow), (1, 0, bow), (2, 0, square)], RINGS)
    found = repair.repaired(df, "key", "part")
    got = sorted(((x.key, x.piece, x.area) for x in found.withColumn("area", repair.area(F.col("rings"))).collect()), key=str)
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 4.0), (None, 0, 1.0), (None, 1, 1.0)]


def some_rings(r, n):
    """Closed rings of few points on a coarse grid or anywhere, far from the origin too; many cross, touch or repeat themselves."""
    for k in range(n):
        off, wide = r.choice([0, 0, 500000]), r.choice([2, 6])
        one = (lambda: r.randint(0, wide) + off) if k % 2 else (lambda: r.uniform(0, wide) + off)
        ring = [(one(), one()) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 12, 20]))]
        yield ring + ring[:1]


def nested(polygons, rings_, points, corners):
    """What polygons_of_each() tells as polygons_of() would of each ring."""
    corners, points, rings_ = iter(map(tuple, corners.tolist())), iter(points.tolist()), iter(rings_.tolist())
    return [[[[next(corners) for _ in range(next(points))] for _ in range(next(rings_))] for _ in range(n)] for n in polygons.tolist()]


def test_rings_repaired_together_are_as_repaired_one_by_one():
    around_a_hole = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2), (0, 0)]
    touching_hole = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 4), (4, 4), (4, 2), (0, 0)]
    long_ = [(math.cos(k * 2.4), math.sin(k * 2.4)) for k in range(90)]
    own = [around_a_hole, *some_rings(random.Random(11), 1500), touching_hole, long_ + long_[:1], [(0, 0), (math.nan, 1), (2, 2), (2, 0), (0, 2), (0, 0)], []]
    p, size = np.array([q for ring in own for q in ring], float), np.array([len(ring) for ring in own])
    one_by_one = repair._outlines(p, np.repeat(np.arange(len(own)), size), len(own))[3]
    assert one_by_one[0] and one_by_one[-4:].tolist() == [True, True, False, False] and one_by_one.mean() < 0.1
    for ring, got in zip(own, nested(*repair.polygons_of_each(p, size)), strict=True):
        want = repair.polygons_of(ring)
        assert [[len(r) for r in polygon] for polygon in got] == [[len(r) for r in polygon] for polygon in want], ring
        assert all(np.allclose(g, w, rtol=0, atol=1e-9) for a, b in zip(got, want, strict=True) for g, w in zip(a, b, strict=True)), ring


def test_rings_judged_together_are_as_judged_in_their_rows(spark):
    own = [*some_rings(random.Random(12), 1500), [(0, 0), (math.nan, 1), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (math.nan, 1), (1, 1), (math.nan, 1), (0, 0)], [(0.0, 0.0), (1, 0), (-0.0, 0.0), (0, 1), (0, 0)]]
    found = {x.key for x in repair.invalid(table(spark, [(k, 0, ring) for k, ring in enumerate(own)]), "key").collect()}
    bad = repair.faulty(np.array([q for ring in own for q in ring], float), np.array([len(ring) for ring in own]))
    assert set(np.flatnonzero(bad).tolist()) == found and 100 < len(found) < 1400


def test_crowns_are_repaired_once(spark):
    bow, square = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    far = [(math.cos(k * math.pi / 50), math.sin(k * math.pi / 50)) for k in range(100)]  # long rings meet what crossing() finds
    crossed = [*far[:30], far[31], far[30], *far[32:]]
    rows = [(k % 2, k, [bow if k % 3 else square]) for k in range(30)] + [(0, 30, [far + far[:1]]), (1, 31, [crossed + crossed[:1], []]), (1, 32, None), (None, 33, [square])]
    polygons = spark.createDataFrame(rows, "site int, key int, parts array<array<struct<x: double, y: double>>>")
    parts_ = polygons.select("site", "key", F.posexplode("parts").alias("part", "ring"))
    assert "EvalPython" not in repair.repaired(parts_.where("size(ring) <= 64"), "key", "part")._jdf.queryExecution().executedPlan().toString()
    got = vector.cleaned(polygons, "site", 3.0).collect()
    assert sorted(repr(x[:4]) for x in got) == sorted(repr(x[:]) for x in vector.cleaned(polygons, "site", 3.0, outlines=False).collect())
    areas = [round(x.area_m2, 6) for x in got]
    assert areas.count(4.0) == 40 and areas.count(16.0) == 11 and areas.count(round(50 * math.sin(math.pi / 50), 6)) == 1 and len(got) == 53
    assert sorted(int(x.crown_id.split("_")[1]) for x in got if x.site == 0) == list(range(26))


def test_rings_of_a_small_file_are_many_tasks(spark):
    assert src.broken_polygons(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
