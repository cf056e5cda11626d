"""Segmentation without a group for a raster, against plain versions."""

import random

import numpy as np

from pixelplan.operators import segment


def some(r, high, height, width, density):
    return {(y, x): r.randint(5, high) for y in range(height) for x in range(width) if r.random() < density}


def test_spaced_peaks_equal_peaks_of_each_chip(spark):
    r = random.Random(8)
    height, width, threshold = 13, 17, 6
    chips = {k: some(r, r.choice([5, 6, 7, 8, 40]), height, width, r.choice([0.1, 0.6, 1.0])) for k in range(60)}
    chips[60] = {(y, x): 9 for y in range(height) for x in range(width)}  # one plateau
    rows = spark.createDataFrame([(k, y, x, v) for k, own in chips.items() for (y, x), v in own.items()], "chip int, r int, c int, v int")
    for d in (1, 2, 3):
        got = sorted((x.chip, x.r, x.c) for x in segment.spaced_peaks(rows, "chip", height, width, threshold, d).collect())
        want = []
        for k, own in chips.items():
            grid = np.full((height, width), -np.inf)
            for (y, x), v in own.items():
                grid[y, x] = v
            want += [(k, *p) for p in segment.peaks(grid, grid >= threshold, d, threshold)]
        assert got == sorted(want), d


def test_no_peaks_of_nothing(spark):
    empty = spark.createDataFrame([], "chip int, r int, c int, v int")
    assert segment.spaced_peaks(empty, "chip", 8, 8, 1, 2).count() == 0
    assert segment.components_across(empty, 8, 4).count() == 0


def test_components_that_wind_through_many_chunks(spark):
    width = 40
    snake = [(y, x) for y in range(0, 21, 2) for x in range(width)] + [(y, 0 if y % 4 == 1 else width - 1) for y in range(1, 20, 2)]
    spots = [(30 + 2 * k, 3 * k) for k in range(8)]
    rows = spark.createDataFrame(snake + spots + snake[:50], "r int, c int")
    got = {(x.r, x.c): x.component for x in segment.components_across(rows, width, 7).collect()}
    assert got == {p: 0 for p in snake} | {(y, x): y * width + x for y, x in spots}


def test_components_of_random_masks_equal_those_of_one_chunk(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([*some(r, 9, 50, 50, 0.55)], "r int, c int")
    whole, cut = (sorted(tuple(x) for x in segment.components_across(rows, 50, chunk).collect()) for chunk in (64, 6))
    assert whole == cut


def test_corners_walk_the_same_rings(spark):
    from pyspark.sql import functions as F

    from pixelplan.operators import raster

    r = random.Random(9)
    rows = [(k, 1 + (y * x) % 2, y, x) for k in range(12) for y in range(9) for x in range(9) if r.random() < 0.6]
    edges = raster.label_edges(spark.createDataFrame(rows, "chip int, label int, r int, c int"), "chip")
    rings = {}
    for x in segment.corners(edges, "chip").collect():
        rings.setdefault((x.chip, x.label, x.ring), {})[x.at] = (x.x, x.y)
    got = {}
    for (chip, label, _), own in rings.items():
        walk = [own[k] for k in range(len(own))]
        k = walk.index(min(walk)) if walk.count(min(walk)) == 1 else None
        got.setdefault((chip, label), []).append(sorted(walk) if k is None else walk[k:] + walk[:k])
    want = {}
    for x in segment.rings(edges, "chip").withColumn("points", F.col("points")).collect():
        walk = [(int(p.x), int(p.y)) for p in x.points[:-1]]
        k = walk.index(min(walk)) if walk.count(min(walk)) == 1 else None
        want.setdefault((x.chip, x.label), []).append(sorted(walk) if k is None else walk[k:] + walk[:k])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_edges_are_found_along_lines(spark):
    from pixelplan.operators import raster

    r = random.Random(10)
    rows = [(k, label, y, x) for k in ("a", "b", None) for label in (1, 2, None) for y in range(-2, 6) for x in range(-2, 6) if r.random() < 0.6]
    rows += r.sample(rows, 60)
    edges = raster.label_edges(spark.createDataFrame(rows, "chip string, label int, r int, c int").repartition(4), "chip")
    ways = (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))
    there = {x for x in rows if None not in x}
    want = [(k, label, y, x, name) for k, label, y, x in rows for name, dy, dx in ways if (k, label, y + dy, x + dx) not in there or None in (k, label)]
    assert sorted(map(tuple, edges.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in edges._jdf.queryExecution().toString()


def test_rings_within_blocks_are_walked_by_tasks_and_others_by_joins(spark, monkeypatch):
    from pixelplan.operators import raster

    r = random.Random(11)
    rows = [(k, 1 + (y * x) % 2, y, x) for k in "abcdef" for y in range(-7, 9) for x in range(-7, 9) if r.random() < 0.6]
    rows += [x for x in rows if x[0] == "b" and r.random() < 0.3] + [(None, 1, 0, 0)]  # pixels that are repeated
    edges = raster.label_edges(spark.createDataFrame(rows, "chip string, label int, r int, c int"), "chip").persist()
    want = sorted(map(tuple, segment._doubled(edges, "chip").collect()))
    assert want
    for bits, size in ((9, 10_000), (3, 7), (1, 50), (5, 13)):
        monkeypatch.setattr(segment, "BLOCK_BITS", bits)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)  # blocks reach over batches
        try:
            got = sorted(map(tuple, segment.corners(edges, "chip").collect()))
            whole = segment.whole_rings(edges, "chip").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
        each = {}
        for chip, label, ring, _, x, y in want:
            each.setdefault((chip, label, ring), []).append((x, y))
        assert {(x.chip, x.label, x.ring): list(zip(x.x, x.y, strict=True)) for x in whole} == each and len(whole) == len(each)


def test_short_rings_need_no_rounds(spark, monkeypatch):
    from pixelplan.operators import raster

    calls = []
    monkeypatch.setattr(segment, "kept", lambda df, real=segment.kept: (calls.append(1), real(df))[1])
    edges = raster.label_edges(spark.createDataFrame([(k, 1, y, x) for k in range(30) for y in range(5) for x in range(5)], "chip int, label int, r int, c int"), "chip")
    assert segment.corners(edges, "chip").count() == 30 * 20 and len(calls) == 1
    nothing = edges.where("chip < 0")
    assert segment.corners(nothing, "chip").count() == segment.whole_rings(nothing, "chip").count() == 0


def test_rings_have_no_group_for_each_label(spark):
    rows = [(k, 1, y, x) for k in (None, *range(40)) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a label's 16 sides reach over batches
    try:
        edges = spark.createDataFrame([(k, label, y, x, side) for k, label, y, x in rows for side in (["top"] * (y == 0) + ["bottom"] * (y == 2) + ["left"] * (x == 0) + ["right"] * (x == 2) + ["bottom"] * ((y, x) == (0, 1)) + ["top"] * ((y, x) == (2, 1)) + ["right"] * ((y, x) == (1, 0)) + ["left"] * ((y, x) == (1, 2)))], "chip int, label int, r int, c int, side string").repartition(3)
        found = segment.rings(edges, "chip")
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        got = {(x.chip, x.ring): [(p.x, p.y) for p in x.points] for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2 * 41 and {k for k, _ in got} == {None, *range(40)}
    assert all(len(walk) == (13 if ring == 0 else 5) and walk[0] == walk[-1] == ((0, 0) if ring == 0 else (1, 1)) for (_, ring), walk in got.items())


def test_label_rings_are_moved_whole(spark):
    from pixelplan import registry

    registry.load()
    plan = registry.QUERIES["label_rings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan
