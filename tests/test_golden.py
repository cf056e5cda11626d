"""Fixed cases whose results were derived by hand from the semantics."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelplan import config
from pixelplan.functions import crowns, mercator, rings
from pixelplan.operators import grids, matching, raster, segment, stats, tables, training, vector


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_size_classes_include_their_bounds(spark):
    assert one(spark, *(crowns.size_class(F.lit(x)) for x in (4.9, 4.91, 15.9, 15.91))) == ("small", "medium", "medium", "large")


def test_pixels_round_half_to_even(spark):
    assert one(spark, F.rint(F.lit(0.5)), F.rint(F.lit(1.5)), F.lit(-0.7).cast("int")) == (0.0, 2.0, 0)


def test_site_name_and_tile_name(spark):
    assert one(spark, crowns.site_name(F.lit("a_rgb_b_rgb")), crowns.tile_name(F.lit("Park"), F.lit(7), F.lit(204288))) == ("a_b", "park_r00007_c204288.tif")


def test_f1_without_any(spark):
    assert one(spark, *crowns.f1_scores(F.lit(0), F.lit(0), F.lit(0))) == (0.0, 0.0, 0.0)


def test_ground_resolution(spark):
    assert one(spark, *(F.round(mercator.ground_resolution_cm(F.lit(z)), 2) for z in (20, 19))) == (10.03, 20.05)


def test_utm_of_known_point(spark):
    east, north = one(spark, *mercator.utm(F.lit(-123.0), F.lit(0.0), 10))
    assert abs(east - 500000) < 1e-3 and abs(north) < 1e-3
    east, north = one(spark, *mercator.utm(F.lit(-122.0), F.lit(47.81), 10))
    assert abs(east - 574870.0) < 200 and abs(north - 5295700.0) < 2000


def test_single_pixel_crown_is_100(spark):
    rows = spark.createDataFrame([(1, 1, 3, 4)], "raster_id int, label int, r int, c int")
    assert raster.distance_transform(rows, "raster_id", "label").first()["dtm"] == 100.0


def test_origins(spark):
    got = {(r.h, r.w): r.n for r in grids.origins(spark.createDataFrame([(26000, 35000), (300, 300)], "h int, w int")).groupBy("h", "w").agg(F.count("*").alias("n")).collect()}
    assert got == {(26000, 35000): 14214, (300, 300): 9}
    small = spark.createDataFrame([(300, 300)], "h int, w int")
    assert sorted((r.r, r.c) for r in grids.origins(small).where("r < 0 or c < 0").collect()) == [(-212, -212), (-212, 0), (-212, 256), (0, -212), (256, -212)]
    assert grids.origins(small, inside=True).count() == 4


def test_rows_owned_twice_by_the_older_rule(spark):
    heights = spark.createDataFrame([(h,) for h in (26000, 35000, 2200, 2348, 2349, 1000)], "h int")
    assert {r.h: r.twice for r in grids.rows_owned_twice(heights, 2048, 300).collect()} == {26000: 0, 35000: 184, 2200: 152, 2348: 300, 2349: 0, 1000: 0}


def test_every_row_has_one_owner_among_its_chunks(spark):
    n = 2349
    rows = spark.range(n).select(F.col("id").cast("int").alias("y"))
    sent = rows.select("y", F.explode(grids.chunks_of(F.col("y"), F.lit(n), 512, 100)).alias("k"))
    assert sent.where(F.col("k") == grids.owner(F.col("y"), 512)).count() == n
    want = {(y, k) for y in range(n) for k in range(5) if k * 512 - 100 <= y < (k + 1) * 512 + 100}
    assert {(r.y, r.k) for r in sent.collect()} == want


def test_user_settings_replace_defaults():
    got = config.merged({"lr": None, "k_folds": 3, "other": 1})
    assert got["lr"] is None and got["k_folds"] == 3 and got["other"] == 1 and got["epochs"] == 100
    assert config.merged() == config.DEFAULTS


def test_cdf_matching_equals_searchsorted(spark):
    r = np.random.default_rng(1)
    counts = {s: r.integers(0, 50, 256) for s in (0, 1)}
    rows = [(s, v, int(n)) for s, own in counts.items() for v, n in enumerate(own)]
    cdf = raster.cdf(spark.createDataFrame(rows, "band int, v int, n long"), "band")
    source, reference = cdf.where("band = 0"), cdf.where("band = 1").withColumn("band", F.lit(0))
    got = {x.v: x.lut for x in raster.match_table(source, reference, "band").collect()}
    a, b = (np.cumsum(counts[s]) / counts[s].sum() for s in (0, 1))
    assert [got[v] for v in range(256)] == np.clip(np.searchsorted(b, a), 0, 255).tolist()


def test_histogram_has_every_bin(spark):
    rows = spark.createDataFrame([(0, 3), (0, 3), (1, 255)], "band int, v int")
    got = {(x.band, x.v): x.n for x in raster.histogram(rows, "band").collect()}
    assert len(got) == 512 and got[0, 3] == 2 and got[1, 255] == 1 and sum(got.values()) == 3


def loop_greedy(iou, threshold):
    taken, out = set(), []
    for g in range(len(iou)):
        best, at = 0.0, -1
        for p in range(len(iou[g])):
            if p not in taken and iou[g][p] > best:
                best, at = iou[g][p], p
        if at >= 0 and best >= threshold:
            taken.add(at)
            out.append((g, at))
    return out


def test_greedy_matching_equals_the_loop_and_collisions(spark):
    r = random.Random(3)
    for threshold in (0.3, 0.5):
        table = [[[round(r.random(), 1) for _ in range(6)] for _ in range(5)] for _ in range(20)]
        rows = [(t, g, p, x) for t, m in enumerate(table) for g, own in enumerate(m) for p, x in enumerate(own)]
        got = matching.greedy_matches(spark.createDataFrame(rows, "tile long, gt int, pred int, iou double"), threshold)
        assert sorted((x.tile, x.gt, x.pred) for x in got.collect()) == sorted((t, *m) for t, own in enumerate(table) for m in loop_greedy(own, threshold))


def test_greedy_matching_has_no_group_for_each_tile(spark):
    pairs = spark.createDataFrame([(None, 1, 1, 0.9), *((t, g, p, 0.5 + 0.1 * p) for t in range(300) for g in (2, 1) for p in (1, 2))], "tile long, gt int, pred int, iou double").repartition(3)
    found = matching.greedy_matches(pairs, 0.5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted((x.tile, x.gt, x.pred) for x in found.collect()) == sorted((t, g, 3 - g) for t in range(300) for g in (1, 2))


def test_document_of_many_and_of_tiny_numbers_has_no_exponents(spark):
    area = F.when(F.col("id") == 0, 1e-4).otherwise(12345678.0)
    crowns = spark.range(300000).select(area.alias("area_m2"), F.when(F.col("id") == 0, "small").otherwise("large").alias("size_class"))
    text = stats.document(crowns, spark.createDataFrame([("a\":\"1",), ("b",)], "site string")).first().document
    found = json.loads(text)
    assert "E" not in text and '"canopy_ha":370369105.4322,' in text and '"median_m2":12345678.0,' in text and '"percent":0.0003}' in text
    assert found["crowns"]["total_crowns"] == 300000 and found["classes"]["small"] == {"crowns": 1, "percent": 0.0003} and found["tiles"] == {'a":"1': 1, "b": 1}


def test_outcomes_add_up(spark):
    mask = lambda seed: spark.createDataFrame([(t, 1 + (y // 4) * 2 + x // 4, y, x) for t in range(6) for y in range(8) for x in range(8) if random.Random(seed * 1000 + t * 64 + y * 8 + x).random() < 0.7], "tile long, label int, r int, c int")
    predicted, true = mask(1), mask(2)
    found = matching.overlaps(predicted, true)
    kinds = {x.kind: x["count"] for x in matching.outcomes(found, matching.greedy_matches(matching.pairs_of(found), 0.5)).groupBy("kind").count().collect()}
    n_true, n_pred = (x.select("tile", "label").distinct().count() for x in (true, predicted))
    assert kinds.get("tp", 0) + kinds.get("fn", 0) == n_true and kinds.get("tp", 0) + kinds.get("fp", 0) == n_pred


def test_f1_rows_of_missing_classes(spark):
    rows = spark.createDataFrame([("tp", "a", "large"), ("fn", "b", "large"), ("fp", "b", "medium")], "kind string, site string, size_class string")
    got = {(x.grouping, x.label): (x.tp, x.fp, x.fn, x.precision, x.recall) for x in tables.f1_by_group(rows, ["small", "medium", "large"]).collect()}
    assert got["size_class", "small"] == (0, 0, 0, 0.0, 0.0) and got["size_class", "large"] == (1, 0, 1, 1.0, 0.5)
    assert got["overall", "all"] == (1, 1, 1, 0.5, 0.5) and got["site", "a"] == (1, 0, 0, 1.0, 1.0) and len(got) == 6


def loop_stop(values, patience):
    best, bad = math.inf, 0
    for k, v in enumerate(values, 1):
        if v < best:
            best, bad = v, 0
        else:
            bad += 1
        if bad >= patience:
            return k, best
    return len(values), best


def test_early_stop_equals_the_loop(spark):
    r = random.Random(5)
    histories = {f: [round(r.random() + 2 / (k + 1), 2) for k in range(r.randint(1, 60))] for f in range(12)}
    rows = spark.createDataFrame([(f, k, v) for f, own in histories.items() for k, v in enumerate(own, 1)], "fold int, epoch int, val_mae double")
    got = {x.fold: (x.stop_epoch, x.best) for x in training.early_stop(rows, 7).collect()}
    assert got == {f: loop_stop(own, 7) for f, own in histories.items()}


def test_plateau_rates(spark):
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate([5.0, 4.0, 4.0, 4.0, 4.0, 3.0, 3.0], 1)], "fold int, epoch int, val_mae double")
    got = [x.lr for x in training.plateau_rates(rows, 1.0, 0.5, 2).orderBy("epoch").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5]


def test_numbering_follows_the_order(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009,) for k in range(1000)], "k long")
    got = sorted((x.k, x.number) for x in tables.numbered(rows, "k").collect())
    assert [n for _, n in got] == list(range(1, 1001))


def test_rings(spark):
    def ring(*points):
        return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))

    triangle = ring((0, 0), (4, 0), (0, 3), (0, 0))
    assert one(spark, rings.area(triangle), *(F.round(c, 6) for c in rings.centroid(triangle))) == (6.0, 1.333333, 1.0)
    assert one(spark, rings.contains(triangle, F.lit(0.5), F.lit(0.5)), rings.contains(triangle, F.lit(3.0), F.lit(2.0))) == (True, False)
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))
    assert one(spark, rings.self_crossing(bow), rings.self_crossing(triangle)) == (True, False)
    assert one(spark, rings.centroid(ring((1, 1), (1, 1)))[0]) == (None,)


def test_reflected_border(spark):
    pixels = spark.createDataFrame([(1, r, c, r * 4 + c) for r in range(4) for c in range(4)], "k int, r int, c int, v int")
    got = {(x.r, x.c): x.v for x in raster.padded(pixels, "k", 4, 2).collect()}
    want = np.pad(np.arange(16).reshape(4, 4), 2, mode="reflect")
    assert all(got[r - 2, c - 2] == want[r, c] for r in range(8) for c in range(8))


def test_later_polygon_stays(spark):
    pixels = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 1)], "r int, c int, id int")
    assert sorted(tuple(x) for x in vector.painted(pixels, "id").collect()) == [(0, 0, 2), (0, 1, 1)]


def test_flood_fills_what_is_connected():
    grid = np.array([[9, 5, 1, 5, 9], [8, 4, 1, 4, 8], [1, 1, 1, 1, 1], [7, 1, 1, 1, 1]], float)
    mask = grid >= 4
    seeds = [(0, 0), (0, 4), (3, 0)]
    assert segment.flood(grid, mask, seeds).tolist() == [[1, 1, 0, 2, 2], [1, 1, 0, 2, 2], [0] * 5, [3, 0, 0, 0, 0]]
    assert segment.flood(grid, mask, seeds[:1])[0].tolist() == [1, 1, 0, 0, 0]  # unreachable pixels have no label


def plain_peaks(grid, mask, d, threshold):
    """The definition, place by place."""
    h, w = grid.shape
    inside = [(r, c) for r in range(d, h - d) for c in range(d, w - d) if mask[r, c]]
    if not inside:
        return []
    (r0, r1), (c0, c1) = ((min(x), max(x)) for x in zip(*inside, strict=True))
    own = {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if mask[r, c]}
    highest = {p: max(grid[q] for q in own if max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= d) for p in own}
    found = [p for p in own if grid[p] == highest[p]]
    if len(found) == len(own) and (r1 - r0 + 1) * (c1 - c0 + 1) > 1:
        cross = lambda p: {p, (p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)}
        covered = {q for p in own if cross(p) <= own for q in cross(p)}
        found = [p for p in own if p not in covered]
    kept = []
    for p in sorted((p for p in found if grid[p] > threshold), key=lambda p: (-grid[p], p)):
        if all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) >= d for q in kept):
            kept.append(p)
    return sorted(kept)


def test_peaks_equal_the_definition():
    r = np.random.default_rng(7)
    for k in range(300):
        grid = r.integers(0, (2, 4, 60)[k % 3], (int(r.integers(3, 14)), int(r.integers(3, 14)))).astype(float)
        d, threshold = int(r.integers(1, 4)), float(r.integers(0, 3))
        mask = grid >= threshold
        assert segment.peaks(grid, mask, d, threshold) == plain_peaks(grid, mask, d, threshold)
    flat = np.full((9, 9), 5.0)
    assert segment.peaks(flat, flat > 1, 1, 1.0) == [(1, 1), (1, 7), (7, 1), (7, 7)]  # one height: only what no cross covers
    edge = np.zeros((9, 9))
    edge[0, 4] = edge[4, 4] = 9
    assert segment.peaks(edge, edge > 1, 2, 1.0) == [(4, 4)]  # the edge is left out
    assert segment.markers((1, 4), [(0, 0), (0, 1), (0, 3)]).tolist() == [[1, 1, 0, 2]]


def test_chunked_crowns_equal_whole(spark):
    size = 48
    blobs = [(6, 7), (15, 16), (16, 33), (31, 31), (40, 12), (33, 44)]
    rows = [(r, c, max(0.0, 100 - 22 * math.hypot(r - y, c - x))) for y, x in blobs for r in range(size) for c in range(size) if math.hypot(r - y, c - x) < 4]
    dtm = spark.createDataFrame(rows, "r int, c int, v double").groupBy("r", "c").agg(F.max("v").alias("v"))
    facts = ("area_m2", "min_r", "max_r", "min_c", "max_c")
    whole = segment.crowns_from_dtm(dtm.withColumn("k", F.lit(0)), "k", 10.0, 2, 1.0, 2.0, lambda key: (0, size, 0, size))
    parts = segment.chunked_crowns(dtm, size, size, 16, 8, 10.0, 2, 1.0, 2.0)
    assert sorted(tuple(x[f] for f in facts) for x in whole.collect()) == sorted(tuple(x[f] for f in facts) for x in parts.collect())
    assert whole.count() == len(blobs)


def test_outlines_enclose_their_pixels(spark):
    shape = ["####.", "#..#.", "####.", "....#"]
    rows = [(1, 1, r, c) for r, line in enumerate(shape) for c, x in enumerate(line) if x == "#"]
    edges = raster.label_edges(spark.createDataFrame(rows, "k int, label int, r int, c int"), "k")
    found = [[(p["x"], p["y"]) for p in x.points] for x in segment.rings(edges, "k").collect()]
    area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False)) / 2 for p in found]
    assert all(p[0] == p[-1] for p in found) and sum(area) in (len(rows), -len(rows)) and len(found) == 3


@pytest.mark.parametrize("name", ["crown_summary", "iou_pairs", "distance_transform", "rasterize", "origin_grid", "halo_chunks", "stratified_split"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    from pixelplan import registry

    registry.load()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_numbers_and_medians_of_any_keys(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", None, "b", "hot", "hot", "hot"]), r.choice([None, 1.0, 1.0, 1.0, r.random() * 9]), k) for k in range(900)] + [("none", None, 901)]
    table = spark.createDataFrame(rows, "site string, v double, k int").repartition(5)
    placed = tables.numbered_within(table, ["site"], "k").collect()
    for site in {x[0] for x in rows}:
        own = sorted(k for s, _, k in rows if s == site)
        assert {x.k: (x.number, x["size"]) for x in placed if x.site == site} == {k: (i + 1, len(own)) for i, k in enumerate(own)}
    values = {site: [v for s, v, _ in rows if s == site and v is not None] for site in {x[0] for x in rows}}
    assert {x.site: x.median for x in tables.median(table, "v", "site").collect()} == {s: float(np.median(v)) for s, v in values.items() if v}
    assert tables.median(table, "v").first()["median"] == float(np.median([v for _, v, _ in rows if v is not None]))
    assert [x["median"] for x in tables.median(table.where("k > 900"), "v").collect()] == [None] and tables.median(table.where("k > 900"), "v", "site").count() == 0
    assert tables.numbered_within(table.where("k > 999"), ["site"], "k").count() == 0


@pytest.mark.parametrize("most", [tables.SENT_KEYS, 0])
def test_rows_of_a_large_key_are_not_gathered_to_be_numbered(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "SENT_KEYS", most)
    rows = [(("a", None, "b")[k % 7 % 3], k) for k in range(500)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tables.numbered_within(spark.createDataFrame(rows, "site string, k int").repartition(4), ["site"], "k")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "_salt" in plan if not most else "SortMergeJoin" not in plan
    for site in ("a", None, "b"):
        own = [k for s, k in rows if s == site]
        assert sorted((x.number, x.k, x["size"]) for x in got if x.site == site) == [(i + 1, k, len(own)) for i, k in enumerate(own)]


def test_tries_of_a_tile(spark):
    cases = {"ok": [(200, True)], "no image": [(200, False), (200, True)], "gone": [(404, False), (200, True)], "slow": [(429, False), (None, False), (200, True)], "never": [(429, False)] * 5}
    rows = [(key, k, status, image) for key, own in cases.items() for k, (status, image) in enumerate(own)]
    got = {x.key: tuple(x)[1:] for x in vector.attempts(spark.createDataFrame(rows, "key string, attempt int, status int, image boolean"), "key").collect()}
    assert got == {"ok": ("tile", 1, 0), "no image": ("missing", 1, 0), "gone": ("missing", 1, 0), "slow": ("tile", 3, 2), "never": ("missing", 3, 7)}


def test_large_tables_reach_pixels_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(raster, "SENT_ROWS", 3)
    pixels = spark.createDataFrame([(k % 2, k, k % 5, k % 4) for k in range(40)], "site int, r int, c int, v int")
    luts = spark.createDataFrame([(s, v, 10 * s + v) for s in range(2) for v in range(4)], "site int, v int, lut int")
    assert sorted((x.r, x.matched) for x in raster.apply_table(pixels, luts, "site").collect()) == [(k, 10 * (k % 2) + k % 4) for k in range(40)]


def test_long_rings_that_cross_themselves(spark, monkeypatch):
    turn = [(10 * math.cos(k / 50 * math.pi), 10 * math.sin(k / 50 * math.pi)) for k in range(100)]
    bent = [*turn[:30], turn[60], *turn[31:60], turn[30], *turn[61:]]
    knot = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    shapes = {"circle": turn, "bent": bent, "knot": knot, "square": [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]}
    rows = [(name, 0, [{"x": x, "y": y} for x, y in [*points, points[0]]]) for name, points in shapes.items()]
    parts_ = spark.createDataFrame(rows, "key string, part int, ring array<struct<x: double, y: double>>")
    for few in (64, 3, 1000):
        monkeypatch.setattr(vector, "FEW_POINTS", few)
        assert {x.key for x in vector.crossing(parts_, "key", "part").collect()} == {"bent", "knot"}
