"""Queries on pixel tables, masks and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, rings
from ..functions.crowns import size_class
from ..operators import matching, raster, segment, tables
from ..registry import query
from ..storage import kept
from ..sources import projections as src

PIXELS = "(select vec_id raster_id, label site_no, (pos // 8)::integer r, (pos % 8)::integer c, floor(least(255.0::double, greatest(0.0::double, (p::double + 0.5) * 256)))::integer v from (select vec_id, label, unnest(range(64)) pos, unnest(embedding) p from embeddings))"
MASKS = f"(select *, (1 + 2 * (r // 4) + (c // 4))::integer \"label\" from {PIXELS} where v >= 120)"
PAIRS = (
    f"(with m as (select raster_id // 2 tile, raster_id % 2 odd, \"label\", r, c from {MASKS}), g as (select tile, \"label\" gt, r, c from m where odd = 0), p as (select tile, \"label\" pred, r, c from m where odd = 1), "
    "ng as (select tile, gt, count(*) n from g group by 1, 2), np as (select tile, pred, count(*) n from p group by 1, 2), i as (select tile, gt, pred, count(*) inter from g join p using (tile, r, c) group by 1, 2, 3) "
    "select tile, gt, pred, inter, ng.n + np.n - inter uni, inter::double / (ng.n + np.n - inter) iou from i join ng using (tile, gt) join np using (tile, pred))"
)
_MEAN, _STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)  # fixed values of the pretrained encoder


def _pairs(spark, sf_dir):
    return matching.iou_pairs(*src.predicted_and_true(spark, sf_dir))


@query(f"select raster_id, min(v) low, round(avg(v), 6) mean, max(v) high, count(v) valid from {PIXELS} group by 1")
def band_stats(spark, sf_dir):
    return raster.band_stats(src.pixels(spark, sf_dir), "raster_id")


@query(f"select site_no, min(nullif(v, 0)) low, round(avg(nullif(v, 0)), 6) mean, max(nullif(v, 0)) high, count(nullif(v, 0)) valid from {PIXELS} group by 1")
def nodata_stats(spark, sf_dir):
    return raster.band_stats(src.pixels(spark, sf_dir), "site_no", nodata=0)


@query(f"select raster_id, r, c, v from {PIXELS} where r between 2 and 5 and c between 1 and 3")
def window_read(spark, sf_dir):
    return src.pixels_of(spark, sf_dir, 2, 1, 4, 3).select("raster_id", "r", "c", "v")


@query(f"select raster_id, r, c, band, round((v / 255.0::double - m) / s, 8) x from {PIXELS} join (values (0, 0.485::double, 0.229::double), (1, 0.456, 0.224), (2, 0.406, 0.225)) b(band, m, s) on raster_id % 3 = band ")
def normalise_pixels(spark, sf_dir):
    bands = spark.createDataFrame([(k, m, s) for k, (m, s) in enumerate(zip(_MEAN, _STD, strict=True))], "band int, m double, s double")
    rows = src.pixels(spark, sf_dir).withColumn("band", (F.col("raster_id") % 3).cast("int"))
    return rows.join(F.broadcast(bands), "band").select("raster_id", "r", "c", "band", F.round(raster.normalised(F.col("v"), F.col("m"), F.col("s")), 8).alias("x"))


@query("select vec_id raster_id, i::integer i, embedding[(i % 16) * 4 + i // 16 + 1]::double planar, embedding[i + 1]::double back from embeddings, (select unnest(range(64)) i)")
def band_layouts(spark, sf_dir):
    """Chips of 4 x 4 pixels with four bands, pixel by pixel, as bands and back."""
    planar = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), raster.to_planes(F.col("embedding"), 4, 4, 4).alias("p"))
    both = planar.select("raster_id", F.posexplode(F.arrays_zip("p", raster.to_pixels(F.col("p"), 4, 4, 4).alias("b"))).alias("i", "x"))
    return both.select("raster_id", "i", F.col("x.p").cast("double").alias("planar"), F.col("x.b").cast("double").alias("back"))


@query(f"select raster_id, round(avg(v), 6) mean from {PIXELS} where r between 2 and 5 and c between 2 and 5 group by 1 having avg(v) > 10")
def centre_validation(spark, sf_dir):
    centre = src.pixels_of(spark, sf_dir, 2, 2, 4, 4).groupBy("raster_id").agg(F.avg("v").alias("m"))
    return centre.where("m > 10").select("raster_id", F.round("m", 6).alias("mean"))


@query(f"select raster_id, round(avg(v), 6) mean from {PIXELS} group by 1 having avg(v) >= 128")
def chip_rejection(spark, sf_dir):
    return raster.keep_bright(src.pixels(spark, sf_dir), "raster_id", 128).select("raster_id", F.round("mean", 6).alias("mean"))


@query(f"select raster_id from (select * from (select raster_id, avg(v) m from {PIXELS} group by 1 order by raster_id limit 200) where m >= 128 order by raster_id limit 100)")
def bounded_sample(spark, sf_dir):
    chips = src.pixels(spark, sf_dir).groupBy("raster_id").agg(F.avg("v").alias("m"))
    return raster.bounded_sample(chips, "raster_id", F.col("m") >= 128, 100).select("raster_id")


_HIST = f"(select s.site_no, s.v, coalesce(n, 0)::bigint n from (select site_no, unnest(range(256))::integer v from (select distinct site_no from {PIXELS})) s left join (select site_no, v, count(*) n from {PIXELS} group by 1, 2) h using (site_no, v))"
_CDF = f"(select site_no, v, n, sum(n) over (partition by site_no order by v)::double / sum(n) over (partition by site_no)::double cdf from {_HIST})"
_LUT = f"(select s.site_no, s.v, coalesce(min(r.v), 255)::integer lut from {_CDF} s left join (select site_no - 1 site_no, v, cdf from {_CDF} where site_no > 0) r on s.site_no = r.site_no and r.cdf >= s.cdf group by 1, 2)"


def _cdf(spark, sf_dir):
    return raster.cdf(raster.histogram(src.pixels(spark, sf_dir), "site_no"), "site_no")


def _lut(spark, sf_dir):
    cdf = _cdf(spark, sf_dir)
    return raster.match_table(cdf, cdf.where("site_no > 0").withColumn("site_no", F.col("site_no") - 1), "site_no")


@query(f"select * from {_HIST}")
def histogram_256(spark, sf_dir):
    return raster.histogram(src.pixels(spark, sf_dir), "site_no")


@query(f"select site_no, v, round(cdf, 9) cdf from {_CDF}")
def cdf(spark, sf_dir):
    return _cdf(spark, sf_dir).select("site_no", "v", F.round("cdf", 9).alias("cdf"))


@query(f"select * from {_LUT}")
def match_lut(spark, sf_dir):
    return _lut(spark, sf_dir)


@query(f"select raster_id, r, c, v, lut matched from {PIXELS} join {_LUT} using (site_no, v)")
def apply_lut(spark, sf_dir):
    return raster.apply_table(src.pixels(spark, sf_dir), _lut(spark, sf_dir), "site_no").select("raster_id", "r", "c", "v", "matched")


_ZONAL = f"(select raster_id, \"label\", count(*) pixels, count(*) * 0.5::double area_m2, min(r) min_r, max(r) max_r, min(c) min_c, max(c) max_c, trunc(avg(r))::integer centre_r, trunc(avg(c))::integer centre_c from {MASKS} group by 1, 2)"


@query(f"select * from {_ZONAL}")
def zonal_stats(spark, sf_dir):
    return raster.zonal_stats(src.masks(spark, sf_dir), "raster_id", "label", pixel_area=0.5)


@query(f"select raster_id, \"label\", area_m2 from {_ZONAL} where area_m2 >= 5")
def zonal_filter(spark, sf_dir):
    return raster.zonal_stats(src.masks(spark, sf_dir), "raster_id", "label", pixel_area=0.5).where("area_m2 >= 5").select("raster_id", "label", "area_m2")


_DTM = (
    f"(with k as (select raster_id, \"label\", least(max(r), greatest(min(r), round_even(avg(r), 0))) y, least(max(c), greatest(min(c), round_even(avg(c), 0))) x from {MASKS} group by 1, 2), "
    f"d as (select raster_id, \"label\", r, c, sqrt((r - y) ** 2 + (c - x) ** 2) d from {MASKS} join k using (raster_id, \"label\")), f as (select *, max(d) over (partition by raster_id, \"label\") m from d) "
    "select raster_id, \"label\", r, c, case when m = 0 then 100.0::double else (1 - d / m) * 99 + 1 end dtm from f)"
)


@query(f"select raster_id, \"label\", r, c, round(dtm, 6) dtm from {_DTM}")
def distance_transform(spark, sf_dir):
    return raster.distance_transform(src.masks(spark, sf_dir), "raster_id", "label").select("raster_id", "label", "r", "c", F.round("dtm", 6).alias("dtm"))


@query(
    f"select raster_id, coalesce(n, 0)::bigint crown_pixels, low, high, round(coalesce(n, 0) * 100.0::double / 64, 6) coverage_pct from (select distinct vec_id raster_id from embeddings) left join (select raster_id, count(*) n, round(min(dtm), 6) low, round(max(dtm), 6) high from {_DTM} where raster_id % 3 > 0 group by 1) using (raster_id)"
)
def dtm_coverage(spark, sf_dir):
    """Each third raster has no crown at all."""
    masks = src.masks(spark, sf_dir).where("raster_id % 3 > 0")
    every = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"))
    return raster.coverage(raster.distance_transform(masks, "raster_id", "label"), "raster_id", 64, every)


@query(f"select raster_id, r, c, p.v rgb, round(coalesce(dtm, 0), 6) dtm from {PIXELS} p left join {_DTM} d using (raster_id, r, c)")
def rgb_dtm_pair(spark, sf_dir):
    """Images and their transforms pixel by pixel; images of another size than their transform's would raise."""
    rgb = src.pixels(spark, sf_dir)
    dtm = raster.distance_transform(src.masks(spark, sf_dir), "raster_id", "label").select("raster_id", "r", "c", "dtm")
    sizes = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), F.expr("size(embedding) div 8").alias("h"), F.lit(8).alias("w"))
    checked = raster.same_extent(sizes, sizes, "raster_id").where("h > 0").select("raster_id")
    return rgb.join(checked, "raster_id", "left_semi").join(dtm, ["raster_id", "r", "c"], "left").select("raster_id", "r", "c", F.col("v").alias("rgb"), F.round(F.coalesce("dtm", F.lit(0.0)), 6).alias("dtm"))


@query(f"select raster_id, (r // 3)::integer tile_r, (c // 3)::integer tile_c, round(count(*) filter (x > 0) / 9.0::double, 4) crown_frac, coalesce(round(avg(x) filter (x > 0), 2), 0.0::double) dtm_mean, coalesce(max(x) filter (x > 0), 0) dtm_max from (select *, case when v >= 120 then v else 0 end x from {PIXELS}) where r < 6 and c < 6 group by 1, 2, 3")
def tile_stats(spark, sf_dir):
    rows = src.pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 120, F.col("v")).otherwise(0))
    return raster.tile_stats(rows, "raster_id", 3, 8, 8)


@query(
    f"select raster_id, (tr)::integer tile_r, (tc)::integer tile_c, round(count(*) filter (x > 0) / 16.0::double, 4) crown_frac, coalesce(round(avg(x) filter (x > 0), 2), 0.0::double) dtm_mean, coalesce(max(x) filter (x > 0), 0) dtm_max "
    f"from (select *, case when v >= 120 then v else 0 end x from {PIXELS}), (select unnest(range(3)) tr), (select unnest(range(3)) tc) where r >= tr * 2 and r < tr * 2 + 4 and c >= tc * 2 and c < tc * 2 + 4 group by 1, 2, 3"
)
def tile_stats_stride(spark, sf_dir):
    """Tiles of 4 x 4 that begin every 2 pixels."""
    rows = src.pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 120, F.col("v")).otherwise(0))
    return raster.tile_stats(rows, "raster_id", 4, 8, 8, stride=2)


@query(f"select raster_id, \"label\", round(1000 + min(c) * 0.5::double, 6) \"left\", round(2000 - (max(r) + 1) * 0.5::double, 6) bottom, round(1000 + (max(c) + 1) * 0.5::double, 6) \"right\", round(2000 - min(r) * 0.5::double, 6) top from {MASKS} group by 1, 2")
def crown_bounds(spark, sf_dir):
    """The boxes of crowns on the map."""
    found = raster.zonal_stats(src.masks(spark, sf_dir), "raster_id", "label")
    sides = geo.to_bounds(*(F.col(c) for c in ("min_r", "max_r", "min_c", "max_c")), F.lit(1000.0), F.lit(2000.0), F.lit(0.5))
    return found.select("raster_id", "label", *(F.round(x, 6).alias(n) for x, n in zip(sides, ("left", "bottom", "right", "top"), strict=True)))


@query(f"select tile, gt, pred, inter, uni, round(iou, 6) iou from {PAIRS}")
def iou_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("iou", F.round("iou", 6))


_BOXES = f"(select raster_id // 2 tile, raster_id % 2 odd, \"label\", min(r) r0, max(r) r1, min(c) c0, max(c) c1 from {MASKS} group by 1, 2, 3)"


@query(f"select a.tile, a.\"label\" label_a, b.\"label\" label_b from {_BOXES} a join {_BOXES} b on a.tile = b.tile and a.odd = 1 and b.odd = 0 and a.r1 >= b.r0 and b.r1 >= a.r0 and a.c1 >= b.c0 and b.c1 >= a.c0")
def bbox_pairs(spark, sf_dir):
    predicted, true = (raster.zonal_stats(x, "tile", "label") for x in src.predicted_and_true(spark, sf_dir))
    return matching.bbox_pairs(predicted, true, cell=3)


@query(f"select tile, gt, pred, round(iou, 6) iou from (select *, row_number() over (partition by tile, gt order by iou desc, pred) rn from {PAIRS}) where rn = 1")
def best_match(spark, sf_dir):
    return matching.best_match(_pairs(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


_SIDES = f"(select raster_id // 2 tile, raster_id % 2 odd, r, c from {MASKS})"


@query(f"select tile, r, c, bool_or(odd = 1) and bool_or(odd = 0) both_ from {_SIDES} group by 1, 2, 3")
def mask_algebra(spark, sf_dir):
    predicted, true = (x.select("tile", "r", "c") for x in src.predicted_and_true(spark, sf_dir))
    both = predicted.intersect(true).withColumn("both_", F.lit(True))
    return predicted.union(true).distinct().join(both, ["tile", "r", "c"], "left").withColumn("both_", F.coalesce("both_", F.lit(False)))


@query(f"select tile, gt, pred, round(iou, 6) iou from {PAIRS} where iou > 0.5")
def match_gt_half(spark, sf_dir):
    return _pairs(spark, sf_dir).where("iou > 0.5").select("tile", "gt", "pred", F.round("iou", 6).alias("iou"))


@query(f"select tile, gt, pred, round(iou, 6) iou from {PAIRS} where iou >= 0.5")
def match_greedy(spark, sf_dir):
    return matching.greedy_matches(_pairs(spark, sf_dir), 0.5).withColumn("iou", F.round("iou", 6))


_TORN = "(select l_orderkey tile, l_linenumber::integer gt, (l_partkey % 3)::integer pred, max(round(0.45 + l_quantity / 100.0::double, 2)) iou from lineitem group by 1, 2, 3)"


@query(
    f"with recursive p as materialized (select * from {_TORN} where iou >= 0.5), k as (select tile, gt, row_number() over (partition by tile order by gt) n from (select distinct tile, gt from p)), q as materialized (select p.*, n from p join k using (tile, gt)), "
    "w as (select tile, 0::bigint n, []::integer[] taken, null::integer gt, null::integer pred, null::double iou from (select distinct tile from p) union all "
    "select tile, n, case when pick is null then taken else list_append(taken, pick.pred) end, gt, pick.pred, pick.iou from (select w.tile, w.n + 1 n, w.taken, any_value(q.gt) gt, "
    "arg_max({'pred': q.pred, 'iou': q.iou}, q.iou * 1000 - q.pred) filter (not list_contains(w.taken, q.pred)) pick from w join q on q.tile = w.tile and q.n = w.n + 1 group by w.tile, w.n, w.taken)) "
    "select tile, gt, pred, iou from w where pred is not null"
)
def match_greedy_torn(spark, sf_dir):
    """Greedy matches where several true crowns want one prediction: lines of orders stand for crowns, parts modulo 3 for predictions."""
    iou = F.max(F.round(F.lit(0.45) + F.col("l_quantity") / F.lit(100.0), 2)).alias("iou")
    pairs = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tile"), F.col("l_linenumber").cast("int").alias("gt"), (F.col("l_partkey") % 3).cast("int").alias("pred")).agg(iou)
    return matching.greedy_matches(pairs, 0.5)


_KINDS = (
    f"(with m as materialized (select * from {PAIRS} where iou >= 0.5), a as (select raster_id // 2 tile, raster_id % 2 odd, \"label\", count(*) area from {MASKS} group by 1, 2, 3), "
    "k as (select case when gt is null then 'fn' else 'tp' end kind, a.tile, area from a left join m on a.tile = m.tile and a.\"label\" = m.gt where odd = 0 union all select 'fp', a.tile, area from a left join m on a.tile = m.tile and a.\"label\" = m.pred where odd = 1 and m.pred is null) "
    "select kind, (tile % 3)::integer site, case when area <= 4.9 then 'small' when area <= 15.9 then 'medium' else 'large' end size_class from k)"
)


@query(
    f"with k as ({_KINDS}), c as (select * from (select 'size_class' grouping_, s label, count(*) filter (kind = 'tp') tp, count(*) filter (kind = 'fp') fp, count(*) filter (kind = 'fn') fn from (select unnest(['small', 'medium', 'large']) s) left join k on size_class = s group by 2 "
    "union all select 'overall', 'all', count(*) filter (kind = 'tp'), count(*) filter (kind = 'fp'), count(*) filter (kind = 'fn') from k union all select 'site', site::varchar, count(*) filter (kind = 'tp'), count(*) filter (kind = 'fp'), count(*) filter (kind = 'fn') from k group by site)), "
    "pr as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0::double end p, case when tp + fn > 0 then tp::double / (tp + fn) else 0.0::double end r from c) "
    'select grouping_ as "grouping", label, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end, 6) f1 from pr'
)
def f1_by_group(spark, sf_dir):
    predicted, true = src.predicted_and_true(spark, sf_dir)
    found = kept(matching.overlaps(predicted, true))
    kinds = matching.outcomes(found, kept(matching.greedy_matches(matching.pairs_of(found), 0.5)))
    rows = kinds.select("kind", (F.col("tile") % 3).cast("int").alias("site"), size_class(F.col("area")).alias("size_class"))
    found = tables.f1_by_group(rows, ["small", "medium", "large"]).orderBy("grouping", "label")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"select raster_id, r.r, c.c, v from (select unnest(range(-2, 10))::integer r) r, (select unnest(range(-2, 10))::integer c) c, (select raster_id, r pr, c pc, v from {PIXELS}) p where pr = case when r.r < 0 then -r.r when r.r >= 8 then 14 - r.r else r.r end and pc = case when c.c < 0 then -c.c when c.c >= 8 then 14 - c.c else c.c end")
def reflect_pad(spark, sf_dir):
    return raster.padded(src.pixels(spark, sf_dir), "raster_id", 8, 2)


@query(f"select site_no, r, c, arg_max(v, raster_id) v from {PIXELS} group by 1, 2, 3")
def last_write_wins(spark, sf_dir):
    writes = src.pixels(spark, sf_dir).withColumns({"origin_r": F.expr("raster_id div 100"), "origin_c": F.col("raster_id") % 100})
    return raster.last_write(writes, "site_no", "r", "c")


@query(f"with e as (select vec_id raster_id, (pos // 8)::integer r, (pos % 8)::integer c, p::double v from (select vec_id, unnest(range(64)) pos, unnest(embedding) p from embeddings)) select raster_id, r, c, v from e a where v >= (select max(b.v) from e b where a.raster_id = b.raster_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1)")
def focal_max(spark, sf_dir):
    rows = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), F.posexplode("embedding").alias("pos", "p"))
    rows = rows.select("raster_id", F.expr("pos div 8").cast("int").alias("r"), (F.col("pos") % 8).alias("c"), F.col("p").cast("double").alias("v"))
    return raster.focal_max(rows, "raster_id", 1).select("raster_id", "r", "c", "v")


@query(
    f"with recursive m as (select raster_id, r, c, r * 8 + c id from {PIXELS} where v >= 120), e as (select a.raster_id, a.id a, b.id b from m a join m b on a.raster_id = b.raster_id and abs(a.r - b.r) + abs(a.c - b.c) = 1), "
    "w as (select raster_id, id, id root from m union select e.raster_id, e.b, w.root from w join e on w.raster_id = e.raster_id and w.id = e.a) select raster_id, (id // 8)::integer r, (id % 8)::integer c, min(root)::integer component from w group by raster_id, id",
)
def components(spark, sf_dir):
    found = segment.components(src.pixels(spark, sf_dir).where("v >= 120"), "raster_id", 8)
    return found.select("raster_id", "r", "c", "component")


_SIDE = f"(select ((raster_id // 64) * 8 + r)::integer r, ((raster_id % 64) * 8 + c)::integer c, v from {PIXELS})"


def _side_by_side(spark, sf_dir):
    """All chips as one raster, 64 in a row."""
    return src.pixels(spark, sf_dir).select((F.expr("raster_id div 64") * 8 + F.col("r")).cast("int").alias("r"), ((F.col("raster_id") % 64) * 8 + F.col("c")).cast("int").alias("c"), "v")


def _height(spark, sf_dir):
    return src.table(spark, sf_dir, "embeddings").agg(F.coalesce((F.expr("max(vec_id) div 64 + 1") * 8).cast("int"), F.lit(0))).first()[0]


@query(
    f"with recursive m as materialized (select r, c, r::bigint * 512 + c id from {_SIDE} where v >= 128), e as materialized (select a.id a, b.id b from m a join m b on (a.r = b.r and abs(a.c - b.c) <= 1) or (a.c = b.c and abs(a.r - b.r) = 1)), "
    "w as (select id, id root, true moved, 0 step from m union all select id, root, bool_or(moved) over () moved, step + 1 from (select w.id, min(o.root) root, min(o.root) < any_value(w.root) moved, any_value(w.step) step from w join e on e.a = w.id join w o on o.id = e.b where w.moved group by w.id)) "
    "select m.r, m.c, root component from m join (select id, min(root) root from w group by 1) using (id)"
)
def components_across(spark, sf_dir):
    """Components of all chips side by side as one raster, in chunks of 16 x 16."""
    return segment.components_across(_side_by_side(spark, sf_dir).where("v >= 128"), 512, 16)


@query(
    f"with recursive i as materialized (select r, c, v from {_SIDE} where v >= 120 and c between 3 and 508 and r between 3 and (select max(r) - 3 from {_SIDE})), "
    "t as materialized (select a.r, a.c, any_value(a.v) v from i a join i b on b.r between a.r - 3 and a.r + 3 and b.c between a.c - 3 and a.c + 3 group by a.r, a.c having max(b.v) <= any_value(a.v) and any_value(a.v) > 120), "
    "p as materialized (select row_number() over (order by v desc, r, c) k, r, c, v from t), x as materialized (select a.k, b.k worse from p a join p b on a.k < b.k and abs(a.r - b.r) < 3 and abs(a.c - b.c) < 3), "
    "w as (select 0::bigint k, []::bigint[] gone union all select w.k + 1, list_concat(gone, case when list_contains(gone, w.k + 1) then [] else coalesce((select list(worse) from x where x.k = w.k + 1), []) end) from w where w.k < (select max(k) from p)) "
    "select r, c, v from p where not list_contains((select arg_max(gone, k) from w), p.k)"
)
def spaced_peaks(spark, sf_dir):
    """Peaks at least 3 apart of all chips side by side as one raster."""
    rows = _side_by_side(spark, sf_dir).withColumn("raster", F.lit(0))
    return segment.spaced_peaks(rows, "raster", _height(spark, sf_dir), 512, threshold=120, min_distance=3).select("r", "c", "v")


def _flooded(pixels: str, threshold: str, height: str = "8", width: str = "8") -> str:
    """SQL for labels of the priority flood of chips (k, cell, r, c, v; cell = r * width + c): peaks of distance 1, markers, then one pixel a step."""
    return (
        f"(with recursive px as materialized ({pixels}), dim as materialized (select k, {height}::bigint h, {width}::bigint w from px group by k), m as materialized (select px.*, h, w from px join dim using (k) where v >= {threshold}), "
        "inn as materialized (select * from m where r between 1 and h - 2 and c between 1 and w - 2), "
        "tops as materialized (select a.k, a.cell, any_value(a.r) r, any_value(a.c) c, any_value(a.v) v from inn a join inn b on a.k = b.k and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.k, a.cell having max(b.v) <= any_value(a.v)), "
        "flat as materialized (select k from (select k, count(*) n, max(r) - min(r) + max(c) - min(c) box from inn group by k) join (select k, count(*) t from tops group by k) using (k) where n = t and box > 0), "
        "s5 as (select 0 y, 0 x union all values (-1, 0), (1, 0), (0, -1), (0, 1)), "
        "mid as (select k, r + y r, c + x c from inn join flat using (k), s5 group by all having count(*) = 5), covered as (select distinct k, r + y r, c + x c from mid, s5), "
        f"seeds as materialized (select k, cell, r, c from tops where k not in (select k from flat) and v > {threshold} union all select k, cell, r, c from inn where k in (select k from flat) and v > {threshold} and (k, r, c) not in (select k, r, c from covered)), "
        "tied as (select k, cell, cell root from seeds union select a.k, a.cell, b.root from seeds a join tied b on a.k = b.k join seeds o on o.k = b.k and o.cell = b.cell and abs(a.r - o.r) + abs(a.c - o.c) = 1), "
        "marked as materialized (select k, cell, dense_rank() over (partition by k order by root)::integer l, row_number() over (partition by k order by cell) - 1 age from (select k, cell, min(root) root from tied group by 1, 2)), "
        "ranked as materialized (select m.*, dense_rank() over (partition by m.k order by v desc) rk from m), "
        "cells as (select k, h, w, unnest(range(h * w)) cell from dim), "
        "grids as materialized (select k, any_value(c.h) h, any_value(c.w) w, list(coalesce(rk, 0) order by cell) g from cells c left join ranked using (k, cell) group by k), "
        "flood as (select k, any_value(labels) labels, list((rk * 16777216 + age) * 16777216 + cell) todo, max(age) + 1 age from marked join ranked using (k, cell) join (select k, list(coalesce(l, 0) order by cell) labels from cells left join marked using (k, cell) group by k) using (k) group by k "
        "union all select k, case when len(near) = 0 then labels else list_transform(labels, lambda l, i: case when list_contains(near, i - 1) then labels[pos + 1] else l end) end, list_concat(list_filter(todo, lambda q: q <> pop), list_transform(near, lambda x, i: (g[x + 1] * 16777216 + age + i - 1) * 16777216 + x)), age + len(near) "
        "from (select *, list_filter([case when pos >= w then pos - w end, case when pos % w > 0 then pos - 1 end, case when pos % w < w - 1 then pos + 1 end, case when pos < (h - 1) * w then pos + w end], lambda x: x is not null and g[x + 1] > 0 and labels[x + 1] = 0) near "
        "from (select f.k, labels, todo, age, list_min(todo) pop, list_min(todo) % 16777216 pos, g, h, w from flood f join grids using (k) where len(todo) > 0))) "
        "select k, cell, l \"label\" from (select k, unnest(range(len(labels))) cell, unnest(labels) l from flood where len(todo) = 0) where l > 0)"
    )


@query(f"select k raster_id, \"label\", (cell // 8)::integer r, (cell % 8)::integer c from {_flooded(f'select raster_id k, (r * 8 + c)::bigint cell, r, c, v from {PIXELS}', '120')}")
def watershed(spark, sf_dir):
    return segment.watershed(src.pixels(spark, sf_dir), "raster_id", threshold=120, min_distance=1, extent=segment.chip(8))


_EXTENT = "(select (max(vec_id) // 64 + 1) * 8 from embeddings)"
_TOP, _LEFT = "greatest(0, split_part(k, ',', 1)::bigint * 32 - 8)", "greatest(0, split_part(k, ',', 2)::bigint * 32 - 8)"
_HIGH, _WIDE = f"least({_EXTENT}, (split_part(k, ',', 1)::bigint + 1) * 32 + 8) - {_TOP}", f"least(512, (split_part(k, ',', 2)::bigint + 1) * 32 + 8) - {_LEFT}"
_WINDOW = (
    f"select k, (r - {_TOP}) * ({_WIDE}) + c - {_LEFT} cell, r - {_TOP} r, c - {_LEFT} c, v from (select kr || ',' || kc k, r, c, v from {_SIDE}, (select unnest(range({_EXTENT} // 32 + 1)) kr), (select unnest(range(16)) kc) "
    "where v >= 120 and r >= kr * 32 - 8 and r < (kr + 1) * 32 + 8 and c >= kc * 32 - 8 and c < (kc + 1) * 32 + 8 and kr * 32 < " + _EXTENT + ")"
)


@query(
    f"select * from (select k chunk, \"label\", count(*) pixels, count(*) * 0.5::double area_m2, min(r)::integer min_r, max(r)::integer max_r, min(c)::integer min_c, max(c)::integer max_c, trunc(avg(r))::integer centre_r, trunc(avg(c))::integer centre_c "
    f"from (select k, \"label\", cell // w + top r, cell % w + lft c from (select *, {_WIDE} w, {_TOP} top, {_LEFT} lft from {_flooded(_WINDOW, '120', _HIGH, _WIDE)})) group by 1, 2) where area_m2 >= 2 and chunk = (centre_r // 32) || ',' || (centre_c // 32)"
)
def chunked_crowns(spark, sf_dir):
    """All chips side by side as one raster, cut to chunks of 32 x 32 with borders of 8: each crown is found by the chunk that its centre is in."""
    return segment.chunked_crowns(_side_by_side(spark, sf_dir), _height(spark, sf_dir), 512, chunk=32, border=8, threshold=120, min_distance=1, pixel_area=0.5, min_area=2.0)


@query(
    f"select k raster_id, \"label\", count(*) pixels, count(*) * 0.5::double area_m2, min(cell // 8)::integer min_r, max(cell // 8)::integer max_r, min(cell % 8)::integer min_c, max(cell % 8)::integer max_c, trunc(avg(cell // 8))::integer centre_r, trunc(avg(cell % 8))::integer centre_c "
    f"from {_flooded(f'select raster_id k, (r * 8 + c)::bigint cell, r, c, dtm v from {_DTM}', '10.0')} group by 1, 2 having count(*) * 0.5 >= 2"
)
def crowns_from_dtm(spark, sf_dir):
    dtm = raster.distance_transform(src.masks(spark, sf_dir), "raster_id", "label").select("raster_id", "r", "c", F.col("dtm").alias("v"))
    return segment.crowns_from_dtm(dtm, "raster_id", threshold=10.0, min_distance=1, pixel_area=0.5, min_area=2.0, extent=segment.chip(8))


@query(f"select a.raster_id, a.\"label\", a.r, a.c, side from {MASKS} a, (values ('top', -1, 0), ('bottom', 1, 0), ('left', 0, -1), ('right', 0, 1)) s(side, dr, dc) where not exists (select 1 from {MASKS} b where b.raster_id = a.raster_id and b.\"label\" = a.\"label\" and b.r = a.r + dr and b.c = a.c + dc)")
def label_edges(spark, sf_dir):
    return raster.label_edges(src.masks(spark, sf_dir), "raster_id")


@query(f"select raster_id, \"label\", count(*)::double area, min(c)::double min_x, max(c) + 1.0::double max_x, min(r)::double min_y, max(r) + 1.0::double max_y from {MASKS} group by 1, 2")
def label_ring_area(spark, sf_dir):
    """The rings of a label, holes taken off, have the area and the box of its pixels."""
    rings_ = segment.rings(raster.label_edges(src.masks(spark, sf_dir), "raster_id"), "raster_id").select("raster_id", "label", rings.signed_area(F.col("points")).alias("a"), *rings.bounds(F.col("points")))
    return rings_.groupBy("raster_id", "label").agg(F.abs(F.sum("a")).alias("area"), *((F.min if c.startswith("min") else F.max)(c).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


_EDGES = f"(select a.raster_id, a.\"label\", a.r, a.c, k from {MASKS} a, (values (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) s(k, dr, dc) where not exists (select 1 from {MASKS} b where b.raster_id = a.raster_id and b.\"label\" = a.\"label\" and b.r = a.r + dr and b.c = a.c + dc))"


_CORNERS = (
    f"with recursive e as materialized (select raster_id, \"label\", r, c, k, r::bigint * 8589934592 + c * 4 + k id, r + case when k in (2, 3) then 1 else 0 end y, c + case when k in (1, 2) then 1 else 0 end x from {_EDGES}), "
    "ways as (select e.raster_id, e.\"label\", id, n, (r + [0, [0, 1, 0, -1][k + 1], [-1, 1, 1, -1][k + 1]][n + 1])::bigint * 8589934592 + (c + [0, [1, 0, -1, 0][k + 1], [1, 1, -1, -1][k + 1]][n + 1]) * 4 + [(k + 1) % 4, k, (k + 3) % 4][n + 1] nxt from e, (select unnest([0, 1, 2]) n)), "
    "f as materialized (select w.raster_id, w.\"label\", w.id, arg_min(w.nxt, w.n) nxt from ways w join e on e.raster_id = w.raster_id and e.\"label\" = w.\"label\" and e.id = w.nxt group by 1, 2, 3), "
    "walk as (select raster_id, \"label\", id ring, id now, 0::bigint p from f union all select w.raster_id, w.\"label\", w.ring, f.nxt, w.p + 1 from walk w join f on f.raster_id = w.raster_id and f.\"label\" = w.\"label\" and f.id = w.now where f.nxt > w.ring), "
    "whole as (select w.raster_id, w.\"label\", w.ring from walk w join f on f.raster_id = w.raster_id and f.\"label\" = w.\"label\" and f.id = w.now where f.nxt = w.ring) "
    "select raster_id, \"label\", ring, p as \"at\", x::integer x, y::integer y from walk join whole using (raster_id, \"label\", ring) join e using (raster_id, \"label\") where e.id = walk.now"
)


@query(_CORNERS)
def label_corners(spark, sf_dir):
    """The outlines of labels corner by corner."""
    return segment.corners(raster.label_edges(src.masks(spark, sf_dir), "raster_id"), "raster_id")


@query(f"select raster_id, \"label\", row_number() over (partition by raster_id, \"label\" order by ring) - 1 ring, xs, ys from (select raster_id, \"label\", ring, list_append(list(x order by \"at\"), arg_min(x, \"at\")) xs, list_append(list(y order by \"at\"), arg_min(y, \"at\")) ys from ({_CORNERS}) group by 1, 2, 3)")
def label_rings(spark, sf_dir):
    """The outlines of labels as closed rings, numbered within a label by their least sides."""
    from pyspark.sql import Window

    found = segment.whole_rings(raster.label_edges(src.masks(spark, sf_dir), "raster_id"), "raster_id")
    number = F.row_number().over(Window.partitionBy("raster_id", "label").orderBy("ring")).cast("long") - 1
    closed = lambda c: F.concat(c, F.array(F.col(c)[0])).alias(f"{c}s")
    return found.select("raster_id", "label", number.alias("ring"), closed("x"), closed("y"))


@query(
    f"with recursive m as materialized (select raster_id, \"label\", r, c, r * 8 + c id from {MASKS}), e as materialized (select a.raster_id, a.\"label\", a.id a, b.id b from m a join m b using (raster_id, \"label\") where abs(a.r - b.r) + abs(a.c - b.c) = 1), "
    "w as (select raster_id, \"label\", id, id root from m union select w.raster_id, w.\"label\", e.b, w.root from w join e on w.raster_id = e.raster_id and w.\"label\" = e.\"label\" and w.id = e.a), "
    "p as (select raster_id, \"label\", count(distinct root) parts, count(*) area from (select raster_id, \"label\", id, min(root) root from w group by all) group by 1, 2), "
    "pairs as (select raster_id, \"label\", count(*) // 2 n from e group by 1, 2), "
    "squares as (select raster_id, \"label\", count(*) n from (select m.raster_id, m.\"label\", r + dy y, c + dx x from m, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) group by all having count(*) = 4) group by 1, 2) "
    "select raster_id, \"label\", parts, parts - (area - coalesce(pairs.n, 0) + coalesce(squares.n, 0)) holes, area::double area from p left join pairs using (raster_id, \"label\") left join squares using (raster_id, \"label\")"
)
def label_outlines(spark, sf_dir):
    """A label's parts and their holes as one value, written as binary and read back."""
    from ..operators import repair
    from ..sources import files

    found = segment.outlines(segment.rings(raster.label_edges(src.masks(spark, sf_dir), "raster_id"), "raster_id"), "raster_id")
    back = found.select("raster_id", "label", files.from_wkb_many(files.to_wkb_many(F.col("polygons"))).alias("polygons"))
    holes = F.aggregate(F.transform("polygons", lambda p: F.size(p) - 1), F.lit(0), lambda a, b: a + b)
    area = F.aggregate(F.transform("polygons", repair.area), F.lit(0.0), lambda a, b: a + b)
    return back.select("raster_id", "label", F.size("polygons").cast("long").alias("parts"), holes.cast("long").alias("holes"), area.alias("area"))


@query("select * from (select vec_id raster_id, (pos // 8)::integer r, (pos % 8)::integer c, round(greatest(0::float, least(100::float, (p::float + 0.5::float) * 100::float))::double, 4) v from (select vec_id, unnest(range(64)) pos, unnest(embedding) p from embeddings)) where r between 2 and 5 and c between 2 and 5")
def predict_tiles(spark, sf_dir):
    from ..operators.predict import predict_chips

    return predict_chips(src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), "embedding"), "raster_id", "embedding")


@query(
    f"with s as materialized (select g.r, g.c, coalesce(v, 0) v, h from (select unnest(range({_EXTENT}))::integer r, {_EXTENT} h) g0, lateral (select g0.r, unnest(range(512))::integer c) g left join {_SIDE} p on p.r = g.r and p.c = g.c), n as (select a.r, a.c, case when a.r + y < 0 then 1 when a.r + y >= h then h - 2 else a.r + y end sr, case when a.c + x < 0 then 1 when a.c + x >= 512 then 510 else a.c + x end sc from s a, (select unnest([-1, 0, 1]) y), (select unnest([-1, 0, 1]) x)) "
    "select n.r, n.c, least(1400.0::double, greatest(0.0::double, sum(s.v)::double)) v from n join s on s.r = n.sr and s.c = n.sc group by n.r, n.c"
)
def infer_image(spark, sf_dir):
    """All chips side by side as one image, predicted by overlapping windows of 16 x 16, of which the inner 8 x 8 count."""
    from ..operators.predict import box_sum, infer

    height = _height(spark, sf_dir)
    chips = src.table(spark, sf_dir, "embeddings").agg((F.expr("max(vec_id) div 64 + 1") * 64).cast("int")).first()[0] or 0
    # Places that the last row of chips does not fill are black.
    spine = spark.range(chips).select(F.col("id").alias("raster_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    place = spine.select((F.expr("raster_id div 64") * 8 + F.expr("pos div 8")).cast("int").alias("r"), ((F.col("raster_id") % 64) * 8 + F.col("pos") % 8).cast("int").alias("c"))
    rows = place.join(_side_by_side(spark, sf_dir), ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0)).alias("v"))
    return infer(rows, height, 512, box_sum(16), tile=16, stride=8, low=0.0, high=1400.0)


@query(f"select batch, round(avg(e), 6) mae from (select raster_id // 30 batch, raster_id, avg(abs(v - lut)) e from {PIXELS} join {_LUT} using (site_no, v) group by 1, 2) group by 1")
def validation_mae(spark, sf_dir):
    matched = raster.apply_table(src.pixels(spark, sf_dir), _lut(spark, sf_dir), "site_no")
    each = matched.groupBy(F.expr("raster_id div 30").alias("batch"), "raster_id").agg(F.avg(F.abs(F.col("v") - F.col("matched"))).alias("e"))
    return each.groupBy("batch").agg(F.round(F.avg("e"), 6).alias("mae"))
