"""Queries on map tiles, downloads, polygons and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, mercator, rings
from ..operators import grids, vector
from ..registry import query
from ..sources import files
from ..sources import projections as src
from .crowns import EXTENTS, extents
from .pixels import PIXELS

_W = "40075016.685578488::double"
_H = "20037508.342789244::double"
POINTS = (
    "(select *, floor((mx + 20037508.342789244::double) / (40075016.685578488::double / pow(2.0::double, zoom)))::integer col, floor((20037508.342789244::double - my) / (40075016.685578488::double / pow(2.0::double, zoom)))::integer \"row\" "
    "from (select c_custkey as \"key\", ((c_custkey * 7919) % 40000000 - 20000000)::double mx, ((c_custkey * 104729) % 40000000 - 20000000)::double my, (20 - c_custkey % 2)::integer zoom from customer))"
)
DOWNLOADS = "(select event_id id, user_id col, case event_type when 'error' then 404 when 'signup' then 429 when 'purchase' then 500 else 200 end::integer status from events)"
PARTS = "(select p_partkey as \"key\", part, ((p_partkey % 100) * 120 + part * 60)::double x0, ((p_partkey // 100) * 120)::double y0, p_size::double w, (p_size % 7 + 1)::double h from part, (select unnest(range(2))::integer part) where part = 0 or p_size % 5 = 0)"


@query(f"select \"key\", zoom, col, \"row\" from {POINTS}")
def mercator_tiles(spark, sf_dir):
    return src.points(spark, sf_dir).select("key", "zoom", "col", "row")


@query(f"select \"key\", round(col * ({_W} / pow(2.0::double, zoom)) - {_H}, 6) \"left\", round({_H} - \"row\" * ({_W} / pow(2.0::double, zoom)), 6) top from {POINTS}")
def tile_bounds(spark, sf_dir):
    rows = src.points(spark, sf_dir)
    return rows.select("key", F.round(mercator.tile_left(F.col("col"), F.col("zoom")), 6).alias("left"), F.round(mercator.tile_top(F.col("row"), F.col("zoom")), 6).alias("top"))


_ZOOM = "(10 + c_custkey % 12)::integer"


@query(f"select {_ZOOM} zoom, count(*) points, round({_W} / (256.0::double * pow(2.0::double, {_ZOOM})), 8) resolution_m, round(15654303.0::double * cos(radians(47.81::double)) / pow(2.0::double, {_ZOOM}), 2) ground_cm from customer group by {_ZOOM}")
def ground_resolution(spark, sf_dir):
    """Resolutions of the zooms that points are asked at."""
    zooms = src.table(spark, sf_dir, "customer").groupBy((F.lit(10) + F.col("c_custkey") % 12).cast("int").alias("zoom")).agg(F.count("*").alias("points"))
    return zooms.select("zoom", "points", F.round(mercator.resolution(F.col("zoom")), 8).alias("resolution_m"), F.round(mercator.ground_resolution_cm(F.col("zoom")), 2).alias("ground_cm"))


@query(
    "with b as (select c_custkey as \"key\", (20 - c_custkey % 2)::integer zoom, -13620000.0::double + c_custkey * 10 l, 6070000.0::double + c_custkey * 5 t from customer), "
    f"g as (select \"key\", zoom, floor((l + {_H}) / ({_W} / pow(2.0::double, zoom)))::integer col_min, floor((l + 3000 + {_H}) / ({_W} / pow(2.0::double, zoom)))::integer col_max, floor(({_H} - t) / ({_W} / pow(2.0::double, zoom)))::integer row_min, floor(({_H} - (t - 2000)) / ({_W} / pow(2.0::double, zoom)))::integer row_max from b) "
    "select \"key\", zoom, col_min, col_max, row_min, row_max, (col_max - col_min + 1)::bigint * (row_max - row_min + 1) tiles, (col_max - col_min + 1) * 256 width_px, (row_max - row_min + 1) * 256 height_px, "
    f"round(col_min * ({_W} / pow(2.0::double, zoom)) - {_H}, 6) snap_left, round({_H} - row_min * ({_W} / pow(2.0::double, zoom)), 6) snap_top, round((col_max - col_min + 1)::double * (row_max - row_min + 1) * 256 * 256 * 3 / 1e9 * 0.15::double, 6) est_gb from g",
)
def tile_grid(spark, sf_dir):
    key = F.col("c_custkey")
    boxes = src.table(spark, sf_dir, "customer").select(key.alias("key"), (F.lit(20) - key % 2).cast("int").alias("zoom"), (F.lit(-13620000.0) + key * 10).alias("left"), (F.lit(6070000.0) + key * 5).alias("top"))
    boxes = boxes.withColumns({"right": F.col("left") + 3000, "bottom": F.col("top") - 2000})
    found = grids.tile_grid(boxes).withColumns({c: F.round(c, 6) for c in ("snap_left", "snap_top")})
    return found.select("key", "zoom", "col_min", "col_max", "row_min", "row_max", "tiles", "width_px", "height_px", "snap_left", "snap_top", "est_gb")


@query(f"select \"key\", concat_ws('/', 'https://tiles.example.org/rest/services', 'Imagery' || (1990 + \"key\" % 30)::varchar, 'MapServer/tile', zoom::varchar, \"row\"::varchar, col::varchar) url from {POINTS}")
def tile_url(spark, sf_dir):
    rows = src.points(spark, sf_dir)
    service = F.concat(F.lit("Imagery"), (F.lit(1990) + F.col("key") % 30).cast("string"))
    return rows.select("key", mercator.tile_url("https://tiles.example.org/rest/services", service, F.col("zoom"), F.col("row"), F.col("col")).alias("url"))


@query(
    f"select status, case status when 200 then 'tile' when 404 then 'missing' when 429 then 'retry' else 'failed' end outcome, count(*) tiles, round(100.0::double * count(*) / (select count(*) from events), 6) percent from {DOWNLOADS} group by 1, 2"
)
def download_report(spark, sf_dir):
    return vector.download_report(src.downloads(spark, sf_dir))


@query(
    f"with t as (select col, status from {DOWNLOADS}), s as (select (col // 10)::integer strip, col % 10 k, bool_or(status = 200) got from t group by 1, 2), m as (select distinct strip from s) "
    "select strip, k::integer slot, (k * 256)::integer x, coalesce(got, false) present, (k // 4)::integer batch from m cross join (select unnest(range(10)) k) g left join s using (strip, k)",
)
def strip_layout(spark, sf_dir):
    rows = src.downloads(spark, sf_dir).select(F.expr("cast(col div 10 as int)").alias("strip"), (F.col("col") % 10).cast("int").alias("slot"), (F.col("status") == 200).alias("got"))
    return vector.strip_layout(rows, tiles=10, batch=4)


@query(f"select \"key\", part, round(w * h, 6) area from {PARTS}")
def ring_area(spark, sf_dir):
    return vector.parts(src.polygons(spark, sf_dir)).select("key", "part", F.round(rings.area(F.col("ring")), 6).alias("area"))


@query(f"select \"key\", part, round(x0 + w / 2, 6) x, round(y0 + h / 2, 6) y from {PARTS}")
def ring_centroid(spark, sf_dir):
    x, y = rings.centroid(F.col("ring"))
    return vector.parts(src.polygons(spark, sf_dir)).select("key", "part", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"select \"key\", part, row_number() over (order by \"key\", part) - 1 as number from {PARTS}")
def explode_parts(spark, sf_dir):
    from ..operators.tables import numbered

    return numbered(vector.parts(src.polygons(spark, sf_dir)).select("key", "part"), "key", "part").withColumn("number", F.col("number") - 1)


@query(f"select min(x0) min_x, min(y0) min_y, max(x0 + w) max_x, max(y0 + h) max_y, round(sum(w * h), 4) area, bool_or(part = 1) multi from {PARTS}")
def total_bounds(spark, sf_dir):
    return vector.total_bounds(vector.parts(src.polygons(spark, sf_dir)))


@query(
    f"select \"key\", part, py::integer r, px::integer c from (select *, unnest(range(floor(x0)::bigint, ceil(x0 + w)::bigint + 1)) px from (select *, unnest(range(floor(y0)::bigint, ceil(y0 + h)::bigint + 1)) py from {PARTS})) "
    "where px + 0.5::double > x0 and px + 0.5::double < x0 + w and py + 0.5::double > y0 and py + 0.5::double < y0 + h",
)
def rasterize(spark, sf_dir):
    return vector.rasterized(vector.parts(src.polygons(spark, sf_dir))).select("key", "part", "r", "c")


@query("select c_custkey as \"key\", (3857 + c_custkey % 3)::integer epsg from customer")
def crs_epsg(spark, sf_dir):
    crs = F.concat(F.lit("EPSG:"), (F.lit(3857) + F.col("c_custkey") % 3).cast("string"))
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), mercator.epsg(crs).alias("epsg"))


@query(
    "with p as (select c_custkey as \"key\", ((c_custkey * 7919) % 3600) / 10.0::double - 180 lon, ((c_custkey * 104729) % 1700) / 10.0::double - 85 lat from customer) "
    "select \"key\", round(radians(lon) * 6378137.0::double, 4) mx, round(ln(tan(0.7853981633974483::double + radians(lat) / 2)) * 6378137.0::double, 4) my, round(lon, 6) lon, round(lat, 6) lat from p"
)
def reproject_4326_3857(spark, sf_dir):
    key = F.col("c_custkey")
    rows = src.table(spark, sf_dir, "customer").select(key.alias("key"), (((key * 7919) % 3600) / F.lit(10.0) - 180).alias("lon"), (((key * 104729) % 1700) / F.lit(10.0) - 85).alias("lat"))
    mx, my = mercator.to_mercator(F.col("lon"), F.col("lat"))
    there = rows.select("key", mx.alias("mx"), my.alias("my"))
    lon, lat = mercator.to_degrees(F.col("mx"), F.col("my"))
    return there.select("key", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_F = "(1 / 298.257223563::double)"
_N = f"({_F} / (2 - {_F}))"
_BIG = f"(0.9996::double * 6378137.0::double / (1 + {_N}) * (1 + {_N} ** 2 / 4 + {_N} ** 4 / 64))"
_SERIES = (f"({_N} / 2 - 2 * {_N} ** 2 / 3 + 5 * {_N} ** 3 / 16)", f"(13 * {_N} ** 2 / 48 - 3 * {_N} ** 3 / 5)", f"(61 * {_N} ** 3 / 240)")


@query(
    f"with p as (select c_custkey as \"key\", -126.0::double + (c_custkey * 7919 % 600) / 100.0::double lon, (c_custkey * 104729 % 8000) / 100.0::double lat, 2 * sqrt({_N}) / (1 + {_N}) k from customer), "
    "t as (select *, sinh(atanh(sin(radians(lat))) - k * atanh(k * sin(radians(lat)))) t, radians(lon + 123) d from p), x as (select *, atan2(t, cos(d)) xi, atanh(sin(d) / sqrt(1 + t * t)) eta from t) "
    f"select \"key\", round(500000 + {_BIG} * (eta + " + " + ".join(f"{c} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(_SERIES, 1)) + f"), 3) east, round({_BIG} * (xi + " + " + ".join(f"{c} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(_SERIES, 1)) + "), 3) north from x"
)
def reproject_utm(spark, sf_dir):
    """Points of zone 10 north, from degrees; a point without a coordinate system would raise."""
    key = F.col("c_custkey")
    rows = src.table(spark, sf_dir, "customer").select(key.alias("key"), (F.lit(-126.0) + key * 7919 % 600 / F.lit(100.0)).alias("lon"), (key * 104729 % 8000 / F.lit(100.0)).alias("lat"), F.lit("EPSG:4326").alias("crs"))
    east, north = mercator.reprojected(F.col("lon"), F.col("lat"), F.col("crs"), 32610)
    return rows.select("key", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(
    f"with e as {EXTENTS}, r as (select h, w, unnest(range(0, h, 256)) r from e), g as (select h, w, r, unnest(range(0, w, 256)) c from r union select h, w, h - 512, unnest(range(0, w, 256)) from e union select h, w, r, w - 512 from r union select h, w, h - 512, w - 512 from e) "
    "select h, w, count(*) origins, count(*) filter (r < 0 or c < 0) negative, min(r)::integer min_r, max(c)::integer max_c, sum(r * 31 + c)::bigint checksum from g group by 1, 2"
)
def origin_grid(spark, sf_dir):
    found = grids.origins(extents(spark, sf_dir))
    return found.groupBy("h", "w").agg(F.count("*").alias("origins"), F.count_if((F.col("r") < 0) | (F.col("c") < 0)).alias("negative"), F.min("r").alias("min_r"), F.max("c").alias("max_c"), F.sum((F.col("r") * 31 + F.col("c")).cast("long")).alias("checksum"))


@query(
    f"with e as (select distinct h from {EXTENTS}), y as (select h, unnest(range(h)) y from e), k as (select h, y, unnest(range(0, (ceil(h / 2048.0::double))::bigint)) k from y) "
    "select h, k::integer chunk, count(*) as \"rows\", min(y)::integer first_row, max(y)::integer last_row from k where y >= k * 2048 - 300 and y < (k + 1) * 2048 + 300 group by 1, 2",
)
def halo_chunks(spark, sf_dir):
    rows = extents(spark, sf_dir).select("h").distinct().select("h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    sent = rows.select("h", "y", F.explode(grids.chunks_of(F.col("y"), F.col("h"), 2048, 300)).alias("chunk"))
    return sent.groupBy("h", "chunk").agg(F.count("*").alias("rows"), F.min("y").alias("first_row"), F.max("y").alias("last_row"))


@query(
    f"with e as (select distinct h from {EXTENTS}), k as (select h, unnest(range(0, (ceil(h / 2048.0::double))::bigint)) k from e), s as (select h, k, case when least(h, (k + 1) * 2048 + 300) = h then h else (k + 1) * 2048 end - k * 2048 n from k) "
    "select h, (sum(n) - h)::bigint twice, 0::bigint twice_by_owner from s group by h"
)
def owner_rows(spark, sf_dir):
    heights = extents(spark, sf_dir).select("h").distinct()
    old = grids.rows_owned_twice(heights, 2048, 300)
    rows = heights.select("h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    sent = rows.select("h", "y", F.explode(grids.chunks_of(F.col("y"), F.col("h"), 2048, 300)).alias("k")).where(F.col("k") == grids.owner(F.col("y"), 2048))
    new = sent.groupBy("h").agg((F.count("*") - F.first("h")).alias("twice_by_owner"))
    return old.join(new, "h").select("h", F.col("twice").cast("long").alias("twice"), "twice_by_owner")


@query(f"select \"key\", least(999, greatest(0, round_even((20000000 - my) / 40000.0::double, 0)))::integer r, least(999, greatest(0, round_even((mx + 20000000) / 40000.0::double, 0)))::integer c from {POINTS}")
def map_to_pixel(spark, sf_dir):
    """Points of the map as pixels of an image of 1000 x 1000."""
    r, c = geo.to_pixel(F.col("mx"), F.col("my"), F.lit(-20000000.0), F.lit(20000000.0), F.lit(40000.0), F.lit(1000), F.lit(1000))
    return src.points(spark, sf_dir).select("key", r.alias("r"), c.alias("c"))


@query(
    f"with t as (select id // 4 tile, id % 4 attempt, case when status = 500 then null else status end status, id % 5 <> 0 image from {DOWNLOADS} where id % 4 < 3), l as (select tile, coalesce(min(attempt) filter (status is not null and status <> 429), 2) k from t group by 1) "
    "select tile, case when bool_or(attempt = k and coalesce(status, 0) = 200 and image) then 'tile' else 'missing' end outcome, count(*) tries, sum(case when status is null then 1 when status = 429 then pow(2, attempt) else 0 end)::bigint waited from t join l using (tile) where attempt <= k group by 1"
)
def download_attempts(spark, sf_dir):
    """Four events in a row stand for the tries of a tile, a status of 500 for an exception."""
    status = F.when(F.col("status") != 500, F.col("status"))
    tries = src.downloads(spark, sf_dir).select(F.expr("id div 4").alias("tile"), (F.col("id") % 4).alias("attempt"), status.alias("status"), (F.col("id") % 5 != 0).alias("image"))
    return vector.attempts(tries, "tile", most=3)


@query(
    f"with p as (select raster_id // 10 strip, raster_id % 10 slot, r, c, v from {PIXELS} where raster_id % 7 <> 0), s as (select distinct strip from p) "
    "select s.strip, y::integer y, x::integer x, coalesce(v, 0) v from s cross join (select unnest(range(6)) y) cross join (select unnest(range(60)) x) left join p on p.strip = s.strip and p.r = y and p.c < 6 and p.slot * 6 + p.c = x"
)
def mosaic_strips(spark, sf_dir):
    """Chips as tiles of 6 x 6, ten to a strip; each seventh did not come."""
    rows = src.pixels(spark, sf_dir).where("raster_id % 7 <> 0").select(F.expr("raster_id div 10").alias("strip"), (F.col("raster_id") % 10).alias("slot"), "r", "c", "v")
    return vector.mosaic(rows, tiles=10, edge=6)


@query(
    f"select count(*) area from (select distinct py, px from (select *, unnest(range(floor(x0)::bigint, ceil(x0 + w)::bigint + 1)) px from (select *, unnest(range(floor(y0)::bigint, ceil(y0 + h)::bigint + 1)) py from (select x0 % 40 x0, y0 % 40 y0, w, h from {PARTS}))) "
    "where px + 0.5::double > x0 and px + 0.5::double < x0 + w and py + 0.5::double > y0 and py + 0.5::double < y0 + h)"
)
def union_area(spark, sf_dir):
    """Polygons moved on top of each other: what they cover together."""
    moved = F.transform("ring", lambda p: F.struct((p["x"] - F.col("dx")).alias("x"), (p["y"] - F.col("dy")).alias("y")))
    low = lambda a: F.array_min(F.transform("ring", lambda p: p[a]))
    parts_ = vector.parts(src.polygons(spark, sf_dir)).withColumns({"dx": low("x") - low("x") % 40, "dy": low("y") - low("y") % 40})
    return vector.union_area(parts_.select("key", "part", moved.alias("ring")))


@query(
    "with t as materialized (select p_partkey \"key\", p_partkey % 97 site, (p_partkey * 7919 % 400) / 10.0::double x, (p_partkey * 104729 % 400) / 10.0::double y, p_size / 3.0::double w, (p_size % 7 + 1) / 1.7::double h from part), "
    "e as materialized (select site, ax, ay, ux, uy, way from (select site, unnest([x, x + w, x]) ax, unnest([y, y + h / 3, y]) ay, unnest([x + w, x + w / 2, x + w / 2]) ux, unnest([y + h / 3, y + h, y + h]) uy, unnest([1, 1, -1]) way from t)), "
    "cut as (select a.site, a.ay + (b.ax - a.ax + (a.ay - b.ay) * (b.ux - b.ax) / (b.uy - b.ay)) / ((a.ux - a.ax) / (a.uy - a.ay) - (b.ux - b.ax) / (b.uy - b.ay)) yy, greatest(a.ay, b.ay) l, least(a.uy, b.uy) hh from e a join e b on a.site = b.site and a.ay < b.uy and b.ay < a.uy and (a.ux - a.ax) / (a.uy - a.ay) <> (b.ux - b.ax) / (b.uy - b.ay)), "
    "ys as (select site, ay yy from e union select site, uy from e union select site, yy from cut where yy > l and yy < hh), st as materialized (select site, yy s, lead(yy) over (partition by site order by yy) t from ys), "
    "z as (select site, s, t, way, ax + ((s + t) / 2 - ay) * (ux - ax) / (uy - ay) x from st join e using (site) where ay <= s and uy >= t and t is not null), "
    "o as (select *, sum(way) over w turns, lead(x) over (partition by site, s order by x) nx from z window w as (partition by site, s order by x rows unbounded preceding)) "
    "select site, round(sum((nx - x) * (t - s)), 6) area from o where turns <> 0 and nx is not null group by site"
)
def covered_area(spark, sf_dir):
    """What the triangles of a site cover together, wherever their corners lie."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = src.table(spark, sf_dir, "part").select((key % 97).alias("site"), (key * 7919 % 400 / F.lit(10.0)).alias("x"), (key * 104729 % 400 / F.lit(10.0)).alias("y"), (size / F.lit(3.0)).alias("w"), ((size % 7 + 1) / F.lit(1.7)).alias("h"))
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    ring = F.array(corner("x", "y"), corner("x + w", "y + h / 3"), corner("x + w / 2", "y + h"), corner("x", "y"))
    return vector.covered_area(rows.select("site", ring.alias("ring")), "site", cell=16.0).select("site", F.round("area", 6).alias("area"))


@query(
    f"with e as {EXTENTS}, r as (select h, w, unnest(range(0, h, 256)) r from e), g as (select h, w, r, unnest(range(0, w, 256)) c from r union select h, w, h - 512, unnest(range(0, w, 256)) from e union select h, w, r, w - 512 from r union select h, w, h - 512, w - 512 from e) "
    "select h, w, r::integer r, c::integer c from g where r >= 0 and c >= 0 and h < 3000"
)
def inner_origins(spark, sf_dir):
    """The origins within the smaller extents, in order of rows and columns."""
    return grids.origins(extents(spark, sf_dir).where("h < 3000"), inside=True).orderBy("h", "w", "r", "c")


@query(f"select py::integer r, px::integer c, max(\"key\") as \"key\" from (select *, unnest(range(floor(x0)::bigint, ceil(x0 + w)::bigint + 1)) px from (select *, unnest(range(floor(y0)::bigint, ceil(y0 + h)::bigint + 1)) py from (select \"key\", x0 % 40 x0, y0 % 40 y0, w, h from {PARTS}))) where px + 0.5::double > x0 and px + 0.5::double < x0 + w and py + 0.5::double > y0 and py + 0.5::double < y0 + h group by 1, 2")
def painted_pixels(spark, sf_dir):
    """Polygons moved on top of each other: the later one paints a pixel."""
    moved = F.transform("ring", lambda p: F.struct((p["x"] - F.col("dx")).alias("x"), (p["y"] - F.col("dy")).alias("y")))
    low = lambda a: F.array_min(F.transform("ring", lambda p: p[a]))
    parts_ = vector.parts(src.polygons(spark, sf_dir)).withColumns({"dx": low("x") - low("x") % 40, "dy": low("y") - low("y") % 40})
    return vector.painted(vector.rasterized(parts_.select("key", "part", moved.alias("ring"))), "key")


@query(f"select \"key\", count(*) parts, round(sum(w * h), 6) area from {PARTS} group by 1")
def wkb_round_trip(spark, sf_dir):
    """Polygons written as well-known binary and read back."""
    rows = src.polygons(spark, sf_dir).select("key", files.from_wkb(files.to_wkb(F.col("parts"))).alias("parts"))
    return vector.parts(rows).groupBy("key").agg(F.count("*").alias("parts"), F.round(F.sum(rings.area(F.col("ring"))), 6).alias("area"))
