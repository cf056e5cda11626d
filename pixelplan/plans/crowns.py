"""Queries on crown tables, sites, tiles and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS, overlay
from ..functions.crowns import diameter, size_class, site_name
from ..operators import stats, tables
from ..registry import query
from ..sources import projections as src
from ..sources.projections import table

CROWNS = "(select concat_ws('_', l_orderkey::varchar, l_partkey::varchar, l_suppkey::varchar, l_linenumber::varchar) crown_id, l_returnflag site, l_quantity::double area_m2, case when l_quantity <= 4.9 then 'small' when l_quantity <= 15.9 then 'medium' else 'large' end size_class from lineitem)"
EXTENTS = "(select distinct (s_suppkey * 7919 % 1500 * 4 + 200)::integer h, (s_suppkey * 104729 % 1500 * 4 + 200)::integer w from supplier)"
TILES = "(select p_type site, ((p_partkey // 50) * 512)::integer row_off, ((p_partkey % 50) * 512)::integer col_off, round((p_size - 1) / 49.0::double, 4) crown_frac, p_partkey as \"key\", printf('%s_r%05d_c%05d.tif', lower(p_type), ((p_partkey // 50) * 512)::integer, ((p_partkey % 50) * 512)::integer) tile_name from part)"


@query(f"select crown_id, site, area_m2, size_class from {CROWNS} where area_m2 >= 2.0")
def crown_size_class(spark, sf_dir):
    return src.crowns(spark, sf_dir).where(F.col("area_m2") >= DEFAULTS["min_crown_area_m2"])


@query(f"select crown_id, round(2 * sqrt(area_m2 / 3.14159::double), 2) diameter_m, round(area_m2, 2) area_m2 from {CROWNS}")
def crown_diameter(spark, sf_dir):
    return src.crowns(spark, sf_dir).select("crown_id", diameter(F.col("area_m2")).alias("diameter_m"), F.round("area_m2", 2).alias("area_m2"))


@query(f"select site, size_class, count(*) crowns, round(sum(area_m2) / 10000, 4) canopy_ha, median(area_m2) median_m2, min(area_m2) min_m2, max(area_m2) max_m2, round(avg(area_m2), 4) mean_m2 from {CROWNS} group by 1, 2")
def crown_summary(spark, sf_dir):
    return stats.crown_summary(src.crowns(spark, sf_dir), "site", "size_class")


@query(f"select size_class, count(*) crowns, round(100.0::double * count(*) / (select count(*) from lineitem), 4) percent from {CROWNS} group by 1")
def class_percent(spark, sf_dir):
    return stats.class_percent(src.crowns(spark, sf_dir))


@query(
    f"with s as (select count(*)::double n, round(sum(area_m2) / 1e4, 4) ha, median(area_m2) med, round(avg(area_m2), 4) mean, count(*) filter (size_class = 'small')::double small, count(*) filter (size_class = 'medium')::double medium, count(*) filter (size_class = 'large')::double large from {CROWNS}) "
    "select metric, value from (select unnest(['total_crowns', 'canopy_ha', 'median_m2', 'mean_m2', 'small', 'medium', 'large']) metric, unnest([n, ha, med, mean, small, medium, large]) value from s)"
)
def metric_kv(spark, sf_dir):
    return stats.as_metrics(stats.totals(src.crowns(spark, sf_dir)))


@query("select n_name site, count(s_suppkey) crowns, (count(s_suppkey) = 0) true_negative from nation left join (select * from supplier where s_nationkey % 5 <> 0) s on s_nationkey = n_nationkey group by 1")
def site_discovery(spark, sf_dir):
    photos, crowns = src.photos(spark, sf_dir)
    return tables.discover_sites(photos.select(site_name(F.col("stem")).alias("site")), crowns)


@query("select count(*) filter (n > 0) positive, count(*) filter (n = 0) negative, sum(n)::bigint crowns, list(n_name order by n_name) sites from (select n_name, count(s_suppkey) n from nation left join (select * from supplier where s_nationkey % 5 <> 0) s on s_nationkey = n_nationkey group by 1)")
def site_counts_filled(spark, sf_dir):
    photos, crowns = src.photos(spark, sf_dir)
    sites = tables.discover_sites(photos.select(site_name(F.col("stem")).alias("site")), crowns)
    return sites.agg(F.count_if(F.col("crowns") > 0).alias("positive"), F.count_if(F.col("crowns") == 0).alias("negative"), F.sum("crowns").alias("crowns"), F.array_sort(F.collect_list("site")).alias("sites"))


@query(f"select site || '_' || (row_number() over (partition by site order by crown_id) - 1)::varchar site_crown_id, crown_id from {CROWNS} where area_m2 >= 0.5")
def crown_ids(spark, sf_dir):
    kept = src.crowns(spark, sf_dir).where(F.col("area_m2") >= DEFAULTS["small_area_threshold_m2"])
    return tables.numbered_within(kept, ["site"], "crown_id").select(F.concat("site", F.lit("_"), (F.col("number") - 1).cast("string")).alias("site_crown_id"), "crown_id")


@query(f"select printf('CROWN_%07d', row_number() over (order by site, crown_id)) global_id, crown_id from {CROWNS}")
def global_crown_ids(spark, sf_dir):
    return tables.numbered(src.crowns(spark, sf_dir), "site", "crown_id").select(F.format_string(DEFAULTS["crown_id_format"], "number").alias("global_id"), "crown_id")


@query(f"select tile_name, site, row_off, col_off, crown_frac from {TILES}")
def tile_index(spark, sf_dir):
    return src.tiles(spark, sf_dir).select("tile_name", "site", "row_off", "col_off", "crown_frac")


_SPLIT = f"(select *, case when rn <= round(n * 0.2::double) then 'test' else 'train' end split from (select *, row_number() over (partition by site order by (\"key\" * 2654435761) % 1000003, \"key\") rn, count(*) over (partition by site) n from {TILES}))"


@query(f"select tile_name, site, split from {_SPLIT}")
def stratified_split(spark, sf_dir):
    return tables.stratified_split(src.tiles(spark, sf_dir), "site", "key", DEFAULTS["test_frac"]).select("tile_name", "site", "split")


@query(f"select site, split, count(*) tiles, round(avg(crown_frac), 6) mean_frac from {_SPLIT} group by 1, 2")
def tiles_per_site_split(spark, sf_dir):
    split = tables.stratified_split(src.tiles(spark, sf_dir), "site", "key", DEFAULTS["test_frac"])
    return split.groupBy("site", "split").agg(F.count("*").alias("tiles"), F.round(F.avg("crown_frac"), 6).alias("mean_frac"))


@query("select row_number() over (order by site) - 1 as position, site from (select distinct p_type site from part)")
def sites_sorted(spark, sf_dir):
    found = src.tiles(spark, sf_dir).agg(F.array_sort(F.collect_set("site")).alias("sites"))
    return found.select(F.posexplode("sites").alias("position", "site")).withColumn("position", F.col("position").cast("long"))


@query(f"select tile_name, ntile(5) over (order by (\"key\" * 2654435761) % 1000003, \"key\") - 1 fold from {TILES}")
def kfold_assign(spark, sf_dir):
    return tables.folds(src.tiles(spark, sf_dir), "key", DEFAULTS["k_folds"]).select("tile_name", F.col("fold").cast("long").alias("fold"))


@query(f"select tile_name, site, round(1.0::double / count(*) over (partition by site), 10) weight from {TILES}")
def site_weights(spark, sf_dir):
    return tables.site_weights(src.tiles(spark, sf_dir)).select("tile_name", "site", F.round("weight", 10).alias("weight"))


@query(
    f"with t as (select site, \"key\", row_number() over (partition by site order by \"key\") - 1 k from {TILES}), s as (select site, count(*) n, row_number() over (order by site) - 1 i, count(*) over () m from {TILES} group by 1), "
    "draws as (select range d, ((range * 2654435761) % 1000003) / 1000003.0::double u from range(1000)) "
    "select d::bigint draw, t.site, \"key\" from draws join s on floor(u * m) = i join t on t.site = s.site and k = floor((u * m - floor(u * m)) * n)"
)
def weighted_draws(spark, sf_dir):
    """Tiles with replacement, each weighing one over the tiles of its site."""
    draws = spark.range(1000).select(F.col("id").alias("draw"), (((F.col("id") * 2654435761) % 1000003) / F.lit(1000003.0)).alias("u"))
    return tables.draw_tiles(src.tiles(spark, sf_dir), draws, "key")


@query(f"select tile_name from {TILES} where crown_frac >= 0.1 or (crown_frac = 0 and ((\"key\" * 2654435761) % 1000003) / 1000003.0::double < 0.15)")
def tile_accept(spark, sf_dir):
    return tables.accept_tiles(src.tiles(spark, sf_dir), "key", 0.1, DEFAULTS["negative_sample_rate"]).select("tile_name")


@query("select yr, count(*) crowns, round(sum(area_m2) / 10000, 4) canopy_ha, round(100 * sum(area_m2) / 1e6, 4) cover_pct, median(area_m2) median_m2 from (select year(o_orderdate)::integer yr, o_totalprice / 10000 area_m2 from orders) group by 1")
def temporal_summary(spark, sf_dir):
    """In order of years."""
    rows = src.yearly(spark, sf_dir)
    found = rows.groupBy("yr").agg(F.count("*").alias("crowns"), F.round(F.sum("area_m2") / 10000, 4).alias("canopy_ha"), F.round(F.sum("area_m2") * 100 / 1e6, 4).alias("cover_pct"))
    return stats.with_median(found, rows, "area_m2", "yr").orderBy("yr")


@query("select y::integer yr, printf('city_%d_image.tif', y) file from (select unnest(range(1995, 2004)) y) where y not in (select year(o_orderdate) from orders where o_orderstatus = 'F' and o_totalprice > 499900)")
def pending_years(spark, sf_dir):
    wanted = spark.range(1995, 2004).select(F.col("id").cast("int").alias("yr"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 499900").select(F.year("o_orderdate").alias("yr"))
    return tables.pending(wanted, done, "yr").select("yr", F.format_string(DEFAULTS["year_file_format"], "yr").alias("file"))


@query("select n_regionkey region, arg_min(n_name, n_nationkey) picked from nation where n_nationkey % 3 <> 0 group by 1")
def pick_candidate(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("priority"), (F.col("n_nationkey") % 3 != 0).alias("present"))
    return tables.first_present(files, "region").withColumnRenamed("path", "picked")


@query(
    "select n_nationkey site, \"key\", value from (select n_nationkey, unnest(['epochs', 'extra', 'k_folds', 'lr']) \"key\", unnest([(50 + n_nationkey)::varchar, n_name, '5', case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then '0.01' else '1e-4' end]) value from nation where n_nationkey % 5 > 0 "
    "union all select n_nationkey, unnest(['epochs', 'k_folds', 'lr']), unnest(['100', '5', '1e-4']) from nation where n_nationkey % 5 = 0)"
)
def config_merge(spark, sf_dir):
    """Each nation's own settings over the defaults; each fifth has none."""
    base = F.create_map(*(F.lit(x) for x in ("epochs", "100", "k_folds", "5", "lr", "1e-4")))
    key = F.col("n_nationkey")
    given = F.create_map(F.lit("epochs"), (key + 50).cast("string"), F.lit("extra"), F.col("n_name"))
    rate = F.create_map(F.lit("lr"), F.when(key % 3 == 1, "0.01"))
    user = F.when(key % 5 > 0, F.when(key % 3 == 2, given).otherwise(F.map_concat(given, rate)))
    return table(spark, sf_dir, "nation").select(key.alias("site"), F.explode(overlay(base, user)).alias("key", "value"))


@query(
    f"with t as (select count(*)::double total_crowns, round(sum(area_m2) / 1e4, 4) canopy_ha, median(area_m2) median_m2, round(avg(area_m2), 4) mean_m2, count(*) filter (size_class = 'small')::double small, count(*) filter (size_class = 'medium')::double medium, count(*) filter (size_class = 'large')::double large from {CROWNS}), "
    f"c as (select size_class, count(*) crowns, round(100.0::double * count(*) / (select count(*) from lineitem), 4) percent from {CROWNS} group by 1), s as (select site, count(*) tiles from {TILES} group by 1) "
    "select to_json({'crowns': (select t from t), 'classes': (select map_from_entries(list((size_class, {'crowns': crowns, 'percent': percent}) order by size_class)) from c), 'tiles': (select map_from_entries(list((site, tiles) order by site)) from s)})::varchar as document"
)
def stats_document(spark, sf_dir):
    """All summaries as one JSON document."""
    return stats.document(src.crowns(spark, sf_dir), src.tiles(spark, sf_dir))


@query(
    f"with e as {EXTENTS}, d as (select * from (values ('uint8', 1), ('uint16', 2), ('float32', 4)) t(dtype, bytes)) "
    "select h, w, dtype, pixels, width_km, raw_gb, float32_gb, printf('%.4f x %.4f km', width_km, h * 0.075::double / 1000) extent, round(ratio_, 6) ratio, printf('%.1fx', ratio_) ratio_text from (select *, case when h > 500 then raw_gb / (h / 1000.0::double) else 0.0::double end ratio_ from ("
    "select h, w, dtype, h::bigint * w pixels, round(w * 0.075::double / 1000, 6) width_km, round(h::bigint * w * 3 * bytes / 1e9, 6) raw_gb, round(h::bigint * w * 3 * 4 / 1e9, 6) float32_gb from e, d))"
)
def image_stats(spark, sf_dir):
    types = spark.createDataFrame([("uint8", 1), ("uint16", 2), ("float32", 4)], "dtype string, bytes int")
    return stats.image_stats(extents(spark, sf_dir), types, file_gb=F.when(F.col("h") > 500, F.col("h") / F.lit(1000.0)).otherwise(0.0))


@query(f"select site, round(100 * sum(area_m2) / 1e7, 6) cover_pct, round(sum(area_m2) / 1e4, 6) canopy_ha, round(sum(area_m2) / 2.59e6, 8) canopy_sq_mi from {CROWNS} group by 1")
def canopy_cover(spark, sf_dir):
    return stats.canopy_cover(src.crowns(spark, sf_dir), "site", 1e7)


def extents(spark, sf_dir):
    """Heights and widths of images: one for each supplier, of 200 to about 6,200 rows and columns."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((key * 7919 % 1500 * 4 + 200).cast("int").alias("h"), (key * 104729 % 1500 * 4 + 200).cast("int").alias("w")).distinct()


@query(f"select site, format('{{:,}}', count(*)) crowns, upper(site[1]) || lower(site[2:]) title from {CROWNS} group by 1")
def display_labels(spark, sf_dir):
    """Counts with thousands separators and capitalised names, in order of sites."""
    counts = src.crowns(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"))
    return counts.orderBy("site").select("site", F.format_number("n", 0).alias("crowns"), F.initcap("site").alias("title"))


@query("select y::integer yr, 'Imagery_' || y::varchar service, case when y >= 2013 then 20 else 19 end zoom, round(15654303.0::double * cos(radians(47.81::double)) / pow(2.0::double, case when y >= 2013 then 20 else 19 end), 2) ground_cm from (select distinct year(o_orderdate) y from orders)")
def year_dimension(spark, sf_dir):
    """Service, largest zoom and ground resolution of each year that there are crowns of."""
    years = src.yearly(spark, sf_dir).select("yr").distinct()
    return tables.year_dimension(years, DEFAULTS["fine_since"]).orderBy("yr")
