"""Queries whose results go through files of the formats that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import rings
from ..functions.crowns import diameter, size_class
from ..operators import raster, tables, vector
from ..registry import query
from ..sources import files, formats, sinks
from ..sources import projections as src
from ..storage import folder
from .crowns import _SPLIT
from .maps import PARTS
from .pixels import _DTM, PIXELS
from .training import LOSSES

_MOSAIC = (
    f"(with p as (select raster_id // 10 strip, raster_id % 10 slot, r, c, v from {PIXELS} where raster_id % 7 <> 0), s as (select distinct strip from p) "
    "select (s.strip * 6 + y)::integer r, x::integer c, coalesce(v, 0)::double v from s cross join (select unnest(range(6)) y) cross join (select unnest(range(60)) x) left join p on p.strip = s.strip and p.r = y and p.c < 6 and p.slot * 6 + p.c = x)"
)


def _mosaic(spark, sf_dir):
    """Strips of a mosaic as files: the folder."""
    formats.register(spark)
    rows = src.pixels(spark, sf_dir).where("raster_id % 7 <> 0").select(F.expr("raster_id div 10").alias("strip"), (F.col("raster_id") % 10).alias("slot"), "r", "c", "v")
    placed = vector.mosaic_cells(rows, tiles=10, edge=6).select(F.lit("city").alias("name"), (F.col("strip") * 6 + F.col("y")).cast("int").alias("r"), F.col("x").alias("c"), "v")
    path = folder(spark, "mosaic")
    sinks.as_strips(placed, "name", 60, 6).write.format("pixels").mode("append").save(path)
    return path


@query(f"select r, c, v from {_MOSAIC} where r >= 12 and c < 40")
def mosaic_files(spark, sf_dir):
    """A window of a mosaic that was written strip by strip, read from the files that hold it."""
    return spark.read.format("pixels").option("placed", True).load(_mosaic(spark, sf_dir)).where("r >= 12 and c < 40").select("r", "c", "v")


@query(f"select printf('city-%09d', r0) as stem, 60 width, 6 height, 1 bands, 'uint8' dtype, -r0::double top, row_number() over (order by r0) - 1 position from (select distinct (r // 6) * 6 r0 from {_MOSAIC})")
def image_headers(spark, sf_dir):
    """The images of a folder in order of names, and what their headers say."""
    images = files.list_images(spark, _mosaic(spark, sf_dir), "city-*.tif")
    heads = files.read_headers(images).join(images.select("path", "site"), "path")
    found = tables.numbered(heads.select(F.col("site").alias("stem"), "width", "height", "bands", "dtype", "top"), "stem")
    return found.withColumn("position", F.col("number") - 1).drop("number")


@query(f"select raster_id // 64 as strip, (r + (raster_id // 64) * 8)::integer r, ((raster_id % 64) * 8 + c)::integer c, round(dtm::float::double, 4) v from {_DTM}")
def dtm_files(spark, sf_dir):
    """Distance transforms as files of 32-bit samples, 0 where there is no crown, read back without the background."""
    formats.register(spark)
    dtm = raster.distance_transform(src.masks(spark, sf_dir), "raster_id", "label")
    placed = dtm.select(F.lit("dtm").alias("name"), (F.expr("raster_id div 64") * 8 + F.col("r")).cast("int").alias("r"), ((F.col("raster_id") % 64) * 8 + F.col("c")).cast("int").alias("c"), F.col("dtm").alias("v"))
    path = folder(spark, "dtm")
    sinks.as_strips(placed, "name", 512, 8, "f4").write.format("pixels").mode("append").save(path)
    found = spark.read.format("pixels").option("placed", True).load(path).where("v > 0")
    return found.select(F.expr("cast(r div 8 as bigint)").alias("strip"), "r", "c", F.round("v", 4).alias("v"))


@query(f"select \"key\", count(*) parts, round(sum(w * h), 6) area from {PARTS} where x0 < 6000 group by 1 having count(*) > 0")
def shape_files(spark, sf_dir):
    """Polygons written as Shapefiles and read back by their index."""
    formats.register(spark)
    path = folder(spark, "shapes")
    west = src.polygons(spark, sf_dir).withColumn("parts", F.filter("parts", lambda ring: F.get(ring, F.lit(0))["x"] < 6000)).where(F.size("parts") > 0)
    sinks.write_shapes(west, path)
    back = spark.read.format("shapes").load(path).select(F.col("attributes")["KEY"].cast("long").alias("key"), F.explode("rings").alias("ring"))
    return back.groupBy("key").agg(F.count("*").alias("parts"), F.round(F.sum(rings.area(F.col("ring"))), 6).alias("area"))


@query(f"select tile_name, site, split, crown_frac from {_SPLIT} where split = 'test'")
def tile_store(spark, sf_dir):
    """Tiles written by split and site; a split is read from its own folders."""
    path = folder(spark, "tiles")
    tiles = src.tiles(spark, sf_dir)
    split = tables.stratified_split(tiles, "site", "key", DEFAULTS["test_frac"]).select("tile_name", "site", "split", "crown_frac")
    sinks.write_tiles(split, path)
    return spark.read.parquet(path).where("split = 'test'").select("tile_name", "site", "split", "crown_frac")


@query(f"select fold, epoch, null::double train_total, null::double train_mae, val_mae from {LOSSES}")
def table_files(spark, sf_dir):
    """Histories as delimited text under the older name of their loss, read with the stated schema."""
    path = folder(spark, "losses")
    sinks.write_table(src.losses(spark, sf_dir).select("fold", "epoch", F.col("val_mae").alias("val_loss")), path)
    older = "fold int, epoch int, val_loss double"
    found = files.renamed(files.read_table(spark, path, older), "val_mae", "val_loss")
    for name in ("train_total", "train_mae"):
        found = files.renamed(found, name)
    return found.select("fold", "epoch", "train_total", "train_mae", "val_mae")


@query("select o_orderkey \"key\", o_orderstatus status from orders")
def pending_rows(spark, sf_dir):
    """Orders of one status are done; a second run adds those that the manifest lacks."""
    path, rows = folder(spark, "pending"), src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    rows.where("status = 'F'").write.parquet(path)
    done = spark.read.parquet(path)
    sinks.write_pending(rows, done, "key", path)
    return spark.read.parquet(path)


@query(f"select 'S' || (\"key\" % 4)::varchar || '_' || \"key\"::varchar crown_id, round(sum(w * h), 4) area_m2, round(2 * sqrt(sum(w * h) / 3.14159::double), 2) diameter_m, count(*) rings, round(sum(w * h), 4) ring_area from {PARTS} group by \"key\"")
def crown_packages(spark, sf_dir):
    """Crowns appended to a folder of GeoPackages in two runs and read back."""
    formats.register(spark)
    path = folder(spark, "crowns")
    area = F.aggregate(F.transform("parts", rings.area), F.lit(0.0), lambda a, b: a + b)
    crowns = src.polygons(spark, sf_dir).withColumn("area_m2", area)
    crowns = crowns.select(F.concat(F.lit("S"), (F.col("key") % 4).cast("string"), F.lit("_"), F.col("key").cast("string")).alias("crown_id"), "area_m2", diameter(F.col("area_m2")).alias("diameter_m"), size_class(F.col("area_m2")).alias("size_class"), F.col("parts").alias("rings"))
    for part in ("area_m2 < 100", "area_m2 >= 100"):
        crowns.where(part).write.format("crown_packages").mode("append").save(path)
    back = spark.read.format("crown_packages").load(path)
    ring_area = F.aggregate(F.transform("rings", rings.area), F.lit(0.0), lambda a, b: a + b)
    return back.select("crown_id", F.round("area_m2", 4).alias("area_m2"), "diameter_m", F.size("rings").cast("long").alias("rings"), F.round(ring_area, 4).alias("ring_area"))
