"""Tables of the reference's shapes, projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator
from ..functions.crowns import size_class, tile_name
from ..operators.tables import numbered_within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crown_id, site, area_m2, size_class."""
    rows = table(spark, sf_dir, "lineitem")
    crown_id = F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    return rows.select(crown_id.alias("crown_id"), F.col("l_returnflag").alias("site"), F.col("l_quantity").cast("double").alias("area_m2")).withColumn("size_class", size_class(F.col("area_m2")))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_id, site_no, r, c, v: chips of 8 x 8."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), F.col("label").alias("site_no"), F.posexplode("embedding").alias("pos", "p"))
    return rows.select("raster_id", "site_no", F.expr("pos div 8").cast("int").alias("r"), (F.col("pos") % 8).alias("c"), grey(F.col("p")).alias("v"))


def pixels_of(spark: SparkSession, sf_dir: str, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The pixels of a window of each chip: only their places are taken from the arrays."""
    at = F.array(*(F.lit(r * 8 + c) for r in range(row_off, row_off + height) for c in range(col_off, col_off + width)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), F.col("label").alias("site_no"), "embedding", F.explode(at).alias("pos"))
    return rows.select("raster_id", "site_no", F.expr("pos div 8").cast("int").alias("r"), (F.col("pos") % 8).alias("c"), grey(F.get("embedding", "pos")).alias("v"))


def grey(value: Column) -> Column:
    """An embedding's number as a grey value of 0 to 255."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (value.cast("double") + 0.5) * 256))).cast("int")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of labelled crowns: four quarters of a chip where v >= 120."""
    return pixels(spark, sf_dir).where("v >= 120").withColumn("label", F.expr("cast(1 + 2 * (r div 4) + (c div 4) as int)"))


def predicted_and_true(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Masks of odd chips as predictions and of even ones as truth: tile, label, r, c."""
    m = masks(spark, sf_dir).select(F.expr("raster_id div 2").alias("tile"), "label", "r", "c", (F.col("raster_id") % 2).alias("odd"))
    return m.where("odd = 1").drop("odd"), m.where("odd = 0").drop("odd")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_name, site, row_off, col_off, crown_frac, key (p_partkey)."""
    rows = table(spark, sf_dir, "part")
    out = rows.select(F.col("p_type").alias("site"), F.expr("cast((p_partkey div 50) * 512 as int)").alias("row_off"), F.expr("cast((p_partkey % 50) * 512 as int)").alias("col_off"), F.round((F.col("p_size") - 1) / F.lit(49.0), 4).alias("crown_frac"), F.col("p_partkey").alias("key"))
    return out.withColumn("tile_name", tile_name(F.col("site"), F.col("row_off"), F.col("col_off")))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, epoch (from 1), val_mae: numbered over ranges of events, so that a fold is not one window."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("fold"), "event_id", F.col("value").alias("val_mae"))
    return numbered_within(rows, ["fold"], "event_id").select("fold", F.col("number").alias("epoch"), "val_mae")


def photos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """site of each photo; site of each annotated crown."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    crowns_ = supplier.where("s_nationkey % 5 <> 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return nation.select(F.concat("n_name", F.lit("_rgb")).alias("stem")), crowns_.select(F.col("n_name").alias("site"), F.col("s_suppkey").alias("crown"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yr, area_m2."""
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"), (F.col("o_totalprice") / 10000).alias("area_m2"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, mx, my, zoom and the tile's col and row."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("key"), ((key * 7919) % 40000000 - 20000000).cast("double").alias("mx"), ((key * 104729) % 40000000 - 20000000).cast("double").alias("my"), (F.lit(20) - (key % 2)).cast("int").alias("zoom"))
    return rows.withColumn("col", mercator.tile_column(F.col("mx"), F.col("zoom"))).withColumn("row", mercator.tile_row(F.col("my"), F.col("zoom")))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, col (a tile's column), status."""
    status = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "purchase", 500).otherwise(200)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("col"), status.cast("int").alias("status"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt anew to as many tasks as shuffles have: a small file is read in few splits, however much work its rows will be."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, parts: arrays of closed rectangular rings; every fifth has a second part."""
    return _polygons(table(spark, sf_dir, "part"))


def _polygons(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").alias("key"), ((F.col("p_partkey") % 100) * 120).cast("double").alias("x0"), F.expr("cast((p_partkey div 100) * 120 as double)").alias("y0"), F.col("p_size").cast("double").alias("w"), ((F.col("p_size") % 7) + 1).cast("double").alias("h"), F.col("p_size"))

    def ring(x):
        point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        y = F.col("y0")
        return F.array(point(x, y), point(x + F.col("w"), y), point(x + F.col("w"), y + F.col("h")), point(x, y + F.col("h")), point(x, y))

    one, two = ring(F.col("x0")), ring(F.col("x0") + 60)
    return rows.select("key", F.when(F.col("p_size") % 5 == 0, F.array(one, two)).otherwise(F.array(one)).alias("parts"))


def broken_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polygons() of which a quarter each cross themselves in the middle, have a spike, and have points twice; a quarter is left."""
    rows = _polygons(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")))

    def broken(ring: Column) -> Column:
        p = [F.get(ring, F.lit(k)) for k in range(4)]
        spike = F.struct((p[2]["x"] + 5).alias("x"), p[2]["y"].alias("y"))
        kinds = ([p[0], p[2], p[1], p[3], p[0]], [p[0], p[1], p[2], spike, p[2], p[3], p[0]], [p[0], p[0], p[1], p[2], p[2], p[2], p[3], p[0]])
        out = ring
        for k, points in enumerate(kinds, 1):
            out = F.when(F.col("key") % 4 == k, F.array(*points)).otherwise(out)
        return out

    return rows.withColumn("parts", F.transform("parts", broken))
