"""Summaries of crowns, tiles and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def crown_summary(crowns: DataFrame, *keys: str) -> DataFrame:
    area = F.col("area_m2")
    found = crowns.groupBy(*keys).agg(F.count("*").alias("crowns"), F.round(F.sum(area) / 10000, 4).alias("canopy_ha"), F.min(area).alias("min_m2"), F.max(area).alias("max_m2"), F.round(F.avg(area), 4).alias("mean_m2"))
    return with_median(found, crowns, "area_m2", *keys).select(*keys, "crowns", "canopy_ha", "median_m2", "min_m2", "max_m2", "mean_m2")


def with_median(found: DataFrame, rows: DataFrame, value: str, *keys: str, name: str = "median_m2") -> DataFrame:
    """found, which has one row for each key of rows, with the exact median; null for a key without values."""
    middle = tables.median(rows, value, *keys)
    middle = middle.select(*(F.col(key).alias(f"_k{k}") for k, key in enumerate(keys)), F.col("median").alias(name))
    same = F.lit(True)
    for k, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{k}"))
    return found.join(middle, same, "left").drop(*(f"_k{k}" for k in range(len(keys))))


def class_percent(crowns: DataFrame) -> DataFrame:
    """Crowns of each size class and their share; no rows for no crowns."""
    counts = crowns.groupBy("size_class").agg(F.count("*").alias("crowns"))
    total = counts.agg(F.sum("crowns").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("size_class", "crowns", F.round(F.lit(100.0) * F.col("crowns") / F.col("total"), 4).alias("percent"))


def totals(crowns: DataFrame) -> DataFrame:
    """One row of totals; zeros for no crowns."""
    area, zero = F.col("area_m2"), F.lit(0.0)
    classes = [F.count_if(F.col("size_class") == c).cast("double").alias(c) for c in ("small", "medium", "large")]
    found = crowns.agg(F.count("*").cast("double").alias("total_crowns"), F.coalesce(F.round(F.sum(area) / 1e4, 4), zero).alias("canopy_ha"), F.coalesce(F.round(F.avg(area), 4), zero).alias("mean_m2"), *classes)
    found = with_median(found, crowns, "area_m2")
    return found.select("total_crowns", "canopy_ha", F.coalesce("median_m2", zero).alias("median_m2"), "mean_m2", "small", "medium", "large")


def as_metrics(row: DataFrame) -> DataFrame:
    """Columns as rows of metric and value."""
    return row.unpivot([], row.columns, "metric", "value")


def image_stats(extents: DataFrame, types: DataFrame, pixel_m: float = 0.075, bands: int = 3, file_gb: Column | None = None) -> DataFrame:
    """Pixels, extent and sizes of images; with file_gb also the compression ratio, 0 for an empty file, and both as text."""
    pixels = F.col("h").cast("long") * F.col("w")
    size = lambda width: F.round(pixels * bands * width / F.lit(1e9), 6)
    out = extents.crossJoin(F.broadcast(types)).select("h", "w", "dtype", pixels.alias("pixels"), F.round(F.col("w") * F.lit(pixel_m) / 1000, 6).alias("width_km"), size(F.col("bytes")).alias("raw_gb"), size(F.lit(4)).alias("float32_gb"))
    if file_gb is None:
        return out
    ratio = F.when(file_gb > 0, F.col("raw_gb") / file_gb).otherwise(0.0)
    extent = F.format_string("%.4f x %.4f km", F.col("width_km"), F.col("h") * F.lit(pixel_m) / 1000)
    return out.withColumns({"extent": extent, "ratio": F.round(ratio, 6), "ratio_text": F.format_string("%.1fx", ratio)})


def canopy_cover(crowns: DataFrame, key: str, area_m2: float) -> DataFrame:
    """Cover of an area that the caller states, in per cent, hectares and square miles."""
    total = F.sum("area_m2")
    return crowns.groupBy(key).agg(F.round(total * 100 / area_m2, 6).alias("cover_pct"), F.round(total / 1e4, 6).alias("canopy_ha"), F.round(total / 2.59e6, 8).alias("canopy_sq_mi"))


def _plain(value: Column) -> Column:
    """A number as text without an exponent, whatever its size: Spark writes doubles from ten million on, and below a thousandth, with one."""
    digits = value.cast("string").try_cast("decimal(38, 17)").cast("string")
    whole = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    far = (F.abs(value) >= 1e7) | (F.abs(value) < 1e-3) & (value != 0)
    return F.when(far, F.coalesce(whole, value.cast("string"))).otherwise(value.cast("string"))


def _bare(text: Column) -> Column:
    """A JSON text whose values are all numbers written as texts, with the quotes around these values taken off."""
    return F.regexp_replace(text, '":"(-?[0-9][-+.0-9E]*)"', '":$1')


def document(crowns: DataFrame, tiles: DataFrame) -> DataFrame:
    """Crown totals, classes and tiles by site as one JSON text; sites are keys, so they are a map. Numbers have no exponents."""
    total = totals(crowns)
    total = total.select(_bare(F.to_json(F.struct(*(_plain(F.col(c)).alias(c) for c in total.columns)))).alias("crowns"))
    shares = F.struct(F.col("crowns").cast("string").alias("crowns"), _plain(F.col("percent")).alias("percent"))
    classes = class_percent(crowns).agg(_bare(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size_class", shares.alias("v"))))))).alias("classes"))
    sites = tiles.groupBy("site").agg(F.count("*").alias("tiles")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "tiles"))))).alias("tiles"))
    joined = total.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(sites))
    return joined.select(F.concat(F.lit('{"crowns":'), "crowns", F.lit(',"classes":'), "classes", F.lit(',"tiles":'), "tiles", F.lit("}")).alias("document"))
