"""Operators on pixel tables: one row for each pixel, background left out where it may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def band_stats(pixels: DataFrame, key: str, value: str = "v", nodata: int | None = None) -> DataFrame:
    """Least, mean and largest value of each raster; nodata values are left out as nulls."""
    v = F.col(value) if nodata is None else F.nullif(F.col(value), F.lit(nodata))
    return pixels.groupBy(key).agg(F.min(v).alias("low"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("high"), F.count(v).alias("valid"))


def window(pixels: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The pixels of a window; the bounds are filters that reach the scan."""
    return pixels.where(F.col("r").between(row_off, row_off + height - 1) & F.col("c").between(col_off, col_off + width - 1))


def normalised(value: Column, mean: Column, std: Column) -> Column:
    return (value / 255 - mean) / std


def to_planes(samples: Column, rows: int, columns: int, bands: int) -> Column:
    """An array of samples pixel by pixel as one band after another."""
    n = rows * columns
    return F.transform(F.sequence(F.lit(0), F.lit(n * bands - 1)), lambda i: F.get(samples, ((i % n) * bands + F.floor(i / F.lit(n))).cast("int")))


def to_pixels(samples: Column, rows: int, columns: int, bands: int) -> Column:
    """An array of samples band by band as one pixel after another."""
    n = rows * columns
    return F.transform(F.sequence(F.lit(0), F.lit(n * bands - 1)), lambda i: F.get(samples, ((i % bands) * n + F.floor(i / F.lit(bands))).cast("int")))


def keep_bright(pixels: DataFrame, key: str, least: float = 10.0) -> DataFrame:
    """Chips whose mean over all pixels is no less."""
    return pixels.groupBy(key).agg(F.avg("v").alias("mean")).where(F.col("mean") >= least)


def bounded_sample(chips: DataFrame, order: str, valid: Column, n: int) -> DataFrame:
    """The first n valid of the first 2 n attempts in this order."""
    return chips.orderBy(order).limit(2 * n).where(valid).orderBy(order).limit(n)


def histogram(pixels: DataFrame, *keys: str, value: str = "v", bins: int = 256) -> DataFrame:
    """n for each key and each value of 0 to bins - 1, zeros included."""
    counts = pixels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    spine = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(value))
    return spine.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cdf(counts: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """cdf: running sum of n over its total, within each key; each has as many rows as there are bins."""
    own = Window.partitionBy(*keys)
    return counts.withColumn("cdf", F.sum("n").over(own.orderBy(value)) / F.sum("n").over(own))


def match_table(source: DataFrame, reference: DataFrame, key: str, value: str = "v", bins: int = 256) -> DataFrame:
    """lut: for each source value the first reference value whose cdf is no less, the last bin if there is none.

    An as-of join within each key; both sides have a fixed number of rows for a key.
    """
    ref = reference.select(key, F.col(value).alias("_r"), F.col("cdf").alias("_rc"))
    joined = source.join(ref, (source[key] == ref[key]) & (F.col("_rc") >= F.col("cdf")), "left").drop(ref[key])
    return joined.groupBy(key, value).agg(F.coalesce(F.min("_r"), F.lit(bins - 1)).cast("int").alias("lut"))


#: Rows of lookup tables that are sent to all executors; more meet the pixels by a shuffle with a salt.
SENT_ROWS = 1 << 20
SALT = 16


def apply_table(pixels: DataFrame, luts: DataFrame, key: str, value: str = "v") -> DataFrame:
    """matched: the table's entry for the pixel's key and value. The tables are kept, and their size decides how they reach the pixels."""
    luts = kept(luts.select(key, value, "lut"))
    if luts.count() <= SENT_ROWS:
        found = pixels.join(F.broadcast(luts), [key, value])
    else:  # a key's pixels of one value may be very many
        dealt = luts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = pixels.withColumn("_salt", F.pmod(F.hash("r", "c"), F.lit(SALT))).join(dealt, [key, value, "_salt"]).drop("_salt")
    return found.withColumn("matched", F.col("lut")).drop("lut")


def zonal_stats(masks: DataFrame, *keys: str, pixel_area: float = 1.0) -> DataFrame:
    """For each label: pixels, area, box and the mean row and column, cut to whole numbers."""
    return masks.groupBy(*keys).agg(
        F.count("*").alias("pixels"), (F.count("*") * F.lit(pixel_area)).alias("area_m2"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"),
        F.avg("r").cast("int").alias("centre_r"), F.avg("c").cast("int").alias("centre_c"),
    )


def distance_transform(masks: DataFrame, *keys: str) -> DataFrame:
    """dtm of each pixel: 100 at the crown's centre pixel, 1 at the pixel furthest from it; 100 if all are at it.

    The centre is the mean row and column, rounded half to even. Centres and largest distances are one row for
    each crown, joined back, so a large crown is no large task.
    """
    centre = masks.groupBy(*keys).agg(F.rint(F.avg("r")).alias("_r"), F.rint(F.avg("c")).alias("_c"), F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    centre = centre.select(*keys, F.greatest("_r0", F.least("_r1", "_r")).alias("_r"), F.greatest("_c0", F.least("_c1", "_c")).alias("_c"))
    placed = masks.join(centre, list(keys)).withColumn("_d", F.sqrt(F.pow(F.col("r") - F.col("_r"), 2) + F.pow(F.col("c") - F.col("_c"), 2)))
    far = placed.groupBy(*keys).agg(F.max("_d").alias("_far"))
    dtm = F.when(F.col("_far") == 0, 100.0).otherwise((1 - F.col("_d") / F.col("_far")) * 99 + 1)
    return placed.join(far, list(keys)).withColumn("dtm", dtm).drop("_r", "_c", "_d", "_far")


def coverage(dtm: DataFrame, key: str, pixels: int, rasters: DataFrame | None = None) -> DataFrame:
    """Share of a raster of so many pixels that is crown, and the range of its positive values.

    Of rasters (a row each), those without a crown have 0 pixels and 0.0 percent, and no range.
    """
    positive = dtm.where("dtm > 0").groupBy(key).agg(F.count("*").alias("crown_pixels"), F.round(F.min("dtm"), 6).alias("low"), F.round(F.max("dtm"), 6).alias("high"))
    if rasters is not None:
        positive = rasters.select(key).distinct().join(positive, key, "left").withColumn("crown_pixels", F.coalesce("crown_pixels", F.lit(0)).cast("long"))
    return positive.withColumn("coverage_pct", F.round(F.col("crown_pixels") * F.lit(100.0) / pixels, 6))


def same_extent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Heights and widths (key, h, w) of rasters that two tables describe; raises when a row is read whose sizes differ."""
    other = b.select(key, F.col("h").alias("_h"), F.col("w").alias("_w"))
    told = F.concat_ws(" ", F.lit("sizes differ:"), F.col(key).cast("string"), *(F.col(c).cast("string") for c in ("h", "w", "_h", "_w")))
    equal = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))
    return a.join(other, key).withColumn("h", F.when(equal, F.col("h")).otherwise(F.raise_error(told))).select(key, "h", "w")


def tile_stats(pixels: DataFrame, key: str, tile: int, height: int, width: int, stride: int | None = None) -> DataFrame:
    """crown_frac, dtm_mean and dtm_max of each whole tile; partial tiles at the edges are left out. Value column: v, crown where v > 0.

    tile_r and tile_c count tiles, which begin every `stride` pixels (the tile's size if not given); a pixel is sent
    to all tiles that hold it.
    """
    stride = stride or tile

    def held(at: str, extent: int) -> Column:
        low, high = F.ceil((F.col(at) - (tile - 1)) / F.lit(stride)), F.floor(F.col(at) / F.lit(stride))
        return F.filter(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.greatest(high, F.lit(0)).cast("int")), lambda t: (t * stride <= F.col(at)) & (F.col(at) < t * stride + tile) & (t * stride + tile <= extent))

    whole = pixels.withColumn("tile_r", F.explode(held("r", height))).withColumn("tile_c", F.explode(held("c", width)))
    crown = F.col("v") > 0
    return whole.groupBy(key, "tile_r", "tile_c").agg(
        F.round(F.count_if(crown) / F.lit(float(tile * tile)), 4).alias("crown_frac"), F.coalesce(F.round(F.avg(F.when(crown, F.col("v"))), 2), F.lit(0.0)).alias("dtm_mean"), F.coalesce(F.max(F.when(crown, F.col("v"))), F.lit(0)).alias("dtm_max"))


def reflect(i: Column, n: int) -> Column:
    """The place inside 0 to n - 1 that a place outside mirrors, the edge not repeated; good for less than n beyond."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def padded(pixels: DataFrame, key: str, n: int, pad: int) -> DataFrame:
    """Rasters of n x n with a mirrored border: each pixel is sent to the places that show it, so there is no join by range."""
    def shown(c: str) -> Column:
        """A place and its mirror images at both ends, as far as the border reaches."""
        at = F.col(c)
        return F.filter(F.array(at, F.when(at > 0, -at), F.when(at < n - 1, 2 * (n - 1) - at)), lambda i: i.isNotNull() & (i >= -pad) & (i <= n - 1 + pad))

    return pixels.select(key, F.explode(shown("r")).alias("r"), "c", "v").select(key, "r", F.explode(shown("c")).alias("c"), "v")


def last_write(writes: DataFrame, *keys: str) -> DataFrame:
    """Of several values written to a pixel the one of the last origin in (row, column) order."""
    return writes.groupBy(*keys).agg(F.max_by("v", F.struct("origin_r", "origin_c")).alias("v"))


def focal_max(pixels: DataFrame, key: str, radius: int, value: str = "v") -> DataFrame:
    """Pixels that no pixel of the square around them exceeds.

    Separable: the largest in each row's neighbourhood, then in each column's, by sending each value to the
    places around it and taking maxima, which combine before the shuffle.
    """
    around = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    rows = pixels.select(key, "r", "c", value, around.alias("_d")).groupBy(key, F.col("r"), (F.col("c") + F.col("_d")).alias("c")).agg(F.max(value).alias("_m"))
    both = rows.select(key, "r", "c", "_m", around.alias("_d")).groupBy(key, (F.col("r") + F.col("_d")).alias("r"), "c").agg(F.max("_m").alias("_m"))
    return pixels.join(both, [key, "r", "c"]).where(F.col(value) >= F.col("_m")).drop("_m")


def label_edges(masks: DataFrame, key: str) -> DataFrame:
    """The sides of labelled pixels beyond which the same label does not go on: key, label, r, c, side.

    Pixels next to one another are looked for along the lines of a label, rows first and then columns, so a pixel is moved twice.
    """
    along = lambda line, at, step: F.count(F.lit(1)).over(Window.partitionBy(key, "label", line).orderBy(at).rangeBetween(step, step)) == 0
    unknown = F.greatest(*(F.col(x).isNull() for x in (key, "label", "r", "c")))  # what is not known is next to nothing
    ways = (("left", "r", "c", -1), ("right", "r", "c", 1), ("top", "c", "r", -1), ("bottom", "c", "r", 1))
    found = masks.select(key, "label", "r", "c")
    for line in ("r", "c"):
        found = found.select("*", *(along(by, at, step).alias(f"_{name}") for name, by, at, step in ways if by == line))
    sides = F.array(*(F.when(unknown | F.col(f"_{name}"), F.lit(name)) for name, *_ in ways))
    return found.select(key, "label", "r", "c", F.explode(F.array_compact(sides)).alias("side"))
