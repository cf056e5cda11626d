"""Grids of tiles, windows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator


def origins(extents: DataFrame, tile: int = 512, stride: int = 256, inside: bool = False) -> DataFrame:
    """h, w, r, c: the distinct origins of overlapping windows that cover an extent, those flush with the far edges included.

    inside: without negative origins, which extents smaller than a tile have.
    """
    last_r, last_c = F.array(F.col("h") - tile), F.array(F.col("w") - tile)

    def lay(r: Column, c: Column) -> DataFrame:
        return extents.select("h", "w", F.explode(r).alias("r")).select("h", "w", "r", F.explode(c).alias("c"))

    rows = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(stride))
    out = lay(rows("h"), rows("w")).union(lay(last_r, rows("w"))).union(lay(rows("h"), last_c)).union(lay(last_r, last_c)).distinct()
    return out.where("r >= 0 and c >= 0") if inside else out


def chunks_of(row: Column, extent: Column, chunk: int, border: int) -> Column:
    """The chunks whose window with its border holds a row: three at most, so a pixel is sent to each."""
    n = F.ceil(extent / F.lit(float(chunk))).cast("int")
    return F.filter(F.array(*(F.floor(row / F.lit(chunk)).cast("int") + d for d in (-1, 0, 1))), lambda k: (k >= 0) & (k < n) & (row >= k * chunk - border) & (row < (k + 1) * chunk + border))


def owner(centre: Column, chunk: int) -> Column:
    """The one chunk that an object belongs to."""
    return F.floor(centre / F.lit(chunk)).cast("int")


def rows_owned_twice(extents: DataFrame, chunk: int, border: int) -> DataFrame:
    """For each height the rows that the guards of the older rule give to two chunks: there the last chunk but one has no
    lower guard where its border reaches the image's end."""
    h = F.col("h")
    n = F.ceil(h / F.lit(float(chunk))).cast("int")
    chunks = extents.select("h", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    top = F.when(F.col("k") == 0, 0).otherwise(F.col("k") * chunk)
    reach = F.least(h, (F.col("k") + 1) * chunk + border)
    bottom = F.when(reach == h, h).otherwise((F.col("k") + 1) * chunk)
    spans = chunks.select("h", top.alias("lo"), bottom.alias("hi"))
    return spans.groupBy("h").agg((F.sum(F.col("hi") - F.col("lo")) - F.first("h")).alias("twice"))


def tile_grid(boxes: DataFrame) -> DataFrame:
    """The tiles of a projected box at a zoom, corners included: counts, size in pixels, bounds of the whole tiles."""
    zoom = F.col("zoom")
    c0, c1 = mercator.tile_column(F.col("left"), zoom), mercator.tile_column(F.col("right"), zoom)
    r0, r1 = mercator.tile_row(F.col("top"), zoom), mercator.tile_row(F.col("bottom"), zoom)
    placed = boxes.withColumns({"col_min": c0, "col_max": c1, "row_min": r0, "row_max": r1})
    cols, rows = F.expr("col_max - col_min + 1"), F.expr("row_max - row_min + 1")
    placed = placed.withColumns({"cols": cols, "rows": rows})
    return placed.withColumns({
        "tiles": F.col("cols").cast("long") * F.col("rows"), "width_px": F.col("cols") * mercator.TILE, "height_px": F.col("rows") * mercator.TILE,
        "snap_left": mercator.tile_left(F.col("col_min"), zoom), "snap_top": mercator.tile_top(F.col("row_min"), zoom), "est_gb": F.round(F.expr("cast(cols as double) * rows * 256 * 256 * 3 / 1e9 * 0.15"), 6),
    })


def batches(rows: DataFrame, order: str, size: int, key: str) -> DataFrame:
    """batch: groups of so many rows in order within each key."""
    from .tables import numbered_within

    placed = numbered_within(rows, [key], order).drop("size")
    return placed.withColumn("batch", F.floor((F.col("number") - 1) / F.lit(size)).cast("int")).drop("number")
