"""Where results go: partitioned parquet, delimited tables, one JSON document, and a manifest of what is done."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Tiles by split and site, a site's tiles dealt to several files."""
    pixels.repartition("split", "site", "tile_name").write.mode("overwrite").partitionBy("split", "site").parquet(path)


def write_chips(pixels: DataFrame, path: str, edge: int = 512) -> None:
    """A pixel table as chips: one row for each block of edge x edge with its sparse pixels, so windows read few rows."""
    chips = pixels.groupBy("raster_id", F.expr(f"r div {edge}").alias("chip_row"), F.expr(f"c div {edge}").alias("chip_col")).agg(F.collect_list(F.struct("r", "c", "v")).alias("pixels"))
    chips.write.mode("overwrite").partitionBy("chip_row").parquet(path)


def read_chips(chips: DataFrame, row_off: int, col_off: int, height: int, width: int, edge: int = 512) -> DataFrame:
    """The pixels of a window: whole chips are left out before any is unpacked."""
    near = chips.where(F.col("chip_row").between(row_off // edge, (row_off + height - 1) // edge) & F.col("chip_col").between(col_off // edge, (col_off + width - 1) // edge))
    rows = near.select("raster_id", F.explode("pixels").alias("p")).select("raster_id", "p.*")
    return rows.where(F.col("r").between(row_off, row_off + height - 1) & F.col("c").between(col_off, col_off + width - 1))


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_document(rows: DataFrame, path: str, column: str = "document") -> None:
    rows.select(column).write.mode("overwrite").text(path)


def write_pending(rows: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Adds the rows whose key the manifest lacks."""
    rows.join(done.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def as_strips(pixels: DataFrame, name: str, width: int, rows: int, dtype: str = "u1", fill: float = 0, height: int | None = None) -> DataFrame:
    """Pixels (name, r, c, v) of one band as strips of so many rows, the form that the format `pixels` writes; what no pixel has is fill.

    A group is a strip, of rows x width pixels. The last strip of a known height is as short as it must be. A row without a column
    only makes its strip be there.
    """

    @F.arrow_udf("binary")
    def packed(column: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for cells, n in zip(column, high.to_pylist(), strict=True):
            grid = np.full(n * width, fill, np.dtype("<" + dtype))
            at = cells.values
            grid[at.field("at").to_numpy()] = at.field("v").to_numpy()
            out.append(grid.tobytes())
        return pa.array(out, pa.binary())

    first = (F.floor(F.col("r") / F.lit(rows)) * rows).cast("int")
    cells = F.collect_list(F.when(F.col("c").isNotNull() & F.col("v").isNotNull(), F.struct(((F.col("r") - F.col("first_row")) * width + F.col("c")).cast("int").alias("at"), F.col("v").cast("double").alias("v"))))
    groups = pixels.withColumn("first_row", first).groupBy(F.col(name).cast("string").alias("name"), "first_row").agg(cells.alias("cells"))
    high = F.lit(rows) if height is None else F.least(F.lit(rows), F.lit(height) - F.col("first_row"))
    return groups.select("name", "first_row", F.lit(width).alias("width"), F.lit(1).alias("bands"), F.lit(dtype).alias("dtype"), packed("cells", high.cast("int")).alias("data"))


def write_shapes(polygons: DataFrame, path: str) -> None:
    """Polygons (key, parts) as Shapefiles, some a task, with the key as their attribute KEY. A task that runs again writes its files again."""
    from .formats import opened, shape_files

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(path)
        system.create_dir(place, recursive=True)
        for k, batch in enumerate(batches):
            for ending, raw in shape_files(batch["key"].to_pylist(), batch["parts"].to_pylist()).items():
                with system.open_output_stream(f"{place}/part-{TaskContext.get().partitionId():05d}-{k:05d}{ending}") as file:
                    file.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    polygons.select("key", "parts").mapInArrow(write, "n long").agg(F.sum("n")).collect()
