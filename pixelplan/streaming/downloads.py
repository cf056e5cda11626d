"""Download outcomes counted while tiles come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the outcome files that a fetcher leaves in its folder.
OUTCOME = "id long, col long, status int, at timestamp"


def follow(spark: SparkSession, path: str, late: str = "10 minutes", every: str = "5 minutes", files: int = 100) -> DataFrame:
    """Tiles by status in windows of time, as a stream: outcomes later than `late` are left out, state is dropped with its window."""
    rows = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", files).parquet(path)
    counted = rows.withWatermark("at", late).groupBy(F.window("at", every), "status").agg(F.count("*").alias("tiles"))
    return counted.select(F.col("window.start").alias("start"), "status", "tiles")
