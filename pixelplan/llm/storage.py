"""Where results that cut lineage go: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session on one machine, as in tests, may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor takes nothing of it along."""
    _shared(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of folder() that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def opened(uri: str):
    """The file system of a path of Spark's, as tasks can use it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri) if ":" in uri else uri)


class Scratch:
    """Tables of one job as Parquet in a folder of its own in the shared folder; each can be removed once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.place = spark, folder(spark, name)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df written once and read from there, so that a lost executor takes nothing of it along.

        The shuffle files of the write are removed with its end, as nothing reads them again.
        """
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.place}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.place}/{name}")
