"""Tables that are computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session on one machine, as in tests, may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read from there, so that all later passes see the same rows."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
