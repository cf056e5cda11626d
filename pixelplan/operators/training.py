"""Replays of training histories: epochs in order within a fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Epochs of a fold that are one window or array; what is longer is put together from blocks.
BLOCK = 4096


def block() -> Column:
    return F.floor(F.col("epoch") / F.lit(BLOCK)).cast("long")


def _running(rows: DataFrame, name: str, value: Column, pick, join, last: int) -> DataFrame:
    """name: what pick (F.min or F.max) finds of value in a fold's epochs up to `last` rows from each: over its block, joined with all blocks before."""
    rows = rows.withColumns({"_block": block(), "_value": value})
    before = Window.partitionBy("_fold").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(F.col("fold").alias("_fold"), F.col("_block").alias("_at")).agg(pick("_value").alias("_own"))
    ahead = ahead.select("_fold", "_at", pick("_own").over(before).alias("_ahead"))
    within = Window.partitionBy("fold", "_block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, last)
    both = rows.join(ahead, F.col("fold").eqNullSafe(F.col("_fold")) & (F.col("_block") == F.col("_at")))
    return both.withColumn(name, join(F.col("_ahead"), pick("_value").over(within))).drop("_block", "_value", "_fold", "_at", "_ahead")


def running_best(losses: DataFrame) -> DataFrame:
    """best_before: the least loss of earlier epochs; is_best: a strict improvement on it."""
    found = _running(losses, "best_before", F.col("val_mae"), F.min, F.least, -1)
    return found.withColumn("is_best", F.coalesce(F.col("val_mae") < F.col("best_before"), F.lit(True)))


def early_stop(losses: DataFrame, patience: int) -> DataFrame:
    """fold, stop_epoch and best of the epochs up to it: the first epoch that is `patience` after the last improvement, the last epoch if none is."""
    best = _running(running_best(losses), "since", F.when(F.col("is_best"), F.col("epoch")), F.max, F.greatest, 0)
    stop = best.groupBy("fold").agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    return losses.join(stop, "fold").where("epoch <= stop_epoch").groupBy("fold", "stop_epoch").agg(F.min("val_mae").alias("best"))


def fold_summary(losses: DataFrame) -> DataFrame:
    """Per fold the number of epochs, the least loss and its first epoch; the spread over folds is that of the population."""
    folds = losses.groupBy("fold").agg(F.count("*").alias("epochs"), F.min("val_mae").alias("best"), F.min_by("epoch", F.struct("val_mae", "epoch")).alias("best_epoch"))
    over = folds.agg(F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.stddev_pop("best"), 6).alias("std_best"), F.sum("epochs").alias("all_epochs"))
    return folds.crossJoin(F.broadcast(over))


def unpivoted(histories: DataFrame, first: str | None = None) -> DataFrame:
    """Arrays by epoch as rows: fold, epoch (from 1, or from column first where a fold has several runs) and one column for each array."""
    arrays = [f.name for f in histories.schema.fields if f.dataType.typeName() == "array"]
    start = F.col(first) if first else F.lit(1)
    return histories.select("fold", start.alias("_first"), F.posexplode(F.arrays_zip(*arrays)).alias("at", "e")).select("fold", (F.col("_first") + F.col("at")).alias("epoch"), *(F.col(f"e.{a}").alias(a) for a in arrays))


def warmup(epoch: Column, lr: float, epochs: int) -> Column:
    """epoch from 0: the rate rises to lr in equal steps."""
    return F.lit(lr) * F.when(epoch < epochs, (epoch + 1) / F.lit(float(epochs))).otherwise(F.lit(1.0))


def plateau_rates(losses: DataFrame, lr: float, factor: float, patience: int, least: float = 1e-6, threshold: float = 1e-4) -> DataFrame:
    """lr after each epoch: multiplied by factor when more than `patience` epochs in a row are no relative improvement by the threshold.

    Epochs count from 1 without gaps, losses are not negative. An improvement is also a new least loss, and those are few
    and found block by block; only they are read in order, to tell which of them improve by the threshold. How often
    the rate has been cut follows from the last of them.
    """

    def improvements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, at, cuts = (), float("inf"), 0, 0
        for batch in batches:
            out = []
            for fold, epoch, v in zip(*(batch[c].to_pylist() for c in ("fold", "epoch", "val_mae")), strict=True):
                if now != (fold,):
                    now, best, at, cuts = (fold,), float("inf"), 0, 0
                if v is not None and v < best * (1 - threshold):
                    cuts += (epoch - at - 1) // (patience + 1)
                    best, at = v, epoch
                    out.append((fold, epoch, cuts))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["_f", "_improved", "_cuts"])

    rates = [lr]
    while (after := max(rates[-1] * factor, least)) != rates[-1]:
        rates.append(after)
    rows = losses.select(F.col("fold").cast("int").alias("fold"), F.col("epoch").cast("long").alias("epoch"), F.col("val_mae").cast("double").alias("val_mae"))
    least_so_far = running_best(rows).where(F.col("is_best") & F.col("val_mae").isNotNull()).select("fold", "epoch", "val_mae")
    found = least_so_far.repartition("fold").sortWithinPartitions("fold", "epoch").mapInArrow(improvements, "_f int, _improved long, _cuts long")
    marked = rows.join(found, F.col("fold").eqNullSafe(F.col("_f")) & (F.col("epoch") == F.col("_improved")), "left")
    marked = _running(marked.drop("_f"), "_last", F.when(F.col("_improved").isNotNull(), F.struct("_improved", "_cuts")), F.max, F.greatest, 0)
    at, cuts = F.coalesce("_last._improved", F.lit(0)), F.coalesce("_last._cuts", F.lit(0))
    cut = F.least(cuts + F.floor((F.col("epoch") - at) / F.lit(patience + 1)), F.lit(len(rates) - 1)).cast("int")
    return marked.select("fold", F.col("epoch").cast(losses.schema["epoch"].dataType).alias("epoch"), F.element_at(F.array(*map(F.lit, rates)), cut + 1).alias("lr"))
