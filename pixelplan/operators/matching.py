"""Matching of predicted crowns with true ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(predicted: DataFrame, true: DataFrame, tile: str = "tile") -> DataFrame:
    """tile, gt, pred, n: how many pixels have these labels; null where no crown of that side is.

    One pass over both sides' pixels, which meet by one grouping; all else follows from this small table.
    """
    none = F.lit(None).cast("int")
    both = predicted.select(tile, "r", "c", F.col("label").alias("pred"), none.alias("gt")).unionByName(true.select(tile, "r", "c", none.alias("pred"), F.col("label").alias("gt")))
    return both.groupBy(tile, "r", "c").agg(F.max("pred").alias("pred"), F.max("gt").alias("gt")).groupBy(tile, "gt", "pred").agg(F.count("*").alias("n"))


def areas(found: DataFrame, side: str, tile: str = "tile") -> DataFrame:
    """tile, label (named after its side) and area, from overlaps."""
    return found.where(F.col(side).isNotNull()).groupBy(tile, side).agg(F.sum("n").alias("area"))


def pairs_of(found: DataFrame, tile: str = "tile") -> DataFrame:
    """Every pair of crowns of one tile that share a pixel: tile, gt, pred, inter, uni, iou; from overlaps."""
    n_p, n_g = (areas(found, side, tile).withColumnRenamed("area", f"n_{side}") for side in ("pred", "gt"))
    both = found.where("gt is not null and pred is not null").withColumnRenamed("n", "inter").join(n_p, [tile, "pred"]).join(n_g, [tile, "gt"])
    both = both.withColumn("uni", F.col("n_pred") + F.col("n_gt") - F.col("inter"))
    return both.select(tile, "gt", "pred", "inter", "uni", F.coalesce(F.try_divide(F.col("inter").cast("double"), F.col("uni").cast("double")), F.lit(0.0)).alias("iou"))


def iou_pairs(predicted: DataFrame, true: DataFrame, tile: str = "tile") -> DataFrame:
    """Every pair of crowns of one tile that share a pixel: tile, gt, pred, inter, uni, iou. A side's labels are disjoint."""
    return pairs_of(overlaps(predicted, true, tile), tile)


def bbox_pairs(a: DataFrame, b: DataFrame, tile: str = "tile", cell: int = 64) -> DataFrame:
    """Pairs of boxes of one tile that overlap, touching sides included.

    Boxes are sent to the grid cells they reach, so pairs meet by equality; a pair that meets in several cells
    is kept in the first of them only.
    """
    reached = lambda x, n: F.sequence(F.expr(f"min_{n} div {cell}"), F.expr(f"max_{n} div {cell}"))

    def spread(df, s):
        cells = df.withColumn("_i", F.explode(reached(df, "r"))).withColumn("_j", F.explode(reached(df, "c")))
        return cells.select(tile, "_i", "_j", *(F.col(c).alias(f"{c}_{s}") for c in ("label", "min_r", "max_r", "min_c", "max_c")))

    met = spread(a, "a").join(spread(b, "b"), [tile, "_i", "_j"]).where("max_r_a >= min_r_b and max_r_b >= min_r_a and max_c_a >= min_c_b and max_c_b >= min_c_a")
    first = (F.col("_i") == F.greatest(F.expr(f"min_r_a div {cell}"), F.expr(f"min_r_b div {cell}"))) & (F.col("_j") == F.greatest(F.expr(f"min_c_a div {cell}"), F.expr(f"min_c_b div {cell}")))
    return met.where(first).select(tile, F.col("label_a"), F.col("label_b"))


def best_match(pairs: DataFrame, tile: str = "tile") -> DataFrame:
    """Of each true crown the prediction of the largest IoU, the smallest label of equals."""
    best = pairs.groupBy(tile, "gt").agg(F.max_by(F.struct("pred", "iou"), F.struct(F.col("iou"), -F.col("pred"))).alias("b"))
    return best.select(tile, "gt", "b.pred", "b.iou")


def greedy_matches(pairs: DataFrame, threshold: float, tile: str = "tile") -> DataFrame:
    """One-to-one matches: true crowns in order of label, each takes the free prediction of the largest IoU (the
    smallest label of equals) if that is no less than the threshold; a prediction not taken stays free.

    A tile's pairs are in one partition, one after another in this order, and partitions are gone through once: what is
    remembered is the predictions that the tile at hand has taken. Pairs below the threshold are left out at once, which
    changes nothing, as a smaller IoU is never accepted.
    """
    good = pairs.where(F.col("iou") >= threshold).where(F.col(tile).isNotNull()).select(tile, F.col("gt").cast("int").alias("gt"), F.col("pred").cast("int").alias("pred"), F.col("iou").cast("double").alias("iou"))
    ordered = good.repartition(tile).sortWithinPartitions(tile, "gt", F.desc("iou"), "pred")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, served, taken = None, None, set()
        for batch in batches:
            picked = []
            for k, (own, gt, pred) in enumerate(zip(*(batch[c].to_pylist() for c in (tile, "gt", "pred")), strict=True)):
                if own != at:
                    at, served, taken = own, None, set()
                if gt != served and pred not in taken:
                    taken.add(pred)
                    served = gt
                    picked.append(k)
            yield batch.take(pa.array(picked, pa.int64()))

    return ordered.mapInArrow(match, ordered.schema)


def outcomes(found: DataFrame, matches: DataFrame, tile: str = "tile") -> DataFrame:
    """kind (tp, fp, fn), tile and area: of true crowns for tp and fn, of predictions for fp; from overlaps and matches."""
    flag = lambda side: matches.select(tile, side, F.lit(True).alias("met"))
    true = areas(found, "gt", tile).join(flag("gt"), [tile, "gt"], "left").select(F.when(F.col("met"), "tp").otherwise("fn").alias("kind"), tile, "area")
    false = areas(found, "pred", tile).join(flag("pred"), [tile, "pred"], "left_anti").select(F.lit("fp").alias("kind"), tile, "area")
    return true.unionByName(false)
