"""Expressions on single crowns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS


def size_class(area: Column, small_max: float = DEFAULTS["size_small_max_m2"], medium_max: float = DEFAULTS["size_medium_max_m2"]) -> Column:
    """small, medium or large; both bounds belong to the smaller class."""
    return F.when(area <= small_max, "small").when(area <= medium_max, "medium").otherwise("large")


def diameter(area: Column) -> Column:
    """Of a circle of this area, with the fixed value 3.14159 for pi, to 2 places."""
    return F.round(2 * F.sqrt(area / F.lit(3.14159)), 2)


def site_name(stem: Column) -> Column:
    """The file's stem without any `_rgb`."""
    return F.replace(stem, F.lit("_rgb"), F.lit(""))


def tile_name(site: Column, row_off: Column, col_off: Column) -> Column:
    return F.format_string("%s_r%05d_c%05d.tif", F.lower(site), row_off, col_off)


def f1_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; 0 where a denominator is 0."""
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]
