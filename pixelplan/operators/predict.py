"""Batched prediction with a pluggable predictor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .raster import last_write


def stand_in() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic predictor in place of a trained network: values in 0 to 100, cut off at both ends."""

    def predict(chips: np.ndarray) -> np.ndarray:
        return np.clip((chips + 0.5) * 100, 0, 100).astype(np.float32)

    return predict


def predict_chips(chips: DataFrame, key: str, values: str, make: Callable = stand_in, batch: int = 160, edge: int = 8, pad: int = 2) -> DataFrame:
    """key, r, c, v: the predictions within `pad` pixels of a chip's edges are left out, as they are seen better elsewhere."""
    size = edge * edge
    predict = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    out = chips.select(key, F.posexplode(predict(F.col(values))).alias("pos", "v"))
    out = out.select(key, F.expr(f"pos div {edge}").cast("int").alias("r"), (F.col("pos") % edge).alias("c"), F.round(F.col("v").cast("double"), 4).alias("v"))
    return out.where(F.col("r").between(pad, edge - 1 - pad) & F.col("c").between(pad, edge - 1 - pad))


def box_sum(tile: int) -> Callable:
    """A deterministic predictor that looks around each pixel: the sum of its square of nine."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def predict(chips: np.ndarray) -> np.ndarray:
            wide = np.pad(chips.reshape(-1, tile, tile), ((0, 0), (1, 1), (1, 1)))
            return np.lib.stride_tricks.sliding_window_view(wide, (3, 3), axis=(1, 2)).sum(axis=(-1, -2)).reshape(-1, tile * tile).astype(np.float32)

        return predict

    return make


def _shown(at: Column, n: int, tile: int, stride: int) -> Column:
    """Along one axis of n: the origins whose bordered windows show a place, and where: origin, at.

    Windows begin (tile - stride) / 2 before their origins, which lie every stride and flush with the far edge; beyond the
    edges they show the mirrored image, the edge not repeated.
    """
    pad = (tile - stride) // 2
    places = F.filter(F.array(at, F.when(at > 0, -at), F.when(at < n - 1, 2 * (n - 1) - at)), lambda p: p.isNotNull())
    low = lambda p: F.greatest(F.lit(0), F.ceil((p + (pad - tile + 1)) / F.lit(stride)).cast("int"))
    high = lambda p: F.least(F.lit((n - 1) // stride), F.floor((p + pad) / F.lit(stride)).cast("int"))
    aligned = lambda p: F.when(low(p) <= high(p), F.transform(F.sequence(low(p), high(p)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    last = n - tile
    flush = lambda p: F.when((F.lit(last % stride != 0)) & (p + pad - last >= 0) & (p + pad - last < tile), F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
    each = lambda p: F.transform(F.concat(aligned(p), flush(p)), lambda o: F.struct(o.alias("origin"), (p + pad - o).cast("int").alias("at")))
    return F.flatten(F.transform(places, each))


def infer(pixels: DataFrame, height: int, width: int, make: Callable, tile: int = 512, stride: int = 256, batch: int = 160, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """r, c, v: predictions for one image (r, c, v; every pixel) of any size, by overlapping windows of tile x tile.

    Each pixel is sent to the windows that show it, mirrored ones included; a window's values are one array, predicted some windows
    at a time and cut off at low and high. Of a window the middle (stride x stride) is written, of several writes
    the one of the last origin by row and column stays. An image must be as large as a tile.
    """
    if height < tile or width < tile:
        raise ValueError(f"an image of {height} x {width} is smaller than a tile of {tile}")
    pad = (tile - stride) // 2
    sent = pixels.select("v", "c", F.explode(_shown(F.col("r"), height, tile, stride)).alias("y")).select("v", "y", F.explode(_shown(F.col("c"), width, tile, stride)).alias("x"))
    cells = F.array_sort(F.collect_list(F.struct((F.col("y.at") * tile + F.col("x.at")).alias("at"), F.col("v").cast("float").alias("v"))))
    windows = sent.groupBy(F.col("y.origin").alias("origin_r"), F.col("x.origin").alias("origin_c")).agg(F.transform(cells, lambda p: p["v"]).alias("values"))
    predict = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[tile * tile]])
    found = windows.select("origin_r", "origin_c", F.posexplode(predict(F.col("values"))).alias("pos", "v"))
    y, x = F.expr(f"cast(pos div {tile} as int)") - pad, (F.col("pos") % tile).cast("int") - pad
    inner = found.where(y.between(0, stride - 1) & x.between(0, stride - 1)).select("origin_r", "origin_c", (F.col("origin_r") + y).alias("r"), (F.col("origin_c") + x).alias("c"), F.greatest(F.lit(low), F.least(F.lit(high), F.col("v").cast("double"))).alias("v"))
    return last_write(inner.where((F.col("r") < height) & (F.col("c") < width)), "r", "c")
