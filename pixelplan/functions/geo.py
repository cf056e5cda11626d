"""Places on a map and in an image whose upper left corner and pixel size are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pixel(x: Column, y: Column, left: Column, top: Column, pixel: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Row and column of a point on the map, rounded half to even and kept inside the image."""
    inside = lambda at, n: F.greatest(F.lit(0), F.least(n - 1, F.rint(at).cast("int")))
    return inside((top - y) / pixel, height), inside((x - left) / pixel, width)


def to_bounds(min_r: Column, max_r: Column, min_c: Column, max_c: Column, left: Column, top: Column, pixel: Column) -> tuple[Column, Column, Column, Column]:
    """Left, bottom, right and top on the map of a box of pixels, its last row and column included."""
    return left + min_c * pixel, top - (max_r + 1) * pixel, left + (max_c + 1) * pixel, top - min_r * pixel
