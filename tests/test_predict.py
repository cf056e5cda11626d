"""Windowed inference against a plain version."""

import numpy as np
import pytest

from pixelplan.operators.predict import box_sum, infer


@pytest.mark.parametrize(("height", "width"), [(21, 19), (8, 8), (16, 9)])
def test_windows_of_an_image_give_what_the_whole_image_gives(spark, height, width):
    image = np.random.default_rng(height).integers(0, 255, (height, width))
    rows = spark.createDataFrame([(y, x, int(image[y, x])) for y in range(height) for x in range(width)], "r int, c int, v int")
    wide = np.pad(image, 1, mode="reflect")
    want = np.lib.stride_tricks.sliding_window_view(wide, (3, 3)).sum(axis=(2, 3)).clip(300, 1500)
    got = {(x.r, x.c): x.v for x in infer(rows, height, width, box_sum(8), tile=8, stride=4, batch=5, low=300.0, high=1500.0).collect()}
    assert got == {(y, x): float(want[y, x]) for y in range(height) for x in range(width)}


def test_images_smaller_than_a_tile_are_refused(spark):
    with pytest.raises(ValueError, match="smaller than a tile"):
        infer(spark.createDataFrame([], "r int, c int, v int"), 7, 8, box_sum(8), tile=8, stride=4)
