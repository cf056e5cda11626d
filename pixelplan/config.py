"""Parameters of the pipeline and how user settings are laid over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default parameters.
DEFAULTS = {
    "target_crs": "EPSG:3857",
    "expected_res_cm": 7.5,
    "small_area_threshold_m2": 0.5,
    "tile_size": 512,
    "stride": 512,
    "min_crown_frac": 0.00,
    "negative_sample_rate": 0.15,
    "test_frac": 0.20,
    "random_seed": 42,
    "k_folds": 5,
    "epochs": 100,
    "batch_size": 30,
    "lr": 1e-4,
    "lr_patience": 8,
    "lr_factor": 0.5,
    "early_stop_patience": 25,
    "l1_lambda": 1e-6,
    "warmup_epochs": 5,
    "min_distance": 30,
    "dtm_threshold": 10.0,
    "min_crown_area_m2": 2.0,
    "iou_threshold": 0.5,
    "size_small_max_m2": 4.9,
    "size_medium_max_m2": 15.9,
    "infer_stride": 256,
    "infer_batch_size": 160,
    "chunk_size": 2048,
    "chunk_border": 300,
}


# Names and years that a user sets for their own images.
DEFAULTS |= {"crown_id_format": "CROWN_%07d", "year_file_format": "city_%d_image.tif", "fine_since": 2013}


def merged(user: dict | None = None) -> dict:
    """The defaults with the user's keys over them: whole values are replaced, null overrides, unknown keys pass through."""
    return {**DEFAULTS, **(user or {})}


def overlay(base: Column, user: Column) -> Column:
    """The same for two map columns."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(user, k), F.lit(False)))
    return F.when(user.isNull(), base).otherwise(F.map_concat(kept, user))
