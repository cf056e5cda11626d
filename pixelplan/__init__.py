"""Raster, vector and table operators for aerial object detection, as Spark DataFrame transformations."""
