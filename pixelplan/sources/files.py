"""Files as tables: images by name, delimited tables with a stated schema, and what to look for in which order."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import merged
from ..functions.crowns import site_name

# Stated schemas of the tables that stages hand to one another.
TILE_INDEX = "tile_name string, site string, split string, row_off int, col_off int, crown_frac double, dtm_mean double, dtm_max double, img_path string, dtm_path string"
LOSS_HISTORY = "fold int, epoch int, train_total double, train_mae double, val_mae double"
EVALUATION = "grouping string, label string, precision double, recall double, f1 double, tp long, fp long, fn long"
METRICS = "metric string, value double"
YEARS = "year int, crowns long, canopy_ha double, cover_pct double, infer_time double"


def list_images(spark: SparkSession, path: str, pattern: str = "*_rgb.tif") -> DataFrame:
    """path, bytes and site of the files of that name, without reading them; raises if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = found.select("path", F.col("length").alias("bytes"), site_name(stem).alias("site"))
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {path}")
    return out.orderBy("path")


HEADER = "path string, width int, height int, bands int, dtype string, compression int, left double, top double, pixel_x double, pixel_y double, epsg int, error string"


def read_headers(images: DataFrame) -> DataFrame:
    """Of each file in column path its size, bands, sample type, compression, map position and coordinate system (HEADER).

    Only the first directory and what it points to is read, by seeking, so images may have any size. A file that is
    no plain TIFF has its error and nulls.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADER.split(", ")]
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path) if ":" in path else path)
                    with system.open_input_file(place) as file:
                        rows.append({"path": path} | tiff_header(file))
                except (OSError, ValueError, struct.error) as error:
                    rows.append({"path": path, "error": str(error) or type(error).__name__})
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return images.select("path").mapInArrow(read, HEADER)


# Fixed values of the TIFF and GeoTIFF formats: field types, sample formats and the tags that are looked at.
_TYPES = {1: "B", 3: "H", 4: "I", 12: "d"}
_SAMPLES = {1: "uint", 2: "int", 3: "float"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _BANDS, _FORMAT, _SCALE, _TIE, _KEYS = 256, 257, 258, 259, 277, 339, 33550, 33922, 34735
_CRS_KEYS = (3072, 2048)


def tiff_header(file) -> dict:
    """The fields of HEADER of an open file; map fields are left out where the file has none."""
    head = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    file.seek(struct.unpack(order + "I", head[4:])[0])
    count = struct.unpack(order + "H", file.read(2))[0]
    entries, fields = file.read(12 * count), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * k)
        if tag in (_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _BANDS, _FORMAT, _SCALE, _TIE, _KEYS) and kind in _TYPES:
            size, raw = struct.calcsize(_TYPES[kind]) * n, entries[12 * k + 8 : 12 * k + 12]
            if size > 4:
                file.seek(struct.unpack(order + "I", raw)[0])
                raw = file.read(size)
            fields[tag] = struct.unpack(f"{order}{n}{_TYPES[kind]}", raw[:size])
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    out = {"width": one(_WIDTH), "height": one(_HEIGHT), "bands": one(_BANDS, 1), "dtype": f"{_SAMPLES.get(one(_FORMAT, 1), 'uint')}{one(_BITS, 1)}", "compression": one(_COMPRESSION, 1)}
    if _SCALE in fields and _TIE in fields:
        x, y = fields[_SCALE][:2]
        col, row, _, left, top = fields[_TIE][:5]
        out |= {"pixel_x": x, "pixel_y": y, "left": left - col * x, "top": top + row * y}
    keys = fields.get(_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return out | {"epsg": next((known[k] for k in _CRS_KEYS if k in known), None)}


def read_settings(path: str | None) -> dict:
    """The user's keys of a flat `key: value` file laid over the defaults; a missing file gives the defaults.

    Values are numbers, true, false, null or text, with or without quotes; nested values need a JSON file.
    """
    if path is None or not os.path.exists(path):
        return merged()
    with open(path) as file:
        text = file.read()
    if path.endswith(".json"):
        return merged(json.loads(text))
    user = {}
    for line in text.splitlines():
        if re.match(r"\s+\S|-\s", line) and not line.lstrip().startswith("#"):
            raise ValueError(f"{path}: nested values need a JSON file: {line.strip()}")
        key, colon, value = line.partition(":")
        if colon and not line.lstrip().startswith("#"):
            value = re.sub(r"\s+#.*$", "", value).strip()
            try:
                user[key.strip()] = json.loads(value) if value else None
            except json.JSONDecodeError:
                user[key.strip()] = None if value == "~" else float(value) if re.fullmatch(r"[-+]?[\d.]+(e[-+]?\d+)?", value, re.I) else value.strip("'\"")
    return merged(user)


_POINTS = "array<struct<x: double, y: double>>"


def to_wkb(parts: Column) -> Column:
    """An array of rings as the well-known binary form of a polygon, its first ring the outline; null stays null."""

    @F.pandas_udf("binary")
    def pack(columns: pd.Series) -> pd.Series:
        def one(rings):
            if rings is None:
                return None
            body = [np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2) for ring in rings]
            return struct.pack("<BII", 1, 3, len(body)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in body)

        return columns.map(one)

    return pack(parts)


def from_wkb(value: Column) -> Column:
    """The rings of a polygon in the well-known binary form, of either byte order; null for null and for other shapes."""

    @F.pandas_udf(f"array<{_POINTS}>")
    def unpack(column: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None or len(raw) < 9:
                return None
            order = "<" if raw[0] else ">"
            kind, n = struct.unpack_from(order + "II", raw, 1)
            if kind != 3:
                return None
            out, at = [], 9
            for _ in range(n):
                (many,) = struct.unpack_from(order + "I", raw, at)
                points = np.frombuffer(raw, order + "f8", 2 * many, at + 4).reshape(-1, 2)
                out.append([{"x": float(x), "y": float(y)} for x, y in points])
                at += 4 + 16 * many
            return out

        return column.map(one)

    return unpack(value)


def to_wkb_many(polygons: Column) -> Column:
    """An array of polygons, each an array of rings, as the well-known binary form of a multi-polygon; null stays null."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        def one(parts):
            if parts is None:
                return None
            out = struct.pack("<BII", 1, 6, len(parts))
            for rings in parts:
                out += struct.pack("<BII", 1, 3, len(rings))
                for ring in rings:
                    out += struct.pack("<I", len(ring)) + np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2).tobytes()
            return out

        return pa.array([one(parts) for parts in column.to_pylist()], pa.binary())

    return pack(polygons)


def from_wkb_many(value: Column) -> Column:
    """The polygons of a polygon or multi-polygon in the well-known binary form; null for null and for other shapes."""

    @F.pandas_udf(f"array<array<{_POINTS}>>")
    def unpack(column: pd.Series) -> pd.Series:
        def polygon(raw, at):
            order = "<" if raw[at] else ">"
            (n,), at, out = struct.unpack_from(order + "I", raw, at + 5), at + 9, []
            for _ in range(n):
                (many,) = struct.unpack_from(order + "I", raw, at)
                out.append([{"x": float(x), "y": float(y)} for x, y in np.frombuffer(raw, order + "f8", 2 * many, at + 4).reshape(-1, 2)])
                at += 4 + 16 * many
            return out, at

        def one(raw):
            if raw is None or len(raw) < 9:
                return None
            kind, n = struct.unpack_from(("<" if raw[0] else ">") + "II", raw, 1)
            if kind == 3:
                return [polygon(raw, 0)[0]]
            if kind != 6:
                return None
            out, at = [], 9
            for _ in range(n):
                part, at = polygon(raw, at)
                out.append(part)
            return out

        return column.map(one)

    return unpack(value)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited file with a header, as the stated schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def renamed(table: DataFrame, wanted: str, *older: str) -> DataFrame:
    """The table with a column called `wanted`, taken from the first older name that it has, or null."""
    if wanted in table.columns:
        return table
    for name in older:
        if name in table.columns:
            return table.withColumnRenamed(name, wanted)
    return table.withColumn(wanted, F.lit(None).cast("double"))
