import struct

import pytest

from pixelplan.sources import files, sinks


def test_images_by_name(spark, tmp_path):
    for name in ("Park_rgb.tif", "b_rgb_rgb.tif", "x_dtm.tif"):
        (tmp_path / name).write_bytes(b"123")
    got = sorted((r.site, r.bytes) for r in files.list_images(spark, str(tmp_path)).collect())
    assert got == [("Park", 3), ("b", 3)]
    with pytest.raises(FileNotFoundError):
        files.list_images(spark, str(tmp_path), "*.png")


def test_tables_keep_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([("overall", "all", 0.5, None, 0.25, 1, 2, 3)], files.EVALUATION)
    sinks.write_table(rows, str(tmp_path / "t"))
    back = files.read_table(spark, str(tmp_path / "t"), files.EVALUATION)
    assert back.dtypes == rows.dtypes and back.collect() == rows.collect()


def test_older_column_names(spark):
    rows = spark.createDataFrame([(1, 2.0)], "epoch int, val_loss double")
    assert files.renamed(rows, "val_mae", "val_loss").columns == ["epoch", "val_mae"]
    assert files.renamed(rows, "train_mae", "t").first()["train_mae"] is None


def test_chips_give_windows_back(spark, tmp_path):
    pixels = spark.createDataFrame([(1, r, c, r * 100 + c) for r in range(0, 40, 3) for c in range(0, 40, 4)], "raster_id int, r int, c int, v int")
    sinks.write_chips(pixels, str(tmp_path / "chips"), 16)
    got = sinks.read_chips(spark.read.parquet(str(tmp_path / "chips")), 10, 5, 15, 20, 16)
    want = pixels.where("r between 10 and 24 and c between 5 and 24")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tiles_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a.tif", "S", "train", 1), ("b.tif", "S", "test", 2)], "tile_name string, site string, split string, v int")
    sinks.write_tiles(rows, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).where("split = 'test'").first()["v"] == 2
    done = rows.where("v = 1").select("tile_name")
    sinks.write_pending(rows, done, "tile_name", str(tmp_path / "out"))
    assert [r.tile_name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b.tif"]


def geo_tiff(order, width, height):
    """A file with a directory and no pixels."""
    far = 8 + 2 + 12 * 9 + 4
    keys = struct.pack(order + "8H", 1, 1, 0, 1, 3072, 0, 1, 3857)
    scale, tie = struct.pack(order + "3d", 0.075, 0.075, 0), struct.pack(order + "6d", 2, 1, 0, 1000.0, 5000.0, 0)
    places = {"bits": far, "keys": far + 6, "scale": far + 22, "tie": far + 46}
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, places["bits"]), (259, 3, 1, 5), (277, 3, 1, 3), (339, 3, 1, 1), (33550, 12, 3, places["scale"]), (33922, 12, 6, places["tie"]), (34735, 3, 8, places["keys"])]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 9)
    for tag, kind, n, value in entries:
        short = kind == 3 and n == 1
        out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if short else struct.pack(order + "I", value))
    return out + struct.pack(order + "I3H", 0, 8, 8, 8) + keys + scale + tie


def test_headers_of_images(spark, tmp_path):
    (tmp_path / "a_rgb.tif").write_bytes(geo_tiff("<", 26000, 35000))
    (tmp_path / "b_rgb.tif").write_bytes(geo_tiff(">", 300, 200))
    (tmp_path / "c_rgb.tif").write_bytes(b"no image")
    got = {r.path[-9]: r for r in files.read_headers(files.list_images(spark, str(tmp_path))).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.width, a.height, a.bands, a.dtype, a.compression, a.pixel_x, a.epsg, a.error) == (26000, 35000, 3, "uint8", 5, 0.075, 3857, None)
    assert (b.width, b.height, round(b.left, 6), round(b.top, 6)) == (300, 200, 999.85, 5000.075) and c.error == "not a TIFF file" and c.width is None


def test_settings(tmp_path):
    assert files.read_settings(str(tmp_path / "none.yaml"))["k_folds"] == 5
    (tmp_path / "c.yaml").write_text("# mine\nk_folds: 7  # more\nlr: 3e-4\nname: 'x: y'\nstride:\nextra: true\n")
    got = files.read_settings(str(tmp_path / "c.yaml"))
    assert (got["k_folds"], got["lr"], got["name"], got["stride"], got["extra"], got["epochs"]) == (7, 3e-4, "x: y", None, True, 100)


def test_binary_polygons(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 0.0)]
    point = lambda p: {"x": p[0], "y": p[1]}
    rows = spark.createDataFrame([(1, [[point(p) for p in ring]] * 2), (2, None)], "k int, parts array<array<struct<x: double, y: double>>>")
    raw = rows.select("k", "parts", files.to_wkb(rows.parts).alias("raw"))
    got = raw.select("k", "parts", "raw", files.from_wkb(raw.raw).alias("back")).orderBy("k").collect()
    assert got[0].back == got[0].parts and got[1].raw is None and got[1].back is None
    assert bytes(got[0].raw[:9]) == struct.pack("<BII", 1, 3, 2) and len(got[0].raw) == 9 + 2 * (4 + 4 * 16)
