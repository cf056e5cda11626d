"""Data sources on files written here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelplan.functions import rings
from pixelplan.sources import files, formats


def tiff(image, compression=1, predictor=1, tile=0, strip_rows=4, order="<", planar=1):
    """A file with the blocks, compression and predictor asked for."""
    height, width, bands = image.shape
    kind = image.dtype.newbyteorder(order)
    pack = {1: bytes, 8: zlib.compress, 5: lzw, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))}[compression]
    h, w = (tile, tile) if tile else (strip_rows, width)
    blocks = []
    for layer in [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(bands)]:
        for y in range(0, height, h):
            for x in range(0, width, w):
                b = layer[y : y + h, x : x + w]
                if tile:
                    b = np.pad(b, ((0, h - b.shape[0]), (0, w - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
                raw = np.ascontiguousarray(b.astype(kind)).tobytes()
                if predictor == 3:
                    rows = np.frombuffer(np.ascontiguousarray(b.astype(b.dtype.newbyteorder(">"))).tobytes(), np.uint8).reshape(b.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    raw = np.diff(rows, axis=1, prepend=np.zeros_like(rows[:, :1])).astype(np.uint8).tobytes()
                blocks.append(pack(raw))
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    values = {256: (4, [width]), 257: (4, [height]), 258: (3, [8 * kind.itemsize] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [form] * bands)}
    at, places = 8, []
    for b in blocks:
        places.append(at)
        at += len(b)
    values |= {322: (3, [tile]), 323: (3, [tile]), 324: (4, places), 325: (4, [*map(len, blocks)])} if tile else {273: (4, places), 278: (4, [strip_rows]), 279: (4, [*map(len, blocks)])}
    entries, far, extra = b"", at + 2 + 12 * len(values) + 4, b""
    for tag in sorted(values):
        k, v = values[tag]
        raw = struct.pack(f"{order}{len(v)}{'H' if k == 3 else 'I'}", *v)
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", tag, k, len(v), far + len(extra))
            extra += raw
        else:
            entries += struct.pack(order + "HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(values)) + entries + b"\0" * 4 + extra


def lzw(raw):
    table, out, bits, word, width = {bytes([k]): k for k in range(256)}, 0, 0, b"", 9
    codes = [(256, 9)]
    size = 258
    for byte in raw:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = size
        size += 1
        width = max(9, min(12, size.bit_length()))
        if size == 4094:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        codes.append((table[word], width))
        size += 1
        width = max(9, min(12, size.bit_length()))
    codes.append((257, width))
    for code, n in codes:
        out, bits = out << n | code, bits + n
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


@pytest.mark.parametrize("settings", [{}, {"compression": 8, "predictor": 2, "tile": 16}, {"compression": 5}, {"compression": 5, "predictor": 2, "planar": 2}, {"compression": 32773, "order": ">"}])
def test_pixels_of_files(spark, tmp_path, settings):
    formats.register(spark)
    image = np.random.default_rng(1).integers(0, 250, (23, 37, 3)).astype(np.uint8)
    image[5:15] = image[5]
    (tmp_path / "a_rgb.tif").write_bytes(tiff(image, **settings))
    found = spark.read.format("pixels").option("rows", 7).load(str(tmp_path))
    got = {(x.band, x.r, x.c): x.v for x in found.collect()}
    assert got == {(b, y, x): float(image[y, x, b]) for y in range(23) for x in range(37) for b in range(3)}
    part = found.where("r between 6 and 9 and c >= 30 and c < 33 and band = 1")
    assert {(x.r, x.c): x.v for x in part.collect()} == {(y, x): float(image[y, x, 1]) for y in range(6, 10) for x in range(30, 33)}


def test_float_samples_and_predictors(spark, tmp_path):
    formats.register(spark)
    dtm = np.random.default_rng(2).random((9, 11, 1)).astype(np.float32) * 100
    for k, settings in enumerate(({"compression": 5}, {"compression": 8, "predictor": 3}, {"order": ">"})):
        (tmp_path / f"{k}.tif").write_bytes(tiff(dtm, **settings))
    for k in range(3):
        got = {(x.r, x.c): x.v for x in spark.read.format("pixels").load(str(tmp_path / f"{k}.tif")).collect()}
        assert got == {(y, x): float(dtm[y, x, 0]) for y in range(9) for x in range(11)}
    (tmp_path / "bad.tif").write_bytes(tiff(dtm, 8, 2).replace(struct.pack("<HHIHH", 339, 3, 1, 3, 0), struct.pack("<HHIHH", 339, 3, 1, 6, 0)))
    with pytest.raises(Exception, match="not read together"):
        spark.read.format("pixels").load(str(tmp_path / "bad.tif")).collect()


def test_files_beyond_the_filters_are_not_opened(spark, tmp_path):
    reader = formats.PixelReader({"path": str(tmp_path), "rows": "8"})
    (tmp_path / "a.tif").write_bytes(tiff(np.zeros((40, 4, 1), np.uint8)))
    (tmp_path / "b.tif").write_bytes(tiff(np.zeros((40, 4, 1), np.uint8)))
    left = list(reader.pushFilters([formats.GreaterThan(("r",), 20), formats.LessThanOrEqual(("r",), 30), formats.EqualTo(("path",), str(tmp_path / "b.tif")), formats.EqualTo(("v",), 1.0)]))
    assert [f.attribute for f in left] == [("v",)]
    assert [(p.path[-5:], p.first, p.end) for p in reader.partitions()] == [("b.tif", 21, 29), ("b.tif", 29, 31)]
    with pytest.raises(FileNotFoundError):
        formats.PixelReader({"path": str(tmp_path / "none")}).partitions()


def test_many_small_files_share_partitions(spark, tmp_path, monkeypatch):
    formats.register(spark)
    image = np.random.default_rng(4).integers(0, 255, (600, 7, 1)).astype(np.uint8)
    spark.createDataFrame([("city", y, 7, 1, "u1", bytearray(image[y : y + 4].tobytes())) for y in range(0, 600, 4)], formats.STRIPS).write.format("pixels").mode("append").save(str(tmp_path))
    whole = spark.read.format("pixels").option("placed", True).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() == 1
    assert sorted((x.r, x.c, x.v) for x in whole.collect()) == [(y, x, float(image[y, x, 0])) for y in range(600) for x in range(7)]
    window = whole.where("r between 30 and 441 and c >= 5")
    assert sorted((x.r, x.c, x.v) for x in window.collect()) == [(y, x, float(image[y, x, 0])) for y in range(30, 442) for x in (5, 6)]
    assert whole.where("r > 600").count() == 0
    # Large ones among them are still cut by rows, and no others are opened to plan.
    big = tmp_path / "big.tif"
    big.write_bytes(tiff(np.random.default_rng(5).integers(0, 255, (100, 90, 1)).astype(np.uint8), strip_rows=10))
    monkeypatch.setattr(formats, "PACK_BYTES", 5000)
    seen = []
    monkeypatch.setattr(formats, "opened", lambda path, real=formats.opened: (seen.append(path), real(path))[1])
    parts = formats.PixelReader({"path": str(tmp_path), "rows": "60"}).partitions()
    assert [(p.first, p.end) for p in parts if isinstance(p, formats.Rows)] == [(0, 60), (60, 100)]
    packs = [p.paths for p in parts if isinstance(p, formats.Files)]
    assert sum(map(len, packs)) == 150 and max(map(len, packs)) < 30 and seen == [str(tmp_path), str(big)]


def test_strips_of_a_mosaic_need_no_places_without_a_tile(spark):
    from pixelplan.operators import vector
    from pixelplan.sources import sinks

    r = np.random.default_rng(6)
    rows = [(strip, slot, y, x, int(r.integers(1, 255)) if (y, x) != (1, 1) else None) for strip in range(3) for slot in range(-1, 4) for y in range(4) for x in range(4) if r.random() < 0.7]
    rows += [(7, 0, 3, 3, 9), (7, 1, 3, 0, 9)]  # all beyond the edge: the strip is there, and black
    tiles = spark.createDataFrame(rows, "strip int, slot int, r int, c int, v int")
    strips = lambda placed: {x.first_row: bytes(x.data) for x in sinks.as_strips(placed.select(F.lit("city").alias("name"), (F.col("strip") * 3 + F.col("y")).alias("r"), F.col("x").alias("c"), "v"), "name", 9, 3).collect()}
    want, cells = strips(vector.mosaic(tiles, 3, 3)), vector.mosaic_cells(tiles, 3, 3)
    assert strips(cells) == want and set(want) == {0, 3, 6, 21} and want[21] == bytes(27)
    assert "Join" not in cells._jdf.queryExecution().toString()


def test_strips_are_in_place_after_the_commit_only(spark, tmp_path):
    formats.register(spark)
    image = np.random.default_rng(3).integers(0, 255, (50, 12, 3)).astype(np.uint8)
    strips = [("city", y, 12, 3, "u1", bytearray(image[y : y + 8].tobytes())) for y in range(0, 50, 8)]
    rows = spark.createDataFrame(strips, formats.STRIPS).repartition(3)
    out = str(tmp_path / "mosaic")
    broken = rows.withColumn("data", F.when(F.col("first_row") == 24, F.raise_error(F.lit("no strip"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no strip"):
        broken.write.format("pixels").mode("append").save(out)
    assert not [p for p in (tmp_path / "mosaic").glob("**/*")] if (tmp_path / "mosaic").exists() else True
    rows.write.format("pixels").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "mosaic").iterdir()) == [f"city-{y:09d}.tif" for y in range(0, 50, 8)]
    found = spark.read.format("pixels").option("placed", True).load(out)
    assert {(x.band, x.r, x.c): x.v for x in found.collect()} == {(b, y, x): float(image[y, x, b]) for y in range(50) for x in range(12) for b in range(3)}
    assert found.where("r >= 20 and r < 30").count() == 360
    heads = files.read_headers(files.list_images(spark, out, "*.tif")).collect()
    assert {(h.width, h.bands, h.dtype, h.error) for h in heads} == {(12, 3, "uint8", None)} and sum(h.height for h in heads) == 50


def test_shapes(spark, tmp_path):
    formats.register(spark)
    square = lambda x, n: [{"x": x, "y": 0.0}, {"x": x, "y": n}, {"x": x + n, "y": n}, {"x": x + n, "y": 0.0}, {"x": x, "y": 0.0}]
    for ending, raw in formats.shape_files([7, 8, 9], [[square(0.0, 2.0)], [square(5.0, 1.0), square(9.0, 3.0)], []]).items():
        (tmp_path / f"Park{ending}").write_bytes(raw)
    found = spark.read.format("shapes").option("records", 2).load(str(tmp_path))
    got = found.select("record", F.col("attributes")["KEY"].alias("key"), F.transform("rings", rings.area).alias("areas")).orderBy("record").collect()
    assert [tuple(x) for x in got] == [(0, "7", [4.0]), (1, "8", [1.0, 9.0]), (2, "9", [])]
    assert [x.record for x in found.where("record >= 1 and record < 2").collect()] == [1]


def test_crown_packages(spark, tmp_path):
    import sqlite3

    formats.register(spark)
    ring = [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 2.0}, {"x": 3.0, "y": 5.0}, {"x": 1.0, "y": 2.0}]
    rows = [("A_0", 3.0, 1.95, "small", [ring, ring]), ("A_1", None, None, None, None)]
    out = str(tmp_path / "crowns")
    for k in range(2):
        spark.createDataFrame(rows[k : k + 1], formats.CROWNS).write.format("crown_packages").mode("append").save(out)
    got = {x.crown_id: x for x in spark.read.format("crown_packages").load(out).collect()}
    assert got["A_0"].rings == [[tuple(p.values()) for p in ring]] * 2 and got["A_0"].area_m2 == 3.0 and got["A_1"].rings is None
    names = sorted(p for p in (tmp_path / "crowns").iterdir())
    assert len(names) == 2 and all(p.suffix == ".gpkg" for p in names)
    found = set()
    for p in names:
        con = sqlite3.connect(p)
        assert con.execute("pragma application_id").fetchone()[0] == 0x47504B47
        found |= {*con.execute("select min_x, max_y, srs_id from gpkg_contents").fetchall()}
    assert found == {(1.0, 5.0, 3857), (None, None, 3857)}
    bad = spark.createDataFrame(rows, formats.CROWNS).withColumn("crown_id", F.raise_error(F.lit("no crown")))
    with pytest.raises(Exception, match="no crown"):
        bad.write.format("crown_packages").mode("append").save(out)
    assert sorted(p for p in (tmp_path / "crowns").iterdir()) == names
