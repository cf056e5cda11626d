import hashlib
import random
import zlib

import numpy as np
import pytest

from pixelplan.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(compression, predictor, tile):
    r = np.random.default_rng(compression)
    images = [r.integers(0, 256, (37, 21, 3)).astype(np.uint8), np.repeat(r.integers(0, 3, (50, 5)), 20, axis=1).astype(np.uint8), np.zeros((90, 100), np.uint8)]
    raw = tiff.write(images, compression, predictor, tile, 0 if tile else 8)
    got = [tiff.samples(raw, fields) for fields in tiff.pages(raw)]
    assert all((g == i.reshape(g.shape)).all() for g, i in zip(got, images, strict=True))


def test_packers_on_any_bytes():
    r = random.Random(2)
    for n in (0, 1, 2, 127, 128, 129, 300, 5000, 40000):
        for alphabet in (1, 2, 256):
            raw = bytes(r.randrange(alphabet) for _ in range(n))
            assert tiff.unpack_bits(tiff.pack_bits(raw)) == raw
            assert tiff.unpack_lzw(tiff.pack_lzw(raw)) == raw


def test_known_streams():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the format's own example
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_lzw(tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_big_endian_16_bit():
    import struct

    data = struct.pack(">6H", 1, 2, 3, 500, 501, 502)
    fields = [(256, 4, 3), (257, 4, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (279, 4, 12)]
    raw = b"MM" + struct.pack(">HI", 42, 20) + data + struct.pack(">H", len(fields))
    for tag, kind, value in fields:
        raw += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    raw += struct.pack(">I", 0)
    (fields,) = tiff.pages(raw)
    assert tiff.samples(raw, fields)[:, :, 0].tolist() == [[1, 2, 3], [500, 501, 502]]


def test_pages_as_rows(spark):
    raw = tiff.write([np.full((4, 5), 9, np.uint8), np.zeros((2, 3, 3), np.uint8)])
    images = spark.createDataFrame([(1, raw, "x"), (2, None, "x"), (3, b"II*\0", "x"), (4, b"", "x"), (1, raw, "x")], "k long, content binary, page string")
    assert {(r.kept, r.media_bytes) for r in tiff.read_pages(images.withColumnRenamed("page", "kept"), "k", carry=("kept",)).where("k = 1").collect()} == {("x", len(raw))}
    got = sorted((r.k, r.page, r.pages, r.width, r.height, r.bands, r.mean, r.error is not None) for r in tiff.read_pages(images, "k").collect() if r.page is not None)
    assert got == [(1, 0, 2, 5, 4, 1, 9.0, False)] * 2 + [(1, 1, 2, 3, 2, 3, 0.0, False)] * 2
    assert sorted(r.k for r in tiff.read_pages(images, "k").where("error is not null").collect()) == [2, 3, 4]


def plain_feature(payload, pages, compression):
    n = len(payload)
    mean = sum(payload) / n
    spread = (sum(b * b for b in payload) / n - mean * mean) ** 0.5
    shares = ",".join(f"{sum(b // 32 == k for b in payload) / n:.4f}" for k in range(8))
    return f"pages={pages};compression={compression};mean={mean:.4f};spread={spread:.4f};shares={shares}"


def test_features_and_forms(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("abc ü\n", k=r.choice([1, 500, 3000, 50000]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files = {x.doc_id: x.content for x in tiff.texts_as_tiff(docs).collect()}
    forms = set()
    for x in tiff.stored_texts(tiff.texts_as_tiff(docs)).collect():
        raw = texts[x.doc_id].encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        n = -(-len(full) // (24 * 1536))
        form = (tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE)[zlib.crc32(full) % 4]
        assert x.feature == plain_feature(full, n, form)
        assert (x.media_bytes, x.media_sha256) == (len(files[x.doc_id]), hashlib.sha256(files[x.doc_id]).hexdigest())
        forms.add((form, len(raw) > 10000))
    assert len(forms) == 6


def test_files_that_cannot_be_read(spark):
    files = spark.createDataFrame([(1, 3, None), (2, 3, b"no"), (3, 3, tiff.layout(b"abc"))], "doc_id long, n_bytes long, content binary")
    got = {x.doc_id: x for x in tiff.stored_texts(files).collect()}
    assert got[1].payload_bytes is None and got[1].media_bytes is None and got[2].media_bytes == 2 and got[3].payload_bytes == 576


def test_texts(spark):
    r = random.Random(1)
    texts = [None, "", "é" * 10, "x" * 575, "x" * 576, "x" * 577, "".join(r.choices("abc ü", k=1100)), "".join(r.choices("abc ü", k=90000))]
    docs = spark.createDataFrame([(i, t, b"c") for i, t in enumerate([*texts, texts[-1]])], "doc_id long, text string, content binary")
    got = {x.doc_id: x for x in tiff.stored_texts(tiff.texts_as_tiff(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert x.media_bytes == len(tiff.layout(raw)) and x.media_sha256 == hashlib.sha256(tiff.layout(raw)).hexdigest()
    assert got[len(texts)][1:] == got[len(texts) - 1][1:]
    assert tiff.stored_texts(tiff.texts_as_tiff(docs.limit(0))).count() == 0


def with_tag(raw, tag, value):
    """The same one-page file whose predictor entry is another tag of one short."""
    import struct

    at = struct.unpack_from("<I", raw, 4)[0]
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        if struct.unpack_from("<H", raw, at + 2 + 12 * k)[0] == tiff.PREDICTOR:
            return raw[: at + 2 + 12 * k] + struct.pack("<HHIHH", tag, 3, 1, value, 0) + raw[at + 14 + 12 * k :]
    raise AssertionError


def test_fill_order_is_undone_and_other_predictors_are_refused():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    raw = tiff.write([image], tiff.NONE, 1)
    (page,) = tiff.pages(with_tag(raw, tiff.FILL_ORDER, 2))
    assert tiff.samples(raw, page).ravel().tolist() == [int(f"{x:08b}"[::-1], 2) for x in range(48)]
    for tag, value in ((tiff.PREDICTOR, 3), (tiff.FORMAT, 3), (tiff.FILL_ORDER, 7)):
        (page,) = tiff.pages(with_tag(raw, tag, value))
        with pytest.raises(ValueError, match="not handled"):
            tiff.samples(raw, page)
