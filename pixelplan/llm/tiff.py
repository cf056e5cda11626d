"""TIFF columns: images as binary values, written as pages of strips or tiles and read back page by page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

# Fixed values of the TIFF 6.0 format: tags, field types with their sizes, and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
FILL_ORDER, FORMAT = 266, 339
#: Bytes with their bits the other way round, as fill order 2 stores them.
_MIRRORED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Samples of an image row, and rows of a page at most, as documents are laid out.
ROW = 24
UNIT = 576
PAGE_ROWS = 24 * 64


def unpack_bits(raw: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += 2 + n
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
                k += 1
            k += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three equal bytes or more as such, all else as it is."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(data)) + 1, [len(data)]]) if len(data) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edges) >= 3)
    out, plain = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            out.append(min(128, b - k) - 1)
            out.extend(raw[k : min(b, k + 128)])

    for a, b in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
        literal(plain, a)
        for k in range(a, b, 128):
            n = min(128, b - k)
            out.extend((257 - n if n > 1 else 0, raw[k]))
        plain = b
    literal(plain, len(raw))
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """Codes from 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                if code > len(table) or len(table) > 4096:
                    raise ValueError("no such LZW code")
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(raw: bytes) -> bytes:
    start = {bytes([k]): k for k in range(256)}
    table, code, held, bits, width, out = dict(start), 258, 256, 9, 9, bytearray()

    def put(value: int) -> None:
        nonlocal held, bits
        held, bits = held << width | value, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    word = b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], code, word = code, code + 1, raw[k : k + 1]
        width = min(12, max(9, code.bit_length()))
        if code == 4094:
            put(256)
            table, code, width = dict(start), 258, 9
    if word:
        put(table[word])
        code += 1
        width = min(12, max(9, code.bit_length()))
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def unpack(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == LZW:
        return unpack_lzw(raw)
    if compression == PACKBITS:
        return unpack_bits(raw)
    raise ValueError(f"compression {compression} is not known")


def pack(raw: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}[compression](raw)


def pages(raw: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            letter = TYPES.get(kind)
            if letter:
                size = struct.calcsize(letter) * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{letter}", raw, place)
        yield fields | {0: (order,)}
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def samples(raw: bytes, fields: dict[int, tuple]) -> np.ndarray:
    """A page's samples, as rows x columns x samples of a pixel."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, many = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    depth = one(BITS, 1)
    if depth not in (8, 16):
        raise ValueError(f"{depth} bits a sample are not handled")
    kind = np.dtype(np.uint8 if depth == 8 else one(0, "<") + "u2")
    predictor, fill = one(PREDICTOR, 1), one(FILL_ORDER, 1)
    if predictor not in (1, 2) or fill not in (1, 2) or one(FORMAT, 1) == 3:
        raise ValueError(f"predictor {predictor}, fill order {fill} and sample format {one(FORMAT, 1)} are not handled together")
    planes = many if one(PLANAR, 1) == 2 else 1
    inner = many // planes
    out = np.zeros((planes, height, width, inner), kind)
    tiled = TILE_OFFSETS in fields
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    across, down = -(-width // w), -(-height // h)
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - y)
        stored = raw[at : at + size] if fill == 1 else bytes(raw[at : at + size]).translate(_MIRRORED)
        stored = unpack(stored, one(COMPRESSION, NONE))
        block = np.frombuffer(stored, kind, rows * w * inner).reshape(rows, w, inner)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        out[plane, y : y + rows, x : x + w] = block[: height - y, : width - x]
    return np.concatenate(list(out), axis=-1) if planes > 1 else out[0]


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, strip_rows: int = 0) -> bytes:
    """A file of grey or multi-sample 8-bit pages; tile: edge of square tiles, 0 for strips of so many rows (0: one)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, many = image.shape
        h, w = (tile, tile) if tile else (strip_rows or height, width)
        places, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, many), np.uint8))
                packed = pack(np.ascontiguousarray(block).tobytes(), compression)
                places.append(len(out))
                sizes.append(len(packed))
                out += packed
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * many), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [many]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (3, [tile]), TILE_HEIGHT: (3, [tile]), TILE_OFFSETS: (4, places), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, places), STRIP_ROWS: (4, [h]), STRIP_BYTES: (4, sizes)}
        entries = bytearray()
        for tag in sorted(fields):
            kind, values = fields[tag]
            packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                entries += struct.pack("<HHII", tag, kind, len(values), len(out))
                out += packed
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def read_pages(images: DataFrame, id_col: str, content: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page, those of a file one after another: id, page (from 0), pages, width, height, bands, compression,
    mean, data (binary), error, media_bytes, media_sha256, and the columns in carry.

    data holds the samples, row by row, pixel by pixel; samples of 16 bits keep the file's byte order undone
    to little-endian. A value that can't be read gives one row with its error and nulls; so does null, with
    the error "null". media_* are those of the file. Repeated rows give their pages each; other columns are not read.
    """
    rows = images.select(F.col(id_col).alias("id"), F.col(content).alias("content"), F.struct(F.lit(True).alias("on"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry))).alias("rest"))
    kind, rest = (rows.schema[c].dataType.simpleString() for c in ("id", "rest"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            rows = []
            for k, raw in enumerate(batch["content"].to_pylist()):
                own, file = [], (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
                try:
                    if raw is None:
                        raise ValueError("null")
                    for page, fields in enumerate(pages(raw)):
                        grid = samples(raw, fields)
                        own.append((k, page, grid.shape[1], grid.shape[0], grid.shape[2], fields.get(COMPRESSION, (NONE,))[0], float(grid.mean()) if grid.size else None, grid.astype(grid.dtype.newbyteorder("<")).tobytes(), None))
                except (ValueError, struct.error, zlib.error, KeyError, IndexError) as error:
                    own = [(k, None, None, None, None, None, None, None, str(error) or type(error).__name__)]
                rows += [(*r, len(own), *file) for r in own]
            which, page, width, height, band, compression, mean, data, error, n, size, digest = zip(*rows, strict=True) if rows else [()] * 12
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(take), pa.array(page, pa.int32()), pa.array(n, pa.int32()), *(pa.array(x, pa.int32()) for x in (width, height, band, compression)), pa.array(mean, pa.float64()), pa.array(data, pa.binary()), pa.array(error, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), batch["rest"].take(take)],
                ["id", "page", "pages", "width", "height", "bands", "compression", "mean", "data", "error", "media_bytes", "media_sha256", "rest"],
            )

    shape = f"id {kind}, page int, pages int, width int, height int, bands int, compression int, mean double, data binary, error string, media_bytes long, media_sha256 string, rest {rest}"
    out = rows.mapInArrow(decode, shape).withColumns({c: F.col(f"rest.c{k}") for k, c in enumerate(carry)}).drop("rest")
    return out.withColumnRenamed("id", id_col)


def layout(raw: bytes) -> bytes:
    """A text's bytes as a file: filled up with 255 to a multiple of 576, rows of 24 samples, pages of up to 1536 rows.

    The content's checksum chooses how all pages are stored, whatever their size, so that each way of the format
    is used alike: PackBits in strips of 64 rows, LZW or deflate with the predictor in strips of 256, or deflate
    in tiles.
    """
    payload = raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    images = [grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)]
    form = zlib.crc32(payload) % 4
    if form == 0:
        return write(images, PACKBITS, 1, strip_rows=64)
    if form == 1:
        return write(images, LZW, 2, strip_rows=256)
    if form == 2:
        return write(images, DEFLATE, 2, strip_rows=256)
    return write(images, DEFLATE, 2, tile=32)


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_bytes (of the text), content (the file).

    Null counts as empty. Repeated rows get equal files; ids may be null or repeat. Only the two columns are read, so others may
    have any names; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raws = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) for x in raws], pa.int64()), pa.array([layout(x) for x in raws], pa.binary())], ["id", "n_bytes", "content"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(encode, f"id {kind}, n_bytes long, content binary").withColumnRenamed("id", id_col)


def stored_texts(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Puts the pages of read_pages for the files of texts_as_tiff together again: the payload's and the file's digests, and a feature of the samples.

    The pages of a file come one after another in one partition, so nothing is shuffled, and digests are taken
    page by page. feature: pages, compression, mean and spread of the samples, and the share of the eight ranges
    of 32 values. A file that is null or can't be read has nulls.
    """
    read = read_pages(files, id_col, carry=("n_bytes",)).select(F.col(id_col).alias("id"), "n_bytes", "page", "pages", "compression", "data", "media_bytes", "media_sha256")
    kind = read.schema["id"].dataType.simpleString()
    values = np.arange(256)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, tail, counts = hashlib.sha256(), b"", np.zeros(256, np.int64)
        for batch in slices(batches, "data"):
            last, rows = [], []
            for k, (page, n_pages, compression, data) in enumerate(zip(*(batch[c].to_pylist() for c in ("page", "pages", "compression", "data")), strict=True)):
                if data is None:
                    last.append(k)
                    rows.append((None, None, None, None))
                    continue
                if page == 0:
                    digest, tail, counts = hashlib.sha256(), b"", np.zeros(256, np.int64)
                digest.update(data)
                tail = (tail + data)[-32:]
                counts += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                if page == n_pages - 1:
                    n = int(counts.sum())
                    mean = float(counts @ values) / n
                    spread = max(0.0, float(counts @ values**2) / n - mean**2) ** 0.5
                    shares = ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(axis=1).tolist())
                    last.append(k)
                    rows.append((n, digest.hexdigest(), zlib.crc32(tail), f"pages={n_pages};compression={compression};mean={mean:.4f};spread={spread:.4f};shares={shares}"))
            size, sha, crc, feature = zip(*rows, strict=True) if rows else [()] * 4
            take = pa.array(last, pa.int64())
            own = {c: batch[c].take(take) for c in ("id", "n_bytes", "media_bytes", "media_sha256")}
            yield pa.RecordBatch.from_arrays(
                [own["id"], own["n_bytes"], pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), own["media_bytes"], own["media_sha256"], pa.array(feature, pa.string())],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    shape = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read.mapInArrow(gather, shape).withColumnRenamed("id", id_col)
