"""File formats as Spark data sources: pixels of TIFF images (read and written strip by strip), polygons of Shapefiles, crowns in GeoPackages.

    sources.formats.register(spark)
    spark.read.format("pixels").load(folder).where("r between 1000 and 1999 and band = 0")
    strips.write.format("pixels").mode("append").save(folder)
    spark.read.format("shapes").load(folder)
    crowns.write.format("crown_packages").mode("append").save(folder)
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .files import tiff_header

PIXELS = "path string, band int, r int, c int, v double"
STRIPS = "name string, first_row int, width int, bands int, dtype string, data binary"
SHAPES = "path string, record int, rings array<array<struct<x: double, y: double>>>, attributes map<string, string>"

#: Pixels of a batch, rows of a partition and records of a partition that are read at once.
BATCH = 1 << 18
ROWS = 4096
RECORDS = 4096

#: Files that are opened to plan a read; of more than these, whole files of so many bytes together, or so many files, are a partition.
OPENED = 64
PACK_BYTES = 1 << 22
PACK_FILES = 512

#: Moves of a commit at a time.
MOVERS = 16

# Fixed values of the TIFF format: tags, and the sample types that are read and written.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 266: "fill", 273: "strips", 277: "bands", 278: "strip_rows", 279: "strip_bytes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_bytes", 339: "format"}
_KINDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def sizes(path: str, ending: str) -> list[tuple[str, int]]:
    """The files of that ending in a folder, or the file itself, in order of names, and their bytes; raises if there is none."""
    system, place = opened(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else []
    names = sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(ending) and not any(p.startswith(("_", ".")) for p in x.path[len(place) :].split("/")))
    if not names:
        raise FileNotFoundError(f"no *{ending} in {path}")
    return names


def listed(path: str, ending: str) -> list[str]:
    """The files of that ending in a folder, or the file itself, in order of names; raises if there is none."""
    return [name for name, _ in sizes(path, ending)]


def unlzw(raw: bytes) -> bytes:
    """LZW of TIFF: codes of 9 to 12 bits, the high bit first, 256 starts anew and 257 ends."""
    table: list[bytes] = []
    out, last, width, bits, held = [], b"", 9, 0, 0
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def unpackbits(raw: bytes) -> bytes:
    """Runs of bytes: 0 to 127 counts literal bytes, -1 to -127 repeats the next one."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


# Fixed values of the TIFF format: compressions.
_UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}


def directory(file) -> dict:
    """The first directory of a TIFF file, whose strips or tiles are equal blocks: what is needed to find and read them."""
    head = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    file.seek(struct.unpack(order + "I", head[4:])[0])
    entries = file.read(12 * struct.unpack(order + "H", file.read(2))[0])
    out: dict = {"order": order}
    for k in range(0, len(entries), 12):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, k)
        if tag in _TAGS and kind in _KINDS:
            size, raw = struct.calcsize(_KINDS[kind]) * n, entries[k + 8 : k + 12]
            if size > 4:
                file.seek(struct.unpack(order + "I", raw)[0])
                raw = file.read(size)
            out[_TAGS[tag]] = struct.unpack(f"{order}{n}{_KINDS[kind]}", raw[:size])
    one = lambda name, default: out.get(name, (default,))[0]
    kind = _DTYPES.get((one("format", 1), one("bits", 1)))
    if kind is None or one("compression", 1) not in _UNPACK or one("predictor", 1) not in (1, 2, 3) or one("fill", 1) != 1 or (one("predictor", 1) == 3) > (kind[0] == "f"):
        raise ValueError(f"samples {one('format', 1)}/{one('bits', 1)}, compression {one('compression', 1)}, predictor {one('predictor', 1)} and fill order {one('fill', 1)} are not read together")
    tiled, height, width = "tiles" in out, one("height", 0), one("width", 0)
    block = {"h": one("tile_height", 0), "w": one("tile_width", 0), "at": out["tiles"], "bytes": out["tile_bytes"]} if tiled else {"h": min(height, one("strip_rows", height)), "w": width, "at": out["strips"], "bytes": out["strip_bytes"]}
    return block | {"order": order, "kind": kind, "height": height, "width": width, "bands": one("bands", 1), "planar": one("planar", 1), "compression": one("compression", 1), "predictor": one("predictor", 1), "tiled": tiled}


def block_samples(file, d: dict, k: int) -> np.ndarray:
    """The samples of one strip or tile: rows x columns x bands of it."""
    down = -(-d["height"] // d["h"])
    across = -(-d["width"] // d["w"])
    inner = 1 if d["planar"] == 2 else d["bands"]
    rows = d["h"] if d["tiled"] else min(d["h"], d["height"] - k // across % down * d["h"])
    file.seek(d["at"][k])
    raw = _UNPACK[d["compression"]](file.read(d["bytes"][k]))
    kind, shape = np.dtype(d["order"] + d["kind"]), (rows, d["w"], inner)
    if d["predictor"] == 3:  # differences of bytes along a row, the most significant byte of all numbers first
        size = kind.itemsize
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * d["w"] * inner * size).reshape(rows, -1, inner), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, size, -1).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    block = np.frombuffer(raw, kind, rows * d["w"] * inner).reshape(shape)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if d["predictor"] == 2 else block


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int


@dataclass
class Files(InputPartition):
    paths: list[str]


class Pixels(DataSource):
    """Long pixels of TIFF images, with the rows and columns that a filter names read only; writes strips (STRIPS).

    Options: rows (of a partition), placed (true: rows and columns count from the map's origin at left = top = 0, in the
    files' own pixels, so strips of one mosaic lie where they belong).
    """

    @classmethod
    def name(cls) -> str:
        return "pixels"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> PixelReader:
        return PixelReader(self.options)

    def writer(self, schema, overwrite: bool) -> StripWriter:
        if overwrite:
            raise ValueError("strips are added to a folder: write with mode append")
        return StripWriter(self.options)


class PixelReader(DataSourceReader):
    """A partition is a range of rows of one file, or of many files some whole ones; files and strips beyond the filters are not read.

    The driver opens few files: the first OPENED if there are no more, else those larger than a partition.
    """

    def __init__(self, options):
        self.path, self.rows, self.placed = options["path"], int(options.get("rows", ROWS)), str(options.get("placed", "false")).lower() == "true"
        self.low, self.high = {"r": 0, "c": 0, "band": 0}, {"r": 1 << 31, "c": 1 << 31, "band": 1 << 31}
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name == "path" and isinstance(f, EqualTo):
                self.only = value
            elif name in self.low and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], value + 1 - isinstance(f, LessThan))
            else:
                yield f

    def _shift(self, head: dict) -> tuple[int, int]:
        """Where the first pixel of a file with this header lies."""
        return (round(-head["top"] / head["pixel_y"]), round(head["left"] / head["pixel_x"])) if self.placed and "top" in head else (0, 0)

    def _wanted(self, head: dict) -> tuple[int, int]:
        """The rows of a file with this header that the filters leave: the first and their end."""
        down = self._shift(head)[0]
        return max(0, self.low["r"] - down), min(head["height"], self.high["r"] - down)

    def partitions(self) -> list[Rows | Files]:
        found = [(path, size) for path, size in sizes(self.path, ".tif") if self.only in (None, path)]
        out, pack, held = [], [], 0
        for path, size in found:
            if len(found) > OPENED and size <= PACK_BYTES:
                if pack and (held + size > PACK_BYTES or len(pack) == PACK_FILES):
                    out.append(Files(pack))
                    pack, held = [], 0
                pack.append(path)
                held += size
                continue
            system, place = opened(path)
            with system.open_input_file(place) as file:
                first, end = self._wanted(tiff_header(file))
            out += [Rows(path, k, min(end, k + self.rows)) for k in range(first, end, self.rows)]
        return out + [Files(pack)] * bool(pack) or [Files([])]

    def read(self, partition: Rows | Files) -> Iterator[pa.RecordBatch]:
        parts = [(partition.path, partition.first, partition.end)] if isinstance(partition, Rows) else [(path, None, None) for path in partition.paths]
        held, n = [], 0
        for part in parts:
            for batch in self._pixels(*part):
                if n and n + batch.num_rows > BATCH:
                    yield pa.concat_batches(held)
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
        if n:
            yield pa.concat_batches(held)

    def _pixels(self, path: str, first: int | None, end: int | None) -> Iterator[pa.RecordBatch]:
        """The pixels of a file's rows that the filters leave, of all rows where no range is given."""
        system, place = opened(path)
        with system.open_input_file(place) as file:
            head = tiff_header(file)
            down, aside = self._shift(head)
            if first is None:
                first, end = self._wanted(head)
            left, right = max(0, self.low["c"] - aside), min(head["width"], self.high["c"] - aside)
            if first >= end or left >= right:
                return
            file.seek(0)
            d = directory(file)
            across, rows_of = -(-d["width"] // d["w"]), -(-d["height"] // d["h"])
            for k in range(len(d["at"])):
                plane, rest = divmod(k, across * rows_of)
                top, side = rest // across * d["h"], rest % across * d["w"]
                r0, r1, c0, c1 = max(top, first), min(top + d["h"], end, d["height"]), max(side, left), min(side + d["w"], right)
                if r0 >= r1 or c0 >= c1:
                    continue
                block = block_samples(file, d, k)
                for inner in range(block.shape[2]):
                    band = plane if d["planar"] == 2 else inner
                    if not self.low["band"] <= band < self.high["band"]:
                        continue
                    step = max(1, BATCH // (c1 - c0))
                    for y in range(r0, r1, step):
                        part = block[y - top : min(y + step, r1) - top, c0 - side : c1 - side, inner]
                        n = part.size
                        r, c = np.divmod(np.arange(n), part.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, band, np.int32)), pa.array((r + y + down).astype(np.int32)), pa.array((c + c0 + aside).astype(np.int32)), pa.array(part.ravel().astype(np.float64))], ["path", "band", "r", "c", "v"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def strip_file(width: int, bands: int, dtype: str, data: bytes, first_row: int) -> bytes:
    """One strip as a TIFF file: deflated, its first row told by its place on the map (a unit a pixel, downwards)."""
    kind = np.dtype("<" + dtype)
    height = len(data) // (width * bands * kind.itemsize)
    body = zlib.compress(data)
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    far = 8 + 2 + 13 * 12 + 4
    extra = struct.pack(f"<{bands}H", *[8 * kind.itemsize] * bands).ljust(2 * bands + 2 * bands % 4, b"\0") + struct.pack("<3d", 1, 1, 0) + struct.pack("<6d", 0, 0, 0, 0, -first_row, 0)
    many = 2 * bands + 2 * bands % 4
    bits = (3, bands, far) if bands > 2 else (3, bands, 8 * kind.itemsize * (1 + (bands == 2) * 65536))
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, *bits), (259, 3, 1, 8), (262, 3, 1, 2 if bands == 3 else 1), (273, 4, 1, far + len(extra)), (277, 3, 1, bands), (278, 4, 1, height), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, 1, form), (33550, 12, 3, far + many), (33922, 12, 6, far + many + 24)]
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4 + extra + body


class StripWriter(DataSourceArrowWriter):
    """Tasks write files into a folder that no reader looks at; with the commit they are moved in place, else removed.

    The driver handles names only. A strip is one file, name-first_row.tif, so a mosaic of any height is as many tasks as wanted;
    a strip of that name that is there already is replaced.
    """

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = opened(self.staged)
        system.create_dir(place, recursive=True)
        names = []
        for batch in iterator:
            for row in batch.to_pylist():
                name = f"{row['name']}-{row['first_row']:09d}.tif"
                mine = f"{name}.{uuid.uuid4().hex}"  # a task that runs twice writes twice; what it commits is its own
                with system.open_output_stream(f"{place}/{mine}") as out:
                    out.write(strip_file(row["width"], row["bands"], row["dtype"], row["data"], row["first_row"]))
                names.append(mine)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = opened(self.staged)
        names = [mine for message in messages if message for mine in message.names]
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(lambda mine: system.move(f"{place}/{mine}", f"{place.rsplit('/', 1)[0]}/{mine.rsplit('.', 1)[0]}"), names):
                pass
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, place = opened(self.staged)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


@dataclass
class Records(InputPartition):
    path: str
    first: int
    end: int


class Shapes(DataSource):
    """Polygons of Shapefiles with their attributes as text, planned from the index file; other shapes are null.

    Option: records (of a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options)


class ShapeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.records = options["path"], int(options.get("records", RECORDS))
        self.low, self.high, self.only = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name == "path" and isinstance(f, EqualTo):
                self.only = value
            elif name == "record" and isinstance(value, int) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == "record" and isinstance(value, int) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Records]:
        out = []
        for path in listed(self.path, ".shp"):
            if self.only in (None, path):
                system, place = opened(path[:-4] + ".shx")
                end = min((system.get_file_info(place).size - 100) // 8, self.high)
                out += [Records(path, k, min(end, k + self.records)) for k in range(self.low, end, self.records)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        n = partition.end - partition.first
        if not n:
            return
        system, place = opened(partition.path[:-4])
        with system.open_input_file(place + ".shx") as file:
            file.seek(100 + 8 * partition.first)
            index = np.frombuffer(file.read(8 * n), ">i4").reshape(n, 2) * 2
        attributes = _attributes(system, place + ".dbf", partition.first, n)
        with system.open_input_file(place + ".shp") as file:
            for k, (at, size) in enumerate(index.tolist()):
                file.seek(at + 8)
                yield partition.path, partition.first + k, _rings(file.read(size)), attributes[k]


def _rings(raw: bytes) -> list | None:
    """The rings of a polygon record, with or without heights and measures; null for other shapes."""
    if struct.unpack_from("<i", raw)[0] not in (5, 15, 25):  # fixed values: polygon, polygon with z, with m
        return None
    parts, points = struct.unpack_from("<2i", raw, 36)
    begins = [*np.frombuffer(raw, "<i4", parts, 44).tolist(), points]
    xy = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    return [[(x, y) for x, y in xy[a:b]] for a, b in zip(begins, begins[1:], strict=False)]


def _attributes(system: fs.FileSystem, place: str, first: int, n: int) -> list[dict[str, str]]:
    """Field values of some records as text, blanks stripped; none if there is no such file."""
    if system.get_file_info(place).type != fs.FileType.File:
        return [{}] * n
    with system.open_input_file(place) as file:
        head = file.read(32)
        begin, size = struct.unpack_from("<HH", head, 8)
        fields, at = [], 1
        raw = file.read(begin - 32)
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            fields.append((raw[k : k + 11].split(b"\0")[0].decode("latin-1"), at, raw[k + 16]))
            at += raw[k + 16]
        file.seek(begin + first * size)
        rows = file.read(n * size)
    return [{name: rows[k * size + a : k * size + a + many].decode("utf-8", "replace").strip() for name, a, many in fields} for k in range(n)]


def shape_files(keys: list[int], rings: list[list]) -> dict[str, bytes]:
    """.shp, .shx and .dbf of polygons with a number KEY each."""
    body, index, boxes = [], [], []
    at = 100
    for k, parts in enumerate(rings):
        points = np.array([(p["x"], p["y"]) for ring in parts for p in ring], "<f8").reshape(-1, 2)
        box = [*points.min(axis=0), *points.max(axis=0)] if len(points) else [0.0] * 4
        boxes.append(box)
        begins = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4")[: len(parts)]
        record = struct.pack("<i4d2i", 5, *box, len(parts), len(points)) + begins.tobytes() + points.tobytes()
        body.append(struct.pack(">2i", k + 1, len(record) // 2) + record)
        index.append(struct.pack(">2i", at // 2, len(record) // 2))
        at += 8 + len(record)
    whole = np.array(boxes, float).reshape(-1, 4)
    bounds = [*whole[:, :2].min(axis=0), *whole[:, 2:].max(axis=0)] if len(whole) else [0.0] * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *bounds, 0, 0, 0, 0)
    field = b"KEY".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([18, 0]) + b"\0" * 14
    table = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(keys), 65, 19) + field + b"\r" + b"".join(b" " + str(k).rjust(18).encode() for k in keys) + b"\x1a"
    return {".shp": head(at) + b"".join(body), ".shx": head(100 + 8 * len(index)) + b"".join(index), ".dbf": table}


CROWNS = "crown_id string, area_m2 double, diameter_m double, size_class string, rings array<array<struct<x: double, y: double>>>"
FEATURES = f"path string, fid long, {CROWNS}"

# Fixed values of the GeoPackage format: its application id and version, and the tables that every file has.
_GPKG_ID, _GPKG_VERSION = 0x47504B47, 10300
_GPKG_TABLES = """
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
create table crowns (fid integer primary key autoincrement, geom blob, crown_id text, area_m2 real, diameter_m real, size_class text);
insert into gpkg_spatial_ref_sys values ('undefined cartesian', -1, 'NONE', -1, 'undefined', null), ('undefined geographic', 0, 'NONE', 0, 'undefined', null), ('WGS 84', 4326, 'EPSG', 4326, 'undefined', null);
"""


def _polygon(rings: list, epsg: int) -> bytes:
    """A polygon as GeoPackage keeps it: a header with the coordinate system, then the well-known binary form."""
    body = b"".join(struct.pack("<I", len(r)) + np.array([(p["x"], p["y"]) for p in r], "<f8").reshape(-1, 2).tobytes() for r in rings)
    return struct.pack("<2sBBi", b"GP", 0, 1 | (0 if rings else 16), epsg) + struct.pack("<BII", 1, 3, len(rings)) + body


def _unpolygon(raw: bytes | None) -> list | None:
    """The rings of a stored polygon; null for none and for other shapes."""
    if raw is None or raw[:2] != b"GP":
        return None
    at = 8 + (0, 32, 48, 48, 64)[raw[3] >> 1 & 7]  # the header may hold a box
    order = "<" if raw[at] else ">"
    kind, n = struct.unpack_from(order + "II", raw, at + 1)
    if kind != 3:
        return None
    out, at = [], at + 9
    for _ in range(n):
        (many,) = struct.unpack_from(order + "I", raw, at)
        out.append([(x, y) for x, y in np.frombuffer(raw, order + "f8", 2 * many, at + 4).reshape(-1, 2).tolist()])
        at += 4 + 16 * many
    return out


def package_file(rows: list[dict], epsg: int) -> bytes:
    """A GeoPackage of one layer, crowns."""
    import sqlite3

    with sqlite3.connect(":memory:") as con:
        con.executescript(f"pragma application_id = {_GPKG_ID}; pragma user_version = {_GPKG_VERSION}; {_GPKG_TABLES}")
        con.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{epsg}", epsg, epsg))
        points = np.array([(p["x"], p["y"]) for r in rows for ring in r["rings"] or [] for p in ring], float).reshape(-1, 2)
        box = [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()] if len(points) else [None] * 4
        con.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values ('crowns', 'features', 'crowns', ?, ?, ?, ?, ?)", (*box, epsg))
        con.execute("insert into gpkg_geometry_columns values ('crowns', 'geom', 'POLYGON', ?, 0, 0)", (epsg,))
        con.executemany("insert into crowns (geom, crown_id, area_m2, diameter_m, size_class) values (?, ?, ?, ?, ?)", [(None if r["rings"] is None else _polygon(r["rings"], epsg), r["crown_id"], r["area_m2"], r["diameter_m"], r["size_class"]) for r in rows])
        con.commit()
        return con.serialize()


class Packages(DataSource):
    """Crowns in GeoPackage files of a folder: read file by file, appended as one file for each batch of a task.

    Option: epsg (of what is written, 3857). A file is read into memory as a whole, as its pages
    refer to one another; so a layer is best kept as many files, which is how it is written.
    """

    @classmethod
    def name(cls) -> str:
        return "crown_packages"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise ValueError("crowns are added to a folder: write with mode append")
        return PackageWriter(self.options)


class PackageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only = options["path"], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[Rows]:
        return [Rows(path, 0, 0) for path in listed(self.path, ".gpkg") if self.only in (None, path)] or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        import sqlite3

        if not partition.path:
            return
        system, place = opened(partition.path)
        with system.open_input_file(place) as file:
            raw = file.read()
        with sqlite3.connect(":memory:") as con:
            con.deserialize(raw)
            for fid, geom, *rest in con.execute("select fid, geom, crown_id, area_m2, diameter_m, size_class from crowns order by fid"):
                yield partition.path, fid, *rest, _unpolygon(geom)


class PackageWriter(StripWriter):
    """Files are staged, and put in place by the commit, as strips are."""

    def __init__(self, options):
        super().__init__(options)
        self.epsg = int(options.get("epsg", 3857))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = opened(self.staged)
        system.create_dir(place, recursive=True)
        names = []
        for batch in iterator:
            if batch.num_rows:
                own = uuid.uuid4().hex
                mine = f"crowns-{own}.gpkg.{own}"
                with system.open_output_stream(f"{place}/{mine}") as out:
                    out.write(package_file(batch.to_pylist(), self.epsg))
                names.append(mine)
        return Written(names)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (Pixels, Shapes, Packages):
        spark.dataSource.register(source)
