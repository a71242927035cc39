"""Data sources that read parts of files by byte range: raw elevation tiles and GeoTIFF rasters.

Both plan their tasks from what a file says of itself (its size, or its table of offsets) and from a window on place, so that
a read touches the rows or tiles that the window meets and nothing else. Any store that Arrow's file systems open will do. The
window is an option of the read, not a pushed condition: Spark 4.1 keeps what was pushed to a Python source for every later
query of the same DataFrame, which then misses rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from overlook.functions.geo import NODATA


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it; a bare path is a local one."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of one file, in order of names; hidden ones are left out."""
    at, inner = store(path)
    info = at.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(inner, recursive=False))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def put(path: str, name: str, data: bytes) -> None:
    """Write a file whole: under a hidden name first, so that a task that dies leaves nothing half-written to be read."""
    at, inner = store(path)
    at.create_dir(inner, recursive=True)
    import uuid

    hidden = f"{inner}/.{name}-{uuid.uuid4().hex}"
    with at.open_output_stream(hidden) as out:
        out.write(data)
    at.move(hidden, f"{inner}/{name}")


# conditions


@dataclass
class Box:
    """Bounds of whole-number columns, ends included."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)

    def narrow(self, name: str, low: int | None = None, high: int | None = None) -> None:
        if low is not None:
            self.low[name] = max(low, self.low.get(name, low))
        if high is not None:
            self.high[name] = min(high, self.high.get(name, high))

    def clip(self, name: str, first: int, last: int) -> tuple[int, int]:
        """The part of first..last that is within the bounds; empty where the second is smaller."""
        return max(first, self.low.get(name, first)), min(last, self.high.get(name, last))

    def holds(self, name: str, value: int) -> bool:
        return self.clip(name, value, value) == (value, value)

    @classmethod
    def of(cls, text: str | None) -> Box:
        """Bounds from an option: ``{"row": [first, last], ...}`` as JSON, null for an open end."""
        box = cls()
        for name, (low, high) in json.loads(text or "{}").items():
            box.narrow(name, low, high)
        return box


# raw elevation tiles


@dataclass
class Rows(InputPartition):
    """Some rows of one tile: a range of bytes."""

    path: str
    lat_i: int
    lon_i: int
    ncols: int
    first: int
    last: int


_NAMED = re.compile(r"(-?\d+)_(-?\d+)(?:\.\w+)?$")


def tile_list(path: str, rows: int) -> list[tuple[str, int, int, int]]:
    """(path, lat_i, lon_i, columns) of a folder's tiles, from their names and sizes alone."""
    out = []
    for name, size in files(path):
        if m := _NAMED.search(name):
            if size % (2 * rows):
                raise ValueError(f"{name}: {size} bytes are no whole columns of {rows} rows")
            out.append((name, int(m[1]), int(m[2]), size // 2 // rows))
    return out


class RawTiles(DataSource):
    """``raw_tiles``: little-endian int16 tiles called ``<lat>_<lon>`` after their south-west corner, row 0 in the north.

    Options: ``path``; ``rows`` of a tile (3600, the columns follow from the file's size); ``bytes`` of a task (8 MB);
    ``window`` (see ``Box.of``) on ``lat_i, lon_i, row, col``.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_tiles"

    def schema(self) -> str:
        return "lat_i int, lon_i int, row int, col int, ncols int, z short"

    def reader(self, schema):
        return _RawReader(self.options["path"], int(self.options.get("rows", 3600)), int(self.options.get("bytes", 8 << 20)), Box.of(self.options.get("window")))


class _RawReader(DataSourceReader):
    def __init__(self, path: str, rows: int, nbytes: int, box: Box | None = None) -> None:
        self.path, self.rows, self.nbytes, self.box = path, rows, nbytes, box or Box()

    def partitions(self) -> list[Rows]:
        first, last = self.box.clip("row", 0, self.rows - 1)
        out = []
        for name, lat, lon, cols in tile_list(self.path, self.rows):
            if self.box.holds("lat_i", lat) and self.box.holds("lon_i", lon):
                step = max(1, self.nbytes // (2 * max(cols, 1)))
                out += [Rows(name, lat, lon, cols, a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
        return out or [Rows("", 0, 0, 0, 0, -1)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.last < part.first:
            return
        at, _ = store(self.path)
        with at.open_input_file(part.path) as f:
            raw = f.read_at((part.last - part.first + 1) * part.ncols * 2, part.first * part.ncols * 2)
        grid = np.frombuffer(raw, "<i2").reshape(-1, part.ncols)
        c0, c1 = self.box.clip("col", 0, part.ncols - 1)
        step = max(1, 500_000 // max(1, part.ncols))
        for r in range(0, len(grid), step):
            own = grid[r : r + step, c0 : c1 + 1]
            z, n = own.ravel(), own.size
            same = lambda v: pa.array(np.full(n, v, np.int32))
            row = np.repeat(np.arange(part.first + r, part.first + r + len(own), dtype=np.int32), own.shape[1])
            col = np.tile(np.arange(c0, c0 + own.shape[1], dtype=np.int32), len(own))
            yield pa.RecordBatch.from_arrays([same(part.lat_i), same(part.lon_i), pa.array(row), pa.array(col), same(part.ncols), pa.array(z, mask=z == NODATA)], ["lat_i", "lon_i", "row", "col", "ncols", "z"])


def write_raw(cells: DataFrame, path: str, rows: int, cols: int) -> int:
    """Write cells ``lat_i, lon_i, row, col, z`` as raw tiles, one file from one task, absent and unknown cells as nodata; returns their count."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        grid = np.full((rows, cols), NODATA, "<i2")
        z = t.column("z").to_pandas()
        ok = z.notna().to_numpy()
        grid[t.column("row").to_numpy()[ok], t.column("col").to_numpy()[ok]] = z.to_numpy()[ok]
        put(path, f"{key[0].as_py()}_{key[1].as_py()}", grid.tobytes())
        return pa.table({"files": pa.array([1], pa.int64())})

    own = cells.select("lat_i", "lon_i", "row", "col", "z")
    return own.groupBy("lat_i", "lon_i").applyInArrow(run, "files long").agg({"files": "sum"}).first()[0] or 0


# GeoTIFF

#: Fixed values of the format: bytes of each field type, and how numbers of it are read.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, GDAL_NODATA = 33550, 33922, 42113
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946


@dataclass
class Tiff:
    """A file's first image: its size, pixels, place, and where each block (tile or strip) lies."""

    path: str
    order: str
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    block_height: int
    block_width: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None
    west: float | None
    north: float | None
    step_x: float | None
    step_y: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def decode(self, raw: bytes, block: int) -> np.ndarray:
        """A block's pixels; what a tile has beyond the image's edge is cut off."""
        if self.compression != PLAIN:
            raw = zlib.decompress(raw)
        by, bx = divmod(block, self.across)
        high = min(self.block_height, self.height - by * self.block_height)
        pixels = np.frombuffer(raw, self.dtype)
        pixels = pixels[: len(pixels) // self.block_width * self.block_width].reshape(-1, self.block_width)
        if self.predictor == 2:
            pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype.newbyteorder("="))
        return pixels[:high, : min(self.block_width, self.width - bx * self.block_width)]


def open_tiff(path: str) -> Tiff:
    """The directory of a classic or big TIFF of one sample a pixel, without reading any pixel."""
    at, inner = store(path)
    with at.open_input_file(inner) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF")
        big = version == 43
        first = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        lead, entry, room = (8, 20, 8) if big else (2, 12, 4)
        count = struct.unpack(order + ("Q" if big else "H"), f.read_at(lead, first))[0]
        table = f.read_at(count * entry, first + lead)
        tags: dict[int, tuple] = {}
        for i in range(count):
            one = table[i * entry : (i + 1) * entry]
            tag, kind, n = struct.unpack(f"{order}HH{'Q' if big else 'I'}", one[: entry - room])
            if kind not in TYPES:
                continue
            size, letter = TYPES[kind]
            raw = one[entry - room :][: size * n] if size * n <= room else f.read_at(size * n, struct.unpack(order + ("Q" if big else "I"), one[entry - room :])[0])
            tags[tag] = (raw,) if kind == 2 else struct.unpack(f"{order}{n * letter}" if len(letter) > 1 else f"{order}{n}{letter}", raw)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (PLAIN, DEFLATE, OLD_DEFLATE) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{path}: {one(SAMPLES, 1)} samples, compression {one(COMPRESSION)}, predictor {one(PREDICTOR, 1)} are not read here")
    bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None or bits not in ((32, 64) if kind == "f" else (8, 16, 32, 64)) or (kind == "f" and one(PREDICTOR, 1) == 2):
        raise ValueError(f"{path}: pixels of {bits} bits and format {one(FORMAT, 1)} are not read here")
    tiled = TILE_AT in tags
    scale, tie = tags.get(SCALE), tags.get(TIE)
    said = tags[GDAL_NODATA][0].rstrip(b"\x00 ") if GDAL_NODATA in tags else b""
    return Tiff(
        path, order, one(WIDTH), one(HEIGHT), f"{order}{kind}{bits // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1),
        one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)), one(TILE_WIDTH) if tiled else one(WIDTH),
        tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], float(said) if said else None,
        tie[3] - tie[0] * scale[0] if scale and tie else None, tie[4] + tie[1] * scale[1] if scale and tie else None, scale[0] if scale else None, -scale[1] if scale else None,
    )


@dataclass
class Blocks(InputPartition):
    """Some blocks of one file."""

    tiff: Tiff
    blocks: tuple[int, ...]


class TiffCells(DataSource):
    """``tiff_cells``: the pixels of GeoTIFF files, tiled or in strips, plain or deflated, with or without the horizontal predictor.

    Options: ``path`` of a file or folder; ``reduce``, if over 1, gives blocks of so many pixels a side in place of pixels
    (``h_max, h_sum, n``, in parts where a block lies in several tiles or strips: add them up by ``file, r, c``); ``pixels``
    of a task (2 million); ``window`` (see ``Box.of``) on ``row, col`` or, reduced, ``r, c``. Tasks are made of whole tiles or strips, planned from the files' own tables of offsets. Pixels of
    the file's nodata number are null, and are left out of reductions.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_cells"

    def schema(self) -> str:
        return "file string, r int, c int, h_max double, h_sum double, n long" if int(self.options.get("reduce", 1)) > 1 else "file string, row int, col int, value double"

    def reader(self, schema):
        return _TiffReader(self.options["path"], int(self.options.get("reduce", 1)), int(self.options.get("pixels", 2_000_000)), Box.of(self.options.get("window")))


class _TiffReader(DataSourceReader):
    def __init__(self, path: str, factor: int, pixels: int, box: Box | None = None) -> None:
        self.path, self.factor, self.pixels, self.box = path, factor, pixels, box or Box()
        self.places = ("r", "c") if factor > 1 else ("row", "col")

    def _window(self, t: Tiff) -> tuple[int, int, int, int]:
        """First and last row and column of the pixels that are asked for."""
        out = []
        for name, n in zip(self.places, (t.height, t.width)):
            a, b = self.box.clip(name, 0, -(-n // self.factor) - 1)
            out += [a * self.factor, min((b + 1) * self.factor, n) - 1]
        return tuple(out)

    def partitions(self) -> list[Blocks]:
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for name, _ in files(self.path):
            t = open_tiff(scheme + name)
            r0, r1, c0, c1 = self._window(t)
            if r1 < r0 or c1 < c0:
                continue
            asked = [by * t.across + bx for by in range(r0 // t.block_height, r1 // t.block_height + 1) for bx in range(c0 // t.block_width, c1 // t.block_width + 1)]
            step = max(1, self.pixels // (t.block_height * t.block_width))
            out += [Blocks(t, tuple(asked[i : i + step])) for i in range(0, len(asked), step)]
        return out

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        t = part.tiff
        r0, r1, c0, c1 = self._window(t)
        at, inner = store(t.path)
        file = inner.rsplit("/", 1)[-1]
        with at.open_input_file(inner) as f:
            for block in part.blocks:
                by, bx = divmod(block, t.across)
                top, left = by * t.block_height, bx * t.block_width
                # a block of no bytes was never written
                grid = t.decode(f.read_at(t.sizes[block], t.offsets[block]), block) if t.sizes[block] else np.full((min(t.block_height, t.height - top), min(t.block_width, t.width - left)), t.nodata or 0.0)
                grid = grid[max(0, r0 - top) : r1 + 1 - top, max(0, c0 - left) : c1 + 1 - left].astype(np.float64)
                if grid.size:
                    yield from (self._reduced if self.factor > 1 else self._cells)(file, t, grid, max(top, r0), max(left, c0))

    def _cells(self, file: str, t: Tiff, grid: np.ndarray, top: int, left: int) -> Iterator[pa.RecordBatch]:
        v = grid.ravel()
        gone = np.isnan(v) if t.nodata is None else np.isnan(v) | (v == t.nodata)
        row = np.repeat(np.arange(top, top + grid.shape[0], dtype=np.int32), grid.shape[1])
        col = np.tile(np.arange(left, left + grid.shape[1], dtype=np.int32), grid.shape[0])
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(v)), pa.array(row), pa.array(col), pa.array(v, mask=gone)], ["file", "row", "col", "value"])

    def _reduced(self, file: str, t: Tiff, grid: np.ndarray, top: int, left: int) -> Iterator[pa.RecordBatch]:
        k = self.factor
        known = ~np.isnan(grid) if t.nodata is None else ~np.isnan(grid) & (grid != t.nodata)
        cuts = []
        for first, n in ((top, grid.shape[0]), (left, grid.shape[1])):
            own = np.arange(first // k, (first + n - 1) // k + 1)
            cuts.append((own, np.maximum(own * k - first, 0)))
        (r, by_row), (c, by_col) = cuts
        both = lambda op, a: op.reduceat(op.reduceat(a, by_row, axis=0), by_col, axis=1).ravel()
        n = both(np.add, known.astype(np.int64))
        some = n > 0
        top_of, total = both(np.maximum, np.where(known, grid, -np.inf)), both(np.add, np.where(known, grid, 0.0))
        rr, cc = np.repeat(r, len(c)).astype(np.int32), np.tile(c, len(r)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([file] * int(some.sum())), *[pa.array(a[some]) for a in (rr, cc, top_of, total, n)]], ["file", "r", "c", "h_max", "h_sum", "n"])


def tiff_bytes(grid: np.ndarray, block: tuple[int, int], tiled: bool = True, deflate: bool = True, predictor: bool = True, nodata: float | None = None, place: tuple[float, float, float] | None = None) -> bytes:
    """A classic little-endian TIFF of one image; ``place`` is its west and north edge and the size of a pixel in degrees."""
    rows, cols = grid.shape
    high, wide = block if tiled else (block[0], cols)
    grid = grid.astype(grid.dtype.newbyteorder("<"))
    blocks = []
    for top in range(0, rows, high):
        for left in range(0, cols, wide):
            own = grid[top : top + high, left : left + wide]
            if tiled:
                own = np.pad(own, ((0, high - own.shape[0]), (0, wide - own.shape[1])), mode="edge")
            if predictor:
                own = np.diff(own, axis=1, prepend=np.zeros((len(own), 1), own.dtype))
            raw = np.ascontiguousarray(own).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    kind = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    tags: list[tuple[int, int, Sequence | bytes]] = [(WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [grid.dtype.itemsize * 8]), (COMPRESSION, 3, [DEFLATE if deflate else PLAIN]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1]), (FORMAT, 3, [kind])]
    tags += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high])] if tiled else [(STRIP_ROWS, 4, [high])]
    if nodata is not None:
        tags.append((GDAL_NODATA, 2, f"{nodata:g}".encode() + b"\x00"))
    if place:
        tags += [(SCALE, 12, [place[2], place[2], 0.0]), (TIE, 12, [0.0, 0.0, 0.0, place[0], place[1], 0.0])]
    sizes = [len(b) for b in blocks]
    tags += [(TILE_BYTES if tiled else STRIP_BYTES, 4, sizes), (TILE_AT if tiled else STRIP_AT, 4, [0] * len(blocks))]
    tags.sort()
    data_at = 8 + 2 + 12 * len(tags) + 4
    extra: list[bytes] = []
    pack = lambda kind, v: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TYPES[kind][1]}", *v)
    room = sum(len(p) + len(p) % 2 for t in tags if len(p := pack(t[1], t[2])) > 4)
    at, offsets = data_at + room, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    table, free = [], data_at
    for tag, kind, v in tags:
        v = offsets if tag in (TILE_AT, STRIP_AT) else v
        raw, n = pack(kind, v), len(v)
        if len(raw) > 4:
            table.append(struct.pack("<HHII", tag, kind, n, free))
            extra.append(raw + b"\x00" * (len(raw) % 2))
            free += len(extra[-1])
        else:
            table.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\x00"))
    return b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(table) + b"\x00" * 4 + b"".join(extra) + b"".join(blocks)


def write_tiffs(cells: DataFrame, path: str, rows: int, cols: int, dtype: str = "u1", block: tuple[int, int] = (256, 256), nodata: float | None = None, **form) -> int:
    """Write cells ``file, row, col, value`` as one GeoTIFF a ``file``, each from one task; absent and null cells are nodata (0 without one). Returns their count."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        grid = np.full((rows, cols), nodata or 0, dtype)
        v = t.column("value").to_pandas()
        ok = v.notna().to_numpy()
        grid[t.column("row").to_numpy()[ok], t.column("col").to_numpy()[ok]] = v.to_numpy()[ok]
        put(path, f"{key[0].as_py()}.tif", tiff_bytes(grid, block, nodata=nodata, **form))
        return pa.table({"files": pa.array([1], pa.int64())})

    own = cells.select("file", "row", "col", "value")
    return own.groupBy("file").applyInArrow(run, "files long").agg({"files": "sum"}).first()[0] or 0


Window = dict[str, tuple[int | None, int | None]]


def _read(spark: SparkSession, source: type[DataSource], window: Window | None, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(window=json.dumps(window or {}), **options).load()


def read_raw(spark: SparkSession, path: str, rows: int = 3600, nbytes: int = 8 << 20, window: Window | None = None) -> DataFrame:
    """``(lat_i, lon_i, row, col, ncols, z)``; ``window`` (first and last of any of the places) chooses files, byte ranges and columns."""
    return _read(spark, RawTiles, window, path=path, rows=rows, bytes=nbytes)


def read_tiff(spark: SparkSession, path: str, pixels: int = 2_000_000, window: Window | None = None) -> DataFrame:
    """``(file, row, col, value)``; ``window`` on ``row`` and ``col`` chooses the tiles or strips that are read."""
    return _read(spark, TiffCells, window, path=path, pixels=pixels)


def read_reduced(spark: SparkSession, path: str, factor: int = 32, pixels: int = 2_000_000, window: Window | None = None) -> DataFrame:
    """``(file, r, c, h_max, h_mean)`` of blocks of ``factor`` pixels a side, means rounded half to even: reduced where they are read, added up where a block lies in several strips."""
    from pyspark.sql import functions as F

    parts = _read(spark, TiffCells, window, path=path, reduce=factor, pixels=pixels)
    return parts.groupBy("file", "r", "c").agg(F.max("h_max").cast("long").alias("h_max"), F.rint(F.sum("h_sum") / F.sum("n")).cast("long").alias("h_mean"))
