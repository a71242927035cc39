"""Writers of region tables, pyramids, byte tiles, images and contours, and the guard on where they write."""

from __future__ import annotations

import shutil
import struct
import zlib
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.functions.geo import NODATA
from overlook.operators.contours import features


def guard(path: str, roots: list[str]) -> str:
    """``path`` if it lies below one of ``roots``; anything else is an error."""
    parts = lambda p: PurePosixPath(urlparse(p).path)
    at = parts(path)
    if ".." in at.parts or not any(urlparse(path)[:2] == urlparse(r)[:2] and (at == parts(r) or parts(r) in at.parents) for r in roots):
        raise PermissionError(f"{path} is outside {roots}")
    return path


def check_free_space(path: str, need_gb: float = 0.0, reserve_gb: float = 100.0) -> float:
    """Free GB of a local folder; an error if less than ``need_gb`` besides the reserve."""
    free = shutil.disk_usage(path).free / 1e9
    if free < need_gb + reserve_gb:
        raise OSError(f"{free:.0f} GB free, {need_gb + reserve_gb:.0f} needed")
    return free


def write_tiles(df: DataFrame, path: str, by: list[str], tasks: int | None = None) -> None:
    """Replace the partitions that ``df`` holds and leave the others: a tile's rows come from one task, once.

    Tasks with few bytes are merged, unless their number is given.
    """
    claim(df.sparkSession, path)
    (df.repartition(*by) if tasks is None else df.repartition(tasks, *by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_pyramid(cells: DataFrame, path: str) -> None:
    """A pyramid by level and tile, so that a viewport reads its own tiles alone. Its many files cost more than their bytes, so tasks are not merged."""
    write_tiles(cells, path, ["level", "tile_y", "tile_x"], int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write_region(meta: DataFrame, path: str) -> None:
    """Metadata as JSON, before any tile, so that a part-built region can be read."""
    claim(meta.sparkSession, path)
    meta.coalesce(1).write.mode("overwrite").json(path)


def _hex(value: Column, width: int) -> Column:
    """Little-endian bytes of a number in hexadecimal digits."""
    v = value.cast("long").bitwiseAND(F.lit((1 << (8 * width)) - 1))
    return F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)])


def byte_tiles(cells: DataFrame, value: str, width: int = 1, name: str | None = None) -> DataFrame:
    """``(name, level, tile_y, tile_x, data)``: a tile's values in row order as raw little-endian bytes. A tile is bounded by its side."""
    at = F.struct("row", "col", F.coalesce(F.col(value).cast("int").cast("long") if value == "valid" else F.col(value).cast("long"), F.lit(NODATA if width == 2 else 0)).alias("v"))
    line = F.transform(F.array_sort(F.collect_list(at)), lambda s: _hex(s["v"], width))
    return cells.groupBy("level", "tile_y", "tile_x").agg(F.unhex(F.array_join(line, "")).alias("data")).select(F.lit(name or value).alias("name"), "level", "tile_y", "tile_x", "data")


def write_contours(lines: DataFrame, path: str, lat0: float, lon0: float) -> None:
    """One GeoJSON feature a line, written in parallel."""
    claim(lines.sparkSession, path)
    features(lines, lat0, lon0).write.mode("overwrite").text(path)


def _png(rgba) -> bytes:
    """An 8-bit RGBA image, top row first, as a PNG file."""
    height, width = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """``(tile_y, tile_x, png)`` of pixels ``py, px, r, g, b, a`` (0 to 255, py down); missing pixels are clear. A task holds one tile."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((tile, tile, 4), np.uint8)
        image[frame["py"] % tile, frame["px"] % tile] = frame[["r", "g", "b", "a"]].fillna(0).clip(0, 255).astype(np.uint8)
        return pd.DataFrame({"tile_y": [key[0]], "tile_x": [key[1]], "png": [_png(image)]})

    at = pixels.withColumns({"tile_y": F.floor(F.col("py") / tile).cast("long"), "tile_x": F.floor(F.col("px") / tile).cast("long")})
    return at.groupBy("tile_y", "tile_x").applyInPandas(run, "tile_y long, tile_x long, png binary")


def png_pixels(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """``(py, px, r, g, b, a)`` back from the tiles of ``png_tiles``."""

    def run(frames):
        for frame in frames:
            for ty, tx, png in frame[["tile_y", "tile_x", "png"]].itertuples(index=False):
                at, data = 8, b""
                while at < len(png):
                    (n,) = struct.unpack(">I", png[at : at + 4])
                    if png[at + 4 : at + 8] == b"IDAT":
                        data += png[at + 8 : at + 8 + n]
                    at += n + 12
                image = np.frombuffer(zlib.decompress(data), np.uint8).reshape(tile, tile * 4 + 1)[:, 1:].reshape(-1, 4)
                row, col = np.divmod(np.arange(tile * tile), tile)
                yield pd.DataFrame({"py": row + ty * tile, "px": col + tx * tile, **{c: image[:, i].astype(np.int32) for i, c in enumerate("rgba")}})

    return tiles.mapInPandas(run, "py long, px long, r int, g int, b int, a int")


def free_space(spark: SparkSession, path: str) -> float:
    """Free GB of the file system that ``path`` is on, whatever its kind, as that file system says."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    while not files.exists(at) and at.getParent() is not None:
        at = at.getParent()
    return files.getStatus(at).getRemaining() / 1e9


def claim(spark: SparkSession, path: str, need_gb: float = 0.0) -> str:
    """``path`` if a writer may use it: below ``spark.overlook.roots`` (comma-separated), with ``spark.overlook.reserve_gb`` free beside what it needs; either is asked only where it is set."""
    roots, reserve = spark.conf.get("spark.overlook.roots", None), spark.conf.get("spark.overlook.reserve_gb", None)
    if roots:
        guard(path, roots.split(","))
    if reserve is not None and (free := free_space(spark, path)) < need_gb + float(reserve):
        raise OSError(f"{free:.0f} GB free, {need_gb + float(reserve):.0f} needed")
    return path
