"""Contour lines: marching squares by a grouped pass over cell corners, pieces traced tile by tile, joined and simplified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.operators.graph import connected_components
from overlook.operators.lattice import corners
from overlook.plans.shared import written


def segments(cells: DataFrame, interval: float = 10.0) -> DataFrame:
    """``(level, iy, ix, a, ay, ax, b, by, bx)``: where each level crosses each square of four cells.

    ``a`` and ``b`` number the crossed edges, so that squares which share an edge share a point. A saddle is parted by
    the mean of its corners. Levels below 0 are not drawn. A corner counts as above if it is higher than the level.
    """
    square = corners(cells)
    low, high = F.least("z00", "z01", "z10", "z11"), F.greatest("z00", "z01", "z10", "z11")
    first, last = F.greatest(F.ceil(low / interval), F.lit(0)).cast("long"), F.floor(high / interval).cast("long")
    drawn = square.where(first <= last).withColumn("level", F.explode(F.transform(F.sequence(first, last), lambda k: k * F.lit(float(interval)))))
    up = {k: (F.col(f"z{k}") > F.col("level")).cast("int") for k in ("00", "01", "10", "11")}
    case = up["00"] + 2 * up["01"] + 4 * up["10"] + 8 * up["11"]
    share = lambda p, q: (F.col("level") - F.col(f"z{p}")) / (F.col(f"z{q}") - F.col(f"z{p}"))
    number = lambda y, x, kind: (y * F.lit(1 << 31) + x) * 2 + kind
    iy, ix = F.col("iy").cast("long"), F.col("ix").cast("long")
    edge = {
        "s": F.struct(number(iy, ix, 0).alias("e"), iy.cast("double").alias("y"), (ix + share("00", "01")).alias("x")),
        "n": F.struct(number(iy + 1, ix, 0).alias("e"), (iy + 1.0).alias("y"), (ix + share("10", "11")).alias("x")),
        "w": F.struct(number(iy, ix, 1).alias("e"), (iy + share("00", "10")).alias("y"), ix.cast("double").alias("x")),
        "e": F.struct(number(iy, ix + 1, 1).alias("e"), (iy + share("01", "11")).alias("y"), (ix + 1.0).alias("x")),
    }
    pair = lambda p, q: F.struct(edge[p].alias("a"), edge[q].alias("b"))
    above = (F.col("z00") + F.col("z01") + F.col("z10") + F.col("z11")) / 4 > F.col("level")
    lines = (
        F.when(case.isin(1, 14), F.array(pair("s", "w"))).when(case.isin(2, 13), F.array(pair("s", "e"))).when(case.isin(4, 11), F.array(pair("w", "n")))
        .when(case.isin(8, 7), F.array(pair("n", "e"))).when(case.isin(3, 12), F.array(pair("w", "e"))).when(case.isin(5, 10), F.array(pair("s", "n")))
        .when((case == 9) & above | (case == 6) & ~above, F.array(pair("s", "e"), pair("w", "n"))).when(case.isin(6, 9), F.array(pair("s", "w"), pair("n", "e")))
    )
    out = drawn.select("level", "iy", "ix", F.explode(lines).alias("l"))
    return out.select("level", "iy", "ix", F.col("l.a.e").alias("a"), F.col("l.a.y").alias("ay"), F.col("l.a.x").alias("ax"), F.col("l.b.e").alias("b"), F.col("l.b.y").alias("by"), F.col("l.b.x").alias("bx"))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay, by the rule of Douglas and Peucker: between two kept points the farthest from their chord stays, if it is over ``tolerance`` off.

    All open spans are treated together, a level at a time: each point knows its span, distances are taken for all at
    once, and a grouped maximum splits the spans that need it. Where both ends are one place, distance is from that place.
    A negative tolerance keeps all points.
    """
    n = len(points)
    if tolerance < 0 or n < 3:
        return np.ones(n, dtype=bool)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    while True:
        ends = np.flatnonzero(keep)
        span = np.searchsorted(ends, np.arange(n), side="right") - 1
        span = np.minimum(span, len(ends) - 2) if n > 1 else span
        a, b = points[ends[span]], points[ends[np.minimum(span + 1, len(ends) - 1)]]
        chord, arm = b - a, points - a
        length = np.hypot(*chord.T)
        flat = length <= 1e-9
        off = np.where(flat, np.hypot(*arm.T), np.abs(chord[:, 0] * arm[:, 1] - chord[:, 1] * arm[:, 0]) / np.where(flat, 1.0, length))
        off[keep] = -1.0
        most = np.full(max(1, len(ends) - 1), -1.0)
        np.maximum.at(most, span, off)
        far = np.flatnonzero((off == most[span]) & (off > tolerance))
        if not len(far):
            return keep
        keep[far[np.unique(span[far], return_index=True)[1]]] = True  # the first of equals in each span


def chain(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Edge numbers of each line: open lines from their ends, then closed ones, which end where they began."""
    near: dict[int, list[int]] = {}
    for u, v in zip(a.tolist(), b.tolist()):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    lines = []
    for start in [k for k, v in near.items() if len(v) % 2] + list(near):
        while near[start]:
            line, at = [start], start
            while near[at]:
                to = near[at].pop()
                near[to].remove(at)
                line.append(to)
                at = to
            lines.append(line)
    return lines


def ordered(line: list[int]) -> list[int]:
    """A line in an order of its own, wherever it was begun: open ones from the smaller end, closed ones from the smallest edge towards its smaller neighbour."""
    if line[0] != line[-1]:
        return line if line[0] < line[-1] else line[::-1]
    ring = line[:-1]
    at = ring.index(min(ring))
    ring = ring[at:] + ring[:at]
    if len(ring) > 2 and ring[-1] < ring[1]:
        ring = [ring[0], *ring[:0:-1]]
    return [*ring, ring[0]]


PIECES = "level double, first long, last long, edges array<long>, ys array<double>, xs array<double>"
LINES = "e long, major boolean, line long, n_raw int, ys array<double>, xs array<double>"


def pieces(cells: DataFrame, interval: float, tile_cells: int) -> DataFrame:
    """Lines as far as they go within a tile: a task holds the segments of one level in one tile."""
    tile = lambda c: F.floor(F.col(c) / tile_cells).cast("long")
    parts = segments(cells, interval).withColumns({"ty": tile("iy"), "tx": tile("ix")})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(np.r_[frame["a"], frame["b"]].tolist(), zip(np.r_[frame["ay"], frame["by"]].tolist(), np.r_[frame["ax"], frame["bx"]].tolist())))
        rows = [(key[0], line[0], line[-1], line, [place[e][0] for e in line], [place[e][1] for e in line]) for line in chain(frame["a"].to_numpy(), frame["b"].to_numpy())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return parts.groupBy("level", "ty", "tx").applyInPandas(run, PIECES)


def contours(cells: DataFrame, interval: float = 10.0, major_every: int = 5, cell: float = 50.0, tolerance: float = 18.0, tile_cells: int = 1024) -> DataFrame:
    """Whole contour lines in metres, whatever the tiles.

    Pieces are traced tile by tile; those that end on a shared edge are joined by the components of their ends, and a task
    holds one line. ``line`` is the number of the line's smallest edge, so a line has one name and one order of points.
    """
    found = written(pieces(cells, interval, tile_cells), "contour-pieces")
    end = lambda c: F.struct("level", F.col(c).alias("e"))
    open_ = found.where("first <> last").select(end("first").alias("u"), end("last").alias("v"))
    whole = connected_components(open_).select(F.col("node.level").alias("level"), F.col("node.e").alias("first"), F.col("component.e").alias("own"))
    named = found.join(whole, ["level", "first"], "left").withColumn("own", F.coalesce("own", F.array_min("edges")))

    def line_rows(level: float, parts: list[tuple]) -> list[tuple]:
        place, a, b = {}, [], []
        for edges, ys, xs in parts:
            edges = list(map(int, edges))
            place.update(zip(edges, zip(ys, xs)))
            a += edges[:-1]
            b += edges[1:]
        rows = []
        for line in map(ordered, chain(np.array(a), np.array(b))):
            points = np.array([place[e] for e in line]) * cell
            kept = points[simplify(points, tolerance)]
            if len(kept) > 1:
                rows.append((int(level), float(level) % (interval * major_every) == 0, min(line), len(points), kept[:, 0].tolist(), kept[:, 1].tolist()))
        return rows

    names = [c.split()[0] for c in LINES.split(", ")]

    def run(frames):
        """Pieces come sorted by line: each line is made as its last piece is read."""
        held, now, rows = [], None, []
        for frame in frames:
            for level, own, *part in frame[["level", "own", "edges", "ys", "xs"]].itertuples(index=False, name=None):
                if (level, own) != now:
                    rows += line_rows(now[0], held) if held else []
                    held, now = [], (level, own)
                held.append(part)
            yield pd.DataFrame(rows, columns=names)
            rows = []
        yield pd.DataFrame(line_rows(now[0], held) if held else [], columns=names)

    return named.repartition("level", "own").sortWithinPartitions("level", "own").mapInPandas(run, LINES)


def totals(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if("major").alias("major_lines"), F.sum("n_raw").alias("points_in"), F.sum(F.size("ys")).alias("points_kept"))


def features(lines: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """One GeoJSON feature a row, compact, coordinates of five decimals."""
    from overlook.functions.geo import metres_per_degree_at

    north, east = metres_per_degree_at(lat0)
    point = F.zip_with("xs", "ys", lambda x, y: F.array(F.round(lon0 + x / east, 5), F.round(lat0 + y / north, 5)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("e", "major").alias("properties"), F.struct(F.lit("LineString").alias("type"), point.alias("coordinates")).alias("geometry"))
    return lines.select(F.to_json(feature).alias("feature"))
