"""Sea and lakes: flat or low cells, joined into 4-connected patches, of a size at least."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import known
from overlook.operators.neighbourhood import SIDE, on_tiles
from overlook.plans.shared import written


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` is linked to, by links ``u`` to ``v``: the larger end of a link follows the smaller."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, after := root[root]):
            root = after


def label_grid(mask: np.ndarray) -> np.ndarray:
    """The place (row by row) of the first cell of each cell's 4-connected patch, NaN where ``mask`` is false.

    Runs of a row are numbered in one sweep; runs that touch one below the other take the smaller number, and numbers
    follow numbers, until nothing moves.
    """
    starts = mask.copy()
    starts[:, 1:] &= ~mask[:, :-1]
    run = np.cumsum(starts.ravel()).reshape(mask.shape) - 1
    first = np.flatnonzero(starts)
    touch = mask[1:] & mask[:-1]
    up, down = run[:-1][touch], run[1:][touch]
    root = _roots(len(first), up, down)
    out = np.full(mask.shape, np.nan)
    if len(first):
        out[mask] = first[root[run[mask]]]
    return out


def _first_cell(place: str, y: str, x: str, side: int = SIDE) -> Column:
    """The cell that names a patch within a tile, as a struct, from its place in the tile."""
    corner = lambda c: F.floor(F.col(c) / side).cast("long") * side
    return F.when(F.col(place).isNotNull(), F.struct((corner(y) + F.expr(f"{place} div {side}")).alias("ry"), (corner(x) + F.col(place) % side).alias("rx")))


#: Tiles of a side that are united at once, then areas of as many such, and so on.
STEP = 8


def _unite(key: tuple, t: pa.Table) -> pa.Table:
    """``(node, root)`` of the labels of one area that have a smaller one, from the links within it."""
    ends = np.stack([np.concatenate([t.column(f"u{c}").to_numpy(), t.column(f"v{c}").to_numpy()]) for c in "yx"], axis=1)
    labels, at = np.unique(ends, axis=0, return_inverse=True)
    at = at.ravel()
    root = labels[_roots(len(labels), at[: len(t)], at[len(t) :])]
    moved = (root != labels).any(axis=1)
    return pa.table({n: pa.array(c[moved]) for n, c in zip(("ny", "nx", "ry", "rx"), (*labels.T, *root.T))})


def _united(labelled: DataFrame, label: str, y: str, x: str, side: int = SIDE) -> DataFrame:
    """``(node, component)`` of tile-local labels that meet another tile's across a border; a component is its smallest label.

    Only cells on borders are compared. Links within an area of STEP x STEP tiles are united in one task; what is left
    crosses the borders of areas, and is united in areas of areas, so that a task's links grow with borders alone and the
    rounds with the logarithm of the raster's side.
    """
    edge = labelled.where(F.col(label).isNotNull()).select(y, x, label)
    links = None
    for along, other in ((y, x), (x, y)):
        last = edge.where(F.pmod(F.col(along), F.lit(side)) == side - 1).select((F.col(along) + 1).alias(along), other, F.col(label).alias("u"))
        next_ = edge.where(F.pmod(F.col(along), F.lit(side)) == 0).select(along, other, F.col(label).alias("v"))
        met = last.join(next_, [along, other]).select("u", "v")
        links = met if links is None else links.unionByName(met)
    links = written(links.distinct(), "tile-links")
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    area = side * STEP
    while not links.isEmpty():
        of = lambda c: F.struct(F.floor(F.col(f"{c}.ry") / area).alias("ay"), F.floor(F.col(f"{c}.rx") / area).alias("ax"))
        near = links.where(of("u") == of("v")).select(of("u").alias("area"), F.col("u.ry").alias("uy"), F.col("u.rx").alias("ux"), F.col("v.ry").alias("vy"), F.col("v.rx").alias("vx"))
        found = near.groupBy("area").applyInArrow(_unite, "ny long, nx long, ry long, rx long")
        pair = lambda a, b: F.struct(F.col(a).alias("ry"), F.col(b).alias("rx"))
        found = written(found.select(pair("ny", "nx").alias("node"), pair("ry", "rx").alias("root")), "tile-roots")
        to = lambda df, c: df.join(found.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        nodes = written(to(nodes, "component"), "tile-nodes")
        links = written(to(to(links.where(of("u") != of("v")), "u"), "v").where("u <> v").distinct(), "tile-links")
        area *= STEP
    return nodes


def patches(cells: DataFrame, y: str = "iy", x: str = "ix", side: int = SIDE) -> DataFrame:
    """``cells`` with ``patch``: cells that touch by an edge share it, the first cell of each.

    A tile is labelled in one pass; only labels that meet at the borders of tiles are united, so that the graph grows with
    borders, not with cells.
    """
    local = on_tiles(cells.withColumn("_at", F.lit(1.0)), "_at", 0, lambda grid, y0, x0: label_grid(~np.isnan(grid)), "bigint", y, x, side)
    local = written(local.withColumn("_label", _first_cell("_at", y, x, side)).drop("_at"), "patches")
    joined = _united(local, "_label", y, x, side).withColumnsRenamed({"node": "_label", "component": "_c"})
    return local.join(joined, "_label", "left").withColumn("patch", F.coalesce("_c", "_label")).drop("_label", "_c")


def detect_water(cells: DataFrame, step: float, flat_tolerance: float = 0.01, min_hectares: float = 10.0, sea_level: float = 0.5, value: str = "z", y: str = "iy", x: str = "ix", side: int = SIDE) -> DataFrame:
    """``cells`` with ``is_water``: flat or at sea level, in a patch of ``min_hectares`` at least. Unknown heights are not water.

    Flatness and the patches of a tile come from one pass over it with a ring of one cell; patches that go on in other
    tiles are united by their borders, and a patch's size is added up over its tiles.
    """
    least = max(1, int(round(min_hectares * 10_000.0 / (step * step))))

    def work(grid: np.ndarray, y0: int, x0: int) -> np.ndarray:
        wide = np.pad(grid, 1, constant_values=np.nan)
        n, m = grid.shape
        around = np.stack([wide[dy : dy + n, dx : dx + m] for dy in range(3) for dx in range(3)])
        # an unknown height is infinite here, and one without a cell is NaN: the first is never flat, the second does not count
        with np.errstate(invalid="ignore"):
            flat = np.fmax.reduce(around) - np.fmin.reduce(around) <= flat_tolerance
        own = np.isfinite(grid) & (flat | (grid <= sea_level))
        out = np.full(grid.shape, np.nan)
        out[1:-1, 1:-1] = label_grid(own[1:-1, 1:-1])  # places count from the tile's own first cell
        return out

    z = F.coalesce(known(F.col(value).cast("double")), F.lit(float("inf")))
    local = on_tiles(cells.withColumn("_at", z), "_at", 1, work, "bigint", y, x, side)
    local = written(local.withColumn("_label", _first_cell("_at", y, x, side)).drop("_at"), "water")
    joined = written(_united(local, "_label", y, x, side).withColumnsRenamed({"node": "_label", "component": "_c"}), "water-joined")
    sizes = local.where("_label IS NOT NULL").groupBy("_label").agg(F.count("*").alias("_n")).join(joined, "_label", "left").withColumn("_c", F.coalesce("_c", "_label"))
    sizes = written(sizes, "water-sizes")
    large = sizes.groupBy("_c").agg(F.sum("_n").alias("n")).where(F.col("n") >= least).select("_c")
    wet = written(sizes.join(large, "_c", "left_semi").select("_label", F.lit(True).alias("_wet")), "water-large")
    return local.join(wet, "_label", "left").withColumn("is_water", F.coalesce("_wet", F.lit(False))).select(*cells.columns, "is_water")
