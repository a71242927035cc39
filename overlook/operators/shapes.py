"""Markers, numbers and outlines as pixels of an image: shapes become spans of rows, spans become pixels, and pixels meet by equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of three by five dots, row by row from the top, the first dot the highest of three bits.
DIGITS = [[7, 5, 5, 5, 7], [2, 6, 2, 2, 7], [7, 1, 7, 4, 7], [7, 1, 7, 1, 7], [5, 5, 7, 1, 1], [7, 4, 7, 1, 7], [7, 4, 7, 5, 7], [7, 1, 1, 2, 2], [7, 5, 7, 5, 7], [7, 5, 7, 1, 7]]


def pixel_of(metres: Column, low: float, span: float, width: int, down: bool = False) -> Column:
    """The pixel of a place on an image of ``width`` that shows ``span`` metres from ``low``; ``down`` counts from the far end."""
    at = (metres - low) / span * width
    return F.rint(width - at if down else at).cast("long")


def _half(radius: int, dy: Column) -> Column:
    """Pixels to either side of the middle of a disc's row; -1 where the row does not meet it."""
    left = F.lit(radius * radius) - dy * dy
    return F.when(left >= 0, F.floor(F.sqrt(left))).otherwise(-1).cast("long")


def ring_spans(spots: DataFrame, radius: int = 7, width: int = 2, dot: int = 2) -> DataFrame:
    """``(py, x0, x1)`` of a ring and a dot around each of ``spots`` (``cx, cy``, pixels): two spans a row and the dot's."""
    rows = spots.select("cx", "cy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dy"))
    outer, inner, middle = _half(radius, F.col("dy")), _half(radius - width, F.col("dy")), _half(dot, F.col("dy"))
    cx = F.col("cx")
    pairs = F.array(F.struct((cx - outer).alias("x0"), (cx - inner - 1).alias("x1")), F.struct((cx + inner + 1).alias("x0"), (cx + outer).alias("x1")), F.struct((cx - middle).alias("x0"), (cx + middle).alias("x1")))
    found = rows.select((F.col("cy") + F.col("dy")).alias("py"), F.explode(pairs).alias("s"))
    return found.select("py", "s.x0", "s.x1").where("x1 >= x0")


def number_spans(spots: DataFrame, right: int = 9, up: int = 7) -> DataFrame:
    """``(py, x0, x1)`` of each spot's ``rank`` in small digits, beside its marker."""
    digits = F.split(F.col("rank").cast("string"), "")
    one = spots.select("cx", "cy", F.posexplode(F.filter(digits, lambda d: d != "")).alias("n", "digit"))
    font = F.array(*[F.array(*[F.lit(v) for v in rows]) for rows in DIGITS])
    lines = one.select("cx", "cy", "n", F.posexplode(F.get(font, F.col("digit").cast("int"))).alias("line", "bits"))
    dots = lines.select("cx", "cy", "n", "line", "bits", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).where(F.expr("shiftright(bits, 2 - c) & 1 = 1"))
    x = F.col("cx") + right + 4 * F.col("n") + F.col("c")
    return dots.select((F.col("cy") - up + F.col("line")).alias("py"), x.alias("x0"), x.alias("x1"))


def outline_spans(boxes: DataFrame, width: int = 2) -> DataFrame:
    """``(py, x0, x1)`` of the outlines of ``boxes`` (``x0, y0, x1, y1``, pixels, ends included), ``width`` pixels inward."""
    rows = boxes.select("x0", "y0", "x1", "y1", F.explode(F.sequence("y0", "y1")).alias("py"))
    level = (F.col("py") < F.col("y0") + width) | (F.col("py") > F.col("y1") - width)
    whole = F.array(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b")))
    ends = F.array(F.struct(F.col("x0").alias("a"), F.least(F.col("x0") + width - 1, F.col("x1")).alias("b")), F.struct(F.greatest(F.col("x1") - width + 1, F.col("x0")).alias("a"), F.col("x1").alias("b")))
    return rows.select("py", F.explode(F.when(level, whole).otherwise(ends)).alias("s")).select("py", F.col("s.a").alias("x0"), F.col("s.b").alias("x1"))


def pixels(spans: DataFrame, width: int, height: int, colour: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """``(py, px, r, g, b, a)``: each pixel of the spans within the image once."""
    inside = spans.where(F.col("py").between(0, height - 1)).select("py", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1")).where("x1 >= x0")
    every = inside.select("py", F.explode(F.sequence("x0", "x1")).alias("px")).distinct()
    return every.select("py", "px", *[F.lit(v).alias(n) for v, n in zip((*colour, 255), "rgba")])


def over(base: DataFrame, marks: DataFrame) -> DataFrame:
    """``base`` pixels with ``marks`` drawn over them: pixels meet by place, a mark wins."""
    side = marks.select("py", "px", F.struct(*"rgba").alias("_m"))
    met = base.select("py", "px", F.struct(*"rgba").alias("_b")).join(side, ["py", "px"], "full")
    return met.select("py", "px", *[F.coalesce(F.col(f"_m.{c}"), F.col(f"_b.{c}")).alias(c) for c in "rgba"])


def marked(spots: DataFrame, half_m: float | None, span: float, width: int, low_x: float, low_y: float) -> DataFrame:
    """White pixels of numbered markers at ``spots`` (``rank, x, y``, metres) and, if ``half_m``, of a centred box; north is up."""
    placed = spots.select("rank", pixel_of(F.col("x"), low_x, span, width).alias("cx"), pixel_of(F.col("y"), low_y, span, width, True).alias("cy"))
    every = ring_spans(placed).unionByName(number_spans(placed))
    if half_m is not None:
        share = half_m / (span / 2)
        low, high = round(width * (1 - share) / 2), round(width * (1 + share) / 2)
        box = spots.sparkSession.createDataFrame([(low, low, high, high)], "x0 long, y0 long, x1 long, y1 long")
        every = every.unionByName(outline_spans(box))
    return pixels(every, width, width)
