"""Colour ramps, alpha blending and colour limits as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import clip

#: Ramps, red, green and blue from 0 to 1. Fixed values.
HEAT = (
    (0.001, 0.000, 0.014), (0.129, 0.047, 0.281), (0.341, 0.063, 0.430), (0.549, 0.161, 0.392),
    (0.741, 0.278, 0.302), (0.890, 0.448, 0.153), (0.976, 0.661, 0.036), (0.988, 0.906, 0.145),
)
SINGLE_HUE = (
    (0.996, 0.941, 0.851), (0.992, 0.851, 0.627), (0.976, 0.722, 0.361),
    (0.933, 0.565, 0.141), (0.812, 0.420, 0.043), (0.612, 0.290, 0.027),
)
REACH_HEX = ("FFF3E0", "FBD89B", "F5B35A", "E8891C", "C4620A", "853B06", "431C02")
REACH = tuple(tuple(int(h[i : i + 2], 16) / 255 for i in (0, 2, 4)) for h in REACH_HEX)


def ramp(t: Column, stops=HEAT) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 1, piecewise linear between evenly spaced stops; null counts as 0."""
    at = clip(F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0) * (len(stops) - 1)
    i = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    f = at - i
    out = []
    for channel in range(3):
        table = F.array(*[F.lit(float(s[channel])) for s in stops])
        out.append(F.get(table, i) * (1 - f) + F.get(table, i + 1) * f)
    return tuple(out)


def byte(x: Column) -> Column:
    return F.floor(clip(x, 0.0, 1.0) * 255).cast("int")


def colour_limits(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98, positive: bool = True) -> tuple[float, float]:
    """Two exact percentiles of the known (positive) values, at least a billionth apart; (0, 1) if there are none."""
    x = F.col(column).cast("double")
    good = df.where(x.isNotNull() & ~F.isnan(x) & (x > 0 if positive else F.lit(True)))
    got = good.agg(F.percentile(x, F.array(F.lit(low), F.lit(high)))).first()[0]
    return (got[0], max(got[1], got[0] + 1e-9)) if got else (0.0, 1.0)


def blend(score_t: Column, shade: Column, dead: Column, water: Column, alpha: float = 0.78) -> tuple[Column, Column, Column]:
    """Terrain shade under a score's colour; dead cells show terrain alone, water its own blue. Fixed weights."""
    base = [shade * w for w in (0.82, 0.84, 0.80)]
    over = ramp(score_t)
    blue = (0.15, 0.27, 0.42)
    return tuple(
        F.when(water, blue[c] * (0.5 + 0.5 * shade)).when(dead, base[c] * 0.9).otherwise(base[c] * (1 - alpha) + over[c] * alpha * (0.35 + 0.65 * shade)) for c in range(3)
    )


def reach_pixel(metres: Column, low: float, high: float) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue and opacity, 0 to 255, of a reach on the square-root ramp; nothing where it is not above 0."""
    t = F.sqrt(clip((metres - low) / max(high - low, 1e-9), 0.0, 1.0))
    colour = [F.floor(c * 255 + 0.5).cast("int") for c in ramp(t, REACH)]
    return *colour, F.when(metres > 0, F.floor((0.22 + 0.72 * t) * 255 + 0.5).cast("int")).otherwise(0)
