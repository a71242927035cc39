"""Directions: wedges of the compass as conditions, bin lists and bit masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AZIMUTHS = 32


def in_wedge(degrees: Column, start, end) -> Column:
    """Clockwise from start to end, both included, across north if need be; ends are taken modulo 360, so (0, 360) is north alone."""
    az, a, b = (F.pmod(x, F.lit(360.0)) for x in (degrees, F.lit(float(start)), F.lit(float(end))))
    return F.when(a <= b, (az >= a) & (az <= b)).otherwise((az >= a) | (az <= b))


def on_wheel(degrees: Column, start, end) -> Column:
    """The wheel's rule: equal ends, and spans of 359.8 degrees and more, are the whole circle."""
    span = F.pmod(F.lit(float(end) - float(start)), F.lit(360.0))
    span = F.when(span == 0, 360.0).otherwise(span)
    return (span >= 359.8) | (F.pmod(degrees - float(start), F.lit(360.0)) <= span)


class Wheel:
    """The two handles of a wheel, snapped half way between bins; equal handles are moved one bin apart."""

    def __init__(self, start: float = 0.0, end: float = 0.0, snap: bool = False, azimuths: int = AZIMUTHS):
        self.step = 360 / azimuths
        self.azimuths = azimuths
        self.start, self.end = (self.snapped(start), self.snapped(end)) if snap else (start % 360, end % 360)
        if snap and self.start == self.end:
            self.end = self.snapped(self.start + self.step)

    def snapped(self, degrees: float) -> float:
        half = self.step / 2
        return (math.floor((degrees - half) / self.step + 0.5) * self.step + half) % 360

    @property
    def span(self) -> float:
        return (self.end - self.start) % 360 or 360.0

    def bins(self) -> list[int]:
        """The azimuth bins it covers: a handful of numbers, so they become literals of the plan."""
        return [b for b in range(self.azimuths) if self.span >= 359.8 or (b * self.step - self.start) % 360 <= self.span]

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bins())


def bins_between(start: float, end: float, azimuths: int = AZIMUTHS) -> list[int]:
    """Bins of ``in_wedge``, as literals."""
    a, b, step = start % 360, end % 360, 360 / azimuths
    return [i for i in range(azimuths) if (a <= i * step <= b if a <= b else i * step >= a or i * step <= b)]


def picked(values: Column, bins: list[int]) -> Column:
    """The elements of an array at ``bins``."""
    return F.array(*[F.get(values, F.lit(b)) for b in bins])


def mean_of(values: Column, bins: list[int]) -> Column:
    chosen = [F.get(values, F.lit(b)).cast("double") for b in bins]
    return sum(chosen[1:], chosen[0]) / F.lit(float(len(bins)))


def sees_water(mask: Column, bins: list[int]) -> Column:
    """Whether any of the bins' bits is set."""
    return mask.bitwiseAND(F.lit(sum(1 << b for b in bins))) != 0


def has_far_water(water_far: Column, least: float = 0.0) -> Column:
    """Whether any direction has water at ``least`` metres or more, one metre at least."""
    return F.exists(water_far, lambda x: x >= max(float(least), 1.0))


class Band:
    """A band of reach in km: handles stay 0.2 apart, and a top handle at the end of the scale means no upper bound."""

    def __init__(self, low: float = 0.0, high: float = 20.0, top: float = 20.0, gap: float = 0.2):
        self.top, self.gap = top, gap
        self.low, self.high = min(low, high - gap), high

    def move_low(self, value: float) -> None:
        self.low = min(value, self.high - self.gap)

    def move_high(self, value: float) -> None:
        self.high = max(value, self.low + self.gap)

    @property
    def open(self) -> bool:
        return self.high >= self.top - 1e-9

    def holds(self, metres: Column) -> Column:
        low = metres >= self.low * 1000
        return low if self.open else low & (metres <= self.high * 1000)
