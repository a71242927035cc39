"""Table functions for SQL: ``FROM places, LATERAL rays(reach)`` and ``LATERAL sun_day(day, lat, lon)``."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from overlook.functions.sun import arc
from overlook.operators.viewshed import radial_steps

_RAY = StructType([StructField("step", IntegerType()), StructField("d", DoubleType())])


class Rays:
    """The sample distances of a ray of ``reach`` metres; none for a null or a reach that is not positive."""

    def eval(self, reach: float) -> Iterator[tuple[int, float]]:
        if reach is not None and reach > 0:
            yield from enumerate(radial_steps(float(reach)))


_SUN = StructType([StructField("minute", IntegerType()), *(StructField(c, DoubleType()) for c in ("geometric", "elevation", "azimuth"))])


class SunDay:
    """Where the sun stands at each minute of a UTC day, 0 to 1440: geometric and refracted elevation, azimuth, in degrees; none for a null."""

    def eval(self, day: datetime.date, lat: float, lon: float) -> Iterator[tuple[int, float, float, float]]:
        if day is not None and lat is not None and lon is not None:
            yield from zip(range(1441), *(c.tolist() for c in arc((day - datetime.date(1970, 1, 1)).days, np.arange(1441), float(lat), float(lon))))


def register(spark: SparkSession) -> None:
    """Make ``rays(reach)`` and ``sun_day(day, lat, lon)`` known to the session's SQL."""
    spark.udtf.register("rays", udtf(Rays, returnType=_RAY))
    spark.udtf.register("sun_day", udtf(SunDay, returnType=_SUN))
