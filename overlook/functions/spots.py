"""Identity, links and share codes of saved spots."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlook.functions.geo import known

STOPS = 10
MAPS = "https://www.google.com/maps"
SPOTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("name", T.StringType())]))


def spot_id(lat: Column, lon: Column) -> Column:
    """Two coordinates of five decimals: places about a metre apart are one."""
    return F.concat_ws(",", F.format_string("%.5f", lat), F.format_string("%.5f", lon))


def is_spot(lat: Column, lon: Column) -> Column:
    return known(lat.cast("double")).isNotNull() & known(lon.cast("double")).isNotNull()


def search_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit(f"{MAPS}/search/?api=1&query="), spot_id(lat, lon))


def route_url(stops: Column) -> Column:
    """A drive through an ordered array of ``lat,lon`` texts: ten stops at most, the last is the destination; null for none."""
    first = F.slice(stops, 1, STOPS)
    there = F.element_at(first, -1)
    way = F.array_join(F.slice(first, 1, F.greatest(F.size(first) - 1, F.lit(0))), "|")
    url = F.concat(F.lit(f"{MAPS}/dir/?api=1&destination="), F.url_encode(there))
    return F.when(F.size(first) > 0, F.when(F.size(first) > 1, F.concat(url, F.lit("&waypoints="), F.url_encode(way))).otherwise(url))


def to_base64url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/\r\n", "-_"), "=+$", "")


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))), F.lit("base64"))


@F.pandas_udf(T.BinaryType())
def shorter_gzip(data: pd.Series) -> pd.Series:
    """Gzip where it is shorter, the bytes themselves otherwise."""

    def pick(b):
        if b is None:
            return None
        z = gzip.compress(b, mtime=0)
        return z if len(z) < len(b) else b

    return data.map(pick)


@F.pandas_udf(SPOTS)
def decode_spots(data: pd.Series) -> pd.Series:
    """Spots from a share code's bytes, gzip or not; a damaged one is an empty list."""

    def one(b):
        try:
            raw = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
            return [{"lat": float(t[0]), "lon": float(t[1]), "name": str(t[2]) if len(t) > 2 and t[2] else ""} for t in json.loads(raw)]
        except Exception:  # whatever a mangled link holds
            return []

    return data.map(one)


def encode_share(spots: Column) -> Column:
    """A share code of an array of (lat, lon, name): compact JSON rows, gzip if shorter, base64url."""
    number = lambda x: F.regexp_replace(F.format_string("%.5f", x), r"\.?0+$", "")
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("n"))), r'^\{"n":(.*)\}$', 1)
    rows = F.transform(spots, lambda s: F.concat(F.lit("["), number(s["lat"]), F.lit(","), number(s["lon"]), F.lit(","), quoted(s["name"]), F.lit("]")))
    return to_base64url(shorter_gzip(F.encode(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")), "UTF-8")))


def decode_share(code: Column) -> Column:
    return decode_spots(from_base64url(code))


def share_url(base: Column, code: Column, parameter: str = "spots") -> Column:
    """``base`` with the code as its fragment, whatever fragment it had."""
    return F.concat(F.regexp_replace(base, "#.*$", ""), F.lit(f"#{parameter}="), code)


def share_code(url: Column, parameter: str = "spots") -> Column:
    """The code in a link's fragment; null if it has none."""
    found = F.regexp_extract(url, rf"#(?:.*&)?{parameter}=([^&]+)", 1)
    return F.when(found != "", found)
