"""Distances, uncertainty and what a time difference lets one say about a place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Metres per second, least and largest radius in metres.
SPEED, LEAST_M, MOST_M = 6.0, 15.0, 50_000.0
#: Seconds within which each granularity holds, coarse to fine.
WINDOWS = (("country", 43_200.0), ("region", 7_200.0), ("city", 600.0))
SHORT_S, FILE_TIME_FACTOR = 120.0, 0.6


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))  # least() would pass over a null


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_KM * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) on the WGS84 ellipsoid; a degree of longitude is at least a metre."""
    p = F.radians(lat)
    north = 111_132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    east = 111_412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return north, F.greatest(east, F.lit(1.0))


def uncertainty_m(delta_s: Column) -> Column:
    return F.least(F.lit(MOST_M), F.greatest(F.lit(LEAST_M), SPEED * F.abs(delta_s)))


def reliable_fields(delta_s: Column, file_time: Column) -> Column:
    """(field, factor) of each granularity that holds at this time difference, coarse to fine."""
    def one(field: str, window: float) -> Column:
        factor = F.when(delta_s <= SHORT_S, 1.0).otherwise(1.0 - 0.4 * (delta_s - SHORT_S) / (window - SHORT_S))
        factor = factor * F.when(file_time, FILE_TIME_FACTOR).otherwise(1.0)
        return F.when(delta_s <= window, F.struct(F.lit(field).alias("field"), F.round(factor, 3).alias("factor")))

    return F.filter(F.array(*(one(f, w) for f, w in WINDOWS)), lambda x: x.isNotNull())
