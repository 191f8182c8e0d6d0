"""Geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111320.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres, rounded half to even."""
    return F.rint(haversine_km(lat1, lon1, lat2, lon2) * 1000).cast("int")


def finite_coords(lat: Column, lon: Column) -> Column:
    """Whether both cast to finite numbers within range.  NaN compares above all numbers, so it is tested for."""
    a, b = (c.try_cast("double") for c in (lat, lon))
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & a.between(-90, 90) & b.between(-180, 180), F.lit(False))


def symmetrised(there: Column, back: Column) -> Column:
    """Mean of both directions; the one that is known; or null."""
    return F.coalesce((there + back) / 2.0, there.cast("double"), back.cast("double"))


def travel_seconds(metres: Column, kmh: float) -> Column:
    return F.rint(metres / F.lit(kmh * 1000 / 3600)).cast("int")


def exact_capacity(n: Column, vehicles: Column) -> Column:
    """The cap that allows only the even split: ceil(n / vehicles), 0 without vehicles."""
    return F.when(vehicles <= 0, 0).otherwise(F.ceil(n / vehicles)).cast("int")


def order_runs(jobs: Column, vehicles: Column) -> Column:
    """How many job orders a joint solve tries."""
    return F.when(vehicles <= 1, 1).when(jobs <= 40, 5).otherwise(3)


def enclave_thresholds(n: Column, ratios=(0.0, 0.05, 0.10), cap: float = 0.15) -> Column:
    """Rising levels of enclaves that are allowed, none above the cap."""
    top = F.ceil(n * cap).cast("int")
    return F.concat(F.transform(F.array(*map(F.lit, ratios)), lambda r: F.least(F.ceil(r * n).cast("int"), top)), F.array(top))


def enclave_level(enclaves: Column, n: Column, cap: float = 0.15) -> Column:
    """The number, from 0, of the first threshold that isn't below the enclaves, or null."""
    thresholds = enclave_thresholds(n, cap=cap)
    below = F.size(F.filter(thresholds, lambda t: t < enclaves))
    return F.when(below < F.size(thresholds), below)
