"""Distances, vectors and intervals as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether [start, end) meets any of an array of struct(start, end)."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, half-even as reports print it; null for a zero whole."""
    return F.bround(F.try_divide(100.0 * part, whole), digits)
