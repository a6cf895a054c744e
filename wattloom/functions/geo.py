"""Geometry and line-parameter expressions on lon/lat degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Length of a degree in km, degrees per km for scattering, metres per degree.
KM_PER_DEGREE = 111.0
DEGREES_PER_KM = 0.009
METRES_PER_DEGREE = 111000.0

# Lower voltage bound in kV, then ohm per km.
RESISTANCE_BANDS = ((380.0, 0.05), (220.0, 0.1), (None, 0.2))
REACTANCE_BANDS = ((380.0, 0.25), (220.0, 0.3), (None, 0.35))


def parse_polyline(c: Column) -> Column:
    """Text `[[lon, lat], ...]` to points; null if it does not parse or a point is incomplete."""
    points = F.from_json(c, "array<array<double>>", {"mode": "PERMISSIVE"})
    sound = (F.size(points) >= 1) & F.forall(points, lambda p: F.size(p) >= 2)
    return F.when(
        sound, F.transform(points, lambda p: F.struct(p.getItem(0).alias("x"), p.getItem(1).alias("y")))
    )


def end_points(points: Column) -> tuple[Column, Column]:
    """First and last point of a polyline with two points or more."""
    line = F.when(F.size(points) >= 2, points)
    return F.try_element_at(line, F.lit(1)), F.try_element_at(line, F.lit(-1))


def polyline_length_km(points: Column) -> Column:
    """Sum of the segment lengths in degrees, times 111 km; 0 for a missing line or a single point."""
    n = F.size(points)
    segments = F.zip_with(
        F.slice(points, 1, n - 1),
        F.slice(points, 2, n - 1),
        lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)),
    )
    degrees = F.aggregate(segments, F.lit(0.0), lambda acc, d: acc + d)
    return F.when(n >= 2, degrees * KM_PER_DEGREE).otherwise(F.lit(0.0))


def _banded(voltage_kv: Column, bands) -> Column:
    expr = None
    for bound, value in bands:
        if bound is None:
            return expr.otherwise(F.lit(value))
        hit = voltage_kv >= bound
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr


def resistance_per_km(voltage_kv: Column) -> Column:
    return _banded(voltage_kv, RESISTANCE_BANDS)


def reactance_per_km(voltage_kv: Column) -> Column:
    return _banded(voltage_kv, REACTANCE_BANDS)


def _unit_uniform(*parts: Column) -> Column:
    """A repeatable U[0,1) from a digest of its arguments: 52 bits, the same on every retry."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def jitter_offset(key: Column, km: float, seed: int = 0) -> tuple[Column, Column]:
    """Offsets uniform in a circle of radius `km`, fixed by `key` and `seed`."""
    angle = _unit_uniform(key, F.lit(seed), F.lit("angle")) * F.lit(2.0) * F.pi()
    radius = F.sqrt(_unit_uniform(key, F.lit(seed), F.lit("radius"))) * F.lit(km * DEGREES_PER_KM)
    return radius * F.cos(angle), radius * F.sin(angle)
