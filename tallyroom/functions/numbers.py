"""Numeric column functions: rounding, clamping, decay, bands, distances, pay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Anchors of the monotone curve from coverage to a share of the score.
COVERAGE_CURVE = ((0.00, 0.00), (0.25, 0.08), (0.40, 0.28), (0.55, 0.60), (0.70, 0.77), (0.80, 0.90), (0.90, 0.96), (1.00, 1.00))
#: employee's rates and limits of a year.
PAY = {"cap": 282600.0, "pension": 0.0976, "disability": 0.015, "sickness": 0.0245, "health": 0.09, "costs": 250.0, "band": 120000.0, "low": 0.12, "high": 0.32, "relief": 3600.0}


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero; Spark's own round goes away from zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5).cast("double")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: it isn't a measured value."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def half_life(age: Column, half: float = 48.0) -> Column:
    """0.5 ** (age / half); null for a negative age."""
    return F.when(age >= 0, F.pow(F.lit(0.5), age / half))


def saturating_penalty(ratio: Column, most: float, scale: float) -> Column:
    return most * (1 - F.exp(-ratio / scale))


def piecewise(x: Column, anchors=COVERAGE_CURVE) -> Column:
    """Linear between anchors, flat outside of them."""
    out = F.lit(float(anchors[-1][1]))
    for (x1, y1), (x2, y2) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(x <= x2, y1 + (x - x1) / (x2 - x1) * (y2 - y1)).otherwise(out)
    return F.when(x <= anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out)


def smoothstep(x: Column, start: float = 0.45, full: float = 0.85) -> Column:
    t = clamp((x - start) / (full - start))
    return t * t * (3 - 2 * t)


def band(x: Column, limits: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the first limit, from the highest down, that x reaches; null for null."""
    return F.when(x.isNotNull(), reduce(lambda out, lim: F.when(x >= lim[0], F.lit(lim[1])).otherwise(out), sorted(limits), F.lit(lowest)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, one decimal."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return round_half_up(2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))), 1)


def monthly_net(gross: Column, p: dict[str, float] = PAY) -> Column:
    """Average monthly net pay from a monthly gross; not positive or null: 0."""
    year = gross * 12
    social = F.least(year, F.lit(p["cap"])) * (p["pension"] + p["disability"]) + year * p["sickness"]
    health = (year - social) * p["health"]
    base = F.greatest(F.lit(0.0), round_half_up(year - social - p["costs"] * 12))
    tax = F.when(base <= p["band"], base * p["low"]).otherwise(p["band"] * p["low"] + (base - p["band"]) * p["high"])
    tax = F.greatest(F.lit(0.0), round_half_up(tax - p["relief"]))
    net = round_half_up((year - social - health - tax) / 12, 2)
    return F.when(gross > 0, F.greatest(F.lit(0.0), net)).otherwise(F.lit(0.0))


def month_index(date: Column) -> Column:
    """year * 12 + month - 1."""
    return F.year(date) * 12 + F.month(date) - 1


def decimal_year(date: Column) -> Column:
    """A month counts as its middle."""
    return F.year(date) + (F.month(date) - 0.5) / 12
