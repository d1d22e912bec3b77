"""Numeric expressions: flags, bands, weighted scores, slope-adjusted distances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the score bands and their names.
BANDS = ((20, "very_low"), (40, "low"), (60, "medium"), (80, "high"))
TOP_BAND = "very_high"


def clean(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def band(v: Column) -> Column:
    """Right-closed bands of twenty points; null stays null."""
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for end, name in BANDS:
        out = out.when(v <= end, name)
    return out.otherwise(TOP_BAND)


def row_mean(columns: list[Column]) -> Column:
    """The mean of what is not null in a row; null if nothing is."""
    total = reduce(add, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns))
    return F.try_divide(total, reduce(add, (c.isNotNull().cast("double") for c in columns)))


def row_sum(columns: list[Column]) -> Column:
    return reduce(add, (F.coalesce(c, F.lit(0)) for c in columns))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null, their weights scaled to one; else null."""
    top = reduce(add, (F.coalesce(c, F.lit(0.0)) * F.lit(float(w)) for c, w in parts))
    return F.try_divide(top, reduce(add, (c.isNotNull().cast("double") * F.lit(float(w)) for c, w in parts)))


def linear_score(weights: dict[str, float]) -> Column:
    """Weighted sum of columns; those of weight 0 aren't read."""
    return reduce(add, (F.col(c) * F.lit(float(w)) for c, w in weights.items() if w))


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy in bits of a row's category shares, two decimals; 0 for an empty row."""
    total = row_sum(counts).cast("double")
    share = [F.try_divide(F.coalesce(c, F.lit(0)).cast("double"), total) for c in counts]
    bits = reduce(add, (F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share))
    return F.round(F.coalesce(bits, F.lit(0.0)), 2)


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(v, F.lit(hi)), F.lit(lo))


def pct_to_absolute(pct: Column, population: Column) -> Column:
    return pct * population / 100


def index_to_absolute(per_thousand: Column, population: Column, decimals: int = 2) -> Column:
    return F.round(per_thousand * population / 1000, decimals)


def impute_censored(value: Column, keys: list[Column], mark: str = "..", top: int = 5) -> Column:
    """Censored counts as 0 to ``top``, by a hash of the keys: the same at every run."""
    return F.when(value == mark, F.pmod(F.xxhash64(*keys), F.lit(top + 1))).otherwise(value.try_cast("bigint"))


def elevation_piecewise(distance: Column, elevation: Column) -> Column:
    """Distance adjusted for climb and descent.

    Fixed values: 8 m per metre of climb; 2000 m per 300 m of descent, added
    below a slope of -12 % and taken off from -5 % on.
    """
    per_metre = F.lit(2000 / 300)
    slope = F.try_divide(elevation, distance) * 100
    return (
        F.when(elevation > 0, distance + elevation * 8)
        .when((elevation < 0) & (slope < -12), distance - elevation * per_metre)
        .when((elevation < 0) & (slope >= -5), distance + elevation * per_metre)
        .otherwise(distance)
    )


def elevation_parkin(distance: Column, elevation: Column) -> Column:
    """Equivalent flat distance by speeds on slopes (Parkin and Rotheram 2010).

    Fixed values: 6.01 m/s on the flat, -40.02 and -23.79 m/s per unit of slope
    up and down, slopes within 10 %, 0.1 m/s at least.
    """
    slope = clip(F.when(distance > 0, F.try_divide(elevation, distance)).otherwise(0.0), -0.10, 0.10)
    speed = F.lit(6.01) + F.lit(-40.02) * F.greatest(slope, F.lit(0.0)) + F.lit(-23.79) * F.least(slope, F.lit(0.0))
    return distance / F.greatest(speed, F.lit(0.1)) * F.lit(6.01)


def scale(v: Column, lo: Column, hi: Column) -> Column:
    """v between its bounds as 0 to 1; equal bounds give 0."""
    return F.when(hi == lo, F.lit(0.0)).otherwise(F.try_divide(v - lo, hi - lo))


def mix_metrics(dispersion: Column, accessibility: Column, alpha: float) -> Column:
    """alpha weighs the (inverted, scaled) dispersion, its complement the accessibility."""
    return F.lit(alpha) * dispersion + F.lit(1 - alpha) * accessibility


def combine(node: Column, graph: Column, how: str = "multiply", power: float = 1.0) -> Column:
    """A node score and a graph score as one: multiply, exponential or power_penalty."""
    if how == "multiply":
        return node * graph
    if how == "exponential":
        return F.pow(node, graph)
    if how == "power_penalty":
        return node * F.pow(graph, F.lit(power))
    raise ValueError(f"unknown combination: {how}")
