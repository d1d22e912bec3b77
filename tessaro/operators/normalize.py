"""Column normalisers: min-max, 0-max, z-score, robust, log, Box-Cox, and their inversions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import quantiles

METHODS = ("minmax", "0-max", "zscore", "robust", "log", "boxcox")


def boxcox_lambda(df: DataFrame, column: str, lo: float = -5.0, hi: float = 5.0, grid: int = 41, rounds: int = 4) -> tuple[float, float]:
    """(the maximum-likelihood lambda, the geometric mean); each round is one aggregate over a grid that closes in.

    Values are divided by their geometric mean first, which changes no likelihood but
    keeps large powers apart from each other.
    """
    x = df.select(F.when(F.col(column) == 0, 1e-6).otherwise(F.col(column).cast("double")).alias("x")).where("x > 0")
    mean = x.agg(F.avg(F.log("x"))).first()[0]
    if mean is None:
        return 1.0, 1.0
    centre = math.exp(mean)
    x = x.select((F.col("x") / F.lit(centre)).alias("x"))
    for _ in range(rounds):
        lams = np.linspace(lo, hi, grid)
        row = x.agg(*[F.var_pop(_power("x", float(la))).alias(f"v{i}") for i, la in enumerate(lams)]).first()
        like = [-math.log(row[f"v{i}"]) if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) else -math.inf for i in range(grid)]
        best = int(np.argmax(like))
        lo, hi = lams[max(0, best - 1)], lams[min(grid - 1, best + 1)]
    return float((lo + hi) / 2), centre


def _power(x, la: float):
    """The Box-Cox transform up to a constant."""
    return F.log(x) if abs(la) < 1e-9 else F.pow(x, F.lit(la)) / F.lit(la)


def normalize(df: DataFrame, column: str, method: str, name: str | None = None) -> DataFrame:
    """``column`` as 0 to 1 in ``name``; prefix ``inverted_`` gives 1 - x. Constant columns are 0 either way.

    One aggregate of a single row is joined to the table; the exact quartiles of
    ``robust`` come from counts within value ranges.
    """
    inverted, base = method.startswith("inverted_"), method.removeprefix("inverted_")
    if base not in METHODS:
        raise ValueError(f"unknown method: {method}")
    v = F.col(column).cast("double")
    if base == "log":
        t = F.log1p(v)
    elif base == "boxcox":
        la, centre = boxcox_lambda(df, column)
        t = _power(F.when(v == 0, 1e-6).otherwise(v) / F.lit(centre), la)
    elif base == "zscore":
        t = v
    else:
        t = v
    if base == "robust":
        q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        one = df.sparkSession.createDataFrame([(median, None if q1 is None else q3 - q1)], "_lo double, _d double")
    elif base == "0-max":
        one = df.agg(F.lit(0.0).alias("_lo"), F.max(t).alias("_d"))
    elif base == "zscore":  # scaling to 0..1 undoes mean and deviation; a constant column has none
        one = df.agg(F.min(t).alias("_lo"), (F.max(t) - F.min(t)).alias("_d"))
    else:
        one = df.agg(F.min(t).alias("_lo"), (F.max(t) - F.min(t)).alias("_d"))
    y = F.try_divide(t - F.col("_lo"), F.col("_d"))
    if base == "robust":
        y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    y = F.when(F.col("_d") == 0, 0.0).when(v.isNull(), F.lit(None).cast("double")).otherwise(F.lit(1.0) - y if inverted else y)
    return df.join(F.broadcast(one)).withColumn(name or column, y).drop("_lo", "_d")


def normalize_columns(df: DataFrame, methods: dict[str, str], decimals: int = 2) -> DataFrame:
    """Each column by its own method, rounded."""
    for c, m in methods.items():
        df = normalize(df, c, m).withColumn(c, F.round(c, decimals))
    return df
