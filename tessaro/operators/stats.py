"""Descriptive statistics: station aggregates, coverage, correlations, collinearity, errors."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import mid_ranks, ranks_of


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, coverage): the share of rows with a value, one pass for all columns."""
    one = df.agg(*[(F.count(c) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "coverage")


def correlation(df: DataFrame, a: str, b: str, min_pairs: int = 10) -> DataFrame:
    """One row: n, pearson, spearman over the rows with both values; null below ``min_pairs``."""
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    ranked = mid_ranks(both, ["a", "b"], "r")  # both sets of ranks come from the pairs themselves
    enough = F.count("*") >= min_pairs
    return ranked.agg(F.count("*").alias("n"), F.when(enough, F.corr("a", "b")).alias("pearson"), F.when(enough, F.corr("ra", "rb")).alias("spearman"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, r): Pearson for all pairs in one aggregate, pairwise complete."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, r): Spearman on rows without nulls."""
    full = df.select(*columns).dropna()
    full = mid_ranks(full, columns, "_r_")
    pairs = correlation_pairs(full, [f"_r_{c}" for c in columns])
    return pairs.select(F.expr("substring(feature_a, 4)").alias("feature_a"), F.expr("substring(feature_b, 4)").alias("feature_b"), "r")


def gram(df: DataFrame, columns: list[str], centred: bool = False) -> np.ndarray:
    """X'X (or the correlation matrix) from one aggregate; k * k numbers reach the driver."""
    k = len(columns)
    cols = [F.col(c).cast("double") for c in columns]
    agg = (lambda x, y: F.corr(x, y)) if centred else (lambda x, y: F.sum(x * y))
    row = df.agg(*[agg(cols[i], cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.eye(k)
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] if row[f"g{i}_{j}"] is not None else 0.0
    return g


def vif(df: DataFrame, columns: list[str], centred: bool = False) -> DataFrame:
    """(feature, vif), the largest first; medians fill nulls, constant columns are left out.

    Regressions have no intercept unless ``centred``.
    """
    med = {c: q[0] for c, q in quantiles(df, columns, [0.5]).items()}
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).first()
    use = [c for c in columns if ends[f"lo_{c}"] is not None and ends[f"lo_{c}"] < ends[f"hi_{c}"]]
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))).alias(c) for c in use])
    g = gram(filled, use, centred)
    values = np.diag(g) * np.diag(np.linalg.pinv(g)) if len(use) else []
    rows = sorted(((c, float(v)) for c, v in zip(use, values)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, of all columns from one table of rank counts.

    Distinct values are counted and summed up within ranges (``ranks_of``), so no
    task gets a whole column; only the values at the wanted places reach the driver.
    """
    place = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    r = ranks_of(df, columns).select("name", "v", "below", "ties", "total", place.alias("p"))
    at = F.col("p") * (F.col("total") - 1)
    lo = (F.col("below") <= F.floor(at)) & (F.floor(at) < F.col("below") + F.col("ties"))
    hi = (F.col("below") <= F.ceil(at)) & (F.ceil(at) < F.col("below") + F.col("ties"))
    got = r.groupBy("name", "p").agg(F.max(F.when(lo, F.col("v"))).alias("lo"), F.max(F.when(hi, F.col("v"))).alias("hi"), F.max(at - F.floor(at)).alias("f")).collect()
    found = {(x["name"], x["p"]): x["lo"] + (x["hi"] - x["lo"]) * x["f"] for x in got}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}


def quartile_fences(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, IQR and Tukey fences with linear interpolation; one row."""
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    iqr = None if q1 is None else q3 - q1
    row = (q1, median, q3, iqr, None if q1 is None else q1 - 1.5 * iqr, None if q1 is None else q3 + 1.5 * iqr)
    return df.sparkSession.createDataFrame([row], "q1 double, median double, q3 double, iqr double, lower double, upper double")


def errors(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """n, MAE, RMSE and R2, per group if asked."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"),
    )


def length_summary(df: DataFrame, column: str) -> DataFrame:
    """min, max, number and the first ten of the distinct text lengths."""
    n = F.length(F.col(column).cast("string"))
    sizes = F.array_sort(F.collect_set(n))
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count_distinct(n).alias("n_lens"), F.array_join(F.slice(sizes, 1, 10), ",").alias("lens"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, n) of equal-width bins; the last one holds the maximum."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null").join(F.broadcast(ends))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))))
    return v.groupBy(at.cast("int").alias("bin")).agg(F.min(F.col("lo") + (F.col("hi") - F.col("lo")) / bins * at).alias("lower"), F.count("*").alias("n"))
