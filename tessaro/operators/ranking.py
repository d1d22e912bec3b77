"""Tie-aware percentiles and ranks without a window over the whole table.

A rank needs only the number of smaller values, so distinct values are counted
first (a partial aggregate), the counts are summed up within value ranges and
over the ranges, and joined back. No task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges in which running counts are taken, at least and at most; between, one for each ``PER_RANGE`` rows.
RANGES, MOST_RANGES, PER_RANGE = 32, 1024, 1_000_000


def _edges(df: DataFrame, columns: list[str], ranges: int | None) -> dict[str, list[float]]:
    """The upper ends of each column's ranges but the last, from one aggregate; ranges grow in number with the table."""
    probs = ", ".join(f"{i / MOST_RANGES}D" for i in range(1, MOST_RANGES))
    v = {c: f"nanvl(cast(`{c}` as double), cast(null as double))" for c in columns}
    row = df.selectExpr(*[x for i, c in enumerate(columns) for x in (f"count({v[c]}) as n{i}", f"percentile_approx({v[c]}, array({probs}), {4 * MOST_RANGES}) as q{i}")]).first()
    out = {}
    for i, c in enumerate(columns):
        k = ranges or min(MOST_RANGES, max(RANGES, row[f"n{i}"] // PER_RANGE))
        q = row[f"q{i}"] or []
        out[c] = sorted(e for e in {q[j * MOST_RANGES // k - 1] for j in range(1, k)} if abs(e) < float("inf")) if q else []
    return out


def ranks_of(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """name, v, ties, below (rows with a smaller value) and total of each column's distinct values, all in one long table."""
    edges = _edges(df, columns, ranges)
    listed = ", ".join(f"'{i}', cast(array({', '.join(f'{e!r}D' for e in edges[c])}) as array<double>)" for i, c in enumerate(columns))
    lookup = F.expr(f"map({listed})")  # one expression, however many ranges
    pair = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(pair)).where("v is not null and not isnan(v)").groupBy("name", "v").agg(F.count("*").alias("ties"))
    counts = counts.withColumn("part", F.size(F.filter(lookup[F.col("name")], lambda e: e < F.col("v"))))
    parts = counts.groupBy("name", "part").agg(F.sum("ties").alias("n"))  # as many rows as there are ranges
    w = Window.partitionBy("name")
    parts = parts.select("name", "part", F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    inside = Window.partitionBy("name", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("inside", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(F.broadcast(parts), ["name", "part"])
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(names[F.col("name").cast("int")].alias("name"), "v", "ties", (F.col("before") + F.col("inside")).alias("below"), "total")


def value_ranks(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """v, ties, below (rows with a smaller value) and total for each distinct value that is not null."""
    return ranks_of(df, [column], ranges).drop("name")


def percentile_scores(df: DataFrame, key: str, specs: list[tuple[str, str, bool]], ranges: int | None = None) -> DataFrame:
    """:func:`percentile_score` of many columns (column, name, higher is better) at once.

    All columns are ranked in long form, so one aggregate and one join serve
    them all however many there are. ``key`` is unique.
    """
    columns = list(dict.fromkeys(c for c, _, _ in specs))
    r = ranks_of(df, columns, ranges)
    mid = F.when(F.col("total") == 1, 1.0).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("total") - 1))
    pair = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(key, F.inline(pair)).where("v is not null and not isnan(v)")
    got = long.join(r.select("name", "v", mid.alias("s"), (F.col("total") == 1).alias("one")), ["name", "v"])
    pick = [F.max(F.when(F.col("name") == c, F.col("s") if up else F.when(F.col("one"), 1.0).otherwise(F.lit(1.0) - F.col("s")))).alias(n) for c, n, up in specs]
    return df.join(got.groupBy(key).agg(*pick), key, "left")


def mid_ranks(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """:func:`mid_rank` of many columns as prefix + column; one aggregate ranks them all."""
    r = ranks_of(df, columns)
    for c in columns:
        one = r.where(F.col("name") == c).select(F.col("v").alias("_v"), (F.col("below") + (F.col("ties") + 1) / 2).alias(f"{prefix}{c}"))
        df = df.join(one, F.col(c).cast("double") == F.col("_v"), "left").drop("_v")
    return df


def percentile_score(df: DataFrame, column: str, name: str, higher_is_better: bool = True, ranges: int | None = None) -> DataFrame:
    """(average rank - 1) / (n - 1) as 0 to 1 among values that are not null; a single value is 1."""
    r = value_ranks(df, column, ranges)
    mid = F.when(F.col("total") == 1, 1.0).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("total") - 1))
    if not higher_is_better:
        mid = F.when(F.col("total") == 1, 1.0).otherwise(F.lit(1.0) - mid)
    r = r.select(F.col("v").alias("_v"), mid.alias(name))
    return df.join(r, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")


def competition_rank(df: DataFrame, column: str, name: str, ranges: int | None = None) -> DataFrame:
    """1 for the largest value; ties share the smallest rank; null stays null."""
    r = value_ranks(df, column, ranges).select(F.col("v").alias("_v"), (F.col("total") - F.col("below") - F.col("ties") + 1).alias(name))
    return df.join(r, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")


def rank_and_percentile(df: DataFrame, column: str, rank: str, percentile: str, ranges: int | None = None) -> DataFrame:
    """:func:`competition_rank` and :func:`percentile_score` of one column from the same counts."""
    r = value_ranks(df, column, ranges)
    mid = F.when(F.col("total") == 1, 1.0).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("total") - 1))
    r = r.select(F.col("v").alias("_v"), (F.col("total") - F.col("below") - F.col("ties") + 1).alias(rank), mid.alias(percentile))
    return df.join(r, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")


def mid_rank(df: DataFrame, column: str, name: str, ranges: int | None = None) -> DataFrame:
    """The average rank of ties, from 1."""
    r = value_ranks(df, column, ranges).select(F.col("v").alias("_v"), (F.col("below") + (F.col("ties") + 1) / 2).alias(name))
    return df.join(r, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")


def top(df: DataFrame, n: int, by: list[Column]) -> DataFrame:
    """The first ``n`` rows; ``by`` should end with a unique column."""
    return df.orderBy(*by).limit(n)


def natural_line_order(c: Column) -> list[Column]:
    """Sort keys for line names: letters, then the number, then the text."""
    from ..functions.text import line_letters, line_number

    return [line_letters(c).asc(), line_number(c).asc_nulls_first(), c.asc()]
