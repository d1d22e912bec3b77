"""Joins on cleaned keys, duplicate handling, set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import numeric_columns


def inner_on_key(left: DataFrame, right: DataFrame, key: str, suffix: str = "_target") -> DataFrame:
    """Inner join on the trimmed text of a key; columns of ``right`` that ``left`` has too are dropped."""
    clash = [c for c in right.columns if c in left.columns and c != key]
    clean = lambda df: df.withColumn(key, F.trim(F.col(key).cast("string")))
    return clean(left).join(clean(right.drop(*clash)), key, "inner")


def collapse(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: numbers by mean, others by the first value that is not null in ``order``."""
    numbers = set(numeric_columns(df))
    aggs = []
    for c in df.columns:
        if c == key:
            continue
        if c in numbers and c != order:
            aggs.append(F.avg(c).alias(c))
        elif order and c != order:
            aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
        else:
            aggs.append(F.min(c).alias(c))
    return df.groupBy(key).agg(*aggs)


def left_section_join(base: DataFrame, table: DataFrame, key: str, normalise) -> DataFrame:
    """Left join on a normalised key; rows without a key and duplicates of the right side can't multiply rows."""
    right = collapse(table.withColumn(key, normalise(F.col(key))).where(F.col(key).isNotNull()), key)
    right = right.drop(*[c for c in right.columns if c in base.columns and c != key])
    return base.withColumn(key, normalise(F.col(key))).join(right, key, "left")


def full_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer joins on one key, one after another."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def latest(df: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key; a null time counts as the newest. One aggregate: a hot key is a partial maximum in each task."""
    by = F.struct(F.col(order).isNull(), F.col(order), *([F.col(tie)] if tie else []))
    return _one_per_key(df, keys, F.max_by, by)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest in the order of some columns (nulls first); further ties are broken by the other columns."""
    rest = [F.col(c) for c in df.columns if c not in keys and not df.schema[c].dataType.typeName() == "map"]
    return _one_per_key(df, keys, F.min_by, F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, *rest])]))


def _one_per_key(df: DataFrame, keys: list[str], pick, by: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_r")).select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once, with their count; counts are aggregated before they are joined back."""
    more = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(more, same).drop(*[f"_{k}" for k in keys])


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows in duplicated keys, duplicated keys, surplus rows. Grouping needs no window."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    none = F.lit(0).cast("long")
    return g.agg(
        F.coalesce(F.sum("n"), none).alias("rows_in_duplicates"),
        F.count("*").alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), none).alias("surplus_rows"),
    )


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner; null keys match null keys."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return left.join(r, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key_l: str, key_r: str) -> DataFrame:
    """One row: distinct keys of each side that the other lacks, and common ones."""
    a = left.select(F.col(key_l).alias("k")).distinct().withColumn("a", F.lit(1))
    b = right.select(F.col(key_r).alias("k")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))


#: Groups whose pairs are listed, at most.
MAX_GROUPS = 5_000


def pairwise_overlap(df: DataFrame, group: str, key: str) -> DataFrame:
    """Sizes, intersection, differences and shares of the key sets of each pair of groups.

    A key carries the list of its groups, so the pairs come from each key alone;
    no group meets another as a whole.
    """
    sets = df.select(group, key).where(F.col(key).isNotNull()).distinct()
    size = sets.groupBy(group).agg(F.count("*").alias("n"))
    if size.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: their pairs are no report any more")
    lists = sets.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pairs = lists.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    every = size.select(F.col(group).alias("a"), F.col("n").alias("n_a")).join(size.select(F.col(group).alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))
    out = every.join(pairs, ["a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0).cast("long")))
    return out.select(
        "a", "b", "n_a", "n_b", "n_both", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"),
        F.try_divide("n_both", "n_a").alias("share_a"), F.try_divide("n_both", "n_b").alias("share_b"),
    )


def synthetic_names(df: DataFrame, group: str, name: str, order: str, prefix: str = "helper") -> DataFrame:
    """Empty names become prefix_1, prefix_2, ... within each group."""
    empty = F.coalesce(F.trim(F.col(name)) == "", F.lit(True))
    n = F.row_number().over(Window.partitionBy(group, empty).orderBy(order))
    return df.withColumn(name, F.when(empty, F.concat(F.lit(f"{prefix}_"), n)).otherwise(F.col(name)))


def pivot_sum(df: DataFrame, key: str, category: str, values: list[str], amount: str, prefix: str = "") -> DataFrame:
    """Long to wide with a stated list of categories; missing cells are 0."""
    out = df.groupBy(key).agg(*[F.sum(F.when(F.col(category) == v, F.col(amount))).alias(f"{prefix}{v}") for v in values])
    return out.fillna(0, [f"{prefix}{v}" for v in values])


def share_of_group(df: DataFrame, keys: list[str], group: list[str], amount: str, name: str = "share") -> DataFrame:
    """Sums per key as a percentage of their group's total, one decimal."""
    g = df.groupBy(*keys).agg(F.sum(amount).alias(amount))
    total = F.sum(amount).over(Window.partitionBy(*group))
    return g.withColumn(name, F.round(F.try_divide(F.col(amount) * 100.0, total), 1))
