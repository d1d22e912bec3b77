"""Small helpers on input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    ``pick(df, doc_id="id", text="body")``: whatever other columns ``df`` has, and
    however they are called, they cannot clash with an operator's own columns.
    """
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def crc_mod(col, m: int):
    """crc32 of the column's text, modulo ``m``."""
    return F.crc32(col.cast("string").cast("binary")) % m


#: Parts that the rows of a key with several rows are dealt into.
SALTS = 16


def join_to_copies(rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, ...) with what ``per_key`` (key, owner, n, ...) has of their keys; a left join without hot keys.

    n: how many rows have the key. The only row of a key is its owner's, so its part
    is known; of other keys each part gets a copy.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = per_key.withColumn("salt", F.explode(F.when(F.col("n") == 1, F.array(part("owner"))).otherwise(every))).drop("n")
    return rows.withColumn("salt", part("doc_id")).join(dealt, ["key", "salt"], "left").drop("salt")
