"""Documents to packed sequences in five stages.

Each stage gets everything its predecessor kept, as a written table, and
returns the columns of ``documents`` again; the last one returns pieces. For
all stages: an empty table gives an empty one, columns other than those of
``documents`` are not looked at, and rows with a null doc_id are handled like
others unless a stage says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaro.llm import decontaminate, langid, minhash, packing, secrets, spans, storage
from tessaro.llm.tables import pick
from tessaro.session import table, worker_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in no language: null and empty texts, and texts without letters.

    Every other text has a language, whichever ones the corpus has labels of, or
    none. Repeated rows all stay or all go.
    """
    found = langid.identify(docs, carry=COLUMNS).where("has_letters")
    return found.select(*(F.col(f"in_{c}").alias(c) for c in COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Null and wordless texts are near nothing. Of rows that repeat a doc_id and its
    text the one with the smallest lang, source and n_chars stays (nulls first);
    rows that repeat a doc_id with another text are decided on their own. Rows
    with a null doc_id all stay, for nothing tells them apart.
    """
    docs = _documents(docs)
    found = storage.materialise(minhash.near_duplicates(docs), "groups")
    gone = found.where("not kept").select("doc_id", "digest").distinct()
    twice = found.where("kept and doc_id is not null").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    left = docs.withColumn("digest", F.xxhash64("text")).join(gone, ["doc_id", "digest"], "left_anti")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    if twice.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(twice, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r"))
    return left.join(twice, ["doc_id", "digest"], "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", "r.*").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; rows with a null doc_id stay."""
    docs = _documents(docs)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


@F.pandas_udf(T.StringType())
def _masked(text: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else spans.replace(t, [(s["start"], s["end"], "secret") for s in f]) for t, f in zip(text, found)])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the scan finds is replaced, and n_chars follows; rows without one stay as they are."""
    docs = _documents(docs)
    found = secrets.scan_secrets(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("of"), F.col("digest").alias("of_text"), "found").dropDuplicates(["of", "of_text"])
    out = docs.withColumn("digest", F.xxhash64("text"))
    out = out.join(found, out["doc_id"].eqNullSafe(found["of"]) & (out["digest"] == found["of_text"]), "left")
    clean = F.col("found").isNull()
    out = out.withColumn("masked", _masked(F.when(~clean, F.col("text")), F.col("found")))  # texts of clean rows stay in the JVM
    return out.select(
        "doc_id", F.coalesce("masked", "text").alias("text"), "lang", "source",
        F.when(clean, F.col("n_chars")).otherwise(F.length("masked").cast("long")).alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of 1024 tokens; a null text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage before the last can be told in SQL: a trained network and hash signatures decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage kept is written before the next one reads it, and its own tables go."""
    worker_path(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with storage.scratch(name):
            docs = storage.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
