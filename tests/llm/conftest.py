import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Builds a documents table of (doc_id, text[, source]) with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def build(rows):
        rows = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        for c in ("key", "hash", "row", "score", "owner", "kept", "band", "packer", "spans", "id", "start"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return build


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
