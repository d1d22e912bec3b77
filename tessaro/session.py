"""Session helpers shared by all queries."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_spark(app: str = "tessaro", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSARO_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def worker_path(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package.

    On a cluster the package is shipped with ``--py-files`` or installed.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*have, ROOT] if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint(spark: SparkSession) -> None:
    """A checkpoint folder for iterative operators: the configured one, else a temporary one if all tasks run on this machine."""
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            import tempfile

            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="tessaro-ckpt-")
        spark.sparkContext.setCheckpointDir(where)
