"""Materialised intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_USERS: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessaro-"))
    return _LOCAL[0]


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """While in here, Spark removes the shuffle files of a job when it ends; nothing reads them after it.

    Threads that are in here together share the setting; the last one restores it.
    """
    with _LOCK:
        state = _USERS.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_CLEANUP, state[1])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return the written table.

    The lineage ends here: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessaro/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    with _own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Tables written in here are deleted at the end, except those whose names are in ``keep``.

    What still reads them must be written by then.
    """
    before = len(_WRITTEN)
    yield
    own = _WRITTEN[before:]
    del _WRITTEN[before:]
    stay = [p for p in own if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep]
    _WRITTEN.extend(stay)
    _delete([p for p in own if p not in stay])


def drop_written() -> None:
    """Delete all tables of :func:`materialise` in this process; results that still read them must be written first."""
    own, _WRITTEN[:] = list(_WRITTEN), []
    _delete(own)


def _delete(paths: list[str]) -> None:
    gateway = SparkContext._gateway
    if not paths or gateway is None:
        return
    live = SparkContext._active_spark_context
    conf = live._jsc.hadoopConfiguration() if live is not None and live._jsc is not None else gateway.jvm.org.apache.hadoop.conf.Configuration()
    for name in paths:
        path = gateway.jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


atexit.register(drop_written)
