"""Session helpers: the reader of a table folder, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables (each a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where driver and tasks are one process."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(told)
        return told
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldscore-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_TABLES: list[str] = []


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder for what only this session reads; `clean` deletes it, at the latest when Python ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(clean)
    _TABLES.append(path)
    return path


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def clean() -> None:
    """Deletes all that this session wrote for itself; results that still read it must have been used before."""
    while _TABLES:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(_TABLES.pop())


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again: the lineage and the plan's size estimate end
    there (a checkpoint keeps the estimate, which a loop of joins multiplies without bound)."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for forget()
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a `cut` that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        _delete(path)
        if path in _TABLES:
            _TABLES.remove(path)
