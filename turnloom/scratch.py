"""Scratch tables in the shared folder: a short lineage that outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made for sessions on one machine that name none (tests), by application id.
_OWN: dict[str, str] = {}
#: Lists that note the tables made while they are open.
_NOTED: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine may leave it unset and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    return _OWN[app]


def _at(df: DataFrame, path: str):
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back. The files go with drop(), or when the driver ends."""
    path = f"{scratch_root(df.sparkSession)}/turnloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, place = _at(df, path)
    store.deleteOnExit(place)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for noted in _NOTED:
        noted.append(out)
    return out


@contextmanager
def step() -> Iterator[list[DataFrame]]:
    """Tables that cut() makes inside go at the end, but for those taken out of the list: what a step returns."""
    noted: list[DataFrame] = []
    _NOTED.append(noted)
    try:
        yield noted
    finally:
        _NOTED[:] = [x for x in _NOTED if x is not noted]
    for df in noted:
        drop(df)


def drop(df: DataFrame) -> None:
    """Delete the files of a table from cut(), once nothing reads them any more."""
    store, place = _at(df, df.scratch_path)
    store.delete(place, True)
