"""Tables in the folder that a cluster shares between its executors and its driver."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Paths of the tables that are written inside, in order: those of this call alone, whatever other threads write.

    Who opened it may remove any of them once no open result reads them (``removed``); what is left at
    the end goes to the scope around, if there is one.
    """
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        outer = _SCOPE.get()
        if outer is not None:
            outer.extend(own)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _SCOPE.get()
    if own is not None:
        own.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table and read again: later work survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str], keep: int = 0) -> None:
    """Deletes the tables of a scope, but for the last ``keep``; no result that reads them may be open."""
    gone = paths[: len(paths) - keep]
    del paths[: len(paths) - keep]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _places(df: DataFrame, columns: tuple[str, ...]) -> list[int]:
    """Where the named columns stand: the first of that very name, else the first that differs by case only."""
    exact, low = {}, {}
    for i, c in enumerate(df.columns):
        exact.setdefault(c, i)
        low.setdefault(c.lower(), i)
    return [exact[c] if c in exact else low[c.lower()] for c in columns]


def clear(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, under these names, even when a table has two that clash by case."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        at = _places(df, columns)
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in at]).toDF(*columns)
    return df.select(*columns)


def whole(df: DataFrame, *columns: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All columns under names of their own, for work on rows that carry any columns; and the way back.

    Column i is called ``c<i>``; the named ones are called ``k_<name>`` instead. Names beginning with
    ``w_`` are free. The way back restores columns, names and order, whatever they clash with.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    for c, i in zip(columns, _places(df, columns), strict=True):
        names[i] = f"k_{c}"
    before = df.columns
    return df.toDF(*names), lambda out: out.select(*names).toDF(*before)
