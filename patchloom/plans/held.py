"""Tables that hold what is costly to make while several results read it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that spark.checkpoint.dir names, so it is made once and outlives lost executors.

    Where that is unset and all runs on one machine, as in tests, the folder is a temporary one."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='patchloom-')}"
    path = f"{root.rstrip('/')}/held-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    if (scope := _SCOPE.get()) is not None:
        scope.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def held_within() -> Iterator[None]:
    """Tables written within are deleted at its end, so a stream of many batches holds one batch's tables at a time."""
    own: list[tuple[SparkSession, str]] = []
    before = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for spark, path in own:
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing to call
            return
