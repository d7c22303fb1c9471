"""Tables that cut lineage: written to the folder that the cluster names for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple[SparkSession, str]]] = [[]]  # tables by who deletes them; the outermost are deleted when the process ends


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset, as in tests, one of this process."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"quarry-{os.getpid()}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder, so no lost executor costs more than its own task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table that written() gave; nothing may read it any more."""
    names = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    for tables in _scopes:
        for spark, path in [t for t in tables if os.path.basename(t[1]) in names]:
            _delete(spark, path)
            tables.remove((spark, path))


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables that were written within it: write what comes of them before."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_end() -> None:
    # what queries returned may be read as long as the session lives; other file systems can't be reached once it is gone
    for _, path in _scopes[0]:
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
