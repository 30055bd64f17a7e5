"""Sessions, and how functions of this package reach Python workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", name: str = "evidentia", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for: UTC, adaptive execution, last map key wins."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(*modules: str) -> None:
    """Send the functions of these modules to Python workers by value, so that workers need not have the package installed."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; it goes when the session ends.

    Where the setting is missing, a local session gets a temporary folder; on a cluster, whose executors would each write
    to a disk of their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Folders written in each scratch() that is open, the innermost last.
_OPEN: list[list[tuple[SparkSession, str]]] = []


def saved(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: the lineage ends there, whichever executor is lost."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._folder = path
    if _OPEN:
        _OPEN[-1].append((df.sparkSession, path))
    return found


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Delete what saved() wrote for this frame, as nothing will read it any more; other frames are left alone."""
    if path := df.__dict__.pop("_folder", None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, everything that saved() writes is for the moment and goes at the end, but for the frames that are handed to
    what this gives. So a result is saved and kept inside, and what led to it takes no room any more."""
    written: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()
    _OPEN.append(written)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._folder)
        return df

    try:
        yield keep
    finally:
        _OPEN.pop()
        for spark, path in written:
            if path not in kept:
                _delete(spark, path)
            elif _OPEN:
                _OPEN[-1].append((spark, path))
