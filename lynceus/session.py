"""What a session needs so that its Python workers can import this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable
from pathlib import Path
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_T = TypeVar("_T")
_paths: list[tuple[SparkSession, str]] = []
_made: dict[tuple, tuple[tuple, object]] = {}

#: bytes of a batch of rows between the JVM and its Python workers
BATCH, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def remembered(make: Callable[..., _T], *args: object) -> _T:
    """make(*args), worked out once for an application. For columns: building one takes a call to the JVM for each
    of its parts, which for a whole algorithm are tens of thousands. Unhashable arguments count by identity."""
    sc = SparkContext._active_spark_context
    known = tuple(a if isinstance(a, Hashable) else id(a) for a in args)
    key = (sc.applicationId if sc is not None else None, make.__module__, make.__qualname__, *known)
    if key not in _made:
        if len(_made) >= 4096:
            _made.clear()
        _made[key] = (args, make(*args))  # the arguments are kept, so that no other object gets their identity
    return _made[key][1]


def ready(spark: SparkSession) -> SparkSession:
    """Put the package's place on the workers' import path. Harmless where it came by --py-files already."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir, removed when the driver ends; where that is unset and all runs
    in one process, on this machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lynceus-")
    path = f"{at.rstrip('/')}/lynceus/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(clear)
    _paths.append((spark, path))
    return path


def clear() -> None:
    """Remove the scratch folders made so far."""
    while _paths:
        spark, path = _paths.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before: go on with the others
            continue


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table and read it again: what follows is planned from the table, and restarts from it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> SparkSession:
    """`ready`, and batches of at most BATCH to the workers, where the session doesn't set it: every task holds some
    of them outside the heap and in its worker, beside what earlier stages have left there."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH)
    return ready(spark)


def planned(spark: SparkSession) -> SparkSession:
    """`ready`, and constraint propagation off: entity plans have hundreds of aliases of related expressions,
    and the optimizer's set of inferred constraints doubles with each. Nothing here relies on it."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return ready(spark)
