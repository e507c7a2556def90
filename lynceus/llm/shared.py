"""The shared folder: where lineage is cut and tables meet, on any file system Spark reaches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs in one process, as in tests, a new
    folder of this machine; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lynceus-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by `clear` or when the driver ends."""
    path = f"{shared_dir(spark)}/lynceus/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a frame as a table of the shared folder, in folders by some columns, and read it again.

    What follows restarts from files that outlive executors, instead of from the plan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession | None = None) -> None:
    """Remove the tables made so far, by one session or by all. For long sessions, once the results of the
    queries that made them are written: a result that is not yet written reads these tables."""
    for made in [x for x in _made if spark is None or x[0] is spark]:
        try:
            drop(*made)
            _made.remove(made)
        except Exception:  # noqa: BLE001  the session may have ended, or the path have no permission: go on with the others
            continue


def _clean() -> None:
    clear()
