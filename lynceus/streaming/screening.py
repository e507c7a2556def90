"""Screening of a stream of query entities against a static store, and incremental updates of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus.operators.entities import SCHEMA, complete
from lynceus.operators.filters import MatchParams
from lynceus.plans.match import Index, match


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query entities as they arrive as JSON lines in a folder."""
    return complete(spark.readStream.schema(SCHEMA).json(path))


def screen(queries: DataFrame, index: Index, params: MatchParams, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Match each micro-batch of queries as one batch and hand its results to the sink.

    The store is static, so no state is kept; a batch that is run again gives the same results, and the sink
    gets the batch id to write them once. With once, the stream ends when what is there now is done.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        sink(match(batch, index, params), epoch)

    out = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def latest(changes: DataFrame) -> DataFrame:
    """The newest version of each entity of a change log (id, last_change); ties by everything else."""
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("last_change"), F.xxhash64("properties_json" if "properties_json" in changes.columns else "caption"))
    return changes.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
