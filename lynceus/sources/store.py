"""Entity stores: reading and writing entity tables, scoped subsets, field values, readiness."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynceus.operators.entities import SCHEMA, complete
from lynceus.operators.filters import field_values

# What the default scoped subset keeps.
SCOPED_SCHEMAS = ("Person", "Organization", "Company", "LegalEntity", "Vessel", "Airplane")
SCOPED_TOPIC = "sanction"
BUCKETS = 10_000


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Entities from JSON lines; absent fields are null, empty or false, unknown ones are ignored."""
    return complete(spark.read.schema(SCHEMA).json(path))


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Entities from any table format that Spark reads, with its connection options."""
    return complete(spark.read.format(format).options(**options).load(path))


def write(entities: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    entities.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def layout_version(entities: DataFrame) -> int:
    """5 for tables with symbol keys, 4 for those with name keys; others are no index."""
    if "name_symbols" in entities.columns:
        return 5
    if "name_keys" in entities.columns:
        return 4
    raise ValueError("the table has neither name_keys nor name_symbols")


def ready(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a store can be searched: it is there and has the entity columns."""
    try:
        columns = set(spark.read.parquet(path).columns)
    except Exception as error:  # a health check reports instead of raising
        return False, str(error).splitlines()[0]
    missing = {"id", "schema", "properties"} - columns
    return not missing, f"missing {sorted(missing)}" if missing else "ok"


def scoped_filter(query: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The subset rule: schemas and the sanction topic, or field -> accepted values, all of which must hold."""
    if query is None:
        query = {"schema": SCOPED_SCHEMAS, "topics": [SCOPED_TOPIC]}
    out = F.lit(True)
    for name, accepted in query.items():
        out = out & F.coalesce(F.arrays_overlap(field_values(name), F.array(*map(F.lit, accepted))), F.lit(False))
    return out


def scoped_query(text: str | None) -> dict[str, list[str]] | None:
    """A subset rule from JSON text, as a setting holds it."""
    return {k: list(v) if isinstance(v, list) else [v] for k, v in json.loads(text).items()} if text else None


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    """The finished versions of a scoped subset, oldest first."""
    path, fs = _folder(spark, root)
    if not fs.exists(path(root)):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(root)))
    return [n for n in names if n.startswith("v-") and fs.exists(path(f"{root}/{n}/_SUCCESS"))]


def create_scoped(entities: DataFrame, root: str, query: Mapping[str, Sequence[str]] | None = None, keep: int = 2) -> str:
    """Write the subset as a new version under root; the last `keep` versions stay, the others go.

    A version counts from when its _SUCCESS file is there, which the write makes last, so readers see the
    old version whole or the new one whole, and one that is being read stays for a while. A write that fails
    leaves only its own folder, which is removed.
    """
    spark = entities.sparkSession
    path, fs = _folder(spark, root)
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    try:
        entities.filter(scoped_filter(query)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{root}/{name}")
    except Exception:
        fs.delete(path(f"{root}/{name}"), True)
        raise
    for old in versions(spark, root)[:-keep]:
        fs.delete(path(f"{root}/{old}"), True)
    return f"{root}/{name}"


def current_scoped(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no scoped subset under {root}")
    return spark.read.parquet(f"{root}/{found[-1]}")


def choose(main: DataFrame, scoped: DataFrame | None, index_type: str) -> DataFrame:
    """The scoped table where it is asked for and there is one, else the main one."""
    return scoped if index_type == "scoped" and scoped is not None else main


def field_counts(entities: DataFrame, fields: Sequence[str], where: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(field, value, count) of the most frequent distinct values of each field, at most `buckets` of one."""
    rows = entities if where is None else entities.filter(where)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(field_values(f)).alias("values")) for f in fields])
    rows = rows.select(F.explode(pairs).alias("p")).select("p.field", F.explode("p.values").alias("value")).filter("value is not null")
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    counts = rows.groupBy("field", "value").count()
    return counts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= buckets).drop("n")


def response(entities: DataFrame, scored: bool = True) -> DataFrame:
    """(id, json) of results: score to three decimals, the match flag and the features, sorted names."""
    fields = ["id", "caption", "schema", "datasets", "referents", "target", "first_seen", "last_seen", "last_change", "properties"]
    extra = [F.round("score", 3).alias("score"), F.col("match"), F.transform_values("features", lambda k, v: F.round(v, 3)).alias("features")] if scored else []
    more = [F.col("explanations")] if "explanations" in entities.columns else []
    return entities.select("id", F.to_json(F.struct(*[F.col(f) for f in fields if f in entities.columns], *extra, *more)).alias("json"))
