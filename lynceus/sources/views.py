"""Entity views of the benchmark tables, so that every operator has rows to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.operators.entities import complete


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def properties(**values: Column) -> Column:
    """A properties map; a value that is no array becomes a list of one, null an empty list."""
    items: list[Column] = []
    for k, v in values.items():
        items += [F.lit(k), F.filter(F.array(v.cast("string")), lambda x: x.isNotNull())]
    return F.create_map(*items)


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as companies: country, registration number, market segment as topic, nation as dataset."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    props = properties(name=F.col("c_name"), country=F.lower("n_name"), registrationNumber=F.regexp_extract("c_name", r"(\d+)", 1), topics=F.col("c_mktsegment"))
    referents = F.array(F.concat(F.lit("OLD"), F.col("c_custkey").cast("string")))
    return complete(rows.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("caption"), F.lit("Company").alias("schema"), F.array("n_name").alias("datasets"), referents.alias("referents"), F.lit(True).alias("target"), props.alias("properties")))


def suppliers(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Suppliers, those of the table or others, as company queries."""
    s, n = table(spark, folder, "supplier") if rows is None else rows, table(spark, folder, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    props = properties(name=F.col("s_name"), country=F.lower("n_name"), registrationNumber=F.regexp_extract("s_name", r"(\d+)", 1))
    return complete(rows.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("caption"), F.lit("Company").alias("schema"), F.array("n_name").alias("datasets"), props.alias("properties")))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as vessels: name, type, brand as flag-like country, and a call sign."""
    p = table(spark, folder, "part")
    props = properties(name=F.col("p_name"), type=F.col("p_type"), flag=F.lower("p_brand"), callSign=F.col("p_partkey"))
    return complete(p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("caption"), F.lit("Vessel").alias("schema"), F.array("p_brand").alias("datasets"), props.alias("properties")))


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as people: birth date, gender from the status, name from the priority and the part of the key."""
    o = table(spark, folder, "orders")
    name = F.concat(F.regexp_extract("o_orderpriority", r"([A-Za-z]+)", 1), F.lit(" "), F.lit("Order"), (F.col("o_orderkey") % 97).cast("string"))
    props = properties(name=name, birthDate=F.date_format("o_orderdate", "yyyy-MM-dd"), gender=F.lower("o_orderstatus"), lastName=F.concat(F.lit("Order"), (F.col("o_orderkey") % 97).cast("string")))
    return complete(o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), name.alias("caption"), F.lit("Person").alias("schema"), F.array("o_orderpriority").alias("datasets"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_change"), props.alias("properties")))


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, people and the ownerships between them: each order's customer owns it."""
    o = table(spark, folder, "orders")
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    props = properties(owner=ident("C", "o_custkey"), asset=ident("O", "o_orderkey"))
    own = complete(o.select(ident("W", "o_orderkey").alias("id"), F.lit("").alias("caption"), F.lit("Ownership").alias("schema"), F.array(F.lit("ownership")).alias("datasets"), props.alias("properties")))
    return companies(spark, folder).unionByName(people(spark, folder)).unionByName(own)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as collections of nations."""
    r, n = table(spark, folder, "region"), table(spark, folder, "nation")
    tree = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("children"))
    top = r.join(tree, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("name"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), F.lit("collection").alias("type"))
    return top.unionByName(n.select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("children"), F.lit("source").alias("type")))
