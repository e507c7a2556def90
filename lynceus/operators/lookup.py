"""Lookup by id or old id, relations of entities, and bounded graph enrichment."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators import schema as S
from lynceus.operators.entities import group


def get(entities: DataFrame, ident: str) -> DataFrame:
    """The entity of an id or an old id, at most one row: kind (canonical or referent), and the entity.

    An equal id comes before an old id, then the smaller id.
    """
    hit = entities.filter((F.col("id") == ident) | F.array_contains("referents", ident))
    kind = F.when(F.col("id") == ident, "canonical").otherwise("referent")
    return hit.withColumn("kind", kind).orderBy("kind", "id").limit(1)


def resolve(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, id, kind) for many ids at once: a join on ids and exploded old ids, the best row of each."""
    known = entities.select(F.col("id").alias("asked"), "id", F.lit("canonical").alias("kind")).unionByName(entities.select(F.explode("referents").alias("asked"), "id", F.lit("referent").alias("kind")))
    order = Window.partitionBy("asked").orderBy("kind", "id")
    return ids.join(known, "asked").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def links(entities: DataFrame, model: S.Model, inherited: bool = True) -> DataFrame:
    """(id, schema, prop, target, reverse) for every value of every entity-typed property.

    inherited: whether properties of ancestors count, or only the schema's own.
    """
    own = lambda n: [p for p in (model.properties(n).values() if inherited else model.schemas[n].properties) if p.type == "entity"]
    names = S.of(model, F.col("schema"), lambda n: sorted(p.name for p in own(n)))
    pairs = {f"{n}.{p.name}": p.reverse for n in sorted(model.schemas) for p in own(n) if p.reverse}
    reverse = F.from_json(F.lit(json.dumps(pairs)), "map<string, string>")
    out = entities.select("id", "schema", F.explode(names).alias("prop"), "properties")
    out = out.select("id", "schema", "prop", F.explode(F.coalesce(F.try_element_at("properties", F.col("prop")), F.array().cast("array<string>"))).alias("target"))
    return out.withColumn("reverse", F.try_element_at(reverse, F.concat_ws(".", "schema", "prop")))


def priority(schema: str | Column = "schema") -> Column:
    """Sanctions before everything else."""
    return F.when((F.col(schema) if isinstance(schema, str) else schema) == "Sanction", 0).otherwise(1)


def related(entities: DataFrame, model: S.Model, roots: DataFrame, ids: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """(root, entity columns): entities listed in ids (root, id) or pointing at their root, unseen, sanctions first."""
    listed = ids.join(entities, "id")
    pointing = links(entities, model).select("id", F.col("target").alias("root")).distinct().join(roots, "root").join(entities, "id")
    both = listed.unionByName(pointing.select(*listed.columns)).dropDuplicates(["root", "id"]).join(seen, ["root", "id"], "left_anti")
    order = Window.partitionBy("root").orderBy(priority(), "id")
    return both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def enrich(entities: DataFrame, model: S.Model, roots: DataFrame, rounds: int = 2, limit: int = 200) -> DataFrame:
    """(root, parent, prop, child, depth): what hangs under each root id, by its own and by reverse properties.

    roots: a frame of one column root. The first round takes what the root refers to and what refers to it;
    later rounds go on from first-round entities and from relations only, to entities not seen before. A
    round takes at most `limit` entities for a root, sanctions first; unknown schemas are left out.
    """
    roots = roots.select(F.col("root")).distinct()
    known = entities.filter(F.col("schema").isin(*model.schemas))
    forward, own = links(known, model), links(known, model, inherited=False)
    edge = F.col("schema").isin(*model.edges) if model.edges else F.lit(False)
    seen = roots.select("root", F.col("root").alias("id"))
    queue = roots.join(forward.withColumnRenamed("id", "root"), "root").select("root", F.col("target").alias("id"), F.col("root").alias("parent"), "prop")
    found = []
    for depth in range(1, rounds + 1):
        ids = queue.select("root", "id").distinct()
        hits = related(known, model, roots if depth == 1 else roots.limit(0), ids, seen, limit)
        at = hits.select("root", "id", "schema")
        down = queue.join(at, ["root", "id"]).select("root", "parent", "prop", F.col("id").alias("child"))
        held = seen.unionByName(at.select("root", "id"))
        refer = at.join(own.drop("schema"), "id").filter("reverse is not null")
        up = refer.join(held.withColumnRenamed("id", "target"), ["root", "target"]).select("root", F.col("target").alias("parent"), F.col("reverse").alias("prop"), F.col("id").alias("child"))
        found.append(down.unionByName(up).distinct().withColumn("depth", F.lit(depth)))
        onward = at if depth == 1 else at.filter(edge)
        queue = onward.join(own.drop("schema"), "id").join(held.withColumnRenamed("id", "target"), ["root", "target"], "left_anti").select("root", F.col("target").alias("id"), F.col("id").alias("parent"), "prop")
        seen = held
    out = reduce(DataFrame.unionByName, found)
    return out.groupBy("root", "parent", "prop", "child").agg(F.min("depth").alias("depth"))


def nested(entities: DataFrame, model: S.Model, ident: str, rounds: int = 2, limit: int = 200) -> dict[str, object] | None:
    """One entity as nested properties, as deep as enrichment went; None if there is none. For a single request.

    An expanded property holds entities where it held ids. A child that is its own ancestor stays an id.
    """
    spark = entities.sparkSession
    row = get(entities, ident).first()
    if row is None or row["kind"] == "referent":
        return None if row is None else {"redirect": row["id"]}
    edges = enrich(entities, model, spark.createDataFrame([(ident,)], "root string"), rounds, limit).collect()
    names = spark.createDataFrame([(x,) for x in {e["child"] for e in edges} | {ident}], "id string")
    nodes = {r["id"]: r.asDict(recursive=True) for r in entities.join(F.broadcast(names), "id").collect()}  # at most rounds * limit ids
    below: dict[str, dict[str, list[str]]] = {}
    for e in sorted(edges, key=lambda e: (e["parent"], e["prop"], e["child"])):
        below.setdefault(e["parent"], {}).setdefault(e["prop"], []).append(e["child"])

    def tree(i: str, path: tuple[str, ...]) -> dict[str, object]:
        out = dict(nodes[i])
        props: dict[str, object] = dict(out.pop("properties") or {})
        for prop, children in below.get(i, {}).items():
            props[prop] = [tree(x, (*path, i)) if x in nodes and x not in (*path, i) else x for x in children]
        return out | {"properties": props}

    return tree(ident, ())


__all__ = ["enrich", "get", "group", "links", "nested", "priority", "related", "resolve"]
