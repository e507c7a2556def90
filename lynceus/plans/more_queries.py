"""Further queries: ranking, gates, set algebra, folds and catalogue operators, registered beside the others."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions import text
from lynceus.functions.kernels import Replacer, align
from lynceus.operators import entities as E
from lynceus.operators import filters as X
from lynceus.operators import lookup
from lynceus.operators import retrieval as R
from lynceus.operators import schema as S
from lynceus.operators.algorithms import score_pairs
from lynceus.operators.features import FEATURES, disjoint, overlap, value_pairs
from lynceus.operators.filters import MatchParams
from lynceus.operators.symbols import tag
from lynceus.plans.match import Index, match, rank
from lynceus.plans.queries import _COMP, _MATCHED, _NATIVE, _ORG_PAIRS, _PART_PAIRS, MODEL, _pairs, org_pairs, part_pairs, query
from lynceus.session import scratch
from lynceus.sources import catalog as C
from lynceus.sources import store
from lynceus.sources import views as V
from lynceus.streaming.screening import latest, screen


@query("txt2_ignored_separators", "SELECT p_partkey, array_to_string(regexp_split_to_array(p_name || '' || replace(p_brand, '.', ''), '[# ]'), '|') AS out FROM part")
def txt2(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.array_join(text.tokens(F.concat_ws(".", "p_name", "p_brand")), "|").alias("out"))


@query("txt21_dictionary_replace", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ltd ' || lower(c_mktsegment) || ' ltd' ELSE 'unlimited ' || lower(c_mktsegment) END AS out FROM customer")
def txt21(spark: SparkSession, d: str) -> DataFrame:
    @F.udf("string", useArrow=True)
    def replace(s: str) -> str:
        return Replacer({"limited": "ltd", "limited company": "ltd"})(s)

    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Limited "), F.lower("c_mktsegment"), F.lit(" LIMITED COMPANY"))).otherwise(F.concat(F.lit("unlimited "), F.lower("c_mktsegment")))
    return V.table(spark, d, "customer").select("c_custkey", replace(name).alias("out"))


@query("flt10_score_gates", "SELECT event_id, value / 100 >= 0.7 AS match FROM events WHERE value / 100 >= 0.5")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    ev = V.table(spark, d, "events").select(F.lit(1).alias("query_id"), F.col("event_id").alias("entity_id"), (F.col("value") / 100).alias("score"))
    return rank(ev.withColumn("query_id", F.col("entity_id")), MatchParams()).select(F.col("entity_id").alias("event_id"), "match")


@query("flt11_schema_gate", f"{_PART_PAIRS} SELECT query_id, CAST(CASE WHEN qn = cn AND qk % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM p")
def flt11(spark: SparkSession, d: str) -> DataFrame:
    """Companies are no match for vessels, whatever their names; every second query is made a company."""
    schema = F.when(F.substring("query_id", 2, 20).cast("long") % 2 == 0, F.col("q_schema")).otherwise("Company")
    pairs = part_pairs(spark, d).withColumn("q_schema", schema)
    return score_pairs(pairs, MODEL, weights=_NATIVE | {"country_mismatch": 0.0}).select("query_id", "score")


@query("top1_results", "SELECT user_id AS query_id, event_id AS entity_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value >= 0.5) WHERE n <= 5")
def top1(spark: SparkSession, d: str) -> DataFrame:
    ev = V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("entity_id"), F.col("value").alias("score"))
    return rank(ev, MatchParams()).select("query_id", "entity_id", "rank")


@query("top3_lookup_order", "SELECT 'canonical' AS kind, 'C5' AS id")
def top3(spark: SparkSession, d: str) -> DataFrame:
    """An entity's own id comes before another's old id."""
    e = V.companies(spark, d).withColumn("referents", F.when(F.col("id") == "C3", F.array(F.lit("C5"))).otherwise(F.col("referents")))
    return lookup.get(e, "C5").select("kind", "id")


@query("top4_priority", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS priority FROM orders")
def top4(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").withColumn("schema", F.when(F.col("o_orderstatus") == "F", "Sanction").otherwise("Person"))
    return o.select(F.col("o_orderkey").alias("id"), lookup.priority().alias("priority"))


@query("set1_value_sets", f"{_PART_PAIRS} SELECT query_id, entity_id, len(list_filter(x, lambda v: NOT list_contains(y, v))) / CAST(greatest(1, least(len(x), len(y))) AS DOUBLE) AS score FROM (SELECT *, list_distinct([qk % 7, qk % 5, 1]) AS x, list_distinct([ck % 7, ck % 5, 1]) AS y FROM p)")
def set1(spark: SparkSession, d: str) -> DataFrame:
    """Distinct numbers of one name less those of the other."""
    p = V.parts(spark, d)
    n = F.substring("id", 2, 20).cast("long")
    named = p.withColumn("properties", F.map_concat("properties", F.create_map(F.lit("previousName"), F.array(F.concat_ws(" x", n % 7, n % 5, F.lit("1"))))))
    named = named.withColumn("properties", F.create_map(F.lit("name"), F.col("properties")["previousName"]))
    return _pairs(named, named, n - 1).select("query_id", "entity_id", FEATURES["numbers_mismatch"](MODEL).alias("score"))


@query("set2_scope_algebra", "SELECT n_name AS dataset FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1")
def set2(spark: SparkSession, d: str) -> DataFrame:
    r = V.table(spark, d, "region").filter("r_regionkey = 1").first()["r_name"]
    reach = C.leaves(V.catalog(spark, d).select("name", "children")).filter(F.col("root") == r).orderBy("leaf").collect()  # a catalogue is small
    tree = {r: [x.leaf for x in reach]}
    kept = X.scope_datasets(tree, r, (), ["NATION_1"])
    return spark.createDataFrame([(k,) for k in kept], "dataset string")


@query("set3_bag_union", "SELECT r_name AS name, 'one' AS title FROM region UNION ALL SELECT n_name, 'two' FROM nation")
def set3(spark: SparkSession, d: str) -> DataFrame:
    """Datasets of several catalogues come together; of equal names, which two catalogues have here, the last stays."""
    names = lambda t, c: [r[0] for r in V.table(spark, d, t).select(c).collect()]  # noqa: E731  a catalogue is small
    region, nation = names("region", "r_name"), names("nation", "n_name")
    docs = {"one": {"datasets": [{"name": n, "title": "one"} for n in [*region, *nation]]}, "two": {"datasets": [{"name": n, "title": "two"} for n in nation]}}
    got = C.build({"catalogs": [{"url": "one"}, {"url": "two"}]}, lambda url, token=None: docs[url], [], datetime(2024, 1, 1))
    return got.frame(spark).select("name", "title")


@query("agg12_last_wins", "SELECT n_name AS name, n_nationkey % 3 AS version FROM nation")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    """Of datasets with one name the last catalogue's stays."""
    rows = V.table(spark, d, "nation").select("n_name", "n_nationkey").collect()  # a catalogue is small
    docs = {str(v): {"datasets": [{"name": r.n_name, "version": str(v)} for r in rows if r.n_nationkey % 3 >= v]} for v in range(3)}
    got = C.build({"catalogs": [{"url": str(v)} for v in range(3)]}, lambda url, token=None: docs[url], [], datetime(2024, 1, 1))
    return got.frame(spark).select("name", F.col("version").cast("int").alias("version"))


@query("cat4_index_stale", "SELECT r_name AS name, bool_or(n_nationkey % 2 = 1) AS stale FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def cat4(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a catalogue of its own; odd nations' indices are older than their export."""
    rows = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # a catalogue is small
    out = []
    for region in sorted({r.r_name for r in rows}):
        own = [r for r in rows if r.r_name == region]
        doc = {"datasets": [{"name": r.n_name, "version": "20240102000000-b", "last_export": "2024-01-02T00:00:00"} for r in own]}
        have = [(r.n_name, "20240101000000-a" if r.n_nationkey % 2 else "20240102000000-b") for r in own]
        out.append((region, C.build({"catalogs": [{"url": "x"}]}, lambda url, token=None, doc=doc: doc, have, datetime(2024, 1, 3)).index_stale))
    return spark.createDataFrame(out, "name string, stale boolean")


@query("agg4_weight_override", f"{_PART_PAIRS} SELECT query_id, entity_id, CAST(CASE WHEN qn = cn THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM p")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    own = _NATIVE | {"name_literal_match": 0.5, "country_mismatch": 0.0}
    return score_pairs(part_pairs(spark, d), MODEL, weights=own).select("query_id", "entity_id", "score")


@query("agg5_clamp", f"{_PART_PAIRS} SELECT query_id, entity_id, up, CAST(greatest(0, same - odd) AS DOUBLE) AS down FROM (SELECT *, CAST(CASE WHEN qn = cn THEN 1 ELSE 0 END AS DOUBLE) AS same, CASE WHEN qf <> cf THEN 1 ELSE 0 END AS odd, CAST(least(1, same + odd) AS DOUBLE) AS up FROM p)")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    """Scores that would leave [0, 1] both ways: 1 for equal names, and 1 more or less for other flags."""
    pairs = part_pairs(spark, d)
    up, down = (score_pairs(pairs, MODEL, cutoff=0.0, weights=_NATIVE | {"country_mismatch": w}).select("query_id", "entity_id", F.col("score").alias(n)) for n, w in (("up", 1.0), ("down", -1.0)))
    return up.join(down, ["query_id", "entity_id"])


@query("agg9_multiset_counts", "SELECT c_custkey, CAST(c_custkey % 3 + 1 <= c_custkey % 4 + 1 AS DOUBLE) AS score FROM customer")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    """A word that a name repeats has to be as often in the other: 1 to 3 times 'ana' against 1 to 4 times."""
    k = F.col("c_custkey")
    many = lambda n: F.array(F.array_repeat(F.lit("ana"), n.cast("int")))

    @F.pandas_udf("double")
    def paired(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align(list(x[0]), list(y[0])) for x, y in zip(a, b, strict=True)])

    return V.table(spark, d, "customer").select("c_custkey", paired(many(k % 3 + 1), many(k % 4 + 1)).alias("score"))


@query("agg10_disjunction_max", f"WITH {_COMP} SELECT 'q' AS query_id, id AS entity_id, CAST(CASE WHEN k % 2 = 0 THEN 0.7 + 0.2 * 0.49 ELSE 0.49 END + 1.0 + 0.2 * 0.5 AS DOUBLE) AS boost FROM comp")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    """A name part counts its best clause and a fifth of the others: LLC as a word (0.7) or by its class (0.49), Acorn
    as a word (1) and its sound (0.5)."""
    q = E.complete(spark.createDataFrame([("q", "Company")], "id string, schema string")).withColumn("names", F.array(F.lit("Acorn LLC")))
    e = V.companies(spark, d)
    name = F.concat(F.lit("Acorn "), F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, "LLC").otherwise("GmbH"))
    return R.symbol_scores(q, R.keyed(e, MODEL, F.array(name), matchable=False, symbols=True), MODEL)


@query("agg11_symbols_by_part", f"WITH {_COMP} SELECT id, lower(part) AS part, symbols FROM comp, (VALUES ('Trading', 'SYMBOL:TRADE'), ('trade', 'SYMBOL:TRADE'), ('India', 'LOC:in'), ('first', 'NUM:1'), ('1st', 'NUM:1')) AS t(part, symbols)")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    """The distinct symbols of each part of a company's names."""
    names = F.array(F.lit("Trading India first trade"), F.lit("Trading 1st India"))
    return R.by_part(tag(V.companies(spark, d), names, MODEL)).select("id", F.lower("part").alias("part"), F.array_join("symbols", "|").alias("symbols")).distinct()


@query("cat1_merge", "SELECT n_name AS name, n_nationkey % 2 = 0 AS load, 'file://' || n_name AS entities_url FROM nation")
def cat1(spark: SparkSession, d: str) -> DataFrame:
    names = [r.n_name for r in V.table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    doc = {"datasets": [{"name": n, "resources": [{"name": "entities.ftm.json", "url": f"file://{n}"}]} for n in names]}
    plan = {"catalogs": [{"url": "memory", "scopes": names[::2]}, {"url": "down"}]}
    got = C.build(plan, lambda url, token=None: {"memory": doc}[url], [], datetime(2024, 1, 1))
    return got.frame(spark).select("name", "load", "entities_url")


@query("cat3_bare_datasets", "SELECT r_name AS name, 'collection' AS type, '20240101000000-mot' AS version, true AS load FROM region")
def cat3(spark: SparkSession, d: str) -> DataFrame:
    tree = V.catalog(spark, d).filter("type = 'collection'").collect()
    plan = {"datasets": [{"name": r.name, "children": r.children} for r in tree]}
    return C.build(plan, C.read_document, [], datetime(2024, 1, 1)).frame(spark).select("name", "type", "version", "load")


@query("join3_value_pairs", f"{_ORG_PAIRS} SELECT query_id, entity_id, CAST(greatest(levenshtein(qn, cn), levenshtein(qr, cr)) AS INTEGER) AS farthest FROM p")
def join3(spark: SparkSession, d: str) -> DataFrame:
    """All values of one side with all of the other, inside the row."""
    p = org_pairs(spark, d)
    both = lambda n: value_pairs(F.col("q_properties")[n], F.col("c_properties")[n], F.levenshtein)
    return p.select("query_id", "entity_id", F.array_max(F.concat(both("name"), both("registrationNumber"))).alias("farthest"))


@query("join2_pair_scores", f"{_ORG_PAIRS} SELECT query_id, entity_id, CAST(CASE WHEN qr = cr THEN 1 ELSE 0 END AS DOUBLE) AS identifier, CAST(CASE WHEN qc <> cc THEN 1 ELSE 0 END AS DOUBLE) AS country FROM p")
def join2(spark: SparkSession, d: str) -> DataFrame:
    return org_pairs(spark, d).select("query_id", "entity_id", FEATURES["identifier_match"](MODEL).alias("identifier"), FEATURES["country_mismatch"](MODEL).alias("country"))


@query("src14_layout", "SELECT * FROM (VALUES ('keys', 4), ('keys and symbols', 5), ('symbols', 5), ('neither', NULL)) AS t(has, version)")
def src14(spark: SparkSession, d: str) -> DataFrame:
    """Tables with the columns of each layout; one with neither is refused."""
    e = V.companies(spark, d)
    keys = e.withColumn("name_keys", text.index_name_keys(F.col("properties")["name"]))
    tables = {"keys": keys, "keys and symbols": tag(keys, F.col("properties")["name"], MODEL).withColumnRenamed("symbols", "name_symbols"), "neither": e}
    tables["symbols"] = tables["keys and symbols"].drop("name_keys")
    out = []
    for name, t in tables.items():
        try:
            out.append((name, store.layout_version(t)))
        except ValueError:
            out.append((name, None))
    return spark.createDataFrame(out, "has string, version int")


@query("schema_is_a", f"WITH {_COMP} SELECT id, true AS organization, false AS person FROM comp")
def schema_is_a(spark: SparkSession, d: str) -> DataFrame:
    return V.companies(spark, d).select("id", S.is_a(MODEL, F.col("schema"), "Organization").alias("organization"), S.is_a(MODEL, F.col("schema"), "Person").alias("person"))


@query("algorithms", "SELECT * FROM (VALUES ('name-based', false), ('name-qualified', false), ('logic-v1', true)) AS t(name, best)")
def algorithms(spark: SparkSession, d: str) -> DataFrame:
    from lynceus.operators.algorithms import listed

    return spark.createDataFrame([(a["name"], a["best"]) for a in listed()], "name string, best boolean")


@query("stream_latest_versions", "SELECT id, last_change FROM (SELECT 'U' || user_id AS id, max(ts) AS last_change FROM events GROUP BY user_id)")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    ev = V.table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp_ntz").alias("last_change"), F.col("event_type").alias("caption"))
    return latest(ev).select("id", "last_change")


@query("stream_screening")
def stream_screening(spark: SparkSession, d: str) -> DataFrame:
    """What a micro-batch of suppliers gives: the sink's frame of a batch is the match plan's."""
    batch = V.suppliers(spark, d)
    return match(batch, Index(V.companies(spark, d), MODEL), MatchParams(cutoff=0.0, limit=1))


@query("join4_set_ops", "SELECT a.o_orderkey AS k, list_has_any(x, y) AS met, NOT list_has_any(x, y) AS apart FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS x, lag([o_orderstatus, o_orderpriority]) OVER (ORDER BY o_orderkey) AS y FROM orders) a WHERE y IS NOT NULL")
def join4(spark: SparkSession, d: str) -> DataFrame:
    """Values of neighbouring orders: in common, or none in common."""
    o = V.table(spark, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("x"))
    pairs = o.join(o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("x").alias("y")), "o_orderkey")
    return pairs.select(F.col("o_orderkey").alias("k"), overlap(F.col("x"), F.col("y")).alias("met"), disjoint(F.col("x"), F.col("y")).alias("apart"))


@query("stream_screening_files", _MATCHED.format(candidates=20, near="false", same_country="true") + "SELECT query_id, entity_id, CAST(rank AS INTEGER) AS rank, score, match, total FROM r WHERE rank <= 1")
def stream_screening_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a stream of files, screened in micro-batches; each batch's results are written under its number."""
    at = scratch(spark, "stream")
    files = spark.readStream.schema(V.table(spark, d, "supplier").schema).option("pathGlobFilter", "supplier.parquet").parquet(d)
    sink = lambda out, epoch: out.drop("features", "boost").write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")
    screen(V.suppliers(spark, d, files), Index(V.companies(spark, d), MODEL), MatchParams(cutoff=0.0, limit=1), sink, f"{at}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")
