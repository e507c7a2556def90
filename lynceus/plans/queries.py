"""One query per operator over the benchmark tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions import text, validators
from lynceus.functions.dictionaries import COUNTRIES
from lynceus.functions.kernels import fingerprint, replace_org_symbols
from lynceus.operators import entities as E
from lynceus.operators import filters as X
from lynceus.operators import lookup
from lynceus.operators import retrieval as R
from lynceus.operators import schema as S
from lynceus.operators.algorithms import pair_up, score_pairs
from lynceus.operators.features import FEATURES, KERNELS, with_kernels
from lynceus.operators.filters import MatchParams
from lynceus.operators.symbols import tag
from lynceus.plans.match import Index, match, rank, rank_alike, respond
from lynceus.session import scratch
from lynceus.sources import catalog as C
from lynceus.sources import store
from lynceus.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODEL = S.default_model()

_COMP = "comp AS (SELECT c_custkey AS k, 'C' || c_custkey AS id, c_name AS name, lower(n_name) AS country, regexp_extract(c_name, '(\\d+)', 1) AS reg, c_mktsegment AS topic, n_name AS dataset FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_SUPP = "supp AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS id, s_name AS name, lower(n_name) AS country, regexp_extract(s_name, '(\\d+)', 1) AS reg, n_name AS dataset FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_PART = "prt AS (SELECT p_partkey AS k, 'P' || p_partkey AS id, p_name AS name, lower(p_brand) AS flag, p_type AS type FROM part)"
_PEOPLE = "ppl AS (SELECT o_orderkey AS k, 'O' || o_orderkey AS id, regexp_extract(o_orderpriority, '([A-Za-z]+)', 1) || ' Order ' || (o_orderkey % 97) AS name, strftime(o_orderdate, '%Y-%m-%d') AS birth, lower(o_orderstatus) AS gender, 'Order' || (o_orderkey % 97) AS last FROM orders)"
_ORG_PAIRS = f"WITH {_COMP}, {_SUPP}, p AS (SELECT s.id AS query_id, c.id AS entity_id, s.name AS qn, c.name AS cn, s.reg AS qr, c.reg AS cr, s.country AS qc, c.country AS cc FROM supp s JOIN comp c ON s.k = c.k // 15)"
_PART_PAIRS = f"WITH {_PART}, p AS (SELECT q.id AS query_id, c.id AS entity_id, q.name AS qn, c.name AS cn, q.flag AS qf, c.flag AS cf, q.k AS qk, c.k AS ck FROM prt q JOIN prt c ON c.k = q.k + 1)"
_PEOPLE_PAIRS = f"WITH {_PEOPLE}, p AS (SELECT q.id AS query_id, c.id AS entity_id, q.name AS qn, c.name AS cn, q.birth AS qb, c.birth AS cb, q.gender AS qg, c.gender AS cg, q.last AS ql, c.last AS cl FROM ppl q JOIN ppl c ON c.k = q.k + 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _number(ident: Column) -> Column:
    return F.substring(ident, 2, 20).cast("long")


def _pairs(queries: DataFrame, hits: DataFrame, key: Column) -> DataFrame:
    """Pair rows where a function of the hit's number is the query's number."""
    q, c = E.derive(queries, MODEL), E.derive(hits, MODEL)
    left = queries.select(F.col("id").alias("query_id"), _number(F.col("id")).alias("n"))
    right = hits.select(F.col("id").alias("entity_id"), key.cast("long").alias("n"))
    return pair_up(q, c, left.join(right, "n").select("query_id", "entity_id"))


def org_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(V.suppliers(spark, d), V.companies(spark, d), F.floor(_number(F.col("id")) / 15))


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = V.parts(spark, d)
    return _pairs(p, p, _number(F.col("id")) - 1)


def people_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = V.people(spark, d)
    return _pairs(p, p, _number(F.col("id")) - 1)


# --- scans, sources, sinks


@query("src1_scan", f"WITH {_COMP} SELECT id, name AS caption, 'Company' AS schema, dataset, country, reg AS registration FROM comp")
def src1(spark: SparkSession, d: str) -> DataFrame:
    p = lambda n: F.col("properties")[n][0]
    return V.companies(spark, d).select("id", "caption", "schema", F.col("datasets")[0].alias("dataset"), p("country").alias("country"), p("registrationNumber").alias("registration"))


@query("src2_lookup", f"WITH {_COMP} SELECT 'referent' AS kind, id, name AS caption FROM comp WHERE k = 7")
def src2(spark: SparkSession, d: str) -> DataFrame:
    return lookup.get(V.companies(spark, d), "OLD7").select("kind", "id", "caption")


@query("join6_resolve_referents", "SELECT DISTINCT 'OLD' || o_custkey AS asked, 'C' || o_custkey AS id, 'referent' AS kind FROM orders JOIN customer ON o_custkey = c_custkey")
def join6(spark: SparkSession, d: str) -> DataFrame:
    ids = V.table(spark, d, "orders").select(F.concat(F.lit("OLD"), F.col("o_custkey").cast("string")).alias("asked")).distinct()
    return lookup.resolve(V.companies(spark, d), ids).select("asked", "id", "kind")


@query("src4_indices", "SELECT n_name AS dataset, '20240' || n_nationkey || '01000000-abc' AS version FROM nation")
def src4(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    names = n.select(F.concat(F.lit("entities-"), "n_name", F.lit("-main-20240"), F.col("n_nationkey").cast("string"), F.lit("01000000-abc")).alias("name"))
    odd = n.select(F.concat(F.lit("entities-"), "n_name").alias("name"))
    return C.parse_indices(names.unionByName(odd))


@query("src5_field_values", f"WITH {_COMP} SELECT field, value, count(*) AS count FROM (SELECT 'country' AS field, country AS value FROM comp UNION ALL SELECT 'topics', topic FROM comp UNION ALL SELECT 'schema', 'Company' FROM comp UNION ALL SELECT 'datasets', dataset FROM comp) GROUP BY ALL")
def src5(spark: SparkSession, d: str) -> DataFrame:
    return store.field_counts(V.companies(spark, d), ["country", "topics", "schema", "datasets"])


@query("src6_caption", f"WITH {_COMP} SELECT id, CASE WHEN k % 2 = 0 THEN '#' || k ELSE name END AS caption FROM comp")
def src6(spark: SparkSession, d: str) -> DataFrame:
    k = _number(F.col("id"))
    e = V.companies(spark, d).withColumn("caption", F.when(k % 2 == 0, F.concat(F.lit("#"), k.cast("string"))).otherwise(F.when(k % 3 == 0, "")))
    return e.select("id", E.caption(MODEL).alias("caption"))


@query("snk2_scoped_default", "SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def snk2(spark: SparkSession, d: str) -> DataFrame:
    rule = {"schema": store.SCOPED_SCHEMAS, "topics": ["BUILDING"]}
    return V.companies(spark, d).filter(store.scoped_filter(rule)).select("id")


@query("snk1_scoped_table", "SELECT dataset, count(*) AS n FROM (SELECT n_name AS dataset FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY dataset")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    """Written as a version of a scoped subset, and the newest version read."""
    root = scratch(spark, "scoped")
    store.create_scoped(V.companies(spark, d), root, {"topics": ["FURNITURE"]})
    store.create_scoped(V.companies(spark, d), root, {"topics": ["BUILDING", "MACHINERY"]})
    return store.current_scoped(spark, root).groupBy(F.col("datasets")[0].alias("dataset")).agg(F.count("*").alias("n"))


@query("snk3_response_json", f"WITH {_SUPP} SELECT id, name AS caption, CAST(round(k / 7.0, 3) AS DOUBLE) AS score, k / 7.0 >= 0.7 AS match FROM supp")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    s = V.suppliers(spark, d).withColumn("score", _number(F.col("id")) / 7).withColumn("match", F.col("score") >= 0.7)
    out = store.response(s.withColumn("features", F.create_map(F.lit("x"), F.col("score"))))
    got = F.from_json("json", "caption string, score double, match boolean")
    return out.select("id", got["caption"].alias("caption"), got["score"].alias("score"), got["match"].alias("match"))


# --- text

_ALNUM = "[^a-z0-9 ]"


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Company and part names as (id, names)."""
    both = V.companies(spark, d).select("id", F.col("properties")["name"].alias("names"))
    return both.unionByName(V.parts(spark, d).select("id", F.col("properties")["name"].alias("names")))


_NAMES = f"WITH {_COMP}, {_PART}, n AS (SELECT id, name FROM comp UNION ALL SELECT id, name FROM prt)"


def _text(name: str, sql: str | None, f: Callable[[Column], Column], joined: str = "|") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _names(spark, d).select("id", F.array_join(f(F.col("names")), joined).alias("out"))

    query(name, sql and f"{_NAMES} SELECT id, {sql} AS out FROM n")(run)


_SPLIT = "regexp_split_to_array(name, '[# _]')"
_text("txt3_tokenize", f"array_to_string({_SPLIT}, '|')", lambda n: F.flatten(text.tokenize_names(n)))
_text("txt5_clean_names", "regexp_replace(lower(name), '[#_]', ' ', 'g')", text.clean_names)
_text("txt6_clean_names_light", "regexp_replace(lower(name), '[#_]', ' ', 'g')", text.clean_names_light)
_text("txt7_clean_literal", f"regexp_replace(lower(name), '{_ALNUM}', '', 'g')", text.clean_literal_names)
_text("txt8_clean_address", f"regexp_replace(lower(name), '{_ALNUM}', ' ', 'g')", text.clean_address_parts)
_text("txt9_tokenize_clean", f"array_to_string(list_filter(list_transform(string_split(name, ' '), lambda x: regexp_replace(lower(x), '{_ALNUM}', '', 'g')), lambda x: strlen(x) >= 2), '|')", text.tokenize_clean_names)
_text("txt10_normalize_identifiers", "regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')", text.normalize_identifiers)
_text("txt12_name_parts_flat", f"array_to_string(list_transform(list_filter({_SPLIT}, lambda x: length(x) > 1), lambda x: lower(x)), '|')", text.name_parts_flat)
_text("txt11_name_parts", f"array_to_string(list_transform({_SPLIT}, lambda x: lower(x)), '|')", lambda n: F.flatten(text.name_parts(n)))
_text("txt13_name_keys", f"array_to_string(list_filter([array_to_string(list_sort(list_transform({_SPLIT}, lambda x: lower(x))), '')], lambda x: strlen(x) > 5), '|')", text.index_name_keys)
_text("txt14_index_name_parts", f"array_to_string(list_transform(list_filter({_SPLIT}, lambda x: length(x) > 1), lambda x: lower(x)), '|')", text.index_name_parts)
# Published Soundex and Metaphone codes of the words that the tables' names are made of.
_CODES = "codes AS (SELECT * FROM (VALUES ('customer', 'C235', 'KSTMR'), ('anvil', 'A514', 'ANFL'), ('blue', 'B400', 'BL'), ('bolt', 'B430', 'BLT'), ('cold', 'C430', 'KLT'), ('gear', 'G600', 'JR'), ('gizmo', 'G250', 'JSM'), ('hot', 'H300', 'HT'), ('large', 'L620', 'LRJ'), ('new', 'N000', 'N'), ('old', 'O430', 'OLT'), ('plate', 'P430', 'PLT'), ('red', 'R300', 'RT'), ('ring', 'R520', 'RNK'), ('rod', 'R300', 'RT'), ('small', 'S540', 'SML'), ('widget', 'W323', 'WJT')) AS t(word, soundex, metaphone))"


def _coded(what: str, order: str = "i") -> str:
    """SQL over each name's words in order, with their codes."""
    return f"{_NAMES}, {_CODES}, w AS (SELECT id, i, w, soundex, metaphone FROM (SELECT id, unnest({_SPLIT}) AS w, unnest(range(len({_SPLIT}))) AS i FROM n) LEFT JOIN codes ON lower(w) = word) SELECT id, {what} FROM w GROUP BY id"


_text("txt18_soundex", None, lambda n: text.soundex_codes(text.name_parts_flat(n)))
ORACLE_SQL["txt18_soundex"] = _coded("string_agg(coalesce(soundex, ''), '|' ORDER BY i) AS out")
_text("txt16_phonetic_names", None, R.phonetic_column)
ORACLE_SQL["txt16_phonetic_names"] = _coded("coalesce(string_agg(metaphone, '|' ORDER BY i) FILTER (length(metaphone) > 2), '') AS out")
_text("txt19_numbers", "array_to_string(list_distinct(regexp_extract_all(name, '\\d+')), '|')", text.extract_numbers)


@query("txt1_latinize", "SELECT doc_id, md5(replace(replace(strip_accents(text), 'ß', 'ss'), '—', '-')) AS out FROM documents")
def txt1(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.md5(text.latinize(F.col("text"))).alias("out"))


_SCRIPTS = ["Müller", "Пётр", "Γιώργος", "Արամ", "王伟", "محمد", "123-45", "王 Wang Wei"]


@query("txt15_modern_alphabet", "SELECT c_custkey, c_custkey % 8 NOT IN (4, 5) AS modern FROM customer")
def txt15(spark: SparkSession, d: str) -> DataFrame:
    """Names in eight scripts: a name is modern by the script of most of its letters."""
    name = F.array(*map(F.lit, _SCRIPTS))[(F.col("c_custkey") % 8).cast("int")]
    return V.table(spark, d, "customer").select("c_custkey", text.is_modern(name).alias("modern"))


@query("txt17_phonetic_tuples", _coded("string_agg(w || ':' || coalesce(CASE WHEN length(metaphone) >= 3 THEN metaphone END, '-'), '|' ORDER BY i) AS tuples"))
def txt17(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.flatten(text.tokenize_names(F.col("names")))
    return _names(spark, d).select("id", F.array_join(F.transform(R.phonetic_tuples(tokens), lambda t: F.concat(t["token"], F.lit(":"), F.coalesce(t["code"], F.lit("-")))), "|").alias("tuples"))


@query("txt20_flip_date", f"WITH {_PEOPLE} SELECT id, substr(birth, 9, 2) || substr(birth, 6, 2) AS out FROM ppl")
def txt20(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("properties")["birthDate"][0]
    return V.people(spark, d).select("id", text.flip_date(F.concat(F.substring(b, 6, 2), F.substring(b, 9, 2))).alias("out"))


@query("txt22_fingerprint", "SELECT DISTINCT 'the ' || lower(c_mktsegment) || ' limited' AS name, lower(c_mktsegment) || ' ltd' AS fingerprint FROM customer")
def txt22(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(fingerprint, "string", useArrow=True)
    name = F.concat(F.lit("the "), F.lower("c_mktsegment"), F.lit(" limited"))
    return V.table(spark, d, "customer").select(name.alias("name")).distinct().select("name", f("name").alias("fingerprint"))


@query("txt23_combine_names", f"WITH {_PEOPLE} SELECT id, list_filter([split_part(name, ' ', 1) || ' ' || last], lambda x: x <> '') AS combined FROM ppl")
def txt23(spark: SparkSession, d: str) -> DataFrame:
    p = V.people(spark, d).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("firstName"), F.array(F.split(F.col("properties")["name"][0], " ")[0]))))
    return p.select("id", text.combine_names(F.col("properties"), F.size(E.group(MODEL, "name", True))).alias("combined"))


@query("txt24_countries", "SELECT lang, CASE lang WHEN 'en' THEN NULL ELSE lang END AS code, count(*) AS n FROM documents GROUP BY ALL")
def txt24(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("fr"), F.lit("Frànce"), F.lit("de"), F.lit("Germany!"), F.lit("es"), F.lit("ES"))
    got = E.countries(F.array(F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("nowhere"))))
    return V.table(spark, d, "documents").select("lang", F.try_element_at(got, F.lit(1)).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))


@query("txt25_pick_names")
def txt25(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("name"))
    e = E.complete(names.select(F.col("p_brand").alias("id"), F.lit("Vessel").alias("schema"), F.create_map(F.lit("name"), F.col("name")).alias("properties")))
    return R.sampled(e, MODEL, 5).select("id", "names")


@query("txt26_symbols", f"WITH {_COMP} SELECT id, 'Trading SYMBOL:TRADE 0.8|LLC ORGCLS:LLC 0.7' || CASE WHEN k % 2 = 0 THEN '|2nd NUM:2 1.4' ELSE '' END AS symbols FROM comp")
def txt26(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(_number(F.col("id")) % 2 == 0, "-2nd").otherwise(" 2ndary")
    c = V.companies(spark, d).select("id", "schema", F.concat(F.col("caption"), F.lit(" Trading LLC"), more).alias("name"))
    shown = F.transform("symbols", lambda s: F.concat_ws(" ", s["part"], s["symbol"], s["boost"].cast("string")))
    return tag(c, F.array("name"), MODEL).select("id", F.array_join(shown, "|").alias("symbols"))


@query("txt30_org_symbols", f"WITH {_COMP} SELECT id, name || ' ' || CASE WHEN k % 2 = 0 THEN 'bank invest' ELSE 'Banquet group' END AS out FROM comp")
def txt30(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(replace_org_symbols, "string", useArrow=True)
    more = F.when(_number(F.col("id")) % 2 == 0, " Banque INVESTMENTS").otherwise(" Banquet gruppe")
    return V.companies(spark, d).select("id", f(F.concat("caption", more)).alias("out"))


@query("txt29_nfc", "SELECT 'C' || c_custkey AS id, 'Zoé' || c_custkey AS name FROM customer")
def txt29(spark: SparkSession, d: str) -> DataFrame:
    """Names spelled with combining marks, as retrieval samples them: composed."""
    name = F.concat(F.lit("Zoe\u0301"), F.col("c_custkey").cast("string"))
    c = V.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Person").alias("schema"), V.properties(name=name).alias("properties"))
    return R.sampled(E.complete(c), MODEL, 5).select("id", F.col("names")[0].alias("name"))


@query("txt27_format_score", "SELECT l_orderkey, l_linenumber, CAST(round(l_discount * l_tax * 10, 3) AS DOUBLE) AS score FROM lineitem")
def txt27(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", text.format_score(F.col("l_discount") * F.col("l_tax") * 10).alias("score"))


@query("txt28_precompute", f"WITH {_PEOPLE} SELECT id, split_part(name, ' ', 1) || ' ' || last AS alias FROM ppl")
def txt28(spark: SparkSession, d: str) -> DataFrame:
    p = V.people(spark, d).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("firstName"), F.array(F.split(F.col("properties")["name"][0], " ")[0]))))
    return E.precompute(p, MODEL).select("id", F.col("properties")["alias"][0].alias("alias"))


# --- filters


def _filtered(name: str, where: str, condition: Callable[[], Column]) -> None:
    query(name, f"WITH {_COMP} SELECT id FROM comp WHERE {where}")(lambda spark, d: V.companies(spark, d).filter(condition()).select("id"))


_filtered("flt2_dataset_scope", "dataset IN ('NATION_1', 'NATION_3')", lambda: X.in_datasets(X.scope_datasets({"all": [f"NATION_{i}" for i in range(6)]}, "all", ["NATION_1", "NATION_3", "NATION_20"], ["NATION_4"])))
_filtered("flt2_unknown_scope", "false", lambda: X.in_datasets(X.scope_datasets({}, "nowhere")))
_filtered("flt3_topics", "topic IN ('BUILDING', 'FURNITURE')", lambda: X.with_topics(["BUILDING", "FURNITURE"]))
_filtered("flt4_boolean", "topic IN ('BUILDING', 'MACHINERY') AND dataset = 'NATION_2'", lambda: X.boolean({"topics": [["BUILDING", "MACHINERY"]], "datasets": [["NATION_2"]]}))
_filtered("flt7_exclude_ids", "k NOT IN (3, 8)", lambda: X.not_ids(["C3", "OLD8"]))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Companies, vessels and people."""
    return V.companies(spark, d).unionByName(V.parts(spark, d)).unionByName(V.people(spark, d))


_MIXED = f"WITH {_COMP}, {_PART}, {_PEOPLE}, mixed AS (SELECT id, 'Company' AS schema FROM comp UNION ALL SELECT id, 'Vessel' FROM prt UNION ALL SELECT id, 'Person' FROM ppl)"


@query("flt1_schema", f"{_MIXED} SELECT id FROM mixed WHERE schema = 'Company'")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).filter(X.comparable(MODEL, F.lit("Organization"))).select("id")


@query("flt6_exclude_schema", f"{_MIXED} SELECT id FROM mixed WHERE schema = 'Person'")
def flt6(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).filter(X.not_schemas(["Company", "Vessel"])).select("id")


@query("flt5_changed_since", "SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-15 00:00:00'")
def flt5(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return V.people(spark, d).filter(X.changed_since(datetime(1999, 6, 15))).select("id")


@query("flt8_partition", f"WITH {_COMP} SELECT id FROM comp WHERE dataset = 'NATION_5'")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    e = V.companies(spark, d).withColumn("dataset_scope", F.col("datasets")[0])
    return X.apply(e, MatchParams(scope="NATION_5", partition=True), None).select("id")


@query("flt9_index_choice", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    c = V.companies(spark, d)
    return store.choose(c, c.filter(X.with_topics(["BUILDING"])), "scoped").agg(F.count("*").alias("n"))


@query("flt12_param_overrides", f"WITH {_COMP} SELECT id FROM comp WHERE dataset = 'NATION_7'")
def flt12(spark: SparkSession, d: str) -> DataFrame:
    p = MatchParams(scope="all", include_dataset=("NATION_1",)).bound({"include_datasets": ["NATION_7"]})
    return V.companies(spark, d).filter(X.in_datasets(X.scope_datasets({"all": ["NATION_1", "NATION_7"]}, p.scope, p.include_dataset))).select("id")


# --- features


def _feature(name: str, pairs: Query, sql: str | None, base: str = "") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = pairs(spark, d)
        if name in KERNELS:
            p = with_kernels(p, [name], MODEL)
        return p.select("query_id", "entity_id", FEATURES[name](MODEL).alias("score"))

    query(f"feature_{name}" + ("_people" if pairs is people_pairs else ""), sql and f"{base} SELECT query_id, entity_id, CAST({sql} AS DOUBLE) AS score FROM p")(run)


_JW = "jaro_winkler_similarity"
_feature("name_literal_match", part_pairs, "CASE WHEN qn = cn THEN 1 ELSE 0 END", _PART_PAIRS)
# names of people are a priority and Order<n>, so their parts are known to SQL
_W = lambda c: f"lower(split_part({c}, ' ', 1))"
_L = lambda x, y: f"levenshtein({x}, {y}) <= least(4, CAST(ceil(least(strlen({x}), strlen({y})) / 5.0) AS INTEGER))"
_o = tuple(f"lower({c})" for c in ("ql", "cl"))
_a = tuple(f"({_W(n)} || {o})" for n, o in zip(("qn", "cn"), _o, strict=True))
_same = f"{_W('qn')} = {_W('cn')}"
_SOUNDEX = f"(CASE WHEN {_same} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)"
_feature("soundex_name_parts", people_pairs, _SOUNDEX, _PEOPLE_PAIRS)
_best = f"list_max(list_transform(regexp_split_to_array(lower(cn), '[# ]'), lambda y: CASE WHEN {_JW}(x, y) > 0.6 THEN {_JW}(x, y) ELSE 0 END))"
_feature("jaro_name_parts", part_pairs, f"list_avg(list_transform(list_distinct(regexp_split_to_array(lower(qn), '[# ]')), lambda x: {_best}))", _PART_PAIRS)
_best_person = f"list_max(list_transform([{_W('cn')}, {_o[1]}], lambda y: CASE WHEN {_JW}(x, y) > 0.6 THEN {_JW}(x, y) ELSE 0 END))"
_JARO = f"list_avg(list_transform([{_W('qn')}, {_o[0]}], lambda x: {_best_person}))"
_feature("jaro_name_parts", people_pairs, _JARO, _PEOPLE_PAIRS)
_PERSON_JW = f"greatest(CASE WHEN {_L(*_a)} THEN power({_JW}({_a[0]}, {_a[1]}), strlen({_a[0]})) ELSE 0 END, CASE WHEN {_same} AND {_L(*_o)} THEN {_JW}({_o[0]}, {_o[1]}) ELSE 0 END)"
_PHONETIC = f"(CASE WHEN {_same} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)"
_feature("person_name_jaro_winkler", people_pairs, _PERSON_JW, _PEOPLE_PAIRS)
_feature("person_name_phonetic_match", people_pairs, _PHONETIC, _PEOPLE_PAIRS)
# names of parts are two words; the words are paired greedily, which leaves the second pair no choice
_SIM = lambda x, y: f"(CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN {_L(x, y)} THEN 1 - levenshtein({x}, {y}) / CAST(greatest(strlen({x}), strlen({y})) AS DOUBLE) ELSE 0.0::DOUBLE END)"
_word = lambda c, i: f"split_part(lower({c}), ' ', {i})"
_first = "list_sort([" + ", ".join(f"{{'s': -{_SIM(_word('qn', i), _word('cn', j))}, 'x': {_word('qn', i)}, 'y': {_word('cn', j)}, 'i': {i}, 'j': {j}}}" for i in (1, 2) for j in (1, 2)) + "])[1]"
_PARTS_FP = f"{_PART_PAIRS}, f AS (SELECT *, {_first} AS f FROM p), g AS (SELECT *, f.x || split_part(lower(qn), ' ', 3 - f.i) AS gx, f.y || split_part(lower(cn), ' ', 3 - f.j) AS gy, lower(qn) AS lq, lower(cn) AS lc, replace(lower(qn), ' ', '') AS jq, replace(lower(cn), ' ', '') AS jc FROM f), h AS (SELECT *, greatest({_SIM('lq', 'lc')}, {_SIM('jq', 'jc')}, {_SIM('gx', 'gy')}) AS fp FROM g)"
_feature("name_fingerprint_levenshtein", part_pairs, None)
ORACLE_SQL["feature_name_fingerprint_levenshtein"] = f"{_PARTS_FP} SELECT query_id, entity_id, CAST(fp AS DOUBLE) AS score FROM h"
_zero = lambda b: f"list_transform(range(strlen({b}) + 1), lambda z: 0::BIGINT)"
_LCS = lambda a, b: f"(list_reduce(string_split({a}, ''), lambda r, ch: list_reduce(range(strlen({b})), lambda n, j: list_append(n, greatest(n[-1], r[j + 2], r[j + 1] + CASE WHEN substr({b}, CAST(j + 1 AS BIGINT), 1) = ch THEN 1 ELSE 0 END)), [0::BIGINT]), {_zero(b)})[-1] / CAST(greatest(strlen({a}), strlen({b})) AS DOUBLE))"
_keys = tuple(f"array_to_string(list_sort([{_W(n)}, {o}]), '')" for n, o in zip(("qn", "cn"), _o, strict=True))
_PEOPLE_KEYS = f"{_PEOPLE_PAIRS}, k AS (SELECT *, {_keys[0]} AS qk, {_keys[1]} AS ck FROM p), u AS (SELECT DISTINCT qk, ck FROM k), l AS (SELECT qk, ck, {_LCS('qk', 'ck')} AS lcs FROM u)"
_feature("longest_common_subsequence", people_pairs, None)
ORACLE_SQL["feature_longest_common_subsequence_people"] = f"{_PEOPLE_KEYS} SELECT query_id, entity_id, lcs AS score FROM k JOIN l USING (qk, ck)"
_feature("identifier_match", org_pairs, "CASE WHEN qr = cr THEN 1 ELSE 0 END", _ORG_PAIRS)
_feature("country_match", org_pairs, "CASE WHEN qc = cc THEN 1 ELSE 0 END", _ORG_PAIRS)
_feature("country_mismatch", org_pairs, "CASE WHEN qc <> cc THEN 1 ELSE 0 END", _ORG_PAIRS)
_feature("country_mismatch_all", part_pairs, "CASE WHEN qf <> cf THEN 1 ELSE 0 END", _PART_PAIRS)
_feature("country_disjoint", org_pairs, "CASE WHEN qc <> cc THEN 1 ELSE 0 END", _ORG_PAIRS)
_feature("identifier_mismatch", org_pairs, "CASE WHEN qr <> cr THEN 1 ELSE 0 END", _ORG_PAIRS)
_feature("last_name_mismatch", people_pairs, "CASE WHEN ql <> cl THEN 1 ELSE 0 END", _PEOPLE_PAIRS)
_feature("gender_mismatch", people_pairs, "CASE WHEN qg <> cg THEN 1 ELSE 0 END", _PEOPLE_PAIRS)
_feature("gender_disjoint", people_pairs, "CASE WHEN qg <> cg THEN 1 ELSE 0 END", _PEOPLE_PAIRS)
_feature("dob_year_disjoint", people_pairs, "CASE WHEN left(qb, 4) <> left(cb, 4) THEN 1 ELSE 0 END", _PEOPLE_PAIRS)
_feature("dob_day_disjoint", people_pairs, "CASE WHEN left(qb, 4) <> left(cb, 4) THEN 1 WHEN substr(qb, 6) = substr(cb, 6) THEN 0 WHEN substr(qb, 9, 2) || '-' || substr(qb, 6, 2) = substr(cb, 6) THEN 0.5 ELSE 1 END", _PEOPLE_PAIRS)
_dd = lambda a, b: f"CASE WHEN abs(date_diff('day', {a}, {b})) <= 1 THEN 1 WHEN abs(date_diff('day', {a}, {b})) >= 60 THEN -1 ELSE (60 - abs(date_diff('day', {a}, {b}))) / 59.0 END"
_sw = "try_cast(left(qb, 4) || '-' || substr(qb, 9, 2) || '-' || substr(qb, 6, 2) AS DATE)"
_plain, _turn = _dd("CAST(qb AS DATE)", "CAST(cb AS DATE)"), _dd(_sw, "CAST(cb AS DATE)")
_feature("dob_progressive_match", people_pairs, f"greatest({_plain}, CASE WHEN substr(qb, 6, 2) <> substr(qb, 9, 2) AND {_sw} IS NOT NULL AND {_turn} > 0 THEN 0.5 * ({_turn}) END)", _PEOPLE_PAIRS)
_ratio = "1 - levenshtein(qr, cr) / CAST(greatest(length(qr), length(cr)) AS DOUBLE)"
_feature("orgid_disjoint", org_pairs, f"CASE WHEN qr = cr THEN 0 WHEN {_ratio} > 0.7 THEN 1 - ({_ratio}) ELSE 1 END", _ORG_PAIRS)
_feature("numbers_mismatch", people_pairs, "CASE WHEN regexp_extract(qn, '\\d+') <> regexp_extract(cn, '\\d+') THEN 1 ELSE 0 END", _PEOPLE_PAIRS)


@query("feature_weak_alias_match", f"{_PART_PAIRS} SELECT query_id, entity_id, CAST(CASE WHEN ck % 3 = 0 OR qn = cn THEN 1 ELSE 0 END AS DOUBLE) AS score FROM p")
def weak_alias(spark: SparkSession, d: str) -> DataFrame:
    """Every third part has its predecessor's name as a weak alias, the others their own."""
    p = V.parts(spark, d)
    before = p.select(_number(F.col("id")).alias("n"), F.upper(F.col("properties")["name"][0]).alias("before"))
    n = _number(F.col("id"))
    e = p.withColumn("n", F.when(n % 3 == 0, n - 1).otherwise(n)).join(before, "n", "left")
    e = e.withColumn("properties", F.map_concat("properties", F.create_map(F.lit("weakAlias"), F.array("before")))).drop("n", "before")
    return _pairs(p, e, _number(F.col("id")) - 1).select("query_id", "entity_id", FEATURES["weak_alias_match"](MODEL).alias("score"))


def _checked(body: Column, valid: Callable[[Column], Column], digits: int) -> tuple[Column, Column]:
    """A code with the check digits that hold, and one with the next, which don't."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(10**digits - 1)), lambda x: F.lpad(x.cast("string"), digits, "0"))
    return _with_next(body, F.filter(ends, lambda e: valid(F.concat(body, e)))[0], digits)


def _lei(k: Column) -> tuple[Column, Column]:
    """Codes of a number as of `_checked`, the first check digits that hold worked out instead of tried."""
    body = F.concat(F.lit("AB"), F.lpad(k.cast("string"), 16, "0"))
    return _with_next(body, F.lpad(F.pmod(98 - validators.mod97(F.concat(body, F.lit("00")), 20), F.lit(97)).cast("string"), 2, "0"), 2)


def _with_next(body: Column, good: Column, digits: int) -> tuple[Column, Column]:
    bad = F.lpad(F.pmod(good.cast("int") + 1, F.lit(10**digits)).cast("string"), digits, "0")
    return F.concat(body, good), F.concat(body, bad)


#: feature: schema, property, and from a number a good and a bad code
_CODED: dict[str, tuple[str, str, Callable[[Column], tuple[Column, Column]]]] = {
    "isin_security_match": ("Security", "isin", lambda k: _checked(F.concat(F.lit("US"), F.lpad(k.cast("string"), 9, "0")), validators.isin, 1)),
    "lei_code_match": ("Company", "leiCode", _lei),
    "ogrn_code_match": ("Company", "ogrnCode", lambda k: _checked(F.lpad(k.cast("string"), 12, "1"), validators.ogrn, 1)),
    "inn_code_match": ("Company", "innCode", lambda k: _checked(F.lpad(k.cast("string"), 9, "1"), validators.inn, 1)),
    "bic_code_match": ("Company", "bicCode", lambda k: (F.concat(F.lit("ABCD"), F.translate(F.lpad(k.cast("string"), 7, "0"), "0123456789", "ABCDEFGHIJ")), F.concat(F.lit("1BCD"), F.translate(F.lpad(k.cast("string"), 7, "0"), "0123456789", "ABCDEFGHIJ")))),
    "vessel_imo_mmsi_match": ("Vessel", "imoNumber", lambda k: _checked(F.concat(F.lit("imo"), F.lpad(k.cast("string"), 6, "1")), validators.imo_mmsi, 1)),
}


def _coded_pairs(feature: str) -> Query:
    schema, prop, code = _CODED[feature]

    def run(spark: SparkSession, d: str) -> DataFrame:
        n = F.floor(F.col("p_partkey") / 2)
        good, bad = code(n)
        rows = V.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.lit(schema).alias("schema"), V.properties(**{prop: F.when(n % 3 == 0, bad).otherwise(good)}).alias("properties"))
        e = E.complete(rows)
        return _pairs(e, e, _number(F.col("id")) - 1).select("query_id", "entity_id", FEATURES[feature](MODEL).alias("score"))

    return run


# two neighbours share a code; every third code is wrong by its last digit (a BIC by its first letter)
for _n in _CODED:
    query(f"feature_{_n}", f"{_PART_PAIRS} SELECT query_id, entity_id, CAST(CASE WHEN qk // 2 = ck // 2 AND qk // 2 % 3 <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM p")(_coded_pairs(_n))


@query("feature_crypto_wallet_match", "SELECT 'E' || a.event_id AS query_id, 'E' || b.event_id AS entity_id, CAST(CASE WHEN a.user_id = b.user_id THEN 1 ELSE 0 END AS DOUBLE) AS score FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def wallets(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    w = E.complete(e.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.lit("CryptoWallet").alias("schema"), V.properties(publicKey=F.concat(F.lit("0x0000000000"), F.col("user_id").cast("string"))).alias("properties")))
    return _pairs(w, w, _number(F.col("id")) - 1).select("query_id", "entity_id", FEATURES["crypto_wallet_match"](MODEL).alias("score"))


_ADDRESS = """
WITH w AS (SELECT p_partkey AS k, list_distinct([CAST(p_size AS VARCHAR), split_part(lower(p_name), ' ', 1), split_part(lower(p_name), ' ', 2)]) AS w FROM part),
p AS (SELECT q.k AS qk, c.k AS ck, list_intersect(q.w, c.w) AS b, q.w AS x, c.w AS y FROM w q JOIN w c ON c.k = q.k + 1),
r AS (SELECT qk, ck, len(b) AS n, greatest(len(x), len(y)) - len(b) AS rest, len(b) IN (len(x), len(y)) AS all_, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(b, v))), ' ') AS s, array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(b, v))), ' ') AS t FROM p)
SELECT 'A' || qk AS query_id, 'A' || ck AS entity_id, CASE WHEN all_ THEN 1.0::DOUBLE ELSE (n + rest * CASE WHEN s = t THEN 1.0::DOUBLE WHEN levenshtein(s, t) <= least(greatest(strlen(s), strlen(t)), CAST(ceil(least(strlen(s), strlen(t)) / 5.0) AS INTEGER)) THEN 1 - levenshtein(s, t) / CAST(greatest(strlen(s), strlen(t)) AS DOUBLE) ELSE 0.0::DOUBLE END) / (rest + n) END AS score FROM r
"""


@query("feature_address_entity_match", _ADDRESS)
def address(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    full = F.concat(F.lit("2nd floor, "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" Street"))
    a = E.complete(p.select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Address").alias("schema"), V.properties(full=full).alias("properties")))
    return with_kernels(_pairs(a, a, _number(F.col("id")) - 1), ["address_entity_match"], MODEL).select("query_id", "entity_id", FEATURES["address_entity_match"](MODEL).alias("score"))


# --- validators: numbers made from keys

def _validator(name: str, code: Callable[[Column], Column], check: Callable[[Column], Column], sql_code: str, sql_check: str | None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return V.table(spark, d, "customer").select("c_custkey", code(F.col("c_custkey")).alias("code")).select("c_custkey", "code", check(F.col("code")).alias("valid"))

    query(f"valid_{name}", sql_check and f"WITH c AS (SELECT c_custkey, {sql_code} AS code FROM customer) SELECT c_custkey, code, {sql_check} AS valid FROM c")(run)


def _digits(k: Column, factor: int, width: int) -> Column:
    return F.lpad((k * factor).cast("string"), width, "1")


def _sum(weights: tuple[int, ...], first: int = 1) -> str:
    return "(" + " + ".join(f"CAST(substr(code, {first + i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights)) + ")"


_validator("ogrn", lambda k: _digits(k, 7919, 13), validators.ogrn, "lpad(CAST(c_custkey * 7919 AS VARCHAR), 13, '1')", "CAST(left(code, 12) AS BIGINT) % 11 % 10 = CAST(right(code, 1) AS INTEGER)")
_validator("inn", lambda k: _digits(k, 104729, 10), validators.inn, "lpad(CAST(c_custkey * 104729 AS VARCHAR), 10, '1')", f"{_sum((2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = CAST(right(code, 1) AS INTEGER)")
_validator("imo_mmsi", lambda k: F.concat(F.lit("IMO"), _digits(k, 6101, 7)), validators.imo_mmsi, "'IMO' || lpad(CAST(c_custkey * 6101 AS VARCHAR), 7, '1')", f"CASE WHEN length(code) = 10 THEN {_sum((7, 6, 5, 4, 3, 2), 4)} % 10 = CAST(substr(code, 10, 1) AS INTEGER) ELSE false END")
_validator("bic", lambda k: F.concat(F.lit("ABCDEF"), k.cast("string")), validators.bic, "'ABCDEF' || c_custkey", "length(code) IN (8, 11)")
# U and S are 30 and 28; every second digit from the last counts twice, and as the sum of its digits
_isin = "list_sum(list_transform(range(14), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(s, 14 - i, 1) AS BIGINT) ELSE CAST(substr(s, 14 - i, 1) AS BIGINT) * 2 // 10 + CAST(substr(s, 14 - i, 1) AS BIGINT) * 2 % 10 END)) % 10 = 0".replace("s,", "'3028' || substr(code, 3),")
_validator("isin", lambda k: F.concat(F.lit("US"), _digits(k, 7919, 10)), validators.isin, "'US' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 10, '1')", _isin)
_validator("lei", lambda k: F.concat(F.lit("AB"), _digits(k, 7919, 18)), validators.lei, "'AB' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '1')", "CAST('1011' || substr(code, 3) AS HUGEINT) % 97 = 1")
# --- retrieval and joins


@query("join1_block_parts", "WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w, p_partkey, p_name FROM part), e AS (SELECT * FROM v WHERE length(w) > 1), c AS (SELECT q.p_partkey AS q, e.p_partkey AS c, count(*) AS n FROM e q JOIN e ON q.w = e.w WHERE q.p_partkey % 100 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, 'P' || c) AS rank FROM c) SELECT 'P' || q AS query_id, 'P' || c AS entity_id, CAST(n AS DOUBLE) AS boost FROM r WHERE rank <= 20")
def join1(spark: SparkSession, d: str) -> DataFrame:
    e = V.parts(spark, d).select("id", F.explode(text.index_name_parts(F.col("properties")["name"])).alias("key"))
    e = e.select("id", F.lit("name_parts").alias("kind"), "key", F.lit(1.0).alias("boost"))
    return R.best(e.filter(_number(F.col("id")) % 100 == 0), e, 20).select("query_id", "entity_id", "boost")


@query("join1_block_frequent", "SELECT query_id, entity_id, boost FROM (WITH k AS (SELECT user_id AS u, event_type AS t, event_id AS e FROM events), p AS (SELECT DISTINCT u, t FROM k), q AS (SELECT 'U' || u AS query_id, t, u FROM p) SELECT query_id, 'E' || e AS entity_id, CAST(sum(s) AS DOUBLE) AS boost FROM (SELECT query_id, e, 2 AS s FROM (SELECT DISTINCT query_id, u FROM q) JOIN k USING (u) UNION ALL SELECT query_id, e, 1 FROM q JOIN k USING (t)) GROUP BY ALL)")
def join1_frequent(spark: SparkSession, d: str) -> DataFrame:
    ev = V.table(spark, d, "events")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    e = ev.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.explode(F.array(key("user", user), key("type", kind))).alias("k")).select("id", "k.*")
    q = ev.select(F.concat(F.lit("U"), user).alias("id"), F.explode(F.array(F.struct(F.lit("user").alias("kind"), user.alias("key"), F.lit(2.0).alias("boost")), F.struct(F.lit("type").alias("kind"), kind.alias("key"), F.lit(1.0).alias("boost")))).alias("k")).select("id", "k.*").distinct()
    return R.block(q, e)


@query("join1a_fuzzy", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT name, unnest(string_split(lower(name), ' ')) AS w FROM n), near AS (SELECT q.name AS q, c.name AS c, count(DISTINCT q.w) AS met FROM w q JOIN w c ON levenshtein(q.w, c.w) <= CASE WHEN length(q.w) <= 2 THEN 0 WHEN length(q.w) <= 5 THEN 1 ELSE 2 END GROUP BY ALL), need AS (SELECT name AS q, count(DISTINCT w) AS need FROM w GROUP BY ALL) SELECT q AS query_id, c AS entity_id, 3.0::DOUBLE AS boost FROM near JOIN need USING (q) WHERE met = need")
def join1a(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "part").select(F.col("p_name").alias("id"), F.array("p_name").alias("names")).distinct()
    return R.fuzzy(n, n)


@query("join1d_typed_keys", f"WITH {_SUPP}, {_COMP} SELECT s.id AS query_id, c.id AS entity_id, CAST(CASE WHEN s.reg = c.reg THEN 1 ELSE 0 END + CASE WHEN s.country = c.country THEN 1 ELSE 0 END AS DOUBLE) AS boost FROM supp s JOIN comp c ON s.reg = c.reg OR s.country = c.country")
def join1d(spark: SparkSession, d: str) -> DataFrame:
    keys = lambda e, m: e.select("id", F.explode(F.flatten(F.array(*R.typed_keys(MODEL, m)))).alias("k")).select("id", "k.*")
    return R.block(keys(V.suppliers(spark, d), True), keys(V.companies(spark, d), False))


@query("join1c_symbols")
def join1c(spark: SparkSession, d: str) -> DataFrame:
    q = V.suppliers(spark, d).withColumn("names", F.array(F.concat_ws(" ", "caption", F.lit("Bank Ltd"))))
    e = V.companies(spark, d)
    keys = R.keyed(e, MODEL, F.array(F.concat_ws(" ", "caption", F.lit("Banque"))), matchable=False, symbols=True)
    return R.best_symbols(q, keys, MODEL, 20).select("query_id", "entity_id", "boost")


_OWN = "o AS (SELECT 'C' || o_custkey AS c, 'O' || o_orderkey AS a, 'W' || o_orderkey AS w FROM orders)"


@query("join5_enrich", f"WITH {_OWN} SELECT c AS root, c AS parent, 'ownershipOwner' AS prop, w AS child, 1 AS depth FROM o UNION ALL SELECT c, w, 'asset', a, 2 FROM o")
def join5(spark: SparkSession, d: str) -> DataFrame:
    e = V.relations(spark, d)
    roots = V.companies(spark, d).select(F.col("id").alias("root"))
    return lookup.enrich(e, MODEL, roots, limit=1_000_000)


@query("src3_related", f"WITH {_OWN} SELECT c AS root, w AS id FROM o")
def src3(spark: SparkSession, d: str) -> DataFrame:
    e = V.relations(spark, d)
    roots = V.companies(spark, d).select(F.col("id").alias("root"))
    none = spark.createDataFrame([], "root string, id string")
    return lookup.related(e, MODEL, roots, none, none, 1_000_000).select("root", "id")


@query("join7_freshness", "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '20240101000000-a' WHEN n_nationkey % 3 = 1 THEN '20240101000000-b' END AS index_version, coalesce(n_nationkey % 3 = 0, false) AS index_current, CASE WHEN n_nationkey % 3 = 0 THEN 'current' WHEN n_nationkey % 3 = 1 THEN CASE WHEN n_nationkey < 10 THEN 'current' ELSE 'outdated' END END AS status FROM nation")
def join7(spark: SparkSession, d: str) -> DataFrame:
    n, k = V.table(spark, d, "nation"), F.col("n_nationkey")
    at = F.when(k < 10, F.lit("2023-12-31 00:00:00")).otherwise(F.lit("2024-02-01 00:00:00")).cast("timestamp_ntz")
    cat = n.select(F.col("n_name").alias("name"), F.lit("20240101000000-a").alias("version"), at.alias("last_export"))
    idx = n.filter(k % 3 < 2).select(F.col("n_name").alias("dataset"), F.when(k % 3 == 0, "20240101000000-a").otherwise("20240101000000-b").alias("version"))
    return C.freshness(cat, idx).select("name", "index_version", "index_current", "status")


@query("cat5_leaves", "SELECT r_name AS root, n_name AS leaf FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, n_name FROM nation")
def cat5(spark: SparkSession, d: str) -> DataFrame:
    return C.leaves(V.catalog(spark, d).select("name", "children"))


# --- folds and algorithms


def _algorithm(name: str, algorithm: str, pairs: Query, sql: str | None, base: str = "", **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return score_pairs(pairs(spark, d), MODEL, algorithm, **options).select("query_id", "entity_id", "score")

    query(name, sql and f"{base} SELECT query_id, entity_id, CAST({sql} AS DOUBLE) AS score FROM p")(run)


_YEAR = "(CASE WHEN left(qb, 4) <> left(cb, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_DAY = "(CASE WHEN left(qb, 4) <> left(cb, 4) THEN 1.0::DOUBLE WHEN substr(qb, 6) = substr(cb, 6) THEN 0.0::DOUBLE WHEN substr(qb, 9, 2) || '-' || substr(qb, 6, 2) = substr(cb, 6) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
_GENDER = "(CASE WHEN qg <> cg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_LAST = "(CASE WHEN ql <> cl THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_NUMBER = "(CASE WHEN regexp_extract(qn, '\\d+') <> regexp_extract(cn, '\\d+') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_PROGRESS = f"greatest({_plain}, CASE WHEN substr(qb, 6, 2) <> substr(qb, 9, 2) AND {_sw} IS NOT NULL AND {_turn} > 0 THEN 0.5 * ({_turn}) END)"


def _folded(base: str, first: str, penalties: list[tuple[str, float]], source: str = "p", cutoff: float = 0.5) -> str:
    """SQL of a score that starts at `first`, from which penalties are taken in order while it reaches the cutoff."""
    steps = [f"s0 AS (SELECT *, CAST({first} AS DOUBLE) AS s FROM {source})"]
    for i, (v, w) in enumerate(penalties, 1):
        steps.append(f"s{i} AS (SELECT * EXCLUDE (s), CASE WHEN s < {cutoff} THEN s ELSE s - {w}::DOUBLE * {v} END AS s FROM s{i - 1})")
    return f"{base}, {', '.join(steps)} SELECT query_id, entity_id, CAST(least(1, greatest(0, s)) AS DOUBLE) AS score FROM s{len(penalties)}"


_algorithm("algo1_name_based", "name-based", people_pairs, f"0.5::DOUBLE * {_SOUNDEX} + 0.5::DOUBLE * {_JARO}", _PEOPLE_PAIRS)
_algorithm("algo2_name_qualified", "name-qualified", people_pairs, f"least(1, greatest(0, 0.5::DOUBLE * {_SOUNDEX} + 0.5::DOUBLE * {_JARO} - 0.1::DOUBLE * {_YEAR} - 0.15::DOUBLE * {_DAY} - 0.1::DOUBLE * {_GENDER}))", _PEOPLE_PAIRS)
_algorithm("algo3_logic_v1", "logic-v1", people_pairs, None)
_NAMES_OF_PEOPLE = f"greatest(0.8::DOUBLE * {_PERSON_JW}, 0.9::DOUBLE * {_PHONETIC})"
ORACLE_SQL["algo3_logic_v1"] = _folded(_PEOPLE_PAIRS, _NAMES_OF_PEOPLE, [(_LAST, 0.2), (_YEAR, 0.15), (_DAY, 0.2), (_GENDER, 0.2), (_NUMBER, 0.1)])
_algorithm("algo3_logic_v1_companies", "logic-v1", org_pairs, "CASE WHEN qr = cr THEN 0.85::DOUBLE - CASE WHEN qc <> cc THEN 0.2::DOUBLE ELSE 0 END ELSE 0 END", _ORG_PAIRS)
_algorithm("algo4_subsequence_and_dates", "marble-v0", people_pairs, None)
ORACLE_SQL["algo4_subsequence_and_dates"] = _folded(_PEOPLE_KEYS, f"greatest({_NAMES_OF_PEOPLE}, 0.8::DOUBLE * lcs) + 0.15::DOUBLE * {_PROGRESS}", [(_LAST, 0.2), (_GENDER, 0.2), (_NUMBER, 0.1)], "k JOIN l USING (qk, ck)")
_algorithm("algo3_logic_v1_vessels", "logic-v1", part_pairs, None)
ORACLE_SQL["algo3_logic_v1_vessels"] = _folded(_PARTS_FP, "greatest(CASE WHEN qn = cn THEN 1 ELSE 0 END, 0.9::DOUBLE * fp)", [("(CASE WHEN qf <> cf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 0.2)], "h")
# weights of 0 take the kernel features out, which leaves what SQL can say
_NATIVE = {"person_name_jaro_winkler": 0.0, "person_name_phonetic_match": 0.0, "name_fingerprint_levenshtein": 0.0, "address_entity_match": 0.0}
_low = "CASE WHEN qn = cn THEN 1.0 ELSE 0.0 END"
_algorithm("agg3_disqualifiers", "logic-v1", part_pairs, f"greatest(0, CASE WHEN {_low} >= 0.5 AND qf <> cf THEN {_low} - 0.2 ELSE {_low} END)", _PART_PAIRS, weights=_NATIVE)
_algorithm("agg1_highest", "logic-v1", org_pairs, "CASE WHEN qr = cr THEN 0.85 ELSE 0 END", _ORG_PAIRS, weights=_NATIVE | {"country_mismatch": 0.0, "orgid_disjoint": 0.0, "numbers_mismatch": 0.0})
_algorithm("agg2_sum_clamped", "name-qualified", people_pairs, "greatest(0, 0 - CASE WHEN left(qb, 4) <> left(cb, 4) THEN 0.1 ELSE 0 END)", _PEOPLE_PAIRS, weights={"soundex_name_parts": 0.0, "jaro_name_parts": 0.0, "dob_day_disjoint": 0.0, "gender_disjoint": 0.0, "orgid_disjoint": 0.0, "country_disjoint": 0.0})


@query("agg6_features", f"{_PART_PAIRS} SELECT query_id, entity_id, CAST(CASE WHEN qn = cn THEN 1 END AS DOUBLE) AS literal, CAST(CASE WHEN qn = cn AND qf <> cf THEN 1 END AS DOUBLE) AS mismatch FROM p")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    got = score_pairs(part_pairs(spark, d), MODEL, "logic-v1", weights=_NATIVE)
    f = lambda n: F.try_element_at("features", F.lit(n))
    return got.select("query_id", "entity_id", f("name_literal_match").alias("literal"), f("country_mismatch").alias("mismatch"))


@query("flagship_match", """
WITH v AS (SELECT DISTINCT p_partkey AS k, p_name AS name, lower(p_brand) AS flag, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
c AS (SELECT DISTINCT q.k AS q, e.k AS c, CASE WHEN q.name = e.name THEN 1.0 - CASE WHEN q.flag <> e.flag THEN 0.2 ELSE 0 END ELSE 0.0 END AS score FROM v q JOIN v e ON q.w = e.w AND q.k <> e.k WHERE q.k % 100 = 0),
t AS (SELECT *, count(*) FILTER (score >= 0.7) OVER (PARTITION BY q) AS total FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, 'P' || c) AS rank FROM t WHERE score >= 0.5)
SELECT 'P' || q AS query_id, 'P' || c AS entity_id, CAST(rank AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score, score >= 0.7 AS match, total FROM r WHERE rank <= 5
""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth part against all others: block on name tokens, score, rank, total."""
    p = V.parts(spark, d)
    keys = F.array_sort(text.index_name_parts(F.col("properties")["name"]))
    return rank_alike(p.withColumn("keys", keys), _number(F.col("id")) % 100 == 0, MODEL, MatchParams(weights=_NATIVE)).select("query_id", "entity_id", "rank", "score", "match", "total")


@query("agg7_totals", """
WITH p AS (SELECT q.p_partkey AS q, q.p_name = c.p_name AS same, lower(q.p_brand) <> lower(c.p_brand) AS odd FROM part q JOIN part c ON c.p_partkey = q.p_partkey + 1)
SELECT 'P' || q AS query_id, CAST(CASE WHEN same THEN 1 ELSE 0 END AS BIGINT) AS total FROM p
""")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    got = score_pairs(part_pairs(spark, d), MODEL, "logic-v1", weights=_NATIVE)
    return rank(got, MatchParams(cutoff=0.0)).select("query_id", "total")


@query("top2_candidate_limit", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 20")
def top2(spark: SparkSession, d: str) -> DataFrame:
    ev = V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("entity_id"), F.col("value").alias("boost"))
    return R.top(ev, MatchParams(limit=1, candidate_factor=1).candidate_limit()).select(F.col("query_id").alias("user_id"), F.col("entity_id").alias("event_id"))


# a supplier and a customer share a word (their number), an identifier (the same) and, where nations are countries, a
# country; nothing else of their names sounds or looks alike. With a cutoff of 0 every penalty counts.
_MATCHED = f"""
WITH {_SUPP}, {_COMP},
c AS (SELECT s.id AS query_id, c.id AS entity_id, 2.0 * CAST(s.reg = c.reg AS INTEGER) + CAST({{near}} AS INTEGER) AS boost, s.reg = c.reg AS same, {{same_country}} AS near FROM supp s JOIN comp c ON s.reg = c.reg OR {{near}}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, entity_id) AS n FROM c) WHERE n <= {{candidates}}),
s AS (SELECT *, CASE WHEN same THEN 0.85::DOUBLE - CASE WHEN near THEN 0 ELSE 0.2::DOUBLE END ELSE 0 END AS score FROM t),
r AS (SELECT *, score >= 0.7 AS match, count(*) FILTER (score >= 0.7) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM s)
"""


@query("match_end_to_end", _MATCHED.format(candidates=50, near="false", same_country="true") + "SELECT query_id, entity_id, CAST(rank AS INTEGER) AS rank, score, match, total, CAST(boost AS DOUBLE) AS boost FROM r WHERE rank <= 5")
def match_companies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers screened against customers with the whole plan."""
    return match(V.suppliers(spark, d), Index(V.companies(spark, d), MODEL), MatchParams(cutoff=0.0, weights={})).drop("features")


def _in_countries(e: DataFrame) -> DataFrame:
    """Nations of the tables (NATION_0 and so on) as countries, other names as they are."""
    code = F.try_element_at(F.array(*map(F.lit, sorted(COUNTRIES))), F.regexp_extract(F.col("datasets")[0], r"(\d+)$", 1).try_cast("int") + 1)
    country = F.coalesce(F.try_element_at("properties", F.lit("country")), F.array().cast("array<string>"))
    own = F.create_map(F.lit("country"), F.when(code.isNotNull(), F.array(code)).otherwise(country))
    return e.withColumn("properties", F.map_concat(F.map_filter("properties", lambda k, v: k != "country"), own))


@query("match_response", _MATCHED.format(candidates=20, near="s.country = c.country", same_country="s.country = c.country") + "SELECT id AS query_id, 200 AS status, coalesce(max(total), 0) AS total, coalesce(string_agg(entity_id || ' ' || CAST(CAST(round(score, 3) AS DECIMAL(4, 3)) AS VARCHAR), '|' ORDER BY rank), '') AS results FROM supp LEFT JOIN (SELECT * FROM r WHERE rank <= 2) ON query_id = id GROUP BY id")
def match_response(spark: SparkSession, d: str) -> DataFrame:
    index, q = Index(_in_countries(V.companies(spark, d)), MODEL), _in_countries(V.suppliers(spark, d))
    got = respond(q, match(q, index, MatchParams(cutoff=0.0, limit=2)), index)
    shown = F.transform(F.coalesce("results", F.array()), lambda r: F.concat_ws(" ", r["id"], r["score"].cast("decimal(4, 3)").cast("string")))
    return got.select("query_id", "status", "total", F.array_join(shown, "|").alias("results"))


@query("schema_closure", None)
def schema_closure(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, MODEL.parents(n), MODEL.descendants(n), MODEL.matchable(n)) for n in MODEL.schemas]
    return spark.createDataFrame(rows, "schema string, parents array<string>, descendants array<string>, matchable array<string>")
