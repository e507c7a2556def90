from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lynceus.api import Engine, InvalidSchema, NotFound, Unavailable
from lynceus.operators import entities as E
from lynceus.operators import lookup
from lynceus.operators import schema as S
from lynceus.operators.algorithms import ALGORITHMS, listed, pair_up, score_pairs
from lynceus.operators.features import FEATURES
from lynceus.operators.filters import MatchParams, boolean, environment_weights, scope_datasets
from lynceus.plans.match import Index, build_index, match
from lynceus.sources import catalog as C
from lynceus.sources import store

MODEL = S.default_model()


def entities(spark, rows):
    """(id, schema, properties, datasets)"""
    return E.complete(spark.createDataFrame(rows, "id string, schema string, properties map<string, array<string>>, datasets array<string>"))


PEOPLE = [
    ("e1", "Person", {"name": ["Ana María Lopez"], "birthDate": ["1970-03-05"], "nationality": ["es"], "gender": ["female"]}, ["one"]),
    ("e2", "Person", {"name": ["Ana Maria Lopes"], "birthDate": ["1980-01-01"], "gender": ["female"]}, ["two"]),
    ("e3", "Company", {"name": ["Acme Holdings Limited"], "leiCode": ["5493001KJTIIGC8Y1R12"], "topics": ["sanction"]}, ["one"]),
    ("e4", "Vessel", {"name": ["Sea Star"], "imoNumber": ["IMO9074729"]}, ["one"]),
    ("s1", "Sanction", {"entity": ["e1"], "program": ["x"]}, ["one"]),
    ("f1", "Family", {"person": ["e1"], "relative": ["e2"]}, ["one"]),
]


def one(spark, name, q, c, qs="Person", cs="Person"):
    a, b = entities(spark, [("q", qs, q, [])]), entities(spark, [("c", cs, c, [])])
    pairs = pair_up(E.derive(a, MODEL), E.derive(b, MODEL), spark.createDataFrame([("q", "c")], "query_id string, entity_id string"))
    return pairs.select(FEATURES[name](MODEL).alias("s")).first().s


def test_schema_model():
    assert MODEL.parents("Person") == ["Person", "LegalEntity", "Thing"]
    assert MODEL.matchable("Company") == ["Asset", "Company", "LegalEntity", "Organization", "Thing"]
    assert MODEL.matchable_chain("Event") is None and MODEL.matchable_chain("Person")
    assert not MODEL.is_a("Thing", "Person") and MODEL.is_a("Company", "Thing")
    assert MODEL.group("Person", "country") == ["citizenship", "country", "jurisdiction", "nationality"]


@pytest.mark.parametrize(
    ("q", "c", "want"),
    [
        (["1970"], ["1970"], 1.0), (["1970"], ["1971-01-01"], 0.5), (["1970"], ["1980"], -1.0), (["1970-01"], ["1970-02"], 2 / 3),
        (["1970-01"], ["1971-01"], -1.0), (["1970-01-01"], ["1970-01-02"], 1.0), (["1970-01-01"], ["1970-01-31"], 30 / 59),
        (["1970-03-05"], ["1970-05-03"], 0.5), (["1970-01-01"], ["1975-01-01"], -1.0), (["x"], ["1970"], 0.0), ([], ["1970"], 0.0),
    ],
)
def test_dates_agree_progressively(spark, q, c, want):
    assert one(spark, "dob_progressive_match", {"birthDate": q}, {"birthDate": c}) == pytest.approx(want)


@pytest.mark.parametrize(
    ("q", "c", "want"),
    [(["1970-03-05"], ["1970-03-05"], 0.0), (["1970-03-05"], ["1970-05-03"], 0.5), (["1970-03-05"], ["1970-04-04"], 1.0), (["1970-03-05"], ["1980-03-05"], 1.0), (["1970"], ["1980-01-01"], 0.0), (["١٩٧٠-٠٣-٠٥"], ["1970-03-05"], 0.0)],
)
def test_days_disjoint(spark, q, c, want):
    assert one(spark, "dob_day_disjoint", {"birthDate": q}, {"birthDate": c}) == want


def test_identifiers(spark):
    lei = "5493001KJTIIGC8Y1R12"
    assert one(spark, "lei_code_match", {"leiCode": [lei]}, {"registrationNumber": [lei]}, "Company", "Company") == 1.0
    assert one(spark, "lei_code_match", {"leiCode": [lei, "bad"]}, {"leiCode": [lei]}, "Company", "Company") == 1.0
    assert one(spark, "lei_code_match", {"leiCode": [lei, "bad"]}, {"idNumber": [lei]}, "Company", "Company") == 0.0
    assert one(spark, "orgid_disjoint", {"taxNumber": ["12345678"]}, {"taxNumber": ["12345679"]}, "Company", "Company") == pytest.approx(1 / 8)
    assert one(spark, "orgid_disjoint", {"taxNumber": ["123-45"]}, {"taxNumber": ["12345"]}, "Company", "Company") == 0.0
    assert one(spark, "orgid_disjoint", {"ogrnCode": ["1"]}, {"ogrnCode": ["22222"]}, "Company", "Company") == 0.0


def test_numbers_may_pass_one(spark):
    assert one(spark, "numbers_mismatch", {"name": ["a 1 2"]}, {"name": ["a"]}) == 2.0
    assert one(spark, "weak_alias_match", {"name": ["Zed"]}, {"weakAlias": ["zed"]}) == 1.0
    assert one(spark, "crypto_wallet_match", {"publicKey": ["0x12345678901"]}, {"publicKey": ["0x12345678901"]}, "CryptoWallet", "CryptoWallet") == 1.0
    assert one(spark, "gender_mismatch", {"gender": ["f"]}, {}) == 0.0


def scores(spark, q, qs="Person", algorithm="logic-v1", **options):
    a, b = entities(spark, [("q", qs, q, [])]), entities(spark, PEOPLE)
    ids = b.select(F.lit("q").alias("query_id"), F.col("id").alias("entity_id"))
    out = score_pairs(pair_up(E.derive(E.precompute(a, MODEL), MODEL), E.derive(b, MODEL), ids), MODEL, algorithm, **options)
    return {r.entity_id: r for r in out.collect()}


def test_algorithms(spark):
    got = scores(spark, {"name": ["Ana Maria Lopez"], "birthDate": ["1980"]}, explain=True)
    assert got["e1"].features["name_literal_match" if "name_literal_match" in got["e1"].features else "person_name_jaro_winkler"] > 0
    assert got["e3"].score == 0 and got["e3"].features == {}
    assert 0 < got["e1"].score <= 1
    low = scores(spark, {"name": ["Ana Maria Lopez"], "gender": ["male"]}, cutoff=0.99)
    assert "gender_mismatch" not in low["e1"].features
    high = scores(spark, {"name": ["Ana Maria Lopez"], "gender": ["male"]}, cutoff=0.1)
    assert high["e1"].score == pytest.approx(low["e1"].score - 0.2)
    assert scores(spark, {"name": ["Ana Maria Lopez"]}, algorithm="name-based")["e1"].score == pytest.approx(1.0)
    off = scores(spark, {"name": ["Ana Maria Lopez"]}, algorithm="name-based", weights={"jaro_name_parts": 0.0})
    assert "jaro_name_parts" not in off["e1"].features and off["e1"].score == pytest.approx(0.5)
    assert scores(spark, {"name": ["Ana Maria Lopez"], "birthDate": ["1970-03-05"]}, algorithm="marble-v0")["e1"].score <= 1
    assert ALGORITHMS["best"].name == "logic-v1" and len(listed()) == 3


def test_match_and_respond(spark):
    index = Index(entities(spark, PEOPLE), MODEL, scopes={"all": ["one", "two"], "one": ["one"]})
    engine = Engine(spark, index)
    queries = {"a": {"schema": "Person", "properties": {"name": ["Ana Maria Lopez"]}}, "b": {"schema": "Company", "properties": {"name": ["Acme Holdings Ltd"]}}, "none": {"schema": "Person", "properties": {"name": ["Qqqq Zzzz"]}}, "own": {"schema": "Person", "properties": {"name": ["Ana Maria Lopez"]}, "params": {"include_datasets": ["two"]}}}
    got = {r.query_id: r for r in engine.match(queries, MatchParams(scope="all", explain=True)).collect()}
    assert [x.id for x in got["a"].results][:2] == ["e1", "e2"] or {x.id for x in got["a"].results} == {"e1", "e2"}
    assert got["b"].results[0].id == "e3" and got["b"].results[0].match
    assert got["none"].results is None and got["none"].total == 0 and got["none"].status == 200
    assert {x.id for x in got["own"].results} == {"e2"}
    assert engine.match(queries, MatchParams(scope="nowhere")).filter("results is not null").count() == 0
    assert engine.match({"a": queries["a"]}, MatchParams(scope="all", exclude_entity_ids=("e1",))).first().results[0].id == "e2"
    with pytest.raises(InvalidSchema):
        engine.match({"x": {"schema": "Nothing", "properties": {}}})


def test_index_written_once_gives_the_same(spark, tmp_path):
    e = entities(spark, PEOPLE)
    q = entities(spark, [("q", "Person", {"name": ["Anna Maria Lopez"]}, [])])
    for symbols in (False, True):
        a = match(q, Index(e, MODEL, symbols=symbols)).collect()
        b = match(q, build_index(e, str(tmp_path / str(symbols)), MODEL, symbols)).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b)) and a


def test_lookup_and_graph(spark):
    e = entities(spark, PEOPLE).withColumn("referents", F.when(F.col("id") == "e2", F.array(F.lit("old2"))).otherwise(F.array().cast("array<string>")))
    assert lookup.get(e, "old2").first().kind == "referent" and lookup.get(e, "nope").first() is None
    tree = lookup.nested(e, MODEL, "e1")
    assert tree["properties"]["sanctions"][0]["id"] == "s1"
    assert tree["properties"]["familyPerson"][0]["properties"]["relative"][0]["id"] == "e2"
    assert lookup.nested(e, MODEL, "old2") == {"redirect": "e2"}
    with pytest.raises(NotFound):
        Engine(spark, Index(e, MODEL)).entity("nope")
    loop = entities(spark, [("a", "Company", {"name": ["A"], "parent": ["b"]}, []), ("b", "Company", {"name": ["B"], "parent": ["a"]}, []), ("self", "Company", {"name": ["S"], "parent": ["self"]}, [])])
    assert lookup.nested(loop, MODEL, "a")["properties"]["parent"][0]["id"] == "b"
    assert lookup.nested(loop, MODEL, "self")["properties"]["parent"] == ["self"]


def test_catalog():
    now = datetime(2024, 1, 2)
    docs = {"c": {"datasets": [{"name": "a", "version": "20240101000000-x", "last_export": "2024-01-01T00:00:00"}, {"name": "b", "version": "20240105000000-x", "last_export": "2024-01-05T00:00:00"}, {"name": "all", "type": "collection", "children": ["a", "b", "sub", "gone"]}, {"name": "sub", "type": "collection", "children": ["b", "all", "own"]}]}}

    def fetch(url, token=None):
        return docs[url]

    got = C.build({"catalogs": [{"url": "c", "scope": "all"}, {"url": "broken"}], "datasets": [{"name": "own"}]}, fetch, [("a", "20240101000000-x"), ("b", "20240101000000-x")], now)
    assert got.current == ["a"] and got.outdated == ["b"] and got.index_stale
    assert got.leaves("all") == ["a", "b", "own"] and got.leaves("nothing") == []
    assert got.scopes()["all"] == ["a", "b", "own"] and got.scopes()["a"] == ["a"]
    wide = C.build({"catalogs": [{"url": "c"}]}, fetch, [("b", "20240101000000-x")], now, grace=timedelta(days=9))
    assert wide.current == ["b"] and not wide.index_stale


def test_leaves_frame_is_cycle_safe(spark):
    d = spark.createDataFrame([("all", ["a", "sub", "gone"]), ("sub", ["b", "all"]), ("a", []), ("b", [])], "name string, children array<string>")
    assert sorted(map(tuple, C.leaves(d).filter("root = 'all'").collect())) == [("all", "a"), ("all", "b")]


def test_manifest_kinds(tmp_path):
    (tmp_path / "m.yml").write_text("datasets: [{name: x}]")
    (tmp_path / "m.json").write_text('{"datasets": [{"name": "y"}]}')
    assert C.manifest(str(tmp_path / "m.yml"))["datasets"] == [{"name": "x"}] and C.manifest(None) == C.DEFAULT_MANIFEST
    assert C.manifest(str(tmp_path / "m.json"))["catalogs"] == []
    with pytest.raises(ValueError):
        C.manifest("m.txt")


def test_store(spark, tmp_path):
    e = entities(spark, PEOPLE)
    root = str(tmp_path / "scoped")
    first = store.create_scoped(e, root)
    assert [r.id for r in store.current_scoped(spark, root).collect()] == ["e3"]
    second = store.create_scoped(e, root, {"schema": ["Vessel"]})
    assert [r.id for r in store.current_scoped(spark, root).collect()] == ["e4"] and first != second
    assert store.versions(spark, root) == [first.rpartition("/")[2], second.rpartition("/")[2]]
    third = store.create_scoped(e, root, {"schema": ["Person"]})
    assert store.versions(spark, root) == [second.rpartition("/")[2], third.rpartition("/")[2]]
    (tmp_path / "scoped" / "v-9-unfinished").mkdir()  # a write that is going on, or was broken off
    assert sorted(r.id for r in store.current_scoped(spark, root).collect()) == ["e1", "e2"]
    with pytest.raises(Exception):
        store.create_scoped(e.withColumn("id", F.raise_error(F.lit("no"))), root)
    assert sorted(r.id for r in store.current_scoped(spark, root).collect()) == ["e1", "e2"]
    with pytest.raises(FileNotFoundError):
        store.current_scoped(spark, root + "-none")
    assert store.ready(spark, second) == (True, "ok") and not store.ready(spark, root + "-none")[0]
    with pytest.raises(ValueError):
        store.layout_version(e)
    assert store.layout_version(e.withColumn("name_keys", F.lit(1))) == 4
    counts = {(r.field, r.value): r["count"] for r in store.field_counts(e, ["schema", "gender"]).collect()}
    assert counts["schema", "Person"] == 2 and counts["gender", "female"] == 2


def test_commands(spark, tmp_path):
    from lynceus import __version__
    from lynceus.__main__ import main

    store.write(entities(spark, PEOPLE), str(tmp_path / "e"))
    assert main(["version"]) == __version__
    at = main(["create-scoped", str(tmp_path / "e"), str(tmp_path / "s"), "--query", '{"schema": "Vessel"}'])
    assert [r.id for r in store.current_scoped(spark, str(tmp_path / "s")).collect()] == ["e4"] and at.startswith(str(tmp_path / "s"))
    main(["create-scoped", str(tmp_path / "e"), str(tmp_path / "s")])
    assert [r.id for r in store.current_scoped(spark, str(tmp_path / "s")).collect()] == ["e3"]


ANA = {"schema": "Person", "properties": {"name": ["Ana Maria Lopez"]}}


@pytest.mark.parametrize("scopes", [{"all": ["one", "two"], "one": ["one"]}, None])
def test_own_datasets_take_the_place_of_the_requests(spark, scopes):
    engine = Engine(spark, Index(entities(spark, PEOPLE), MODEL, scopes=scopes))

    def found(body=None, scope="all", **own):
        got = engine.match({"other": ANA} | {k: ANA | {"params": v} for k, v in own.items()}, MatchParams(scope=scope), body).collect()
        return {r.query_id: {x.id for x in r.results or ()} for r in got}

    include, exclude = ({f"{x}_datasets": v} for x, v in (("include", ["two"]), ("exclude", ["two"])))
    assert found(q=include) == {"q": {"e2"}, "other": {"e1", "e2"}}
    assert found({"include_datasets": ["one"]}, q=include, empty={"include_datasets": []}) == {"q": {"e2"}, "empty": {"e1", "e2"}, "other": {"e1"}}
    assert found({"exclude_datasets": ["one"]}, q=exclude, empty={"exclude_datasets": []}, barred={"include_datasets": ["one"]}) == {"q": {"e1"}, "empty": {"e1", "e2"}, "barred": set(), "other": {"e2"}}
    if scopes:
        assert found(scope="one", q=include) == {"q": set(), "other": {"e1"}}


def test_weights_of_environment_request_and_body(spark, monkeypatch):
    monkeypatch.setenv("WEIGHT_NAME_LITERAL_MATCH", "0.6")
    off = {n: 0.0 for n, _ in ALGORITHMS["logic-v1"].highest if n != "name_literal_match"}
    engine = Engine(spark, Index(entities(spark, [("e", "Person", {"name": ["Ana Maria Lopez"]}, ["one"])]), MODEL))
    score = lambda params, body=None: engine.match({"q": ANA}, params, body).first().results[0].score
    assert score(MatchParams(weights=off)) == 0.6
    assert score(MatchParams(weights=off | {"name_literal_match": 0.8})) == 0.8
    assert score(MatchParams(weights=off | {"name_literal_match": 0.8}), {"weights": {"name_literal_match": 0.7}}) == 0.7
    with pytest.raises(ValueError):
        engine.match({"q": ANA}, None, {"weights": {"name_literal_match": 1.5}})
    assert engine.metrics.requests == 4 and engine.metrics.queries == 4


def test_catalogue_refresh_readiness_and_fields(spark):
    made = []

    def source():
        if len(made) == 2:
            raise OSError("gone")
        made.append(1)
        return C.Catalog([C.Dataset(f"d{len(made)}")])

    engine = Engine(spark, Index(entities(spark, PEOPLE), MODEL), source=source)
    names = lambda **x: [r.name for r in engine.catalog(**x).collect()]
    assert names() == ["d1"] and names() == ["d1"] and names(force_refresh=True) == ["d2"] and engine.index.scopes == {"d2": ["d2"]}
    with pytest.raises(Unavailable):
        engine.catalog(force_refresh=True)
    assert names() == ["d2"] and engine.metrics.refreshes == 3 and engine.metrics.failures == 1
    assert engine.ready() == (True, "ok") and not Engine(spark, Index(spark.range(1), MODEL)).ready()[0]
    assert {(r.value, r["count"]) for r in engine.fields(["schema"], {"datasets": ["two"]}).collect()} == {("Person", 1)}


def test_catalogues_are_json_whatever_they_end_in(tmp_path):
    (tmp_path / "index").write_text('{"datasets": [{"name": "a"}]}')
    (tmp_path / "m.yml").write_text(f"catalogs: [{{url: {tmp_path / 'index'}}}, {{url: {tmp_path / 'gone'}}}]")
    said = []
    got = C.load(str(tmp_path / "m.yml"), [], datetime(2024, 1, 1), log=said.append)
    assert [d.name for d in got.datasets] == ["a"] and len(said) == 1


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        ("imo_mmsi", ["IMO9074729", "imo9074729", "iMo9074729", "123456789"], ["IMO9074728", "9074729", "IMO9074729\n", "12345678", "123456789\n", "IMO 9074729"]),
        ("bic", ["DEUTDEFF", "deutdeff500"], ["DEUTDEF", "DEUTDEFF50", "DEUTDEFF\n", "1EUTDEFF"]),
        ("inn", ["7707083893", "500100732259"], ["7707083894", "500100732258", "770708389", "7707083893\n"]),
        ("ogrn", ["1027700132195"], ["1027700132196", "102770013219", "1027700132195\n"]),
        ("isin", ["US0378331005", "us0378331005"], ["US0378331006", "US037833100", "US0378331005\n"]),
        ("lei", ["5493001KJTIIGC8Y1R12"], ["5493001KJTIIGC8Y1R13", "5493001KJTIIGC8Y1R1", "5493001KJTIIGC8Y1R12\n"]),
    ],
)
def test_validators(spark, check, good, bad):
    from lynceus.functions import validators

    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", getattr(validators, check)(F.col("x")).alias("ok")).collect()
    assert {r.x for r in rows if r.ok} == set(good)


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "schema": "Person", "properties": {"name": ["X"]}, "other": 1}\n')
    row = store.read_jsonl(spark, str(tmp_path / "x.jsonl")).first()
    assert row.id == "a" and row.datasets == [] and row.target is False


def test_parameters():
    assert MatchParams().candidate_limit() == 50 and MatchParams(limit=1, candidate_factor=1).candidate_limit() == 20 and MatchParams(limit=99999).candidate_limit() == 9999
    with pytest.raises(ValueError):
        MatchParams(weights={"x": 2.0})
    assert environment_weights({"WEIGHT_NAME_LITERAL_MATCH": "7", "X": "1"}) == {"name_literal_match": 1.0}
    assert scope_datasets({"s": ["a", "b"]}, "s", ["b", "z"], []) == ["b"] and scope_datasets({"s": ["a", "b"]}, "s", [], ["a"]) == ["b"]


def test_boolean_filter(spark):
    e = entities(spark, PEOPLE)
    assert [r.id for r in e.filter(boolean({"schema": [["Person", "Vessel"]], "datasets": [["two"]]})).collect()] == ["e2"]
    assert e.filter(boolean({})).count() == len(PEOPLE) and e.filter(boolean({"schema": [[]]})).count() == 0


def test_stream(spark, tmp_path):
    from lynceus.streaming.screening import read_queries, screen

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "q", "schema": "Person", "properties": {"name": ["Ana Maria Lopez"]}}\n')
    out = []
    q = screen(read_queries(spark, str(tmp_path / "in")), Index(entities(spark, PEOPLE), MODEL), MatchParams(), lambda df, epoch: out.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r.entity_id for r in out} >= {"e1"}
