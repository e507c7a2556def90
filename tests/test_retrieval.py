import random

import pytest
from pyspark.sql import functions as F

from lynceus.operators import retrieval as R
from lynceus.operators.entities import complete, precompute
from lynceus.operators.filters import MatchParams
from lynceus.plans.match import Index, candidates
from lynceus.plans.queries import MODEL, QUERIES


def made(df, of=""):
    """The most rows that a step (of a kind) of the frame's plan makes; the rows."""
    rows = df.collect()
    seen = []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        m = p.metrics().get("numOutputRows")
        seen.append(m.get().value() if m.isDefined() and of in kind else 0)
        c = p.children()
        for i in range(c.size()):
            walk(c.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(seen), rows


@pytest.fixture
def keys(spark):
    """Keys of 60 queries and 90 entities, of which many have the same, and the boosts of all pairs."""
    r = random.Random(5)
    pick = lambda: frozenset([("a", str(min(int(r.expovariate(0.5)), 6))), *[("b", str(r.randrange(30))) for _ in range(r.choice([0, 0, 1, 3]))]])
    q, e = {f"q{i}": {k: 2.0 if k[0] == "a" else 0.5 for k in pick()} for i in range(60)}, {f"e{i}": pick() for i in range(90)}
    boosts = {(a, b): sum(v for k, v in x.items() if k in y) for a, x in q.items() for b, y in e.items() if any(k in y for k in x)}
    left = spark.createDataFrame([(a, *k, v) for a, x in q.items() for k, v in x.items()], "id string, kind string, key string, boost double")
    return left, spark.createDataFrame([(b, *k) for b, y in e.items() for k in y], "id string, kind string, key string"), boosts


@pytest.mark.parametrize("deal", [3, 10_000])
def test_block_makes_each_pair_once_and_sends_none(monkeypatch, keys, deal):
    monkeypatch.setattr(R, "DEAL", deal)
    q, e, boosts = keys
    got = R.block(q, e)
    rows = got.collect()
    assert len(rows) == len(boosts) and {(r.query_id, r.entity_id): r.boost for r in rows} == boosts
    above = got._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[0]
    assert "Generate" in above and "Aggregate" not in above and "Exchange" not in above


@pytest.mark.parametrize("frequent, limit", [(0, 4), (5, 1), (5, 7), (12, 20), (1000, 4)])
def test_best_are_the_first_of_all_pairs(monkeypatch, keys, frequent, limit):
    monkeypatch.setattr(R, "FREQUENT", frequent)
    q, e, boosts = keys
    want = set()
    for a in {a for a, _ in boosts}:
        mine = sorted((-v, b) for (x, b), v in boosts.items() if x == a)
        want |= {(a, b, -v, i) for i, (v, b) in enumerate(mine[:limit], 1)}
    got = R.best(q, e, limit).select("query_id", "entity_id", "boost", "rank").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_copies_of_parts_are_not_paired(spark, tmp_path):
    spark.range(4000).selectExpr("id p_partkey", "if(id % 2 = 0, 'hot bolt', 'hot ring') p_name", "concat('Brand#', id % 3) p_brand", "'T' p_type").write.parquet(f"{tmp_path}/part.parquet")
    most, rows = made(QUERIES["join1_block_parts"](spark, str(tmp_path)))
    assert len(rows) == 40 * 20 and {r.boost for r in rows} == {2.0} and most < 20_000


@pytest.mark.parametrize("frequent", [0, 20, 1000])
def test_best_symbols_are_the_first_of_all_pairs(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(R, "FREQUENT", frequent)
    spark.createDataFrame([(0, "CHAD")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(60).selectExpr("id s_suppkey", "concat('Supplier#', lpad(id % 40, 9, '0')) s_name", "0 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(300).selectExpr("id c_custkey", "concat('Customer#', lpad(id % 50, 9, '0')) c_name", "0 c_nationkey", "'M' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    calls = []
    monkeypatch.setattr(R, "best_symbols", lambda *a, f=R.best_symbols: calls.append(a) or f(*a))
    most, rows = made(QUERIES["join1c_symbols"](spark, str(tmp_path)))
    q, e, model, limit = calls[0]
    want = R.top(R.symbol_scores(q, e, model), limit).collect()
    short = lambda rs: {(r.query_id, r.entity_id, round(r.boost, 9)) for r in rs}
    assert len(rows) == len(want) == 60 * 20 and short(rows) == short(want)
    assert frequent != 20 or most < 60 * 300


def test_pairs_by_country_are_not_sent(spark, tmp_path):
    spark.createDataFrame([(0, "CHAD"), (1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(100).selectExpr("id s_suppkey", "concat('Supplier#', id) s_name", "int(id % 2) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(300).selectExpr("id c_custkey", "concat('Customer#', id % 150) c_name", "int(id % 2) c_nationkey", "'M' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["join1d_typed_keys"](spark, str(tmp_path))
    rows = got.collect()
    want = {(f"S{s}", f"C{c}"): float(s == c % 150) + (s % 2 == c % 2) for s in range(100) for c in range(300) if s == c % 150 or s % 2 == c % 2}
    assert len(rows) == len(want) and {(r.query_id, r.entity_id): r.boost for r in rows} == want
    above = got._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[0]
    assert "Generate" in above and "Aggregate" not in above


@pytest.mark.parametrize("frequent, limit", [(2, 1), (40, 3), (1000, 3)])
def test_candidates_are_the_best_of_all_pairs(spark, monkeypatch, frequent, limit):
    """Names nearly alike, shared words and countries; some entities are of schemas that can't match."""
    monkeypatch.setattr(R, "FREQUENT", frequent)
    r = random.Random(3)
    words = ["alpha", "alphq", "betas", "gamma", "delta", "deltb"]

    def some(prefix, n, schemas):
        rows = [(f"{prefix}{i}", r.choice(schemas), {"name": [" ".join(r.sample(words, 2))], "country": [r.choice(["fr", "de"])]}) for i in range(n)]
        return spark.createDataFrame(rows, "id string, schema string, properties map<string, array<string>>")

    q = precompute(complete(some("q", 12, ["Company"])), MODEL).cache()
    index = Index(complete(some("e", 120, ["Company", "Company", "Vessel"])).cache(), MODEL)
    params = MatchParams(limit=limit, candidate_factor=2)
    # lists of one's own, here empty ones, take the way by all pairs
    own = q.select(F.col("id").alias("query_id"), F.array().cast("array<string>").alias("include_datasets"))
    short = lambda df: sorted((x.query_id, x.entity_id, round(x.boost, 9)) for x in df.collect())
    most, rows = made(candidates(q, index, params))
    want = short(candidates(q, index, params, own))
    assert sorted((x.query_id, x.entity_id, round(x.boost, 9)) for x in rows) == want and len(want) == 12 * params.candidate_limit()


def test_candidates_by_country_are_not_paired(spark):
    rows = lambda p, n: spark.range(n).selectExpr(f"concat('{p}', id) id", "'Company' schema", f"map('name', array(concat('{p * 5}', ' ', lpad(id % 20, 9, '0'))), 'country', array('fr')) properties")
    q = precompute(complete(rows("q", 200)), MODEL)
    most, got = made(candidates(q, Index(complete(rows("e", 2000)), MODEL), MatchParams()))
    assert len(got) == 200 * 50 and most < 100_000


def test_alike_parts_are_scored_once(spark, tmp_path):
    """Two names and three brands, many copies: totals and the first five by id, the query itself left out."""
    n = 1200
    spark.range(n).selectExpr("id p_partkey", "if(id % 2 = 0, 'hot bolt', 'hot ring') p_name", "concat('Brand#', id % 3) p_brand", "'T' p_type").write.parquet(f"{tmp_path}/part.parquet")
    most, rows = made(QUERIES["flagship_match"](spark, str(tmp_path)))
    want = set()
    for q in range(0, n, 100):
        hits = sorted((-(1.0 - 0.2 * (q % 3 != c % 3)), f"P{c}") for c in range(n) if c != q and q % 2 == c % 2)
        want |= {(f"P{q}", c, i, -s, True, len(hits)) for i, (s, c) in enumerate(hits[:5], 1)}
    assert {(r.query_id, r.entity_id, r.rank, r.score, r.match, r.total) for r in rows} == want and most < 5 * n


def test_pairs_of_a_frequent_key_are_written_small(spark, tmp_path):
    """Entities of one key come in short runs, query after query, so that files of pairs hold them as repeats."""
    key = lambda rows, letter: rows.selectExpr(f"concat('{letter}', id) id", "'countries' kind", "'chad' key", "1D boost")
    pairs = R.block(key(spark.range(200), "S"), key(spark.range(20_000), "C"))
    pairs.write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == 200 * 20_000 and got.filter("boost = 1").count() == 200 * 20_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").rglob("*.parquet")) < 200 * 20_000 * 0.6


@pytest.mark.parametrize("run, deal", [(1, 1), (2, 5), (7, 20)])
def test_block_by_runs_of_any_length(monkeypatch, keys, run, deal):
    monkeypatch.setattr(R, "RUN", run)
    monkeypatch.setattr(R, "DEAL", deal)
    q, e, boosts = keys
    rows = R.block(q, e).collect()
    assert len(rows) == len(boosts) and {(r.query_id, r.entity_id): r.boost for r in rows} == boosts


def test_entities_with_keys_of_their_own_are_met_in_runs(spark, tmp_path):
    """Events of 200 users and two types; every user is a query of both types, and meets a type's events run by run."""
    spark.range(1600).selectExpr("id event_id", "id % 200 user_id", "concat('t', id % 2) event_type").write.parquet(f"{tmp_path}/events.parquet")
    e = spark.read.parquet(f"{tmp_path}/events.parquet")
    key = lambda rows, kind, c, boost: rows.selectExpr("id", f"'{kind}' kind", f"string({c}) key", f"double({boost}) boost")
    both = lambda rows: key(rows, "user", "user_id", 2).unionByName(key(rows, "type", "event_type", 1))
    q = e.filter("event_id < 200").selectExpr("concat('U', user_id) id", "user_id", "explode(array('t0', 't1')) event_type")
    most, rows = made(R.block(both(q), both(e.selectExpr("concat('E', event_id) id", "user_id", "event_type"))), "Join")
    assert len(rows) == 200 * 1600 and most < 10_000
    assert {(r.query_id, r.entity_id): r.boost for r in rows} == {(f"U{u}", f"E{i}"): 1.0 + 2 * (i % 200 == u) for u in range(200) for i in range(1600)}
