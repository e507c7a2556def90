import os
import sys

import pytest

from lynceus.operators.entities import complete, precompute
from lynceus.plans import more_queries  # noqa: F401
from lynceus.plans.match import candidates
from lynceus.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

FOLDER = os.environ.get("LYNCEUS_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(df.select(*df.columns).collect()) > 0  # all columns: a count would leave kernels out


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "entity_id", "rank", "score", "match", "total"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_block_frequent_is_an_or_of_its_keys(spark):
    rows = [(r.event_id, r.user_id, r.event_type) for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect()]
    types = {}
    for _, u, t in rows:
        types.setdefault(u, set()).add(t)
    want = {(f"U{u}", f"E{e}"): 2.0 * (u == v) + (t in ts) for u, ts in types.items() for e, v, t in rows if u == v or t in ts}
    got = {(r.query_id, r.entity_id): r.boost for r in QUERIES["join1_block_frequent"](spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["match_end_to_end", "match_response", "stream_screening"])
def test_frequent_keys_find_candidates(spark, tmp_path, monkeypatch, name):
    """600 companies share several keys with the query, 25 of another country share one rare key with it."""
    names = [f"Common Holding N{i}" for i in range(600)] + [f"Rareword Q{i}" for i in range(25)]
    tables = {
        "nation": spark.createDataFrame([(0, "CHAD"), (1, "PERU")], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(i, n, int(i >= 600), "M") for i, n in enumerate(names)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": spark.createDataFrame([(1, "Common Holding Rareword", 0)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")

    class Called(Exception):
        pass

    def called(*args):
        raise Called(*args)

    monkeypatch.setattr(sys.modules[QUERIES[name].__module__], "match", called)
    with pytest.raises(Called) as got:
        QUERIES[name](spark, str(tmp_path))
    queries, index, params = got.value.args
    found = candidates(precompute(complete(queries), index.model), index, params).collect()
    assert any(int(r.entity_id[1:]) < 600 for r in found)


def test_every_score_is_formatted(spark):
    assert QUERIES["txt27_format_score"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.mark.parametrize("name, depth", [("join5_enrich", 2), ("src3_related", 1)])
def test_every_company_is_a_root(spark, name, depth):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_custkey").collect()
    got = QUERIES[name](spark, FOLDER).collect()
    assert len(got) == depth * len(orders) and {r.root for r in got} == {f"C{o.o_custkey}" for o in orders}
