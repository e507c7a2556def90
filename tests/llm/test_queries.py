import os

import pytest

from lynceus.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

FOLDER = os.environ.get("LYNCEUS_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], connect(FOLDER))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_a_row_for_each_document(spark, name):
    table = "pages" if name.startswith("op10") else "documents"
    got = QUERIES[name](spark, FOLDER)
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert got.select(got.columns[0]).distinct().count() == want


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op2_langid"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()


def test_pipeline_against_brute_force(spark):
    """The stages one by one: what goes, goes for its stage's reason, and nothing else changes."""
    from corpus_pipeline import STAGES, run
    from lynceus.llm import decontaminate as D
    from tests.llm.test_dedup import linked, without_repeats

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    step = dict(STAGES)
    names = docs.columns
    a = step["language_id"](spark, docs, FOLDER).cache()
    assert a.columns == names and a.count() >= 0.98 * docs.filter("text rlike '[A-Za-z]'").count()
    rows = {r.doc_id: r for r in a.collect()}
    b = step["minhash_dedup"](spark, a, FOLDER).cache()
    ids = list(rows)
    want = {i for i, (_, c) in linked([rows[i].text for i in ids], ids, 5, 80).items() if i == c}
    assert b.columns == names and {r.doc_id for r in b.collect()} == want
    rows = {r.doc_id: r for r in b.collect()}
    c = step["substring_dedup"](spark, b, FOLDER).cache()
    ids = list(rows)
    less = without_repeats([rows[i].text for i in ids], ids, 50)
    expect = {i: rows[i].text if not n else kept.decode() for i, (_, n, kept) in less.items() if rows[i].text is None or not n or kept}
    assert c.columns == names and {r.doc_id: r.text for r in c.collect()} == expect
    d = step["decontaminate"](spark, c, FOLDER).cache()
    rows = {r.doc_id: r for r in c.collect()}
    report = dict(zip(rows, D.brute_force([r.text for r in rows.values()], bench), strict=True))
    assert d.columns == names and {r.doc_id for r in d.collect()} == {i for i, (n, h, _) in report.items() if not (h and 20 * h >= n)}
    got = run(spark, FOLDER)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in d.collect()}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, no n_chars, columns of names that operators use, nulls, repeats and a very long text."""
    from corpus_pipeline import STAGES
    from tests.llm.helpers import CLASH
    from pyspark.sql import functions as F

    spark.createDataFrame([("i", " ".join(f"q{i}" for i in range(20)))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    word = lambda i: f"{'abcdefgh'[i % 8]}{'aeiou'[i % 5]}{'lmnrst'[i % 6]}{i % 97}"
    texts = [" ".join(word(i * j + j) for i in range(60)) for j in range(1, 40)]
    rows = [*enumerate(texts), (100, " ".join(word(i) for i in range(60_000))), (101, None), (102, ""), (None, texts[3]), (5, texts[5]), (103, texts[7])]
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for docs in (plain, plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]), plain.limit(0)):
        for name, stage in STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns
            kept = [r.doc_id for r in got.collect()]
            assert (len(kept) == 0) == (docs.isEmpty())
            if kept and name == "minhash_dedup":
                assert 103 not in kept and kept.count(5) == 2 and None in kept and 101 in kept
        pieces = STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert (len(pieces) == 0) == docs.isEmpty()


def test_stages_get_batches_of_few_bytes(spark):
    """Each task holds batches outside the heap, so a stage's are small; a session's own setting stays."""
    from corpus_pipeline import _stage

    def sizes(batches):
        yield from (type(b).from_pydict({"n": [b.nbytes]}) for b in batches)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 200, 1, 1).selectExpr("id doc_id", "repeat('abcdefghij', 10000) text")
    stage, before = _stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long")), spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        got = [r.n for r in stage(spark, docs, "").collect()]
        assert sum(got) >= 20_000_000 and max(got) <= 5 << 20
        spark.conf.set(key, "9m")
        stage(spark, docs, "")
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
