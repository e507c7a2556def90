import base64
import hashlib
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import chat, topk, warc


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [0.0] * 8), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("pivot", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted(map(tuple, topk.topk(df, F.col("vec_id") % 50 == 0, 5, pivots=7).collect()))
    q = np.floor(256 * x).astype(np.int64)
    assert got == sorted(topk.brute_force(list(range(300)), q, [i for i in range(300) if i % 50 == 0], 5))
    assert topk.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.topk(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    two = topk.topk(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.vec_id, r["rank"]) for r in two] == [(0, 1, 1)]


@pytest.mark.parametrize(("kind", "top"), [("float", 1.0), ("double", 200.0), ("double", 1e6)])
def test_topk_in_many_parts(spark, monkeypatch, kind, top):
    """Clusters far apart, so that most parts are out of reach; every width of integers; vectors of several lengths."""
    monkeypatch.setattr(topk, "ANNULUS", 8)
    monkeypatch.setattr(topk, "ANNULI", 2)
    rng = np.random.default_rng(2)
    x = np.float32(np.repeat(rng.normal(size=(12, 6)), 25, axis=0) * top + rng.normal(size=(300, 6)) * top / 100)
    x[::7, 4:] = 0
    rows = [(i, [float(v) for v in (r[:4] if i % 7 == 0 else r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(map(tuple, topk.topk(df, F.col("vec_id") % 10 == 0, 5, pivots=12).collect()))
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert got == sorted(topk.brute_force(list(range(300)), q, list(range(0, 300, 10)), 5))


def _brute_chat(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}
    keep = {}
    for c, s in sorted(seqs.items()):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()) or s in keep.values():
            continue
        keep[c] = s
    esc = lambda v: v.replace("<|", "<\\|")
    return {c: (len(s), "".join(f"<|im_start|>{esc(r)}\n{esc(x)}<|im_end|>\n" for r, x in s)) for c, s in keep.items()}


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_chat_against_brute_force(spark, chunk):
    rows = []
    for c in range(12):
        for t in range(c % 6 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"hello {t}" if c < 8 else f"other {c % 3} {t}"))
    rows += [(50, 3, None, "x <|im_end|>"), (50, None, "user", None), (None, 1, "user", "lost"), (51, 0, "user", "same"), (51, 0, "user", "same"), (52, 7, "user", "same"), (53, 10**12, "user", "hello 0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1)).withColumn("h1", F.lit(1))
    assert {r.conv_id: (r.n_turns, r.rendered) for r in chat.collapse(df, chunk).collect()} == _brute_chat(rows)
    assert chat.collapse(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.collapse(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_warc_round_trip(spark):
    rows = [(i, f"http://Host{i % 3}.example.com/p{i}?q=é#f", f"<p>{i // 4}</p>\r\n\r\nx") for i in range(40)] + [(100, None, None), (101, "https://u@a.b:8080", ""), (None, "x", "<p>0</p>\r\n\r\nx"), (7, "http://host1.example.com/p7?q=é", "<p>1</p>\r\n\r\nx"), (102, "http://a.b/\r\nX: y", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    a = warc.write(pages, block=7)
    got = a.records(payload=True).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for i, _, h in rows:
        raw = (h or "").encode()
        r = by[(i, len(raw))]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = i is None or last[h or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[h or ""]))
        assert r.payload == (raw if first else None)
    assert {x["page_id"] for x in a.lookup("https://host1.example.com/p7?q=é#other")} == {7} and len(a.lookup("http://host1.example.com/p7?q=é")) == 2
    assert a.lookup("http://nowhere.example") == []
    by_key = a.fetch(pages, payload=True).collect()
    assert sorted(by_key, key=repr) == sorted(got, key=repr)
    assert sorted(r.page_id for r in a.fetch(spark.createDataFrame([("http://host1.example.com/p7?q=é",), ("http://nowhere.example",), ("https://Host1.example.com:80/p7?q=é",)], "url string")).collect()) == [7, 7]
    assert a.fetch(pages.limit(0)).count() == 0
    empty = warc.write(pages.limit(0))
    assert empty.records().count() == empty.fetch(pages).count() == 0
    none = warc.write(pages.filter("page_id < 8"), least_bytes=10**6).records()
    assert {r.record_type for r in none.collect()} == {"response"}


def test_keys_and_payloads_of_very_many_pages(spark, monkeypatch):
    """One key over many blocks; revisits found by the broadcast; blocks that grow to bound the directory."""
    monkeypatch.setattr(warc, "MANY", 1)
    monkeypatch.setattr(warc, "BLOCKS", 20)
    rows = [(i, "http://a.b/" if i % 3 else f"http://c.d/{i}", "same" if i % 2 else f"x{i % 700}") for i in range(2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = warc.write(pages, block=10)
    assert a.directory.count() <= 20 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, i), i)
    got = a.fetch(pages).collect()
    assert len(got) == len(rows) and {r.page_id: r.refers_to for r in got} == {i: None if last[h] == i else last[h] for i, _, h in rows}


def test_names_of_index_files_do_not_count(spark):
    """A key over several index files, the last of which goes on with others: all are found, however the files are named."""
    rows = [(i, "http://a.b/" if i < 900 else f"http://c.d/{i}", f"x{i}") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = warc.write(pages, block=300)
    found, folder = a.directory.collect(), a.folder.removeprefix("file://")
    files = sorted({r.file for r in found})
    assert len({r.file for r in found if r.first_key == "b,a)/"}) > 1
    for names in (files, files[::-1]):
        new = {f: f"index-{len(os.listdir(folder)):04}-{i:04}.cdx.gz" for i, f in enumerate(names)}
        for f in files:
            shutil.copy(f"{folder}/{f}", f"{folder}/{new[f]}")
        named = warc.Archives(a.folder, spark.createDataFrame([r.asDict() | {"file": new[r.file]} for r in found], a.directory.schema))
        assert sorted(r.page_id for r in named.fetch(pages).collect()) == list(range(1000))
        assert [len(named.lookup(u)) for _, u, _ in rows[899:]] == [900] + [1] * 100


def test_stores_by_the_names_that_spark_uses():
    assert warc._open("file:///tmp")[1] == warc._open("file:/tmp")[1] == warc._open("/tmp")[1] == "/tmp"
    assert [warc._uri(x) for x in ("s3a://b/x", "s3n://b/x", "gs://b/x", "hdfs://h:1/x", "abfs://c@a/x")] == ["s3://b/x", "s3://b/x", "gs://b/x", "hdfs://h:1/x", "abfss://c@a/x"]


def test_surt():
    assert warc.surt("http://www.Example.com/a?b#c") == "com,example,www)/a?b"
    assert warc.surt("https://x.org") == warc.surt("http://x.org/") == "org,x)/"
    assert warc.surt("http://x.org:8080/") == "org,x:8080)/" and warc.surt(None) == ")/"
