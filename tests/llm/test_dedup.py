import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lynceus.llm import fmindex, minhash, vec
from lynceus.llm.graph import components, forest
from tests.llm.helpers import corpus, documents, words


def sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def linked(texts, ids, k, percent):
    s = sets(texts, k)
    by = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            by[g].append(i)
    both = Counter(tuple(sorted((a, b))) for v in by.values() for j, a in enumerate(v) for b in v[:j])
    f = forest([(ids[a], ids[b]) for (a, b), n in both.items() if 100 * n >= percent * (len(s[a]) + len(s[b]) - n)])
    return {i: (len(x), f.get(i, i)) for i, x in zip(ids, s, strict=True)}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, k):
    texts = corpus()
    ids = [3 * i + 1 for i in range(len(texts))]
    got = minhash.near_duplicates(documents(spark, texts, ids), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(texts, ids, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_link_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNIT", 4)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        w = list(base)
        for j in range(i):
            w[(j * 7) % 60] = f"u{j}"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), 2, 80).collect()}
    assert got == linked(texts, ids, 2, 80)


def test_near_duplicates_of_nothing_nulls_and_repeats(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    text = " ".join(f"a{i}" for i in range(30))
    got = sorted(minhash.near_duplicates(documents(spark, [text, text, text, None, ""], [5, 2, 2, 9, None])).collect(), key=repr)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(2, 2, True), (2, 2, True), (5, 2, False), (9, 9, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.sort(x[:300]), np.sort(x[100:])
    s = minhash.superminhash([a, b, a[:1], x[:0]], 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1
    assert len(set((s[2] >> np.uint64(32)).tolist())) == 256  # one element deals every rank once
    assert (s[3] == np.uint64(2**64 - 1)).all()
    assert (minhash.superminhash([a], 256)[0] == s[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without_repeats(texts, ids, n):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in sorted(zip(ids, split, strict=True)):
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, w in zip(ids, split, strict=True):
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone |= set(range(j, j + n))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2000, 400_000), (0, 400_000), (2000, 100)])
def test_substrings_against_brute_force(spark, hot, shard):
    texts = corpus(2)
    ids = [(7 * i) % len(texts) for i in range(len(texts))] if len(texts) % 7 else list(range(len(texts)))
    want = without_repeats(texts, ids, 50)
    got = fmindex.removed(documents(spark, texts, ids), hot=hot, shard_words=shard).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (a, b, hashlib.sha256(c).hexdigest()) for i, (a, b, c) in want.items()}


def test_a_passage_of_all_documents(spark, monkeypatch):
    """Busy anchors around a passage that every document has, and segments that meet their places by a broadcast."""
    monkeypatch.setattr(fmindex, "MANY", 1)
    rng = random.Random(4)
    passage = words(rng, 90, 10**6)
    texts = [" ".join([*words(rng, 30, 10**6), *passage, *words(rng, rng.choice([0, 5, 60]), 10**6)]) for _ in range(1100)]
    want = without_repeats(texts, list(range(1100)), 50)
    for hot in (20, 5000):
        got = fmindex.removed(documents(spark, texts), hot=hot).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (a, b, hashlib.sha256(c).hexdigest()) for i, (a, b, c) in want.items()}


def test_substrings_keep_columns_and_untouched_texts(spark):
    long = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [long, "own  text\n" + long + " end", None, "  "], [1, 2, 3, 4])
    got = {r.doc_id: r for r in fmindex.substring_dedup(docs).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [long, "own text end", None, "  "]
    assert got[1].__fields__ == docs.columns
    assert fmindex.removed(documents(spark, [])).count() == 0
    twice = fmindex.removed(documents(spark, [long, long, long], [1, 1, None])).collect()
    assert [r.n_removed for r in twice] == [0, 0, 0]


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 4, n).astype(np.uint64) for n in (30, 1, 50, 7, 0)]
    index = fmindex.FMIndex(seqs, 8)
    query = rng.integers(0, 5, 60).astype(np.uint64)
    have = {tuple(s[i:j].tolist()) for s in seqs for i in range(len(s)) for j in range(i + 1, min(i + 8, len(s)) + 1)}
    want = [max((k for k in range(1, 9) if tuple(query[i : i + k].tolist()) in have and i + k <= len(query)), default=0) for i in range(len(query))]
    assert index.matching_statistics(query).tolist() == want


def test_wavelet_matrix_rank():
    rng = np.random.default_rng(6)
    seq = rng.integers(0, 11, 500)
    tree = fmindex.WaveletMatrix(seq, 10)
    for c in range(11):
        pos = np.arange(0, 501, 13)
        assert tree.rank(np.full(len(pos), c), pos).tolist() == [int((seq[:p] == c).sum()) for p in pos]


def test_hash_index_and_words():
    keys = vec.distinct(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64))
    index = vec.HashIndex(keys[:10])
    index.add(keys[10:])
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) == -1).all()
    texts = [b"ab cd", b"", b"  ", b"e", b"f"]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, ptr = vec.words(buf, off, vec.SPACED)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e", b"f"] and ptr.tolist() == [0, 2, 2, 2, 3, 4]


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from lynceus.llm import shared

    conf = lambda **x: SimpleNamespace(get=lambda k, d=None: x.get("at", d))
    on = lambda master, **x: SimpleNamespace(conf=conf(**x), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(**x), getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    assert shared.shared_dir(on("spark://h:1", at="s3a://b/x/")) == "s3a://b/x"
    assert shared.shared_dir(on("local[4]")).startswith("file://")
    for master in ("spark://h:1", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(on(master))
    t = shared.cut(spark.range(3).toDF("a"), "some")
    assert t.count() == 3
    path = shared._made[-1][1]
    shared.clear(spark)
    assert path not in [p for _, p in shared._made]
