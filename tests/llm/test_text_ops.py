import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lynceus.llm import decontaminate as D
from lynceus.llm import langid, packing, ppm, toxicity, vec
from tests.llm.helpers import corpus, documents, words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_contamination_against_brute_force(spark):
    texts = corpus(4)
    items = [(f"i{j}", " ".join((t or "").split()[3:40])) for j, t in enumerate(texts[:8])] + [("short", "one"), ("short2", "a B c!"), ("none", None), ("blank", " ,. "), ("i1", "one more ONE")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    want = D.brute_force(texts, items)
    for item_bytes in (1 << 20, 200):
        got = sorted(D.digest(D.contamination(documents(spark, texts), bench, item_bytes=item_bytes)).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == [(n, h, len(i), D.sha(i)) for n, h, i in want]
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_decontaminated_texts(spark):
    item = " ".join(f"q{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(300))
    docs = documents(spark, [f"{filler} {item.upper()}! {filler}", item, filler, None, "", item], [1, 2, 3, 4, 5, 2])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert got == {1: f"{filler} {filler}", 3: filler, 4: None, 5: ""}
    assert D.decontaminate(docs, bench).columns == docs.columns
    assert D.contamination(documents(spark, []), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == 6


def test_decontaminated_by_all_automata_at_once(spark):
    w = lambda p, n: [f"{p}{i}" for i in range(n)]
    items = [(f"i{k}", " ".join(w(f"k{k}x", 4))) for k in range(12)]
    docs = [
        " ".join([*w("a", 97), *(x for k in range(12) for x in w(f"k{k}x", 4)[: 4 if k < 3 else 0]), *w("b", 97)]),
        " ".join([*w("a", 40), *w("k0x", 4), *w("b", 40)]),
        " ".join([*w("a", 400), *(x for k in range(3) for x in w(f"k{k}x", 4)), *w("b", 400)]),
        " ".join([*w("a", 400), "k5x0", "k5x1", *w("k0x", 4), "k5x2", "k5x3", *w("b", 400)]),
        "none of it",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    run = lambda size: {r.doc_id: r.text for r in D.decontaminate(frame, bench, window=4, item_bytes=size).collect()}
    whole = run(1 << 20)
    assert 0 not in whole and whole[2] == " ".join([*w("a", 400), *w("b", 400)]) and "k5x1 k5x2" in whole[3]
    for size in (150, 60, 20):
        assert run(size) == whole


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = corpus(5) + ["Émile's  CAFÉ—10 naïve", "<|endoftext|> x", "a b c d", "é É", " ".join(f"z{i}" for i in range(9000))]
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.pack(documents(spark, texts), PATH, ids=True).collect()
    back = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(back.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        back[r.doc_id] += r.ids
    assert back == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_packing_in_shares(spark, monkeypatch):
    """Repeated rows, and more pieces of a length than a share takes."""
    monkeypatch.setattr(packing, "UNIT", 3)
    docs = documents(spark, ["a b"] * 50 + ["x " * 9000] * 4 + [None] * 20, [*range(40), *[7] * 10, *range(100, 104), *[None] * 20])
    rows = packing.pack(docs, PATH).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len([r for r in rows if r.length == 1]) == 20
    assert len(at) == -(-sum(r.length for r in rows) // 4096)


def test_packing_keeps_places_and_attention(spark):
    docs = documents(spark, ["a b c"] * 30 + ["d " * 40] * 10)
    rows = packing.pack(docs, PATH, capacity=128, places=3, attention=5000).collect()
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 128 and len(x) <= 3 and sum(n * n for n in x) <= 5000 for x in per.values()) and sum(map(len, per.values())) == len(rows)


def test_vector_best_fit_chooses_by_all_three():
    """Two bins with as many tokens left: the one with fewer places and more attention left is told from the other."""
    def first(weights, rule):
        fit = packing.VectorBestFit(100, 100, 10_000, rule, weights)
        fit._put(np.array([40, 90, 4000]), [(0, 1)])
        fit._put(np.array([40, 20, 9000]), [(1, 1)])
        fit.sequences = 2
        fit.add(10, 1)
        return fit.rows[0][3]

    assert [first((1, 1, 0), "norm"), first((1, 0, 1), "norm"), first((1, 1, 0), "dot"), first((1, 0, 1), "dot")] == [1, 0, 0, 1]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(2)
    number = {int(n): int(rng.integers(1, 9)) for n in rng.integers(1, 100, 40)}
    for places, attention in ((None, None), (3, None), (None, 6000), (4, 9000)):
        fit = packing.VectorBestFit(100, places, attention or None, rule)
        for n in sorted(number, reverse=True):
            if attention is None or n * n <= attention:
                fit.add(n, number[n])
        bins, ranks = {}, {}
        for n, rank, copies, first, offset, count in fit.table().tolist():
            for r in range(copies * count):
                assert rank + r not in ranks.setdefault(n, set())
                ranks[n].add(rank + r)
                bins.setdefault(first + r // copies, []).append((offset + r % copies * n, n))
        for pieces in bins.values():
            end = 0
            for o, n in sorted(pieces):
                assert o == end
                end += n
            assert end <= 100 and len(pieces) <= (places or 100) and sum(n * n for _, n in pieces) <= (attention or 10**9)
        assert all(ranks[n] == set(range(number[n])) for n in ranks)
    with pytest.raises(ValueError):
        packing.VectorBestFit(100, None, 10).add(50, 1)


def test_ppm_against_plain_trie(spark):
    texts = corpus(6, 20)
    docs = documents(spark, texts)
    train = [t for i, t in enumerate(texts) if i % 4]
    model = ppm.fit(docs.filter("doc_id % 4 <> 0"), order=3)
    trie = ppm.AdaptivePPM(3)
    for t in train:
        before = (ppm.END,) * 3
        for s in [*(t or "").encode().lower(), ppm.END]:
            trie.learn(before, s)
            before = (*before, s)[1:]
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    count = {}
    for t in train:
        for w in tok(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for share in (1 << 20, 4):
        got = {r.doc_id: r for r in ppm.score(docs, ppm.fit(docs.filter("doc_id % 4 <> 0"), order=3, head_share=share) if share == 4 else model).collect()}
        for i, t in enumerate(texts):
            r, w = got[i], tok(t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
            assert r.base_score == pytest.approx(sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            if len(t or "") < 3000:
                assert r.score == pytest.approx(trie.text((t or "").encode(), learn=False))


def test_ppm_keeps_grams_beyond_its_head(spark):
    texts = corpus(6, 20)
    docs = documents(spark, [*texts, "zq xj " * 9])
    trie = ppm.AdaptivePPM(3)
    for t in texts:
        before = (ppm.END,) * 3
        for s in [*(t or "").encode().lower(), ppm.END]:
            trie.learn(before, s)
            before = (*before, s)[1:]
    train = docs.filter(f"doc_id < {len(texts)}")
    for head in (1, 50, 1 << 21):
        model = ppm.fit(train, order=3, gram_head=head)
        assert len(model.top) <= head
        got = {r.doc_id: r.score for r in ppm.score(docs, model).collect()}
        for i, t in enumerate([*texts, "zq xj " * 9]):
            if len(t or "") < 3000:
                assert got[i] == pytest.approx(trie.text((t or "").encode(), learn=False))


def test_ppm_scores_with_its_own_model(spark):
    """Many models one after the other in the same workers; repeated rows; a score that unrelated texts don't change."""
    docs = documents(spark, ["abab cd", "abab cd", "é"], [1, 1, 2])
    seen = []
    for text in ["abab cd", "zz", "abab"] * 2:
        got = ppm.score(docs, ppm.fit(documents(spark, [text]), order=2)).collect()
        assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1
        trie = ppm.AdaptivePPM(2)
        trie.text(text.encode())
        assert all(r.score == pytest.approx(trie.text(("abab cd" if r.doc_id == 1 else "é").encode(), learn=False)) for r in got)
        seen.append(sorted(r.score for r in got))
    assert seen[:3] == seen[3:] and seen[0] != seen[1]


def test_ppm_is_a_distribution_and_survives_nothing(spark):
    trie = ppm.AdaptivePPM(2)
    trie.text(b"abracadabra")
    for before in ((97, 98), (256, 256), (1, 2)):
        assert sum(10 ** trie.log10(before, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)
    docs = documents(spark, ["ab", None])
    model = ppm.fit(docs.limit(0))
    got = {r.doc_id: r for r in ppm.score(docs, model).collect()}
    assert got[0].score == pytest.approx(-3 * np.log10(257)) and got[1].score == pytest.approx(-np.log10(257)) and got[0].n_known == 0
    assert ppm.score(docs.limit(0), model).count() == 0
    assert {r.doc_id: r.score for r in ppm.adaptive(docs, 2).collect()}[1] == pytest.approx(-np.log10(257))


def test_pruned_trie_sums_to_one(spark):
    texts = [" ".join(words(random.Random(i), 60, 50)) for i in range(30)]
    model = ppm.fit(documents(spark, texts), order=2, trie_share=300)
    s = ppm.Scorer(model.tries)
    for before in (b"w1", b"w9", b" w", b"zz"):
        key = np.array([(before[0] << 18) | (before[1] << 9) | c for c in range(257)], np.uint64)
        assert (10 ** s.log10(key)).sum() == pytest.approx(1)


def _languages(n=90):
    rng = random.Random(1)
    bags = {"aa": ["the", "cat", "sat", "mat"], "bb": ["der", "hund", "läuft", "über"], "cc": ["щука", "рыба"]}
    return [(i, " ".join(rng.choices(bags[l], k=rng.choice([2, 30]))), l) for i, l in enumerate((list(bags) * n)[:n])]


def test_language_id(spark):
    rows = _languages()
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34!", "aa"), (902, "", None), (903, "cat", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("__letter", F.lit(7))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model, prefix="p_").collect()}
    assert sum(got[i].p_lang_pred == l for i, _, l in rows) == len(rows) and not any(got[i].p_rejected for i, _, _ in rows)
    assert all(got[i].p_lang_pred == "und" and got[i].p_score == 0 and got[i].p_rejected for i in (900, 901, 902))
    assert got[903].p_lang_pred == "aa" and 0 <= got[903].p_score <= 1 and got[903].score == 1 and got[903]["__letter"] == 7
    own = langid.identify(docs, model)
    assert own.columns == ["doc_id", "text", "lang", "__letter", "lang_pred", "score", "rejected"]
    assert {r.doc_id: r.score for r in own.collect()} == {i: r.p_score for i, r in got.items()}
    empty = langid.fit(docs.limit(0))
    assert {r.p_lang_pred for r in langid.identify(docs, empty, prefix="p_").collect()} == {"und"}
    assert langid.identify(docs.limit(0), model, prefix="p_").count() == 0


def test_language_id_rejects_what_is_far(spark):
    rng = random.Random(3)
    rows = [(i, t * 3, l) for i, t, l in _languages(3000)]
    noise = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60))
    docs = spark.createDataFrame([*rows, (9000, noise, None), (9001, "かな文字だけの長い文章です。" * 20, None), (9002, rows[0][1], None), (9003, rows[0][1], None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.filter("lang is not null"))).collect()}
    assert got[9000].rejected and got[9001].rejected and got[9000].lang_pred != "und"
    assert sum(got[i].rejected for i, _, _ in rows) <= 0.01 * len(rows)
    assert got[9002].lang_pred == got[9003].lang_pred == "aa" and got[9002].score == got[9003].score


def test_language_id_against_brute_force(spark):
    rows = _languages(60) + [(200, "x" * 300_000 + " der hund", "bb"), (201, "The CAT", None), (202, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    mask = (1 << 32) - 1
    plain = lambda c: c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
    for r in langid.identify(docs, model).collect():
        b, x = [plain(c) for c in r.text.encode()], np.zeros(langid.DIMS)
        for i in range(len(b) - 1):
            x[((((b[i] << 8) | b[i + 1]) + (1 << 24)) * 2654435761 & mask) >> 20] += 1
        for i in range(len(b) - 2):
            x[(((b[i] << 16) | (b[i + 1] << 8) | b[i + 2]) * 2246822519 & mask) >> 20] += 1
        x = np.sqrt(x) * model.idf
        sim = model.centroids @ (x / (np.linalg.norm(x) or 1))
        assert model.languages[int(sim.argmax())] == r.lang_pred and r.score == pytest.approx(max(0, sim.max()), abs=1e-5)
        assert r.rejected == (r.score < model.limits[int(sim.argmax()), int(np.log2(len(r.text.encode())))])


def test_language_sample_is_bounded_whatever_the_copies(spark):
    rows = [(i, "the cat sat", "aa") for i in range(3000)] + [(i + 5000, f"der hund {i}", "bb") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    for frame in (docs, docs.select("text", "lang")):
        model = langid.fit(frame, fit_rows=50)
        seen.append(set(model.languages))
        assert {r.lang_pred for r in langid.identify(docs.filter("doc_id in (1, 5001)"), model).collect()} == {"aa", "bb"}
    assert seen == [{"aa", "bb"}] * 2


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal(c, 0.05, (50, 5)) for c in np.eye(5)])).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = (x @ langid.cluster(x, 5).T).argmax(axis=1).reshape(5, 50)
    assert all(len(set(r.tolist())) == 1 for r in own) and len(set(own[:, 0].tolist())) == 5
    assert len(langid.cluster(x[:1], 4)) == 1 and len(langid.cluster(np.repeat(x[:1], 9, axis=0), 4)) == 1


def test_toxicity(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.sample(w := words(rng, 60, 300) + (["vile", "scum"] if i % 4 == 0 else []), len(w))) for i in range(400)]
    docs = documents(spark, [*texts, None, "", "a vile thing", "é VILE scum, a", texts[0]], [*range(403), 403, 0])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 405 and len({r.score for r in rows if r.doc_id == 0}) == 1
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400)) >= 396
    assert got[400].score == got[401].score < 0.5 < got[402].score
    assert [(s.start, s.end) for s in got[402].spans] == [(2, 6)] and [(s.start, s.end) for s in got[403].spans] == [(2, 11)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1 or doc_id = 1")):
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} <= {0, 1}
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda t, y, n: seen.append((len(t), sum(map(len, t)), n)))
    toxicity.fit(docs, labels, fit_rows=40)
    toxicity.fit(docs, labels, fit_bytes=4000)
    assert seen[0][0] == 80 and 2000 < seen[1][1] <= 4000 and seen[0][2] == {0: 225, 1: 75}


def test_toxicity_against_brute_force(spark):
    """Scores and spans of short texts from the model's weights, over all labellings of their tokens."""
    rng = random.Random(5)
    texts = [" ".join(rng.sample(w := words(rng, 6, 30) + (["vile", "Scum9"] if i % 3 == 0 else []), len(w))) for i in range(120)]
    texts += ["", None, "-- !", "vile", "a, vile-scum9 b"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.node[1:].tolist(), strict=True))
    for r in toxicity.score(docs, model).collect():
        text = texts[r.doc_id] or ""
        found = list(re.finditer(r"[A-Za-z0-9]+", text))
        hashes = toxicity.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()
        assert len(hashes) == len(found)
        p, _ = toxicity.brute_force([model.node[0] + sum(weight.get(f, 0.0) for f in row) for row in hashes], model.edge)
        x = [1, np.log1p(sum(p)), max(p, default=0), np.log1p(1000 * sum(p) / max(1, len(p)))]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.logistic))))
        spans = []
        for m, q in zip(found, p, strict=True):
            if q >= 0.5 and spans and spans[-1][2]:
                spans[-1][1:] = [m.end(), True]
            elif q >= 0.5:
                spans.append([m.start(), m.end(), True])
            elif spans:
                spans[-1][2] = False
        assert [(s.start, s.end) for s in r.spans] == [(a, b) for a, b, _ in spans]


def test_features_of_tokens():
    buf = "Ab cde ab\u00e9 12".encode()
    f, starts, ends, ptr = toxicity.tokens(np.frombuffer(buf + b"ab", np.uint8), np.array([0, len(buf), len(buf), len(buf) + 2]))
    assert [buf[a:b].decode() for a, b in zip(starts[:4], ends[:4], strict=True)] == ["Ab", "cde", "ab\u00e9", "12"] and ptr.tolist() == [0, 4, 4, 5]
    assert f[0, 0] == f[4, 0] and f[0, 5] != f[4, 5]  # the word is blind to case, its shape is not
    assert f[0, 3] == f[4, 3] == f[4, 3] and f[3, 4] == f[4, 4]  # beside the first and last tokens
    assert len({*f[:, 1].tolist()}) == 4 and f[1, 3] != f[2, 3]


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(4)
    edge = np.array([[0, 0.7], [-0.4, 1.2]])
    node, valid = rng.normal(size=(4, 7)), np.arange(7) < np.array([7, 1, 4, 6])[:, None]
    marginal, clean, moves = toxicity.forward_backward(node, edge, valid, True)
    for i, n in enumerate(valid.sum(axis=1).tolist()):
        p, log_clean = toxicity.brute_force(node[i, :n].tolist(), edge)
        assert marginal[i, :n] == pytest.approx(p) and clean[i] == pytest.approx(log_clean) and (marginal[i, n:] == 0).all()
        assert moves[i, 1] + moves[i, 2] == pytest.approx(sum(p[:-1])) and moves[i, 0] + moves[i, 2] == pytest.approx(sum(p[1:]))


def test_gradient_of_the_field(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 4)
    rng = np.random.default_rng(7)
    row, label, ptr = rng.integers(0, 6, (11, 6)), rng.random(11), np.array([0, 3, 3, 11])
    theta = rng.normal(size=10)
    theta[6] = 0
    at = lambda t: toxicity.likelihood(row, ptr, label, t[:6], t[6:].reshape(2, 2))
    _, by_node, by_edge = at(theta)
    for i, g in enumerate([*by_node, *by_edge.ravel()]):
        if i != 6:
            step = np.eye(10)[i] * 1e-5
            assert (at(theta + step)[0] - at(theta - step)[0]) / 2e-5 == pytest.approx(g, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_on_held_out_rows():
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id) ORDER BY md5(CAST(doc_id AS VARCHAR))").fetchall()
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows])
    y = np.array([t for _, _, t in rows])
    model = toxicity.learn([t for (_, t, _), o in zip(rows, out, strict=True) if not o], y[~out])
    tagger = toxicity.Tagger(model)
    p, _, _, ptr = tagger.read(*vec.binary(pa.array([t for (_, t, _), o in zip(rows, out, strict=True) if o], pa.string())))
    score, y = tagger.score(p, ptr), y[out]
    auc = np.mean((score[y == 1][:, None] > score[y == 0]) + 0.5 * (score[y == 1][:, None] == score[y == 0]))
    assert auc > 0.85 and (score[y == 0] < 0.5).mean() > 0.98 and (score[y == 1] >= 0.5).mean() > 0.55


def test_languages_of_many_short_texts_are_counted_in_blocks(monkeypatch):
    """A row of counts is far larger than a short text, so rows bound a block, not bytes alone."""
    at_once, counts = [], langid.counts
    monkeypatch.setattr(langid, "counts", lambda buf, off: at_once.append(len(off) - 1) or counts(buf, off))
    n = 2000
    texts, langs = pa.array([f"word {i} abc" for i in range(n)]), pa.array(["aa"] * n)
    sent = type("Sent", (), {"value": langid.LanguageModel(np.ones(langid.DIMS, np.float32), np.ones((1, langid.DIMS), np.float32), ["aa"], np.zeros((1, langid.CLASSES)))})
    row = lambda *columns: iter([pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])])
    assert sum(b.column(1).to_pylist()[-1] for b in langid._frequencies(row(texts))) == n
    assert sum(len(b) for b in langid._sampled(row(langs, texts, pa.array(range(n))))) == n
    assert sum(sum(b.column(3).to_pylist()) for b in langid._distances(row(texts), sent)) == n
    got = pa.Table.from_batches(langid._predict(row(texts, pa.array([True] * n)), sent, 0, [0]))
    assert got.column(0).to_pylist() == texts.to_pylist() and set(got.column(1).to_pylist()) == {"aa"}
    assert sum(at_once) == 4 * n and max(at_once) <= langid.BLOCK < n
