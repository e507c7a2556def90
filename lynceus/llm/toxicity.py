"""Toxicity: a linear-chain conditional random field tags tokens, its marginals gather to documents.

Labels are of documents. A clean document labels all its tokens clean; in a toxic one a token is labelled
toxic as far as clean documents don't explain its word. The field has two states,
a bias, transition weights, and a weight of the toxic state for each feature of a token: the word, the words
beside it, its first and last three bytes and its shape. It is fitted to the token labels by the gradient of
their likelihood, which forward-backward gives. Chains are stretches of a text (STRETCH tokens); each
token's marginal comes from its stretch.

A document's score is a logistic function of its marginals, fitted on labelled rows that the field has not
seen. Offending tokens come with offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import vec

#: Labelled rows of each class that are learned from, at most, and the bytes of their whole texts, at most.
FIT_ROWS, FIT_BYTES = 1000, 32 << 20
STRETCH = 64
#: Passes over the sample, steps of a pass, the rate of a step and its decay.
PASSES, STEPS, RATE, DECAY = 6, 8, 0.15, 1e-3
#: A word's labels: documents' worth of its prior, and errors that are taken off its log odds ratio.
PRIOR, Z = 10.0, 2.0
#: Features of the sample that only one of its documents has can't be told from chance, and get no weight.
LEAST_DOCUMENTS = 2
BIAS = -6.0
_EDGE = np.uint64(0x2545F4914F6CDD1D)  # stands beside the first and the last token


@dataclass
class ToxicityModel:
    features: np.ndarray  # hashes, distinct
    node: np.ndarray  # weight of the toxic state: the bias, then by feature
    edge: np.ndarray  # 2 x 2, from clean to clean 0
    logistic: np.ndarray  # of `summary`


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of feature hashes for each token, start and end bytes, and the n + 1 token offsets of the texts."""
    low = vec.LOWER[buf]
    starts, ends, ptr = vec.words(low, off, vec.ALNUM)
    h = vec.word_hashes(low, starts, ends)
    some = ptr[1:] > ptr[:-1]
    before, after = np.r_[_EDGE, h[:-1]][: len(h)], np.r_[h[1:], _EDGE][: len(h)]
    before[ptr[:-1][some]] = _EDGE
    after[ptr[1:][some] - 1] = _EDGE
    size = ends - starts
    within = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.stack([starts, ends])], axis=0)[0]
    capitals, digits = within((buf >= 65) & (buf <= 90)), within((buf >= 48) & (buf <= 57))
    first = (buf[starts] >= 65) & (buf[starts] <= 90) if len(starts) else np.zeros(0, bool)
    shape = first.astype(np.int64) | (capitals == size) << 1 | (digits > 0) << 2 | (within(buf >= 128) > 0) << 3 | np.minimum(size, 12) << 4
    kinds = (h, vec.word_hashes(low, starts, np.minimum(starts + 3, ends)), vec.word_hashes(low, np.maximum(ends - 3, starts), ends), before, after, shape.astype(np.uint64))
    return np.stack([vec.mix(x + vec.U64((j + 1) * int(vec.K2) % (1 << 64))) | vec.U64(1) for j, x in enumerate(kinds)], axis=1), starts, ends, ptr


def stretches(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch its text, its tokens (a row, 0 beyond its end), and which places of the row exist."""
    count = -(-np.diff(ptr) // STRETCH)
    text = np.repeat(np.arange(len(count)), count)
    first = ptr[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
    valid = np.arange(STRETCH) < (ptr[text + 1] - first)[:, None]
    return text, np.where(valid, first[:, None] + np.arange(STRETCH), 0), valid


def forward_backward(node: np.ndarray, edge: np.ndarray, valid: np.ndarray, transitions: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, log probability of clean tokens only, and expected transitions of each chain.

    node: chains x tokens, the toxic state's weight (the clean state has 0); edge: weights of transitions,
    clean to clean 0; valid: which tokens exist, those of a chain first. Forward and backward values of two
    states are kept as ratios of toxic to clean, which can't under- or overflow. The expected transitions
    (clean to toxic, toxic to clean, toxic to toxic) are only worked out if they are asked for.
    """
    n, length = node.shape
    (_, ct), (tc, tt) = np.exp(edge)
    e = np.exp(np.clip(node, -30, 30))
    r, b, clean = np.empty((n, length)), np.ones((n, length)), np.zeros(n)
    r[:, 0] = e[:, 0]
    for t in range(1, length):
        left = 1 + r[:, t - 1] * tc
        r[:, t] = np.where(valid[:, t], e[:, t] * (ct + r[:, t - 1] * tt) / left, r[:, t - 1])
        clean -= np.where(valid[:, t], np.log(left), 0)
    clean -= np.log1p(r[:, -1])
    for t in range(length - 2, -1, -1):
        on = e[:, t + 1] * b[:, t + 1]
        b[:, t] = np.where(valid[:, t + 1], (tc + on * tt) / (1 + on * ct), 1)
    marginal = np.where(valid, r * b / (1 + r * b), 0)
    moves = np.zeros((n, 3))
    if transitions:
        on = e[:, 1:] * b[:, 1:]
        p = np.stack([ct * on, r[:, :-1] * tc, r[:, :-1] * tt * on])
        p /= 1 + p.sum(axis=0)
        moves = (p * valid[:, 1:]).sum(axis=2).T
    return marginal, clean, moves


def likelihood(row: np.ndarray, ptr: np.ndarray, label: np.ndarray, node: np.ndarray, edge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Expected log probability of token labels, and its gradient by node and edge weights.

    row: feature rows of each token, 0 for none; label: the probability that it is labelled toxic, each token
    for itself.
    """
    _, place, valid = stretches(ptr)
    weight = np.where(row > 0, node[row], 0).sum(axis=1) + node[0]
    marginal, clean, moves = forward_backward(weight[place], edge, valid, True)
    q = np.where(valid, label[place], 0)
    a, b, both = q[:, :-1], q[:, 1:], valid[:, 1:]
    seen = np.array([((1 - a) * b)[both].sum(), (a * (1 - b))[both].sum(), (a * b)[both].sum()])
    value = (label * weight).sum() + (seen * edge.ravel()[1:]).sum() + clean.sum()
    token = label.copy()
    token[place[valid]] -= marginal[valid]
    by_node = np.bincount(row.ravel(), np.repeat(token, row.shape[1]), len(node))
    by_node[0] = token.sum()
    return float(value), by_node, np.r_[0, seen - moves.sum(axis=0)].reshape(2, 2)


def fit_field(row: np.ndarray, ptr: np.ndarray, label: np.ndarray, start: np.ndarray, passes: int = PASSES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights that maximise the labels' probability, less a decay, by Adam over shares of the texts."""
    theta = np.r_[start, np.zeros(4)]
    m, v, step = np.zeros(len(theta)), np.zeros(len(theta)), 0
    texts = len(ptr) - 1
    steps = max(1, min(steps, texts // 16))
    for _ in range(passes):
        for k in range(steps):
            part = np.arange(k, texts, steps)
            size = np.diff(ptr)[part]
            at = np.repeat(ptr[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if not len(at):
                continue
            _, by_node, by_edge = likelihood(row[at], np.r_[0, np.cumsum(size)], label[at], theta[: len(start)], theta[len(start) :].reshape(2, 2))
            grad = np.r_[by_node, by_edge.ravel()] / len(part)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) - DECAY * np.r_[0, theta[1:]]
    return theta[: len(start)], theta[len(start) :].reshape(2, 2)


def labelled(row_hash: np.ndarray, ptr: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample's features that several documents have, and each token's probability of a toxic label.

    In clean documents that is 0. In toxic ones it is the share of the word's toxic documents that its odds
    in clean ones don't explain, 1 - 1 / ratio, with the odds ratio taken Z errors below its estimate and
    the word's share of all documents as its prior (Monroe, Colaresi and Quinn 2008).
    """
    text = vec.run_ids(ptr)
    key = vec.distinct(row_hash.ravel())
    at = np.searchsorted(key, row_hash).astype(np.int32)
    toxic, every = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for d in range(len(y)):
        own = vec.distinct(at[ptr[d] : ptr[d + 1]].ravel())
        every[own] += 1
        toxic[own] += y[d]
    a, b = float(y.sum()), float(len(y) - y.sum())
    prior = PRIOR * every / len(y)
    odds = np.log((toxic + prior) / (a + PRIOR - toxic - prior + 1e-9)) - np.log((every - toxic + prior) / (b + PRIOR - every + toxic - prior + 1e-9))
    low = odds - Z * np.sqrt(1 / (toxic + prior) + 1 / (every - toxic + prior))
    unexplained = 1 - np.exp(-np.maximum(low, 0))
    return key[every >= LEAST_DOCUMENTS], np.where(y[text] == 1, unexplained[at[:, 0]], 0.0)


def summary(p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Of each text 1, log(1 + expected toxic tokens), the greatest marginal, log(1 + expected per 1000 tokens)."""
    n = np.diff(ptr)
    total = np.diff(np.r_[0, np.cumsum(p)][ptr])
    most = np.zeros(len(n))
    if len(p):
        most[n > 0] = np.maximum.reduceat(p, ptr[:-1][n > 0])
    return np.stack([np.ones(len(n)), np.log1p(total), most, np.log1p(1000 * total / np.maximum(n, 1))], axis=1)


class Tagger:
    """A model made ready to read texts."""

    def __init__(self, model: ToxicityModel):
        self.model, self.index = model, vec.HashIndex(model.features)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return self.index.find(hashes.ravel()).reshape(hashes.shape) + 1

    def marginals(self, row: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The toxic probability of each token, from its feature rows."""
        out = np.zeros(len(row))
        if len(row):
            weight = np.where(row > 0, self.model.node[row], 0).sum(axis=1) + self.model.node[0]
            _, place, valid = stretches(ptr)
            out[place[valid]] = forward_backward(weight[place], self.model.edge, valid)[0][valid]
        return out

    def read(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginal, start and end byte of each token, and the n + 1 token offsets of the texts."""
        hashes, starts, ends, ptr = tokens(buf, off)
        return self.marginals(self.rows(hashes), ptr), starts, ends, ptr

    def score(self, p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, ptr) @ self.model.logistic, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-2, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(hess, grad)
    return w


def learn(texts: list[str], toxic: np.ndarray, number: dict[int, int] | None = None) -> ToxicityModel:
    """A model from whole texts and their labels, both kinds present. number: how many labels of each kind there
    are, where the texts are a sample.

    The logistic function is fitted on marginals of texts that a field fitted on the other half gives.
    """
    hashes, _, _, ptr = tokens(*vec.binary(pa.array(texts, pa.string())))

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(ptr)[which]
        at = np.repeat(ptr[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return hashes[at], np.r_[0, np.cumsum(size)]

    def field(which: np.ndarray) -> Tagger:
        own, at = part(which)
        key, label = labelled(own, at, toxic[which])
        tagger = Tagger(ToxicityModel(key, np.r_[BIAS, np.zeros(len(key))], np.zeros((2, 2)), np.zeros(4)))
        tagger.model.node, tagger.model.edge = fit_field(tagger.rows(own), at, label, tagger.model.node)
        return tagger

    every = np.arange(len(texts))
    halves = [every[k::2] for k in (0, 1)]
    if any(len(set(toxic[h].tolist())) < 2 for h in halves):
        halves = [every, every]  # too few to part
    x, y = np.zeros((len(texts), 4)), toxic.astype(float)
    for own, other in (halves, halves[::-1]):
        tagger, (rows, at) = field(own), part(other)
        x[other] = summary(tagger.marginals(tagger.rows(rows), at), at)
    have = {c: int((toxic == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, (number or have)[1] / have[1], (number or have)[0] / have[0])
    model = field(every).model
    model.logistic = fit_logistic(x, y, weight / weight.mean())
    return model


def fit(training: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> ToxicityModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    At most fit_rows labelled documents of each class, those with the least hashes of their ids, are learned
    from, whole, and of these as many as fit_bytes holds. Rows with null labels, ids or texts teach nothing;
    a document with several labels is toxic if one says so, one with several texts counts by the least of
    them. Without labels of both kinds every score is near the share of toxic labels, or a half.
    """
    spark = training.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    ids = [tuple(r) for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()]
    none = ToxicityModel(np.zeros(0, np.uint64), np.array([BIAS]), np.zeros((2, 2)), np.zeros(4))
    if not number.get(0) or not number.get(1):
        none.logistic[0] = 0.0 if not number else 5.0 if number.get(1) else -5.0
        return none
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))  # at most 2 * fit_rows ids
    docs = training.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    size = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).collect()
    held, room, wanted = dict(map(tuple, size)), {y: fit_bytes // 2 for y in (0, 1)}, []
    for doc, y in ids:
        if held.get(doc, fit_bytes) <= room[y]:
            room[y] -= held[doc]
            wanted.append((doc, y))
    if {y for _, y in wanted} != {0, 1}:
        return none
    few = F.broadcast(spark.createDataFrame(wanted, "doc_id long, toxic int"))
    rows = docs.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()
    return learn([r["text"] for r in rows], np.array([r["toxic"] for r in rows]), number)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(model.value)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1), 1 << 20):
            p, starts, ends, ptr = tagger.read(buf, off)
            score = tagger.score(p, ptr)
            character = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]  # characters before each byte
            low, high, at = vec.runs(p >= 0.5, ptr)
            base = np.repeat(character[off[:-1]], np.diff(at))
            most = np.maximum.reduceat(p, low) if len(low) else p[:0]
            flat = pa.StructArray.from_arrays([pa.array(character[starts[low]] - base, pa.int64()), pa.array(character[ends[high - 1]] - base, pa.int64()), pa.array(most)], fields=list(kind.value_type))
            spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans], ["doc_id", "score", "predicted", "spans"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted and the toxic spans (character offsets, greatest probability) of every text.

    docs has doc_id and text; nothing else is read. A span is a run of tokens of which each is toxic with
    probability of a half or more. Null and empty texts have no tokens and the score of none. Repeated rows
    come back repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_score, model=sent), "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, probability: double>>")


def brute_force(weight: list[float], edge: np.ndarray) -> tuple[list[float], float]:
    """Marginals and log probability of clean tokens only of one chain, over all its labellings; for tests."""
    from itertools import product

    every = {s: np.exp(sum(w for w, x in zip(weight, s, strict=True) if x) + sum(edge[a, b] for a, b in zip(s[:-1], s[1:], strict=True))) for s in product((0, 1), repeat=len(weight))}
    z = sum(every.values())
    return [sum(v for s, v in every.items() if s[i]) / z for i in range(len(weight))], float(np.log(every[(0,) * len(weight)] / z))
