"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key and cut into annuli,
the index keeps for each annulus the pivot, the least and greatest distance and the greatest norm. With
q a query and p the pivot, the triangle inequality gives |q - x| >= max(|q - p| - far, near - |q - p|), and
<q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2; Cauchy-Schwarz gives <q, x> <= <q, p> + |q| far. Annuli are read
from the greatest bound down until no bound reaches a query's k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.shared import cut

PIVOTS = 64
#: Vectors that pivots are chosen from, and from which each query gets its first k-th score, at most.
SAMPLE = 2048
#: Vectors of an annulus, annuli of a part (more where there would be more than PARTS parts), queries of a block.
ANNULUS, ANNULI, QUERIES = 1024, 16, 512
#: Rows of the directory of parts that every worker gets, about, at most.
PARTS = 1 << 17


def _binary(x: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.dtype.itemsize if x.ndim > 1 else 0
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * size), pa.py_buffer(x)]).cast(pa.binary())


def _quantised(batches: Iterator[pa.RecordBatch], scale: float, dims: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        given = np.flatnonzero(~(batch.column(0).is_null().to_numpy(zero_copy_only=False) | lists.is_null().to_numpy(zero_copy_only=False)))
        ids, lists = batch.column(0).take(pa.array(given)), lists.take(pa.array(given))
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(scale * flat)
        good = np.bincount(row, ~np.isfinite(x), len(size)) == 0
        out = np.zeros((len(size), dims), kind)
        at = good[row]
        out[row[at], (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[at]] = x[at]
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), _binary(out[good])], ["vec_id", "v"])


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def choose_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k vectors, each farthest from those before."""
    if not len(x):
        return x.astype(np.float64)
    x = x.astype(np.float64)
    at, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < k and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dims: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1), dims, kind).astype(np.float64)
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1), 0))
        near = d.argmin(axis=1)
        exact = np.linalg.norm(x - pivots[near], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(exact), *batch.columns], ["pivot", "distance", "vec_id", "v"])


def _annuli(batches: Iterator[pa.RecordBatch], dims: int, kind: str, size: int, run: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one pivot, in order of distance, and the part (a run of annuli of one pivot) of each."""
    held: list[tuple] = []
    made, pivot_ = 0, None
    part = TaskContext.get().partitionId() << 32

    def done() -> pa.RecordBatch:
        nonlocal made, pivot_, part
        pivot, distance, ids, v = zip(*held, strict=True)
        if pivot[0] != pivot_ or made == run:
            part, made, pivot_ = part + 1, 0, pivot[0]
        made += 1
        x = np.frombuffer(b"".join(v), kind).reshape(-1, dims).astype(np.float64)
        cols = [[part], [pivot[0]], [distance[0]], [distance[-1]], [float(np.linalg.norm(x, axis=1).max())], [np.array(ids, "<i8").tobytes()], [b"".join(v)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["part", "pivot", "near", "far", "norm", "ids", "vs"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) >= size):
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def _bounds(q: np.ndarray, p: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The most that the inner product of each query with a vector of each annulus can be."""
    nq = np.linalg.norm(q, axis=1)[:, None]
    qp = q @ p.T
    dq = np.sqrt(np.maximum(nq**2 - 2 * qp + (p * p).sum(axis=1), 0))
    apart = np.maximum(np.maximum(dq - far, near - dq) - 1e-6 * (dq + far + 1), 0)
    bound = np.minimum((nq**2 + norm**2 - apart**2) / 2, qp + nq * far)
    return bound + 1e-6 * (np.abs(bound) + nq * norm + 1)


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: as floats where no sum can leave 53 bits, else as integers."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best (score, smaller id) of each query of a block, and the score that a new one has to reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.floor = ids, k, floor
        self.score: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        self.vec: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]

    def add(self, rows: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        for r, s in zip(rows.tolist(), score, strict=True):
            at = np.flatnonzero((s >= self.floor[r]) & (vec_id != self.ids[r]))
            if not len(at):
                continue
            s, v = np.r_[self.score[r], s[at]], np.r_[self.vec[r], vec_id[at]]
            o = np.lexsort((v, -s))[: self.k]
            self.score[r], self.vec[r] = s[o], v[o]
            if len(o) == self.k:
                self.floor[r] = max(self.floor[r], s[o[-1]])


def _query_blocks(batches: Iterator[pa.RecordBatch], sent, dims: int, kind: str, k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Queries gathered in blocks, with the k-th score that the sample alone gives each of them, and the parts
    whose bound reaches the k-th score of some query."""
    ids0, v0, pivots, directory = sent.value
    part, pivot, near, far, norm = directory
    least = np.iinfo(np.int64).min
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            rows = batch.slice(lo, size)
            ids, q = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dims, kind)
            best = Best(ids, np.full(len(ids), least), k)
            if len(ids0):
                best.add(np.arange(len(ids)), _dot(q, v0), ids0)
            visit = np.zeros(len(part), bool)
            for a in range(0, len(part), 4096):
                b = slice(a, a + 4096)
                visit[b] = (_bounds(q.astype(np.float64), pivots[pivot[b]], near[b], far[b], norm[b]) >= best.floor[:, None]).any(axis=0)
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in (ids.astype("<i8").tobytes(), q.tobytes(), best.floor.astype("<i8").tobytes())), pa.array([part[visit].tolist()], pa.list_(pa.int64()))], ["ids", "vs", "floor", "parts"])


def _search(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dims: int, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, pivot, near, far, norm, ids, vs, floor), a part's annuli before the query blocks."""
    part, annuli = None, []
    for batch in batches:
        for g, what, pivot, near, far, norm, ids, vs, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != part:
                part, annuli = g, []
            ids, vs = np.frombuffer(ids, "<i8"), np.frombuffer(vs, kind).reshape(-1, dims)
            if what == 0:
                annuli.append((pivot, near, far, norm, ids, vs))
                continue
            best = Best(ids, np.frombuffer(floor, "<i8").copy(), k)
            p = pivots[[a[0] for a in annuli]].reshape(-1, dims)
            bound = _bounds(vs.astype(np.float64), p, *(np.array([a[i] for a in annuli]) for i in (1, 2, 3)))
            order = np.argsort(-bound.max(axis=0)) if len(annuli) else []
            for j in order:
                rows = np.flatnonzero(bound[:, j] >= best.floor)
                if len(rows):
                    best.add(rows, _dot(vs[rows], annuli[j][5]), annuli[j][4])
            n = [len(s) for s in best.score]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.vec) if n else ids), pa.array(np.concatenate(best.score) if n else ids)], ["query_id", "vec_id", "score"])


def topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """The k rows with the greatest integer inner product for each query row: query_id, rank, vec_id, score.

    vectors has vec_id and embedding; a component x counts as floor(scale * x). Queries are the rows where
    is_query (of vec_id) holds; candidates all rows with another vec_id; ties go to the smaller vec_id. Null
    vectors, those with null or non-finite components and rows without a vec_id take no part. A vector
    shorter than the longest counts as continued with zeros. Products must fit in 64 bits. Repeated rows
    count once.

    The index is keyed, sorted by range and cut into annuli; runs of annuli of one pivot are parts. Each
    query block starts from the k-th score that a bounded sample of vectors gives it, and goes to those parts
    only whose bound in the directory reaches it. Components travel in as few bytes as the greatest needs.
    """
    spark = vectors.sparkSession
    finite = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.abs(x.cast("double"))).otherwise(0.0))
    dims, most = vectors.agg(F.max(F.size("embedding")), F.max(F.array_max(finite))).first()
    dims, most = max(int(dims or 0), 1), scale * (most or 0.0) + 1
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    x = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(partial(_quantised, scale=scale, dims=dims, kind=kind), "vec_id long, v binary").distinct(), "vectors")
    some = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    ids0, v0 = some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks(), dims, kind)
    p = choose_pivots(v0, pivots)
    if not len(p):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = max(ANNULI, -(-x.count() // (ANNULUS * PARTS)))
    keyed = x.mapInArrow(partial(_keyed, pivots=p, dims=dims, kind=kind), "pivot int, distance double, vec_id long, v binary")
    keyed = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    annuli = cut(keyed.mapInArrow(partial(_annuli, dims=dims, kind=kind, size=ANNULUS, run=run), "part long, pivot int, near double, far double, norm double, ids binary, vs binary"), "annuli")
    directory = annuli.groupBy("part").agg(F.min("pivot").alias("pivot"), F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm")).toArrow()
    sent = spark.sparkContext.broadcast((ids0, v0, p, [c.to_numpy() for c in directory.columns]))
    wanted = x.filter(is_query)
    queries = wanted.repartition(max(1, min(parts, -(-wanted.count() // QUERIES)))).mapInArrow(partial(_query_blocks, sent=sent, dims=dims, kind=kind, k=k, size=QUERIES), "ids binary, vs binary, floor binary, parts array<long>")
    left = annuli.select("part", F.lit(0).alias("kind"), "pivot", "near", "far", "norm", "ids", "vs", F.lit(None).cast("binary").alias("floor"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("pivot", "int"), ("near", "double"), ("far", "double"), ("norm", "double"))]
    right = queries.select(F.explode("parts").alias("part"), F.lit(1).alias("kind"), *none, "ids", "vs", "floor")
    both = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = both.mapInArrow(partial(_search, pivots=p, dims=dims, kind=kind, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], x: np.ndarray, queries: list[int], k: int) -> list[tuple[int, int, int, int]]:
    """Every query against every row; for tests."""
    out = []
    for q in queries:
        s = sorted((-int(x[ids.index(q)] @ x[j]), i) for j, i in enumerate(ids) if i != q)[:k]
        out += [(q, r, i, -m) for r, (m, i) in enumerate(s, 1)]
    return out


