"""Language identification: nearest of several centroids per language in a TF-IDF n-gram space.

A text's vector counts its hashed byte bigrams and trigrams (ASCII lower-cased, everything ASCII that is
no letter a space), damped by a square root, weighted by inverse document frequency and normalised. Each
language's sample is split into clusters by spherical k-means. A text gets the language of the centroid with
the greatest cosine. It is rejected if it is farther from that centroid than the texts of its length that
all training rows have there: short texts have few n-grams, so they lie far from every centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.llm import vec

DIMS = 4096
#: Texts that are counted at once, at most: a row of DIMS counts, and a few as large, are held for each, however short it is.
BLOCK = 256
#: Training rows of a language that its centroids are fitted on, at most; all else is counted on all rows.
FIT_ROWS = 800
CENTROIDS = 4
#: Share of a centroid's training rows, by length, that lie beyond its limit, and what is added to their distance.
BEYOND, MARGIN = 0.002, 0.1
#: Length classes are powers of two of bytes. One with fewer rows than this is limited with the shorter ones; where
#: all of these are fewer, the margin is wider by the root of how many times.
CLASSES, LEAST_ROWS = 32, 500
BINS = 200
UNKNOWN = "und"

_PLAIN = vec.LOWER.copy()
_PLAIN[:128][~vec.ALNUM[:128]] = 32
_PLAIN[48:58] = 32


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of n-gram counts for each text."""
    b = _PLAIN[buf].astype(np.uint32)
    out = np.zeros((len(off) - 1, DIMS), np.float32)
    two = (b[:-1] << np.uint32(8)) | b[1:] if len(b) > 1 else b[:0]
    three = (two[:-1] << np.uint32(8)) | b[2:] if len(b) > 2 else b[:0]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    two = ((two + np.uint32(1 << 24)) * np.uint32(2654435761)) >> shift
    three = (three * np.uint32(2246822519)) >> shift
    for d, (a, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if e - a > 1:
            out[d] = np.bincount(np.concatenate([two[a : e - 1], three[a : max(a, e - 2)]]), minlength=DIMS)
    return out


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(count) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(0), rows=BLOCK):
            df += (counts(buf, off) > 0).sum(axis=0)
            n += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIMS), -1]), pa.array(np.r_[df, n])], ["dim", "df"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams that a text has, two bytes each, and how often, four bytes each."""
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1), 1 << 20, BLOCK):
            rows = [(np.flatnonzero(x), x) for x in counts(buf, off)]
            dims, n = (pa.array(c, pa.binary()) for c in ([d.astype("<u2").tobytes() for d, _ in rows], [x[d].astype("<u4").tobytes() for d, x in rows]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], dims, n, batch.column(2)[lo:hi]], ["lang", "dims", "n", "place"])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: the cluster with the most distance in it is split along its main direction, until
    there are k; then rounds of assignment and mean."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12)
    own, c = np.zeros(len(x), np.int64), unit(x.mean(axis=0))[None]
    while len(c) < k:
        far = np.bincount(own, 1 - (x * c[own]).sum(axis=1), len(c))
        j = int(far.argmax())
        rest = x[own == j] - x[own == j].mean(axis=0)
        if far[j] <= 1e-6:
            break
        v = rest[int((rest * rest).sum(axis=1).argmax())]
        for _ in range(8):
            v = unit(rest.T @ (rest @ v))
        side = rest @ v > 0
        if side.all() or not side.any():
            break
        own[np.flatnonzero(own == j)[side]] = len(c)
        c = unit(np.stack([x[own == i].mean(axis=0) for i in range(len(c) + 1)]))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def _centroids(table: pa.Table, idf: np.ndarray, k: int) -> pa.Table:
    """The centroids of one language's sample, in the order of the hashes that chose it."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "dims", "n")), strict=True))
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, dims, n) in enumerate(rows):
        x[i, np.frombuffer(dims, "<u2")] = np.frombuffer(n, "<u4")
    x = vectors(x, idf)
    x = x[(x * x).sum(axis=1) > 0]
    found = [c.astype("<f4").tobytes() for c in cluster(x, k)] if len(x) else []
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()), "part": pa.array(range(len(found)), pa.int32()), "centroid": pa.array(found, pa.binary())})


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of the centroids
    limits: np.ndarray  # least similarity that is not rejected, by centroid and length class

    def nearest(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each text, its cosine and the text's length class."""
        sim = vectors(counts(buf, off), self.idf) @ self.centroids.T
        best = sim.argmax(axis=1)
        return best, sim[np.arange(len(best)), best].astype(np.float64), np.log2(np.maximum(np.diff(off), 1)).astype(np.int64)


def _distances(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """How many rows have a centroid, a length class and a similarity (in BINS steps)."""
    m: LanguageModel = sent.value
    total = np.zeros((len(m.languages), CLASSES, BINS), np.int64)
    for batch in batches:
        for _, _, buf, off in vec.chunks(batch.column(0), rows=BLOCK):
            best, score, size = m.nearest(buf, off)
            np.add.at(total, (best, size, np.clip((score * BINS).astype(np.int64), 0, BINS - 1)), 1)
    at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in at] + [pa.array(total[at])], ["centroid", "size", "bin", "n"])


def limits(total: np.ndarray, beyond: float = BEYOND, margin: float = MARGIN, least: int = LEAST_ROWS) -> np.ndarray:
    """Least similarities from counts by centroid, length class and similarity: the margin below where a share
    of the rows ends. A class of few rows takes in the next shorter ones, whose rows are farther."""
    out = np.zeros(total.shape[:2])
    for j, by_size in enumerate(total):
        for b in range(total.shape[1]):
            rows, a = by_size[b].copy(), b
            while rows.sum() < least and a:
                a -= 1
                rows += by_size[a]
            if n := int(rows.sum()):
                ends = int(np.searchsorted(np.cumsum(rows), beyond * n, "right")) / total.shape[2]
                out[j, b] = max(0.0, ends - margin * max(1.0, (least / n) ** 0.5))
    return out


def fit(training: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """A model from rows of (text, lang) and, if there is one, doc_id; else a row's place stands for it. Rows
    without text or lang teach nothing.

    Document frequencies and limits count every row. Of each language the fit_rows rows with the least hashes
    of id and text, out of a share about four times that, are its centroids' sample; each language's
    centroids are worked out in a task of their own. The driver gets centroids and counts, whose number
    depends on the languages alone.
    """
    place = F.xxhash64(F.col("doc_id") if "doc_id" in training.columns else F.monotonically_increasing_id(), "text")
    rows = training.select(place.alias("place"), "text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    number = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    df = np.zeros(DIMS + 1, np.int64)
    for dim, n in rows.select("text").mapInArrow(_frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df")).collect():
        df[dim] = n
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + 1
    share = reduce(lambda c, l: c.when(F.col("lang") == l, 4 * fit_rows / number[l]), number, F.when(F.lit(False), 0.0))
    some = rows.filter(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text", "place")
    order = Window.partitionBy("lang").orderBy("place")
    chosen = some.mapInArrow(_sampled, "lang string, dims binary, n binary, place long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_rows)

    def one(table: pa.Table) -> pa.Table:
        return _centroids(table, idf, centroids)

    made = chosen.groupBy("lang").applyInArrow(one, "lang string, part int, centroid binary").collect()
    made = sorted(made, key=lambda r: (-number[r["lang"]], r["lang"], r["part"]))
    names = [r["lang"] for r in made]
    model = LanguageModel(idf, np.frombuffer(b"".join(r["centroid"] for r in made), "<f4").reshape(-1, DIMS), names, np.zeros((len(names), CLASSES)))
    if names:
        total = np.zeros((len(names), CLASSES, BINS), np.int64)
        sent = training.sparkSession.sparkContext.broadcast(model)
        seen = rows.select("text").mapInArrow(partial(_distances, sent=sent), "centroid int, size int, bin int, n long")
        for j, b, x, n in seen.groupBy("centroid", "size", "bin").agg(F.sum("n")).collect():
            total[j, b, x] = n
        model = LanguageModel(idf, model.centroids, names, limits(total))
    return model


def _predict(batches: Iterator[pa.RecordBatch], model, text: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    """The columns in keep, then language, score and whether it is rejected; the last column says if there is a letter."""
    m: LanguageModel = model.value
    names = np.array([*m.languages, UNKNOWN], dtype=object)
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(text), rows=BLOCK):
            best, score, limit = np.full(hi - lo, len(names) - 1), np.zeros(hi - lo), np.zeros(hi - lo)
            if m.languages:
                best, score, size = m.nearest(buf, off)
                limit = m.limits[best, size]
            score = np.clip(score, 0, 1)
            blank = ~batch.columns[-1][lo:hi].to_numpy(zero_copy_only=False).astype(bool)
            best[blank], score[blank] = len(names) - 1, 0.0
            rejected = (best == len(names) - 1) | (score < limit)
            cols = [batch.column(i)[lo:hi] for i in keep] + [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])


def identify(docs: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid) and rejected, their names after prefix.

    Only the text is read. Null texts and texts without a letter are `und`, score 0 and rejected, and so
    is everything if the model learned from no row. Texts with letters but no n-gram get the most
    frequent language with score 0. Other rejected texts keep the nearest language, for the caller to use
    or not. Of equally near centroids the more frequent language's counts, then the first by name. Columns
    of docs with the names of results give way to them; repeated rows come back repeated.
    """
    new = [T.StructField(f"{prefix}{n}", t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))]
    keep = [i for i, c in enumerate(docs.columns) if c not in {f.name for f in new}]
    rows = docs.select("*", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_".join(["letter", *docs.columns])))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_predict, model=sent, text=docs.columns.index("text"), keep=keep), T.StructType([*(docs.schema.fields[i] for i in keep), *new]))


def held_out(column: str, folds: int) -> Column:
    """Whether crc32 of a value as text is divisible by folds. A null value is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(True))
