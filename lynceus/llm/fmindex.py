"""Substring deduplication: FM-indexes of shards, searched backward for repeated word windows.

Windows go to shards by content: of the word k-grams in a window, the one with the least hash is its
anchor, so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor form
a segment. Anchors of a single document need no more work; those of very many segments are cut anew, each
window its own anchor. One copy of each distinct segment goes, by anchor, to a shard; a shard's FM-index (a wavelet matrix over the Burrows-Wheeler transform of its
segments) is searched backward with the segments streamed word by word, which gives each place its
matching statistic and suffix range, and each range of at least a window the smallest document in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import vec
from lynceus.llm.shared import cut

WINDOW = 50
#: Words of an anchor.
GRAM = 12
#: Words of one FM-index; a shard that gets more builds several, cut between anchors.
SHARD_WORDS = 400_000
#: Anchors with more distinct segments than this, or more words than an index, are cut anew: each of their windows
#: is its own anchor, so that equal windows still meet.
HOT = 2_000
SALTS = 16
#: Segments whose places are found by a broadcast, at most; each has at most a window's places.
MANY = 4096


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit plane per level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.planes, self.zeros = [], []
        n = len(seq)
        for k in range(self.levels - 1, -1, -1):
            bit = (seq >> k) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bytes_ = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(bytes_)] = bytes_
            block = packed.view("<u8")
            before = np.zeros(len(block), np.int64)
            np.cumsum(np.bitwise_count(block[:-1]), out=before[1:])
            self.planes.append((block, before))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        every = np.arange(top + 1)
        self.begin = self._walk(every, np.zeros(top + 1, np.int64))

    def _walk(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for i, (block, before) in enumerate(self.planes):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            at = pos >> 6
            ones = before[at] + np.bitwise_count(block[at] & ((vec.U64(1) << (pos & 63).astype(vec.U64)) - vec.U64(1)))
            pos = np.where(bit == 1, self.zeros[i] + ones, pos - ones)
        return pos

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, pos) - self.begin[symbol]


class FMIndex:
    """FM-index of sequences, exact for patterns of up to `window` symbols.

    Suffixes are sorted by their first symbols only, as many as the next power of two above window; for
    patterns not longer than that, ranges and backward steps equal those of the full order.
    """

    def __init__(self, sequences: list[np.ndarray], window: int = WINDOW):
        self.window = window
        self.alphabet = vec.distinct(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        size = np.array([len(s) + 1 for s in sequences], np.int64)
        self.starts = np.cumsum(size) - size
        self.text = np.zeros(int(size.sum()), np.int64)  # 0 ends each sequence
        for s, at in zip(sequences, self.starts.tolist(), strict=True):
            self.text[at : at + len(s)] = np.searchsorted(self.alphabet, s) + 1
        self.sigma = len(self.alphabet)
        self._sort()
        bwt = np.where(self.sa > 0, self.text[self.sa - 1], 0)
        self.count = np.zeros(self.sigma + 2, np.int64)
        np.cumsum(np.bincount(self.text, minlength=self.sigma + 1), out=self.count[1:])
        self.tree = WaveletMatrix(bwt, self.sigma)

    def _sort(self) -> None:
        n, rank, half = len(self.text), self.text, 1
        self.ranks = [rank]
        while True:
            tail = np.zeros(n, np.int64)
            tail[: n - half] = rank[half:] + 1 if half < n else 0
            key = (rank.astype(np.uint64) << vec.U64(32)) | tail.astype(np.uint64)
            self.sa = np.argsort(key, kind="stable")
            key = key[self.sa]
            new = np.zeros(n, np.int64)
            new[self.sa] = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if n else 0
            rank, half = new, half * 2
            if half > self.window or half >= 2 * n:
                break
            self.ranks.append(rank)
        # ranges of suffixes that agree in their first `window` symbols
        top = 1 << (len(self.ranks) - 1)
        if top <= self.window:
            r, second = self.ranks[-1], np.minimum(self.sa + max(0, self.window - top), max(n - 1, 0))
            a, b = r[self.sa], r[second]
            self.group = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if n else np.zeros(0, np.int64)
        self.group_start = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.zeros(0, np.int64)
        self.group_end = np.r_[self.group_start[1:], n] if n else self.group_start

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the ranges of symbol + pattern from those of the patterns."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.count[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def _common(self, i: int, j: int) -> int:
        """Length of the common prefix of two suffixes in sorted order, up to the window."""
        a, b, n, out = int(self.sa[i]), int(self.sa[j]), len(self.text), 0
        for k in range(len(self.ranks) - 1, -1, -1):
            while max(a, b) + out < n and self.ranks[k][a + out] == self.ranks[k][b + out] and out + (1 << k) <= 2 * self.window:
                out += 1 << k
        return out

    def matching_statistics(self, query: np.ndarray) -> np.ndarray:
        """For each place of a query, the length, up to the window, of the longest match that starts there.

        The query is streamed from its end; where a step finds nothing, the range widens to its parent
        interval, the longest shorter prefix of the match that occurs elsewhere too.
        """
        at = np.searchsorted(self.alphabet, query)
        known = (at < self.sigma) & (self.alphabet[np.minimum(at, self.sigma - 1)] == query) if self.sigma else np.zeros(len(query), bool)
        n, out = len(self.text), np.zeros(len(query), np.int64)
        lo, hi, size = 0, n, 0
        for i in range(len(query) - 1, -1, -1):
            if not known[i]:
                lo, hi, size = 0, n, 0
                continue
            c = np.array([at[i] + 1])
            while True:
                a, b = (int(x[0]) for x in self.step(c, np.array([lo]), np.array([hi])))
                if a < b:
                    lo, hi, size = a, b, size + 1
                    break
                up = max(self._common(lo - 1, lo) if lo else 0, self._common(hi - 1, hi) if hi < n else 0)
                up = min(up, size - 1)
                while lo and self._common(lo - 1, lo) >= up:
                    lo -= 1
                while hi < n and self._common(hi - 1, hi) >= up:
                    hi += 1
                size = up
            if size > self.window:
                g = self.group[lo]
                lo, hi, size = int(self.group_start[g]), int(self.group_end[g]), self.window
            out[i] = size
        return out

    def least_per_window(self, owner: np.ndarray) -> list[np.ndarray]:
        """Stream every indexed sequence backward; for each of its windows, the least owner of an equal one.

        All sequences move together, a step at a time, so a step is one rank query of the wavelet matrix.
        """
        least = np.minimum.reduceat(np.repeat(owner, np.diff(np.r_[self.starts, len(self.text)]))[self.sa], self.group_start)
        size = np.diff(np.r_[self.starts, len(self.text)]) - 1
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], self.starts[order]
        windows = np.maximum(size - self.window + 1, 0)
        at = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), owner.dtype)
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(self.text))
        for s in range(1, int(size[0]) + 1 if len(size) else 0):
            n = int(np.searchsorted(-size, -s, "right"))
            place = size[:n] - s
            lo, hi = self.step(self.text[begin[:n] + place], lo[:n], hi[:n])
            if s >= self.window:
                g = self.group[lo]
                lo, hi = self.group_start[g], self.group_end[g]  # at most a window of symbols stays matched
                out[at[:n] + place] = least[g]
        parts: list[np.ndarray] = [out] * len(size)
        for k, row in enumerate(order.tolist()):
            parts[row] = out[at[k] : at[k] + windows[k]]
        return parts


def _power(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(int(vec.K1), -1, 1 << 64)


class Segments:
    """The words, windows and segments of some texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.ptr = vec.words(buf, off, vec.SPACED)
        h = vec.word_hashes(buf, self.starts, self.ends)
        n = len(h)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(n, int(vec.K1)), out=prefix[1:])
        self.prefix, self.unpower, self.window = prefix, _power(n + 1, _INVERSE), window
        self.text_key = self.hash(self.ptr[:-1], self.ptr[1:])
        least = vec.grams(h, gram)
        span, reach = window - gram + 1, 1
        while reach * 2 <= span:
            least[: n - reach] = np.minimum(least[: n - reach], least[reach:]) if n > reach else least[: n - reach]
            reach *= 2
        rest = span - reach
        if rest and n > rest:
            least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
        valid = np.arange(n) + window <= np.repeat(self.ptr[1:], np.diff(self.ptr))
        same = np.zeros(n, bool)
        same[1:] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1]
        same[self.ptr[:-1][self.ptr[:-1] < n]] = False
        self.first = np.flatnonzero(valid & ~same)
        stop = np.flatnonzero(valid & ~np.r_[same[1:], False])
        self.end = stop + window  # of the segment's words
        self.anchor = least[self.first]
        self.doc = np.searchsorted(self.ptr, self.first, "right") - 1
        self.segment = self.hash(self.first, self.end)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words from each a to each b."""
        return vec.mix((self.prefix[b] - self.prefix[a]) * self.unpower[a] + (b - a).astype(np.uint64) * vec.K3)


def _list(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each text (anchor null; first: its words) and one for each of its segments."""
    names = ["doc_id", "text_key", "anchor", "segment", "first", "size", "sha"]
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1)):
            s = Segments(buf, off, window, gram)
            ids, raw, n = batch.column(0)[lo:hi], buf.tobytes(), hi - lo
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(s.text_key.view(np.int64)), none, none, pa.array(np.diff(s.ptr).astype(np.int32)), pa.nulls(n, pa.int32()), pa.array(sha)], names)
            if len(s.first):
                place = s.first - s.ptr[s.doc]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s.doc)), pa.array(s.text_key[s.doc].view(np.int64)), pa.array(s.anchor.view(np.int64)), pa.array(s.segment.view(np.int64)), pa.array(place.astype(np.int32)), pa.array((s.end - s.first).astype(np.int32)), pa.nulls(len(s.first), pa.string())], names)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of busy segments, each a segment of its own with itself as anchor; hashes only."""
    for batch in batches:
        ids, keys, busy = (batch.column(c) for c in ("doc_id", "text_key", "busy"))
        for lo, hi, buf, off in vec.chunks(batch.column("text")):
            starts, ends, ptr = vec.words(buf, off, vec.SPACED)
            h = vec.word_hashes(buf, starts, ends)
            prefix = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * _power(len(h), int(vec.K1)), out=prefix[1:])
            unpower = _power(len(h) + 1, _INVERSE)
            part = busy.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = part.flatten()
            first, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            own = first + size <= np.diff(ptr)[row]  # else of another text with this doc_id
            row, first, number = row[own], first[own], (size - window + 1)[own]
            place = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            row = np.repeat(row, number)
            i = ptr[row] + place
            key = pa.array(vec.mix((prefix[i + window] - prefix[i]) * unpower[i] + vec.K2).view(np.int64))
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), key, key, pa.array(place.astype(np.int32)), pa.array(np.full(len(row), window, np.int32))], ["doc_id", "text_key", "anchor", "segment", "first", "size"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments."""
    for batch in batches:
        ids, want = batch.column("doc_id"), batch.column("want")
        for lo, hi, buf, off in vec.chunks(batch.column("text")):
            starts, ends, ptr = vec.words(buf, off, vec.SPACED)
            raw, rows = buf.tobytes(), []
            for d in range(hi - lo):
                for w in want[lo + d].as_py():
                    a, b = int(ptr[d]) + w["first"], int(ptr[d]) + w["first"] + w["size"]
                    if b <= ptr[d + 1]:  # else of another text with this doc_id
                        rows.append((ids[lo + d].as_py(), w["anchor"], w["segment"], raw[starts[a] : ends[b - 1]]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "anchor", "segment", "content"])


def _search(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Segments, sorted by anchor, with the runs of their windows that share a least document."""
    held: list[tuple] = []
    count, last = 0, None

    def done() -> pa.RecordBatch:
        index = FMIndex([w for *_, w in held], window)
        least = index.least_per_window(np.array([d for d, *_ in held], np.int64))
        at = [np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in least]
        return pa.RecordBatch.from_arrays([pa.array([a for _, a, *_ in held], pa.int64()), pa.array([s for _, _, s, _ in held], pa.int64()), pa.array([i.tolist() for i in at], pa.list_(pa.int32())), pa.array([x[i].tolist() for x, i in zip(least, at, strict=True)], pa.list_(pa.int64()))], ["anchor", "segment", "places", "docs"])

    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(3)):
            starts, ends, ptr = vec.words(buf, off, vec.SPACED)
            h = vec.word_hashes(buf, starts, ends)
            for i, (doc, anchor, segment) in enumerate(zip(*(batch.column(c)[lo:hi].to_pylist() for c in range(3)), strict=True)):
                if count >= limit and anchor != last:
                    yield done()
                    held, count = [], 0
                held.append((doc, anchor, segment, h[ptr[i] : ptr[i + 1]]))
                count, last = count + int(ptr[i + 1] - ptr[i]), anchor
    if held:
        yield done()


def _remove(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the windows that a smaller document has too."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, buf, off in vec.chunks(batch.column("text")):
            raw, rows = buf.tobytes(), []
            for d in range(hi - lo):
                w, me = raw[off[d] : off[d + 1]].split(), ids[lo + d]
                gone = np.zeros(len(w) + 1, np.int32)
                for s in batch.column("cuts")[lo + d].as_py():
                    places = [*s["places"], s["size"] - window + 1]
                    for a, b, doc in zip(places[:-1], places[1:], s["docs"], strict=True):
                        if doc < me and s["first"] + b - 1 + window <= len(w):
                            gone[s["first"] + a] += 1
                            gone[s["first"] + b - 1 + window] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join(x for x, k in zip(w, keep.tolist(), strict=True) if k)
                rows.append((len(w) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("text_key")[lo:hi], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "text_key", "n_removed", "kept_sha256", "kept"])


def _cuts(docs: DataFrame, window: int, gram: int, texts: bool, hot: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Every text's words and digest as it is; what remains of the texts that lose words."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(base.mapInArrow(partial(_list, window=window, gram=gram), "doc_id long, text_key long, anchor long, segment long, first int, size int, sha string"), "segments")
    whole = rows.filter("anchor is null").select("doc_id", "text_key", F.col("first").cast("long").alias("n_words"), "sha")
    segments = rows.filter("anchor is not null and doc_id is not null").drop("sha")

    many = segments.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 < d1").select("anchor")
    shared = cut(segments.join(many, "anchor", "left_semi"), "shared")
    each = shared.groupBy("anchor", "segment").agg(F.max("size").alias("size"))
    # the rows of a busy anchor are spread over salts, and the few busy anchors repeated for each
    busy = each.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("words")).filter((F.col("n") > hot) | (F.col("words") > shard_words))
    busy = busy.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("busy"))
    marked = cut(shared.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int")).join(busy, ["anchor", "salt"], "left").drop("salt"), "marked")
    touched = marked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("busy"), F.struct("first", "size"))).alias("busy"), F.min("text_key").alias("text_key"))
    text = cut(base.join(touched, "doc_id"), "texts")
    windows = cut(text.filter(F.size("busy") > 0).mapInArrow(partial(_windows, window=window), "doc_id long, text_key long, anchor long, segment long, first int, size int"), "windows")
    places = marked.filter("busy is null").drop("busy").unionByName(windows)

    # one document's words for each distinct segment; a window alone needs none if no other document has it
    own = places.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "first", "size")).alias("r"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    own = cut(own.filter((F.col("r.size") > window) | (F.col("anchor") != F.col("segment")) | (F.col("r.doc_id") < F.col("last"))), "own")
    want = own.groupBy("r.doc_id").agg(F.collect_list(F.struct("r.first", "r.size", "anchor", "segment")).alias("want"))
    shards = text.select("doc_id", "text").join(want, "doc_id").mapInArrow(_contents, "doc_id long, anchor long, segment long, content binary")
    shards = shards.repartition(parts, "anchor").sortWithinPartitions("anchor")
    runs = cut(shards.mapInArrow(partial(_search, window=window, limit=shard_words), "anchor long, segment long, places array<int>, docs array<long>"), "runs")

    # what very many documents have, at most MANY segments, meets its places by a broadcast
    least = max(1000, -(-places.count() // MANY))
    common = runs.join(own.filter(F.col("n") >= least).select("anchor", "segment"), ["anchor", "segment"], "left_semi").withColumnsRenamed({"places": "p", "docs": "d"})
    met = places.join(F.broadcast(common), ["anchor", "segment"], "left")
    few = met.filter("p is null").drop("p", "d").join(runs, ["anchor", "segment"])
    found = few.unionByName(met.filter("p is not null").withColumnsRenamed({"p": "places", "d": "docs"})).filter(F.exists("docs", lambda x: x < F.col("doc_id")))
    cuts = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "size", "places", "docs")).alias("cuts"))
    less = text.select("doc_id", "text", "text_key").join(cuts, "doc_id")
    less = less.mapInArrow(partial(_remove, window=window, texts=texts), "doc_id long, text_key long, n_removed long, kept_sha256 string, kept string")
    return whole, less


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What substring deduplication leaves of each document: doc_id, n_words, n_removed, kept_sha256.

    docs has doc_id, one row for each, and text; other columns are not read. A word goes if it lies in a
    window (`window` consecutive words of one document) whose words also start somewhere in a document
    with a smaller doc_id. Null and empty texts have no words. A row without a doc_id loses nothing and
    takes nothing from others; identical rows repeated come back repeated. Windows repeated only within
    one document stay.
    """
    whole, less = _cuts(docs, window, gram, False, hot, shard_words)
    less = less.select("doc_id", "n_removed", "kept_sha256").distinct()
    return whole.join(less, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with the text of each document that loses words replaced by the kept ones, joined by spaces.

    Texts that lose nothing, and all other columns, stay as they are. Rules as in `removed`.
    """
    _, less = _cuts(docs, window, gram, True, hot, shard_words)
    ident, kept = (_fresh(docs, c) for c in ("id", "kept"))
    less = cut(less.select(F.col("doc_id").alias(ident), F.col("kept").alias(kept)).distinct(), "kept")
    out = docs.join(less, F.col("doc_id").cast("long") == F.col(ident), "left")
    return out.select(*[F.coalesce(F.col(kept), docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name = f"_{name}"
    return name
