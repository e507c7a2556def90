"""Benchmark decontamination: a generalised suffix automaton of test items, and the text streamed past it.

Test items and texts become lower-cased words (ASCII A-Z only; digits, letters and everything beyond
ASCII). The automaton reads a text word by word and tracks the longest suffix read that occurs in some
item. Where that length reaches the window, the window's words are hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm import vec

WINDOW = 13
#: Bytes of items whose automaton one worker holds; more items take several passes over the texts.
ITEM_BYTES = 8 << 20


class SuffixAutomaton:
    """All factors of several sequences; each state knows the sequences that hold its factors."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.whole: dict[int, set[str]] = {}  # short items that end in a state, as one window each
        self.chain: list[int] = []

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.items.append(set())
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for (longest of p) + c exactly, cut out of the one that p reads c into."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int], item: str, window: int) -> None:
        at = 0
        for c in sequence:
            if c in self.next[at]:
                at = self._split(at, c)
            else:
                new, p = self._state(self.size[at] + 1, 0, {}), at
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                at = new
            self.items[at].add(item)
        if 0 < len(sequence) < window:
            self.whole.setdefault(at, set()).add(item)

    def finish(self) -> None:
        """Hand each state's items to its suffixes; point each state at its nearest whole short item."""
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        for v in reversed(order[1:]):
            self.items[self.link[v]] |= self.items[v]
        self.chain = [-1] * len(self.size)
        for v in order[1:]:
            self.chain[v] = v if v in self.whole else self.chain[self.link[v]]

    def scan(self, tokens: list[int], window: int) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges of the tokens, and the items whose windows occur."""
        v = size = 0
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        nexts, sizes, links = self.next, self.size, self.link
        for i, c in enumerate(tokens):
            while v and c not in nexts[v]:
                v = links[v]
                size = sizes[v]
            if c not in nexts[v]:
                continue
            v, size = nexts[v][c], size + 1
            reach = 0
            if size >= window:
                u = v
                while sizes[links[u]] >= window:
                    u = links[u]
                found |= self.items[u]
                reach = window
            u = self.chain[v]
            while u >= 0:
                if sizes[u] <= size:
                    found |= self.whole[u]
                    reach = max(reach, sizes[u])
                u = self.chain[links[u]]
            if reach:
                lo = i + 1 - reach
                while hits and hits[-1][1] >= lo:
                    lo = min(lo, hits.pop()[0])
                hits.append((lo, i + 1))
        return hits, found


class Matcher:
    """The automaton of some items with its vocabulary, to be sent to the workers."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        names, texts = zip(*items, strict=True) if (items := list(items)) else ((), ())
        buf, off = vec.binary(pa.array([t or "" for t in texts], pa.string()))
        h, ptr = _hashes(buf, off)
        vocabulary = vec.distinct(h)
        ids = np.searchsorted(vocabulary, h)
        self.window, self.index, self.automaton = window, vec.HashIndex(vocabulary), SuffixAutomaton()
        lengths = [int(n) for n in np.diff(ptr) if n]
        self.least = min([window, *lengths])
        for name, a, b in zip(names, ptr[:-1], ptr[1:], strict=True):
            self.automaton.add(ids[a:b].tolist(), name, window)
        self.automaton.finish()

    def scan(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int]], set[str]]]:
        """Per text: number of words, their starts and ends in buf, hit ranges of words, items.

        A word that no item has sends the automaton to its root, so only runs of known words, as long
        as the shortest window at least, are read through it.
        """
        low = vec.LOWER[buf]
        starts, ends, ptr = vec.words(low, off, vec.ALNUM)
        ids = self.index.find(vec.word_hashes(low, starts, ends))
        lo, hi, run_ptr = vec.runs(ids >= 0, ptr)
        long = hi - lo >= self.least
        for d in range(len(off) - 1):
            hits: list[tuple[int, int]] = []
            found: set[str] = set()
            for r in np.flatnonzero(long[run_ptr[d] : run_ptr[d + 1]]) + run_ptr[d]:
                got, items = self.automaton.scan(ids[lo[r] : hi[r]].tolist(), self.window)
                base = int(lo[r] - ptr[d])
                hits += [(a + base, b + base) for a, b in got]
                found |= items
            yield int(ptr[d + 1] - ptr[d]), starts[ptr[d] : ptr[d + 1]], ends[ptr[d] : ptr[d + 1]], hits, found


def _hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = vec.LOWER[buf]
    starts, ends, ptr = vec.words(low, off, vec.ALNUM)
    return vec.word_hashes(low, starts, ends), ptr


def _report(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    m: Matcher = matcher.value
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1)):
            rows = [(n, [{"start": a, "end": b} for a, b in hits], sorted(items)) for n, _, _, hits, items in m.scan(buf, off)]
            spans = pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([r[2] for r in rows], pa.list_(pa.string())), batch.column(2)[lo:hi]], ["doc_id", "n_words", "spans", "items", "text_key"])


def _matchers(benchmark: DataFrame, window: int, item_bytes: int) -> Iterator[Matcher]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // item_bytes))
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else items
        yield Matcher([(r[0], r[1]) for r in part.toLocalIterator()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Where documents hold windows of test items: doc_id, n_words, spans (of word numbers), items.

    docs has doc_id and text; benchmark has item_id and text; other columns are not read. A window is
    `window` consecutive words of an item, or all of a shorter one. Null and empty texts have no words
    and no hits; items without words or without an id never occur. Repeated rows come back repeated, and
    repeated items count once. Items of more than item_bytes in all are split by id over several
    automata, each of which all texts pass; the results of a text are put together again.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, text_key long"
    parts = [rows.mapInArrow(partial(_report, matcher=sc.broadcast(m)), schema) for m in _matchers(benchmark, window, item_bytes)]
    if len(parts) == 1:
        return parts[0].drop("text_key")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("times"))
    return one.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "n_words", F.array_sort("spans").alias("spans"), "items")


def covered(spans: Column) -> Column:
    """Number of words in sorted, possibly overlapping spans, as a column."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _hits(batches: Iterator[pa.RecordBatch], matcher, text: int) -> Iterator[pa.RecordBatch]:
    """The rows as they are, their last column (starts and ends of hit words, flat) longer by this matcher's."""
    m: Matcher = matcher.value
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(text)):
            part = batch.slice(lo, hi - lo)
            flat = [[*before, *(x for h in hits for x in h)] for before, (_, _, _, hits, _) in zip(part.columns[-1].to_pylist(), m.scan(buf, off), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(flat, pa.list_(pa.int64()))], names=[str(i) for i in range(part.num_columns)])


def _clean(batches: Iterator[pa.RecordBatch], matcher, text: int, drop_at: int, others: bool) -> Iterator[pa.RecordBatch]:
    """Decide and cut by this matcher's hits and, with others, those in the last column, which goes."""
    m: Matcher = matcher.value
    for batch in batches:
        found = batch.columns[-1] if others else None
        batch = batch.select(list(range(batch.num_columns - 1))) if others else batch
        for lo, hi, buf, off in vec.chunks(batch.column(text)):
            raw, texts, keep = buf.tobytes(), [], []
            more = found[lo:hi].to_pylist() if others else None
            for d, (n, starts, _, hits, _) in enumerate(m.scan(buf, off)):
                if more and more[d]:
                    hits = _merged([*hits, *zip(more[d][::2], more[d][1::2], strict=True)])
                hit = sum(b - a for a, b in hits)
                keep.append(not (hit and drop_at * hit >= n))
                a = int(off[d])
                out = []
                for i, j in hits:
                    out.append(raw[a : int(starts[i])])
                    a = int(starts[j]) if j < n else int(off[d + 1])
                texts.append(b"".join([*out, raw[a : int(off[d + 1])]]).decode() if hits else None)
            part = batch.slice(lo, hi - lo)
            old = part.column(text)
            new = pa.array([t if t is not None else o for t, o in zip(texts, old.to_pylist(), strict=True)], old.type) if any(t is not None for t in texts) else old
            part = pa.RecordBatch.from_arrays([new if i == text else c for i, c in enumerate(part.columns)], names=[str(i) for i in range(part.num_columns)])
            yield part.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_at: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without contamination: a document of which 1/drop_at of the words or more are hit goes; of
    the others only the hit words go, each with the bytes up to the next word. All columns stay.

    With items beyond item_bytes in all, every automaton reads the text as it came; the last one decides
    and cuts by the hits of all.
    """
    sc = docs.sparkSession.sparkContext
    text = docs.columns.index("text")
    *others, last = (sc.broadcast(m) for m in _matchers(benchmark, window, item_bytes))
    out = docs.withColumn("__hits", F.array().cast("array<long>")) if others else docs
    schema = out.schema
    for m in others:
        out = out.mapInArrow(partial(_hits, matcher=m, text=text), schema)
    return out.mapInArrow(partial(_clean, matcher=last, text=text, drop_at=drop_at, others=bool(others)), docs.schema)


def digest(report: DataFrame) -> DataFrame:
    """The report's counts: n_hit, n_items, items_sha256 and contaminated in place of spans and items."""
    n_hit = covered(F.col("spans"))
    out = report.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text by comparing every place with every window; for tests."""
    split = lambda t: (t or "").encode().translate(bytes(vec.LOWER[i] if vec.ALNUM[i] else 32 for i in range(256))).split()
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
