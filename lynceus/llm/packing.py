"""Best-fit packing: documents to token pieces, and pieces to sequences, by vector best-fit.

What a piece asks of a sequence (tokens, one place, attention cost) follows from its length alone, so the
packing is worked out on the histogram of lengths, which is as large as the capacity and not as the
corpus. Bins with about equal residuals are one class with a count; the driver places whole runs of equal
pieces in whole classes. Each piece then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm import vec
from lynceus.llm.shared import cut

CAPACITY = 4096
END = 1
#: Shares of tokens, places and attention cost in the choice of a bin: tokens are what sequences are short of,
#: the others tell bins of about the same token residual apart.
WEIGHTS = (1.0, 1e-3, 1e-3)
#: Pieces of one length that one task ranks, and how many such shares there are, at most.
UNIT, UNITS = 1 << 14, 1 << 18
#: Words that a worker remembers the tokens of before it starts anew.
CACHE_WORDS = 1_000_000


class Grown:
    """An array that grows at its end."""

    def __init__(self, first: np.ndarray):
        self.data, self.used = first, len(first)

    def append(self, more: np.ndarray) -> None:
        need = self.used + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(need, self.data.dtype)])
        self.data[self.used : need] = more
        self.used = need

    def get(self) -> np.ndarray:
        return self.data[: self.used]


class WordTokens:
    """Token ids of words between white space, each worked out once.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its
    words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.index = vec.HashIndex(np.zeros(0, np.uint64))
        self.start, self.size = Grown(np.zeros(1, np.int64)), Grown(np.ones(1, np.int64))
        self.ids = Grown(np.full(1, END, np.uint32))

    def _learn(self, words: list[str]) -> None:
        """Encode new words, a thousand in one text, and tell by the offsets which tokens are whose."""
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            got = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in part)])
            at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            size = np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(part))
            self.start.append(len(self.ids.get()) + np.cumsum(size) - size)
            self.size.append(size)
            self.ids.append(np.array(got.ids, np.uint32))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents, each followed by END, and their n + 1 offsets."""
        starts, ends, ptr = vec.words(buf, off, vec.SPACED)
        h = vec.word_hashes(buf, starts, ends)
        row = self.index.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.index.size > CACHE_WORDS:
                self._clear()
                new = np.arange(len(h))
            keys = vec.distinct(h[new])
            at = np.zeros(len(keys), np.int64)
            at[np.searchsorted(keys, h[new])] = new
            raw = buf.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(words)
            self.index.add(keys)
            row = self.index.find(h)
        row = np.insert(row + 1, ptr[1:], 0)  # row 0 of the store is END
        size = self.size.get()[row]
        end = np.cumsum(size)
        flat = self.ids.get()[np.repeat(self.start.get()[row] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        return flat, np.r_[0, end[ptr[1:] + np.arange(len(ptr) - 1)]]


@cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1)):
            flat, at = tokens.encode(buf, off)
            flat = flat.astype("<u4")
            size = np.diff(at)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(hi - lo), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            a = at[doc] + start
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[a, at[-1]].astype(np.int32)), pa.array(flat.view(np.int32))) if ids else pa.nulls(len(doc), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), lists], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


class VectorBestFit:
    """Best-fit of (length, number) classes, longest first, into bins with three capacities.

    A piece of length n asks for n tokens, one place and n * n of attention cost. Among the classes of
    open bins that can take it under every capacity, `norm` chooses the least weighted norm of what would be
    left, `dot` the greatest weighted dot product of residual and demand, both in shares of the capacities.
    Without a limit of their own, places and attention have the capacities that the tokens imply.

    Bins are one class if their token residuals are equal and the others are within a factor of sqrt(2); the
    class goes by the least of these. That least is what some bin with as many tokens has left, so capacities
    that the tokens imply never turn a piece away, and others are kept.
    """

    def __init__(self, tokens: int, places: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS):
        self.full = np.array([tokens, tokens if places is None else places, tokens * tokens if attention is None else attention], np.int64)
        self.weights = np.array(weights) / np.maximum(self.full, 1)
        self.rule = rule
        self.left = np.zeros((64, 3), np.int64)  # residuals of the classes; those of unused rows are -1
        self.left[:] = -1
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(64)]  # (first sequence, sequences) of each class
        self.row: dict[tuple[int, int, int], int] = {}
        self.unused = list(range(64))
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    @staticmethod
    def _class(left: np.ndarray) -> tuple[int, int, int]:
        return int(left[0]), *(int(2 * np.log2(x + 1)) for x in left[1:].tolist())

    def _best(self, ask: np.ndarray) -> int:
        fits = np.flatnonzero((self.left[:, 0] >= ask[0]) & (self.left[:, 1] >= ask[1]) & (self.left[:, 2] >= ask[2]))
        if not len(fits):
            return -1
        left = self.left[fits]
        worth = -(((left - ask) * self.weights) ** 2).sum(axis=1) if self.rule == "norm" else (left * ask * self.weights**2).sum(axis=1)
        return int(fits[int(worth.argmax())])

    def _put(self, rest: np.ndarray, got: list[tuple[int, int]]) -> None:
        """Bins with a residual join its class, or make one."""
        if not rest[0]:
            return  # full for good
        key = self._class(rest)
        if key not in self.row:
            if not self.unused:
                n = len(self.left)
                self.left = np.concatenate([self.left, np.full((n, 3), -1, np.int64)])
                self.bins += [[] for _ in range(n)]
                self.unused = list(range(n, 2 * n))
            self.row[key] = self.unused.pop()
            self.left[self.row[key]] = rest
        k = self.row[key]
        self.left[k] = np.minimum(self.left[k], rest)
        self.bins[k] += got

    def add(self, length: int, number: int) -> None:
        ask, rank = np.array([length, 1, length * length], np.int64), 0
        if (ask > self.full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while number:
            k = self._best(ask)
            left = self.left[k].copy() if k >= 0 else self.full
            copies = int((left // ask).min())
            take = min(number // copies, sum(n for _, n in self.bins[k]) if k >= 0 else number) or 1
            copies = min(copies, number)
            if k < 0:
                got = [(self.sequences, take)]
                self.sequences += take
            else:
                got, want = [], take
                while want:
                    first, n = self.bins[k].pop()
                    used = min(n, want)
                    got.append((first, used))
                    want -= used
                    if n > used:
                        self.bins[k].append((first + used, n - used))
                if not self.bins[k]:
                    del self.row[self._class(left)]
                    self.left[k] = -1
                    self.unused.append(k)
            for first, n in got:
                self.rows.append((length, rank, copies, first, int(self.full[0] - left[0]), n))
                rank += n * copies
            number -= take * copies
            self._put(left - ask * copies, got)

    def table(self) -> np.ndarray:
        """Columns length, first rank, copies in a sequence, first sequence, offset, sequences; sorted."""
        rows = np.array(self.rows, np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _place(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    table, first, before = plan.value
    key = (table[:, 0] << 44) | table[:, 1]
    for batch in batches:
        if not batch.num_rows:
            continue
        length, salt, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "n"))
        rank = before[first[length] + salt] + n - 1
        row = table[np.searchsorted(key, (length << 44) | rank, "right") - 1]
        inside = rank - row[:, 1]
        out = batch.drop_columns(["salt", "n"])
        out = out.append_column("sequence_id", pa.array(row[:, 3] + inside // row[:, 2]))
        yield out.append_column("offset", pa.array(row[:, 4] + inside % row[:, 2] * length))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, places: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, ids: bool = False) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most `capacity` tokens.

    docs has doc_id and text; other columns are not read. A document is its ids and END; only longer ones
    than capacity are cut. Null and empty texts are END alone. Repeated rows are packed each for itself.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ids=True the ids.
    places limits the pieces of a sequence, attention the sum of their squared lengths. An attention limit
    below a piece's own square raises, as that piece fits nowhere.

    Pieces of a length are ranked in shares of about UNIT rows, more rows if there are more than UNITS shares.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    pieces = cut(base.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, ids=ids), schema), "pieces")
    if not ids:
        pieces = pieces.drop("ids")
    number = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        number[length] = n
    salts = np.maximum(1, -(-number // max(UNIT, -(-int(number.sum()) // UNITS))))
    first = np.cumsum(salts) - salts
    shares = F.array(*map(F.lit, salts.tolist()))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shares[F.col("length").cast("int")]).cast("int"))
    before = np.zeros(int(salts.sum()), np.int64)
    for length, salt, n in pieces.groupBy("length", "salt").count().collect():
        before[first[length] + salt] = n
    before = np.cumsum(before) - before
    before -= np.repeat(before[first], salts)
    fit = VectorBestFit(capacity, places, attention, rule, weights)
    for length in np.flatnonzero(number)[::-1].tolist():
        fit.add(length, int(number[length]))
    plan = spark.sparkContext.broadcast((fit.table(), first, before))
    ranked = pieces.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    last = ", ids array<int>" if ids else ""
    return ranked.mapInArrow(partial(_place, plan=plan), f"doc_id long, piece int, start long, length long, ids_crc32 long{last}, sequence_id long, offset long")
