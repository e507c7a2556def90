"""LM scoring: prediction by partial matching over bytes, with escapes and symbol exclusion.

The trie of byte contexts up to ORDER is counted over all training texts. A symbol is coded at the longest
context of the trie that has it; each longer one adds an escape (method C: the number of distinct symbols),
and symbols of a longer context are excluded from the shorter ones. As the symbols of a context are symbols
of its suffix too, what exclusion takes from a shorter context depends on the next longer one alone, so
every probability is a few table reads. The whole trie is two tables of the shared folder, grams and
contexts of all orders; the most frequent grams' probabilities are looked up where the text is, those of
the others, seen or not, come by joins. A trie cut to a share of all places (trie_share) is read in bulk
instead; what it left out goes to its escapes.

A text is its bytes, A-Z lower-cased, and one end. Symbol 256 is the end, and what stands before a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm import vec
from lynceus.llm.shared import cut

ORDER = 5
END = 256
SYMBOLS = 257
#: So many of the most frequent grams, at most, are looked up where the text is; the others by a join.
GRAM_HEAD = 1 << 21
#: Grams of up to this order, and contexts of one more, are few and on the path of very many keys: they are broadcast.
LOW = 1
#: Tokens with at least this share of all tokens, at most 2^21, are looked up where the text is; the others by a join.
HEAD_SHARE = 1 << 21
#: Bytes of text taken at once, and counts held before they are added up.
CHUNK, HELD = 1 << 19, 1_500_000

_END_TOKEN = np.uint64(0x5851F42D4C957F2D)


def symbols(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (order + 1)-grams, nine bits a symbol, that end at each byte and each text's end; n + 1 offsets."""
    n = len(off) - 1
    out = np.full(len(buf) + order * (n + 1), END, np.uint64)
    place = np.arange(len(buf)) + np.repeat(order * np.arange(1, n + 1), np.diff(off))
    out[place] = vec.LOWER[buf]
    key = out[: len(out) - order]
    for j in range(1, order + 1):
        key = (key << np.uint64(9)) | out[j : len(out) - order + j]
    keep = np.zeros(len(key), bool)
    keep[place - order] = True
    keep[off[1:] + order * np.arange(n)] = True  # where each text's end stands
    return key[keep], off + np.arange(n + 1)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and of its end token; n + 1 offsets."""
    low = vec.LOWER[buf]
    starts, ends, ptr = vec.words(low, off, vec.SPACED)
    h = np.insert(vec.word_hashes(low, starts, ends), ptr[1:], _END_TOKEN)
    return h, ptr + np.arange(len(ptr))


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Token counts (kind 0) and n-gram counts (kind 1) of a partition, added up now and then."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def merged(kind: int) -> pa.RecordBatch:
        key, n = vec.counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for batch in batches:
        for _, _, buf, off in vec.chunks(batch.column(0), CHUNK):
            held[0].append(vec.counted(_tokens(buf, off)[0]))
            held[1].append(vec.counted(symbols(buf, off, order)[0]))
            for kind in (0, 1):
                if sum(len(k) for k, _ in held[kind]) > HELD:
                    yield merged(kind)
    for kind in (0, 1):
        if held[kind]:
            yield merged(kind)


@dataclass
class Trie:
    """One order of the model: contexts of d symbols and the grams that extend them."""

    gram: np.ndarray  # sorted keys of d + 1 symbols
    log_count: np.ndarray
    context: np.ndarray  # sorted keys of d symbols
    of: np.ndarray  # context row of each gram
    parent: np.ndarray  # row of the context's suffix, one order below
    log_total: np.ndarray  # of a symbol's and the escape's weights, nothing excluded
    log_escape: np.ndarray
    log_total_below: np.ndarray  # in the suffix, this context's symbols excluded
    log_escape_below: np.ndarray


def build(grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Trie]:
    """Orders 0 and up from (gram, count) and (context, total, distinct symbols), each sorted by key."""
    out: list[Trie] = []
    raw: list[tuple[np.ndarray, ...]] = []
    for d, ((gram, n), (context, total, distinct)) in enumerate(zip(grams, contexts, strict=True)):
        used = np.isin(context, vec.distinct(gram >> np.uint64(9)))
        context, total, distinct = context[used], total[used], distinct[used]
        of = np.searchsorted(context, gram >> np.uint64(9))
        kept = np.bincount(of, n, len(context))
        own = np.bincount(of, minlength=len(context))
        weight = total - kept + distinct
        parent, total_below, escape_below = np.zeros(len(context), np.int64), np.zeros(len(context)), np.zeros(len(context))
        if d:
            g0, n0, c0, kept0, left0, distinct0 = raw[-1]
            parent = np.searchsorted(c0, context & np.uint64((1 << (9 * (d - 1))) - 1))
            same = np.searchsorted(g0, gram & np.uint64((1 << (9 * d)) - 1))
            rest = kept0[parent] - np.bincount(of, n0[same], len(context))
            weight_below = left0[parent] + distinct0[parent] - own
            with np.errstate(divide="ignore", invalid="ignore"):
                total_below = np.log10(rest + weight_below)
                escape_below = np.where(rest > 0, np.log10(weight_below) - total_below, 0.0)
        raw.append((gram, n, context, kept, total - kept, distinct))
        with np.errstate(divide="ignore"):
            out.append(Trie(gram, np.log10(n), context, of, parent, np.log10(kept + weight), np.log10(weight) - np.log10(kept + weight), total_below, escape_below))
    return out


class Scorer:
    """Tables of a trie, read in bulk."""

    def __init__(self, tries: list[Trie]):
        self.tries = tries
        one = np.uint64(1)
        self.grams = [vec.HashIndex(t.gram + one) for t in tries]
        self.contexts = [vec.HashIndex(t.context + one) for t in tries]
        top = tries[-1]
        self.direct = top.log_count - top.log_total[top.of]
        none = SYMBOLS - len(tries[0].gram)
        self.unseen = -np.log10(none) if none else 0.0

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each packed gram after the symbols before it."""
        one, top = np.uint64(1), len(self.tries) - 1
        row = self.grams[top].find(key + one)
        out = np.where(row >= 0, self.direct[row] if len(self.direct) else 0.0, 0.0)
        todo = np.flatnonzero(row < 0)
        key, prev = key[todo], np.full(len(todo), -1)
        for d in range(top, -1, -1):
            t = self.tries[d]
            part = key & np.uint64((1 << (9 * (d + 1))) - 1)
            at = np.full(len(part), -1, np.int64)
            known = prev >= 0
            if known.any():
                at[known] = self.tries[d + 1].parent[prev[known]]
            if not known.all():
                at[~known] = self.contexts[d].find((part[~known] >> np.uint64(9)) + one)
            gram = self.grams[d].find(part + one) if d < top else np.full(len(part), -1)
            hit, first = gram >= 0, (at >= 0) & ~known
            # the first context that the trie has excludes nothing; the later ones exclude the one before
            a = hit & first
            out[todo[a]] += t.log_count[gram[a]] - t.log_total[at[a]]
            a = ~hit & first
            out[todo[a]] += t.log_escape[at[a]]
            if known.any():
                up = self.tries[d + 1]
                a = hit & known
                out[todo[a]] += t.log_count[gram[a]] - up.log_total_below[prev[a]]
                a = ~hit & known
                out[todo[a]] += up.log_escape_below[prev[a]]
            todo, key, prev = todo[~hit], key[~hit], at[~hit]
        out[todo] += self.unseen
        return out


@dataclass
class Model:
    """order, trie, counts of frequent tokens, and the table of all token counts.

    The whole trie is grams (d, key, n) and contexts (d, key, total, q distinct symbols, gone: what these
    count in the suffix), with the log10 probabilities of frequent grams. A cut one is tries alone.
    """

    order: int
    tries: list[Trie]
    head: np.ndarray
    head_count: np.ndarray
    n: int
    distinct: int
    tokens: DataFrame
    grams: DataFrame | None = None
    contexts: DataFrame | None = None
    top: np.ndarray | None = None
    top_log10: np.ndarray | None = None
    ident: str = field(default_factory=lambda: uuid.uuid4().hex)  # what workers keep its lookup tables under


def _orders(order: int) -> Column:
    """(d, key) of a packed gram's suffixes of every order."""
    return F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND((1 << (9 * (d + 1))) - 1).alias("key")) for d in range(order + 1))))


def _tables_of(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Model.grams and Model.contexts from (key, n) of the longest grams."""
    grams = cut(counts.select(_orders(order).alias("g"), "n").groupBy("g.d", "g.key").agg(F.sum("n").alias("n")), "grams")
    below = grams.select((F.col("d") + 1).alias("d"), F.col("key").alias("suffix"), F.col("n").alias("n_below"))
    both = grams.withColumn("suffix", F.expr("key & (shiftleft(1L, 9 * d) - 1)")).join(below, ["d", "suffix"], "left")
    contexts = both.groupBy("d", F.shiftright("key", 9).alias("key")).agg(F.sum("n").alias("total"), F.count("*").alias("q"), F.sum("n_below").alias("gone"))
    return grams, cut(contexts, "contexts")


def _log10(keys: DataFrame, model: Model) -> DataFrame:
    """(key, log10) of distinct packed grams by the whole trie, which may not have them."""

    def with_(rows: DataFrame, table: DataFrame, on: str, low: int) -> DataFrame:
        table = table.withColumnRenamed("key", on)
        few = rows.filter(F.col("d") <= low).join(F.broadcast(table.filter(F.col("d") <= low)), ["d", on], "left")
        return few.unionByName(rows.filter(F.col("d") > low).join(table.filter(F.col("d") > low), ["d", on], "left"))

    rows = keys.select("key", _orders(model.order).alias("g")).select("key", "g.d", F.col("g.key").alias("gram"), F.shiftright("g.key", 9).alias("context"))
    rows = with_(with_(rows, model.grams, "gram", LOW), model.contexts, "context", LOW + 1)
    at = rows.groupBy("key").agg(*(F.max(F.when(F.col("d") == d, F.col(c))).alias(f"{c}{d}") for d in range(model.order + 1) for c in ("n", "total", "q", "gone")))
    out = F.when(F.col("n0").isNull(), -F.log10(SYMBOLS - F.coalesce("q0", F.lit(0)))).otherwise(0.0)
    for d in range(model.order, -1, -1):
        n, total, q, coded = F.col(f"n{d}"), F.col(f"total{d}"), F.col(f"q{d}"), F.lit(False)
        if d < model.order:
            # a longer context that the trie has takes its symbols out of this one
            up_q, up_gone = F.coalesce(f"q{d + 1}", F.lit(0)), F.coalesce(f"gone{d + 1}", F.lit(0))
            total, q, coded = total - up_gone, q - up_q, F.col(f"n{d + 1}").isNotNull()
        left = F.log10(total + q)
        out = out + F.when(coded | total.isNull(), 0.0).when(n.isNotNull(), F.log10(n) - left).when(q > 0, F.log10(q) - left).otherwise(0.0)
    return at.select("key", out.alias("log10"))


def fit(texts: DataFrame, order: int = ORDER, trie_share: int | None = None, head_share: int = HEAD_SHARE, gram_head: int = GRAM_HEAD) -> Model:
    """Count tokens and byte contexts over all rows of a text column.

    The counts of all tokens and grams are tables in the shared folder; the driver gets only the gram_head
    most frequent grams and tokens above a share of all places, at most head_share. With trie_share, grams
    and contexts rarer than that share of all places leave the model, and the driver gets the rest. Null is
    the empty text. No rows leave a model that gives every symbol the same probability.
    """
    rows = texts.select("text").mapInArrow(partial(_count, order=order), "kind byte, key long, n long")
    counts = cut(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts", "kind")
    tokens = counts.filter("kind = 0").select("key", "n")
    number = {r[0]: (r[1], r[2]) for r in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()}
    n, distinct = number.get(0, (0, 0))
    places = number.get(1, (0, 0))[0]
    def sorted_(df: DataFrame, *cols: str) -> tuple[np.ndarray, ...]:
        t = df.toArrow()
        key = t.column("key").to_numpy().view(np.uint64)
        o = np.argsort(key)
        return (key[o], *(t.column(c).to_numpy()[o].astype(np.int64) for c in cols))

    top = counts.filter("kind = 1").select("key", "n")
    head, head_count = sorted_(tokens.filter(F.col("n") >= max(1, -(-n // head_share))), "n")
    if trie_share:
        return Model(order, _cut_tries(top, order, max(1, -(-places // trie_share)), sorted_), head, head_count, n, distinct, tokens)
    grams, contexts = _tables_of(top, order)
    held, least = 0, max(1, -(-places // gram_head))  # of this count there are gram_head at most
    for count, number_of in sorted(map(tuple, top.groupBy(F.least("n", F.lit(least)).alias("n")).count().collect()), reverse=True):
        held += number_of
        if held > gram_head:
            break
        least = count
    of = contexts.filter(F.col("d") == order).select(F.col("key").alias("of"), "total", "q")
    often = top.filter(F.col("n") >= least).withColumn("of", F.shiftright("key", 9)).join(of, "of")
    t = often.select("key", (F.log10("n") - F.log10(F.col("total") + F.col("q"))).alias("log10")).toArrow()
    return Model(order, [], head, head_count, n, distinct, tokens, grams, contexts, t.column("key").to_numpy().view(np.uint64), t.column("log10").to_numpy())


def _cut_tries(level: DataFrame, order: int, least: int, sorted_) -> list[Trie]:
    """The trie without grams and contexts of a smaller count than least."""
    grams, contexts = [], []
    for d in range(order, -1, -1):
        if d < order:
            level = cut(level.groupBy(F.col("key").bitwiseAND((1 << (9 * (d + 1))) - 1).alias("key")).agg(F.sum("n").alias("n")), "grams")
        grams.append(sorted_(level.filter(F.col("n") >= least), "n"))
        up = level.groupBy(F.shiftright("key", 9).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("q"))
        contexts.append(sorted_(up.filter(F.col("n") >= least), "n", "q"))
    return build(grams[::-1], contexts[::-1])


class Head:
    """log10 probabilities of the whole trie's most frequent grams."""

    def __init__(self, key: np.ndarray, log10: np.ndarray):
        self.index, self.logs = vec.HashIndex(key + np.uint64(1)), log10

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each packed gram its log10 probability, 0 where the head doesn't have it, and whether it does."""
        row = self.index.find(key + np.uint64(1))
        return np.where(row >= 0, self.logs[row] if len(self.logs) else 0.0, 0.0), row >= 0


_ready: dict[str, tuple[Scorer | Head, vec.HashIndex, np.ndarray]] = {}


def _tables(sent) -> tuple[Scorer | Head, vec.HashIndex, np.ndarray]:
    """The lookup tables of a model, built once in a worker; those of an earlier model go."""
    key, _, tries, top, top_log10, head, head_count = sent.value
    if key not in _ready:
        _ready.clear()
        _ready[key] = Scorer(tries) if tries else Head(top, top_log10), vec.HashIndex(head), np.log10(head_count + 0.1)
    return _ready[key]


_ROW = "rid long, doc_id long, kind byte, key long, n long, n_known long, base double, score double"


def _rest(rid: pa.Array, ptr: np.ndarray, key: np.ndarray, known: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """A row for each text and key of it that is not known, with its number."""
    doc, rare = vec.run_ids(ptr)[~known], key[~known]
    if len(rare):
        o = np.lexsort((rare, doc))
        doc, rare = doc[o], rare[o]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])])
        tf = np.diff(np.r_[first, len(rare)])
        k = len(first)
        yield pa.RecordBatch.from_arrays([rid.take(pa.array(doc[first])), pa.nulls(k, pa.int64()), pa.array(np.full(k, kind, np.int8)), pa.array(rare[first].view(np.int64)), pa.array(tf), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], [c.split()[0] for c in _ROW.split(", ")])


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """A row for each text (kind null), and one for each of its tokens (0) and grams (1) that the heads don't have."""
    order = sent.value[1]
    scorer, index, logs = _tables(sent)
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(2), CHUNK):
            rid, ids, rows = batch.column(0)[lo:hi], batch.column(1)[lo:hi], hi - lo
            key, at = symbols(buf, off, order)
            log10, had = scorer.find(key) if isinstance(scorer, Head) else (scorer.log10(key), np.ones(len(key), bool))
            score = np.add.reduceat(log10, at[:-1])
            h, ptr = _tokens(buf, off)
            row = index.find(h)
            known = row >= 0
            base = np.add.reduceat(np.where(known, logs[row] if len(logs) else 0.0, 0.0), ptr[:-1])
            n_known = np.add.reduceat(known.astype(np.int64), ptr[:-1])
            yield pa.RecordBatch.from_arrays([rid, ids, pa.nulls(rows, pa.int8()), pa.nulls(rows, pa.int64()), pa.array(np.diff(ptr)), pa.array(n_known), pa.array(base), pa.array(score)], [c.split()[0] for c in _ROW.split(", ")])
            yield from _rest(rid, ptr, h, known, 0)
            yield from _rest(rid, at, key, had, 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text.

    score is the trie's log10 probability of the text and its end; base_score the smoothed unigram's of its
    tokens (words, then an end). docs has doc_id and text; nothing else is read. Null is the empty text,
    whose only token and symbol is the end. Repeated rows come back repeated.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((model.ident, model.order, model.tries, model.top, model.top_log10, model.head, model.head_count))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = cut(rows.mapInArrow(partial(_score, sent=sent), _ROW), "scores")
    tail = done.filter("kind = 0").select("rid", "key", "n").join(model.tokens.select("key", F.col("n").alias("c")), "key", "left")
    c = F.coalesce("c", F.lit(0))
    tail = tail.select("rid", (F.col("n") * F.log10(c + F.lit(0.1))).alias("more"), F.when(c > 0, F.col("n")).otherwise(0).alias("also"), F.lit(0.0).alias("grams"))
    if model.grams is not None:
        rare = done.filter("kind = 1").select("rid", "key", "n")
        log10 = cut(_log10(rare.select("key").distinct(), model), "rare")
        tail = tail.unionByName(rare.join(log10, "key").select("rid", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("n") * F.col("log10")).alias("grams")))
    tail = tail.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("more", "also", "grams")))
    den = float(np.log10(model.n + 0.1 * (model.distinct + 1)))
    out = done.filter("kind is null").join(tail, "rid", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", zero) - F.col("n") * F.lit(den)).alias("base_score"), (F.col("score") + F.coalesce("grams", zero)).alias("score"))


class AdaptivePPM:
    """The same model as a plain trie that learns each symbol after coding it; also the tests' reference."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.seen: dict[tuple[int, ...], dict[int, int]] = {}

    def learn(self, before: tuple[int, ...], symbol: int) -> None:
        for d in range(self.order + 1):
            at = self.seen.setdefault(before[len(before) - d :], {})
            at[symbol] = at.get(symbol, 0) + 1

    def log10(self, before: tuple[int, ...], symbol: int) -> float:
        out, gone = 0.0, set()
        for d in range(self.order, -1, -1):
            at = self.seen.get(before[len(before) - d :], {})
            left = {s: n for s, n in at.items() if s not in gone}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + float(np.log10(left[symbol]) - np.log10(total))
            out += float(np.log10(len(left)) - np.log10(total))
            gone |= set(left)
        return out - float(np.log10(SYMBOLS - len(gone)))

    def text(self, text: bytes, learn: bool = True) -> float:
        """log10 probability of a text and its end; with learn, each symbol is learned once coded."""
        before, out = (END,) * self.order, 0.0
        for s in [*bytes(vec.LOWER[np.frombuffer(text, np.uint8)]), END]:
            out += self.log10(before, s)
            if learn:
                self.learn(before, s)
            before = (*before, s)[len(before) + 1 - self.order :]
        return out


def _adaptive(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [AdaptivePPM(order).text(t or b"") for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.float64())], ["doc_id", "score"])


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and the adaptive log10 code length of each text: the trie starts empty in every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_adaptive, order=order), "doc_id long, score double")


