"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

A document's set is its distinct word shingles, lower-cased in ASCII. Signatures follow Ertl's
SuperMinHash: each element deals its ranks along a random permutation of the slots, so the ranks of
one element are correlated and the estimate's variance is lower than MinHash's; a document stops
once its largest slot can no longer be beaten by the next rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import vec
from lynceus.llm.graph import components, forest
from lynceus.llm.shared import cut

#: 1 - (1 - 0.8^ROWS)^BANDS is over 0.9999999: a pair at the threshold meets in some band.
BANDS, ROWS = 40, 5
#: Members of one task's unit: a star around a pivot, or a block of a bucket.
UNIT = 512


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes. Fewer than k words make one shingle, none make none."""
    low = vec.LOWER[buf]
    starts, ends, ptr = vec.words(low, off, vec.SPACED)
    h = vec.word_hashes(low, starts, ends)
    g = vec.grams(h, k)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        else:
            out.append(vec.grams(h[a:b] + vec.U64(b - a), b - a)[:1])
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m slots for each set; slots of an empty set keep the largest value."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(len(sets) * m, full)
    size = np.array([len(x) for x in sets])
    if not size.sum():
        return sig.reshape(len(sets), m)
    h = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)), size) * m
    perm = None
    for level in range(m):
        u = vec.mix(h + vec.U64((level + 1) * int(vec.K1) % (1 << 64)))
        k = level + (((u >> vec.U64(32)) * vec.U64(m - level)) >> vec.U64(32)).astype(np.int64)
        rank = (u & vec.U64(0xFFFFFFFF)) | (vec.U64(level) << vec.U64(32))
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, level]
            perm[:, level] = slot
        np.minimum.at(sig, base + slot, rank)
        # a document goes on while some slot holds more than the next level's least rank
        open_ = sig.reshape(len(sets), m).max(axis=1) >= (vec.U64(level + 1) << vec.U64(32))
        keep = open_[base // m]
        if not keep.any():
            break
        if perm is None:
            h, base, k = h[keep], base[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
            perm[:, 0] = k
            perm[np.arange(len(h)), k] = 0
        elif not keep.all():
            h, base, perm = h[keep], base[keep], perm[keep]
    return sig.reshape(len(sets), m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each document and band; the band's number is part of it."""
    out = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        out = vec.mix(out * vec.K1 + sig[:, j * bands : (j + 1) * bands])
    return vec.mix(out + np.arange(1, bands + 1, dtype=np.uint64) * vec.K2)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(1), 1 << 19):
            sets = shingles(buf, off, k)
            keys = band_keys(superminhash(sets, bands * rows), bands, rows)
            size = np.array([len(x) for x in sets])
            f1 = np.array([np.add.reduce(vec.mix(x)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            f2 = np.array([np.add.reduce(vec.mix(x ^ vec.K3)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(size), pa.array(f1), pa.array(f2), lists], ["doc_id", "n_shingles", "f1", "f2", "bands"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (few + many - inter)


def _units(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (u1, u2, u3, doc_id, tag, text), sorted by unit, gathered to one unit at a time."""
    now, rows = None, []
    for batch in batches:
        for lo, hi, buf, off in vec.chunks(batch.column(5)):
            sets = shingles(buf, off, k)
            cols = [batch.column(i)[lo:hi].to_pylist() for i in range(5)]
            for u1, u2, u3, doc, tag, x in zip(*cols, sets, strict=True):
                if (u1, u2, u3) != now:
                    if rows:
                        yield now, rows
                    now, rows = (u1, u2, u3), []
                rows.append((doc, tag, x))
    if rows:
        yield now, rows


def _edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges between a unit's pivot (the doc_id that names it) and its members."""
    for (pivot, _, _), rows in _units(batches, k):
        centre = next((x for doc, _, x in rows if doc == pivot), None)
        found = [(pivot, doc) for doc, _, x in rows if doc != pivot and centre is not None and _similar(centre, x, percent)]
        if found:
            yield _edges_of(found)


def _blocks(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges between members of a unit that nothing has joined so far; tag is the component so far."""
    for _, rows in _units(batches, k):
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for doc, tag, x in rows:
            groups.setdefault(tag, []).append((doc, x))
        done: list[tuple[int, int]] = []
        root = {t: t for t in groups}
        tags = sorted(groups, key=lambda t: -len(groups[t]))
        for i, s in enumerate(tags):
            for t in tags[:i]:
                if root[s] == root[t]:
                    continue
                hit = next(((a, b) for a, x in groups[s] for b, y in groups[t] if _similar(x, y, percent)), None)
                if hit:
                    done.append(hit)
                    old, new = root[s], root[t]
                    root = {q: new if r == old else r for q, r in root.items()}
        if done:
            yield _edges_of(done)


def _rest(left: DataFrame) -> DataFrame:
    """Units (key, u2, u3, doc_id, tag) that bring together every two members of a bucket with different tags.

    left: (key, doc_id, tag). A bucket's largest component is dealt in blocks, and so are all its other
    members. Blocks of the one meet blocks of the others (u2 >= 0), and blocks of the others each other
    (u2 < 0); the largest component's blocks don't meet, as they have nothing to find.
    """
    part = left.groupBy("key", "tag").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.sum(F.pmod(F.hash("doc_id"), F.lit(1 << 30))).alias("x2"))
    mixed = part.groupBy("key").agg(F.max_by("tag", F.struct("n", "tag")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("m"), F.bit_xor("x1").alias("x1"), F.sum("x2").alias("x2")).filter("most < m and m > 2")
    # of buckets with the same members one is enough
    alike = mixed.groupBy("x1", "x2", "m").agg(F.min(F.struct("key", "main", "most", "m")).alias("b")).select("b.*")
    blocks = lambda n: F.ceil(n / UNIT).cast("int")
    alike = alike.select("key", "main", blocks(F.col("most")).alias("s"), blocks(F.col("m") - F.col("most")).alias("t"))
    rest = left.join(alike, "key")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda a, b: F.struct(a.cast("int").alias("u2"), b.cast("int").alias("u3"))
    inner = F.transform(upto("t"), lambda j: place(block(F.col("s")), j))
    outer = F.concat(F.transform(upto("s"), lambda i: place(i, block(F.col("t")))), F.transform(upto("t"), lambda j: place(-1 - F.least(block(F.col("t")), j), F.greatest(block(F.col("t")), j))))
    rest = rest.withColumn("u", F.explode(F.when(F.col("tag") == F.col("main"), inner).otherwise(outer)))
    return rest.select("key", "u.u2", "u.u3", "doc_id", "tag")


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the class of their set. Sets of at least 1/4096 of all rows, so 4096 of them at most, are broadcast."""
    by = ["f1", "f2", "n_shingles"]
    least = max(1000, -(-rows.count() // 4096))
    common = named.filter(F.col("copies") >= least)
    many = common.select(*by, F.col("class").alias("many"))
    rows = rows.join(F.broadcast(many), by, "left")
    few = rows.filter("many is null").drop("many").join(named.drop("copies"), by, "left")
    return few.unionByName(rows.filter("many is not null").withColumnRenamed("many", "class"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose shingle sets have 100 * intersection >= percent * union.

    docs has doc_id and text, one row per document; other columns are not read. Returns doc_id,
    n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and link with nothing. Rows without a doc_id link with
    nothing either; their component_id is null and they are kept. Repeated rows come back repeated.

    Documents with equal sets collapse first, so a group of copies costs one aggregate. Buckets of more
    than one class then link in two exact steps: a star from each bucket's smallest member, and, where a
    bucket still holds several components, all pairs of different components, inside the task that holds
    them, in blocks of a bounded number of members. No pair table is made and no bucket is capped.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = cut(base.mapInArrow(partial(_sketch, k=words, bands=bands, rows=rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketch")
    part = sketch.filter("n_shingles > 0 and doc_id is not null")
    same = part.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = part.join(same.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    bucket = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("pivot < last")
    member = cut(keys.join(bucket.drop("last"), "key"), "buckets")
    some = member.select("doc_id").distinct()
    text = cut(base.join(some, "doc_id", "left_semi"), "candidates")

    star = member.filter("doc_id <> pivot").select("pivot", "doc_id").distinct()
    salts = star.groupBy("pivot").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("s"))
    rays = star.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("doc_id"), "s").cast("int").alias("salt"), "doc_id")
    hubs = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.col("pivot").alias("doc_id"))
    unit = rays.unionByName(hubs).join(text, "doc_id")
    unit = unit.select("pivot", F.col("salt").alias("u2"), F.lit(0).alias("u3"), "doc_id", F.lit(0).cast("long").alias("tag"), "text")
    unit = unit.repartition(parts, "pivot", "u2").sortWithinPartitions("pivot", "u2")
    links = cut(unit.mapInArrow(partial(_stars, k=words, percent=percent), "a long, b long"), "links")
    groups = cut(components(links), "groups")

    left = member.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("tag"))
    unit = _rest(left).join(text, "doc_id").select("key", "u2", "u3", "doc_id", "tag", "text").repartition(parts, "key", "u2", "u3").sortWithinPartitions("key", "u2", "u3")
    more = cut(unit.mapInArrow(partial(_blocks, k=words, percent=percent), "a long, b long"), "links")
    if not more.isEmpty():
        groups = cut(components(links.union(more)), "groups")

    named = same.join(groups, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n_shingles", "copies", F.coalesce("component", "rep").alias("class"))
    out = _labelled(sketch.drop("bands"), named)
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
