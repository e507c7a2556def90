"""Small documents for every operator: nulls, empties, ties, repeats, long texts, clashing extra columns."""

import random

from pyspark.sql import functions as F

CLASH = ("key", "n", "salt", "start", "offset", "rid", "size", "tag", "pivot", "bands", "component", "cuts", "want", "hot", "first", "content", "score", "spans", "items", "digest", "refers_to", "kept", "id", "last", "least", "busy")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, texts, ids=None):
    """doc_id and text with extra columns of clashing names."""
    rows = list(zip(ids if ids is not None else range(len(texts)), texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, repeats within a text, short and blank texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 20, 120, 300]), 5000) for _ in range(n // 2)]
    passage = words(rng, 70, 5000)
    out = [" ".join(w) for w in base]
    for i, w in enumerate(base):
        kind = i % 5
        if kind == 0:
            out.append(" ".join(w))
        elif kind == 1:
            v = list(w)
            v[len(v) // 2] = "changed"
            out.append("  ".join(v))
        elif kind == 2:
            out.append(" ".join(words(rng, 15, 5000) + passage + words(rng, 15, 5000)))
        elif kind == 3:
            out.append("\n".join(["again and again " * 40, *w]))
        else:
            out.append(" ".join(passage[:55] + words(rng, 60, 5000)).upper())
    return [*out, None, "", "  \t\n", "one", "a b c", "x" * 50_000, " ".join(["same"] * 3000), "éàü ß"]
