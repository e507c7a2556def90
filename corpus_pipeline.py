"""A training-corpus pipeline: each stage takes and returns documents, the last one packs them.

Every stage's result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import langid
from lynceus.llm.decontaminate import decontaminate
from lynceus.llm.fmindex import substring_dedup
from lynceus.llm.minhash import near_duplicates
from lynceus.llm.packing import pack
from lynceus.llm.queries import tokenizer
from lynceus.llm.shared import cut
from lynceus.session import lean


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """A stage whose session's workers can import the operators and get small batches."""
    return lambda spark, docs, sf_dir: f(lean(spark), docs, sf_dir)


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text that a stage has changed; all else as it was."""
    if "n_chars" not in before.columns:
        return docs
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.withColumn("n_chars", size).select(*before.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null, empty or without a letter, or farther from their nearest
    centroid than nearly all training texts of their length. Equal texts fare alike; repeated rows stay repeated;
    an empty table stays empty."""
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 5)).select("doc_id", "text", "lang"))
    return langid.identify(docs, model, prefix="__").filter("not __rejected").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id: five-word shingles,
    similarity of 0.8 or more. Null and blank texts, which have no shingles, and rows without a doc_id are in no
    group and stay; rows with equal doc_ids stay or go together."""
    gone = near_duplicates(docs, words=5, percent=80).filter("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has too leave the text; a document
    that is empty goes. Null texts and rows without a doc_id stay as they are; what one document repeats stays."""
    less = substring_dedup(docs)
    return _counted(less.filter("text is null or text <> '' "), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are in windows of test items go; from the others
    these words go. Null and empty texts, and all texts if there are no items, stay as they are."""
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, and their sequences. Null and empty texts are one piece of the end alone;
    repeated rows are packed each for itself; no documents give no pieces."""
    return pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(language)),
    ("minhash_dedup", _stage(near_duplicate)),
    ("substring_dedup", _stage(substrings)),
    ("decontaminate", _stage(benchmark)),
    ("best_fit_packing", _stage(packing)),
]

#: SQL has no tokenizer and no centroids; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them is a table of the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
