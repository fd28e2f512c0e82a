"""A corpus pipeline: language, toxicity, exact and near duplicates, packing. Each stage reads what the one before wrote.

Defined results of all stages: every row is decided for itself, whatever its id: rows may share an id or have none. A null
text counts as empty; an empty text names no language, so the first stage rejects it. Of equal texts, and of near copies,
exactly one row stays. Input columns beyond those of documents are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin.llm import exact_dedup, langid, near_copies, packing, shared, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def set_up(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage with small batches for Python workers in its session; results are computed after the stage returns, so the setting stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@set_up
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    with shared.Scope(spark) as scope:
        docs, row = shared.numbered(docs.select(*COLUMNS), "documents")
        found = langid.of_documents(docs, langid.model_of(docs), row)
        rejected = shared.written(found.where("NOT accepted").select(F.col("id").alias(row)), "rejected")
        scope.keep(docs, rejected)
    return shared.drop_rows(docs, rejected, row).select(*COLUMNS)


@set_up
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; learned from the labelled ones among them, held-out ones excepted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.score_texts(docs, toxicity.learn(docs, labels)).where("score < 0.5").select(*COLUMNS)


@set_up
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


@set_up
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the smallest id: SimHash and ball hashing, pairs verified, MinHash for those beyond the balls."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


@set_up
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    import public_tokenizers

    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False)
    packed = packing.pack(shared.written(found, "pieces"), ["doc_id", "piece"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_identified),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Every result but the last is written to the shared folder and read again; what its stage wrote for itself, and what it read, is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with shared.Scope(spark) as scope:
            after = shared.written(stage(spark, docs, sf_dir), name)
            scope.keep(after)
        if hasattr(docs, "stored_at"):
            shared.delete(spark, [docs.stored_at])
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither trained models nor shingles and packing; tests hold the stages against brute force.
ORACLE_SQL = None
