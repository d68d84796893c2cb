"""A training corpus from raw documents, in stages that are written one by one.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientela.llm import exact_dedup, language_id, mixing, near_dedup, packing
from clientela.llm.folds import held_out
from clientela.llm.queries import WEIGHTS, domain_labels, tokenizer_path
from clientela.llm.shipping import ship
from clientela.sources.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are of a language that the labelled ones have.

    Those without a letter, and those that no mixture of the languages explains
    better than chance, go.
    """
    ship(spark)
    model = language_id.fit_languages(docs.where(~held_out()))
    accepted = language_id.accepts(model)
    return docs.where(accepted(F.col("text")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact_dedup.first_of_each(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that domains meet ``WEIGHTS``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_documents(docs, domain_labels(labels), WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_known_languages),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Models decide in two stages and a tokenizer in the last: not to be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
