"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kinoframe.llm import exact_dedup, minhash, mixing, packing, quality
from kinoframe.llm.common import durable, forget, release, tracked
from kinoframe.llm.queries import WORD_BPE, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a reference of their language; others go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 80 % shared five-word shingles stays."""
    return minhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.packed_documents(docs, WORD_BPE)


#: Tables that the stage before wrote for itself.
_left: list[str] = []


def _alone(stage):
    """The stage, which first deletes what the stage before wrote for itself: its result has been written and is read again as docs."""

    @wraps(stage)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _left)
        with tracked(_left):
            return stage(spark, docs, sf_dir)

    return run_alone


STAGES = [
    ("quality rules", _alone(quality_rules)),
    ("exact dedup", _alone(exact_copies)),
    ("MinHash near-dedup", _alone(near_copies)),
    ("mixing sources", _alone(source_mix)),
    ("packing", _alone(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)  # the stage after it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, Newton steps and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
