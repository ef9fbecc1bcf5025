"""A training corpus from raw documents: identify, assess, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import language_id as language
from strataline.llm import mixing, near_dedup, packing
from strataline.llm import quality as grading
from strataline.llm.common import discard, discard_paths, durable, stage_paths, stages_since, table
from strataline.llm.queries import pack_config


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language can't be told."""
    return language.identify(docs, carry=True).where("NOT rejected").select("row.*")


def assess_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score below one half."""
    return grading.assess(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, some more than once."""
    found = mixing.mix(docs, carry=True).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents into sequences."""
    return packing.pack(docs, pack_config())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", assess_quality),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# trained models and tokenizers are beyond SQL: a test holds the whole chain against its decisions taken one by one in Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it; what a stage leaves behind is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = stage_paths()
        done = durable(stage(spark, docs, sf_dir), name)
        discard_paths(stages_since(before, done))
        if hasattr(docs, "stage_path"):
            discard(docs)
        docs = done
    return docs
