"""A training corpus from raw documents: five stages, each one operator of folioscope.llm on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import cotrain, exactdup, mixing, neardup, packing
from folioscope.llm.common import written
from folioscope.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained quality classifier rejects."""
    aside = {c: f"__{c}" for c in ("held_out", "score", "kept") if c in docs.columns}  # names that the classifier adds
    scored = cotrain.classify(docs.withColumnsRenamed(aside), table(spark, sf_dir, "labels")).where("kept").drop("held_out", "score", "kept")
    return scored.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each text."""
    return exactdup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate group: five-word shingles, similarity 0.8."""
    found = neardup.near_groups(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__kept"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources weigh 1, 2, 3 in turn."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: one row per piece."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; what each returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and tokenization aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {}
