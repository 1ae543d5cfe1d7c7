"""Answers remembered by question: (model, query_hash, query_text, answer_text, created_ts, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed
from folioscope.operators.vector import cosine_guarded


def query_key(text: Column) -> Column:
    """A question without differences of case and white space."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def query_hash(text: Column) -> Column:
    return F.sha2(query_key(text), 256)


def newest(entries: DataFrame) -> DataFrame:
    """One entry for each model and hash: the newest, of equals that with the larger id."""
    order = W.partitionBy("model", "query_hash").orderBy(F.col("created_ts").desc(), F.col("entry_id").desc())
    return entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def evict(entries: DataFrame, most: int = 400) -> DataFrame:
    """The `most` newest entries."""
    return entries.orderBy(F.col("created_ts").desc(), F.col("entry_id").desc()).limit(most)


def store(entries: DataFrame, new: DataFrame, most: int = 400) -> DataFrame:
    """Entries with new ones put in: blank questions and answers under eight characters are left out, long ones cut."""
    fit = new.where((trimmed(F.col("query_text")) != "") & (F.length(trimmed(F.col("answer_text"))) >= 8))
    cutoff = fit.withColumns({"query_text": F.substring(trimmed(F.col("query_text")), 1, 4000), "answer_text": F.substring(trimmed(F.col("answer_text")), 1, 120000)})
    keyed = cutoff.withColumn("query_hash", query_hash(F.col("query_text")))
    return evict(newest(entries.unionByName(keyed.select(*entries.columns))), most)


def lookup_exact(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, entry_id, answer_text, kind) where the question's key is known to its model."""
    keyed = questions.select("query_id", "model", query_hash(F.col("text")).alias("query_hash"))
    return keyed.join(newest(entries), ["model", "query_hash"]).select("query_id", "entry_id", "answer_text", F.lit("exact").alias("kind"))


def lookup_semantic(questions: DataFrame, entries: DataFrame, threshold: float = 0.95, most: int = 400) -> DataFrame:
    """(query_id, entry_id, answer_text, similarity) of the likest of the `most` newest entries, if like enough; of equals the newer."""
    recent = F.broadcast(evict(entries, most).select("entry_id", "model", "answer_text", "created_ts", F.col("embedding").alias("e")))  # `most` rows
    pairs = questions.join(recent, (questions["model"] == recent["model"]) & (F.size(questions["embedding"]) == F.size(recent["e"])))
    scored = pairs.select("query_id", "entry_id", "answer_text", "created_ts", F.round(cosine_guarded(F.col("embedding"), F.col("e")), 6).alias("similarity"))
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("created_ts").desc(), F.col("entry_id").desc())
    return scored.where(F.col("similarity") >= threshold).withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "entry_id", "answer_text", "similarity")


def lookup(questions: DataFrame, entries: DataFrame, threshold: float = 0.95, most: int = 400) -> DataFrame:
    """(query_id, entry_id, answer_text, kind): by key first, else by likeness."""
    exact = lookup_exact(questions, entries)
    near = lookup_semantic(questions.join(exact.select("query_id"), "query_id", "left_anti"), entries, threshold, most)
    return exact.unionByName(near.select("query_id", "entry_id", "answer_text", F.lit("semantic").alias("kind")))
