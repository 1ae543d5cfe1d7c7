"""Merging, thinning and reordering of ranked candidate lists. Order is the column rank, from 1 in each query."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig

PREFIX_CHARS = 160


def prefix(text: Column) -> Column:
    """The beginning of a text by which candidates count as equal."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, PREFIX_CHARS), r"^\s+|\s+$", "")


def dedup_prefix(rows: DataFrame) -> DataFrame:
    """The first row of each query and beginning."""
    first = F.row_number().over(W.partitionBy("query_id", prefix(F.col("text"))).orderBy("rank"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def per_doc_cap(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each query and path."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "path").orderBy("rank"))).where(F.col("__n") <= most).drop("__n")


def renumbered(rows: DataFrame, top_k: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def postprocess(rows: DataFrame, top_k: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Equal beginnings once, then at most so many chunks of a document, then the first top_k."""
    return renumbered(per_doc_cap(dedup_prefix(rows), config.max_chunks_per_doc), top_k)


def greedy_dedup_cap(rows: DataFrame, top_k: int, most: int = 3) -> DataFrame:
    """One pass in rank order: a row is taken unless its id or beginning was taken or its path is full.

    Unlike postprocess, a row that a full path rejects doesn't hide a later row of the same beginning. Whether a
    row is taken depends on all rows taken before, so each query's list, of 200 rows at most, goes to one call."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, beginnings, per_path, kept = set(), set(), {}, []
        for i, r in enumerate(pdf.sort_values("rank", kind="stable").itertuples()):
            start = (r.text or "")[:PREFIX_CHARS].strip()
            if r.chunk_id not in ids and start not in beginnings and per_path.get(r.path, 0) < most and len(kept) < top_k:
                ids.add(r.chunk_id)
                beginnings.add(start)
                per_path[r.path] = per_path.get(r.path, 0) + 1
                kept.append(i)
        out = pdf.sort_values("rank", kind="stable").iloc[kept].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["query_id", "chunk_id", "path", "rank"]]

    return rows.select("query_id", "chunk_id", "path", "text", "rank").groupBy("query_id").applyInPandas(take, "query_id long, chunk_id long, path string, rank int")


def rrf_merge(first: DataFrame, second: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, rrf) of two lists (query_id, chunk_id, rank): the sum of 1 / (k + rank).

    Ties go by the rank in the first list, then in the second."""
    a = first.select("query_id", "chunk_id", F.col("rank").alias("first_rank"))
    b = second.select("query_id", "chunk_id", F.col("rank").alias("second_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "chunk_id"], "full").withColumn("rrf", F.round(part("first_rank") + part("second_rank"), 12))
    order = W.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last())
    out = both.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def lexical_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct tokens that the text holds."""
    from folioscope.functions.analysis import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(F.substring(text, 1, 2200)))) / F.size(q)).otherwise(0.0)


def cross_rerank(rows: DataFrame, pool: int, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """The first `pool` rows by the scorer's value for (query, the text's first 2200 characters); the rest is dropped."""
    scored = rows.withColumn("cross", F.round(scorer(F.col("query"), F.col("text")), 9))
    order = W.partitionBy("query_id").orderBy(F.col("cross").desc(), F.col("rank"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def encoder_scorer(score: Callable[[list[str], list[str]], Iterable[float]]) -> Callable[[Column, Column], Column]:
    """A scorer for cross_rerank from a model's batch function of queries and texts."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(list(score(q.tolist(), t.str.slice(0, 2200).tolist())), dtype="float64")

    return lambda q, t: scored(q, t)
