"""Retrieval quality against labelled snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(text: Column) -> Column:
    """Lower case, without any white space."""
    return F.regexp_replace(F.lower(text), r"[\s\x{3000}\x{00A0}]+", "")


def snippet_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, snippet_no, rank): each result of a query that holds a snippet of it. Joined by query, then compared."""
    snippets = golden.select("query_id", F.posexplode("snippets").alias("snippet_no", "snippet")).where(F.length(bare(F.col("snippet"))) > 0)
    pairs = results.select("query_id", "rank", "text").join(snippets, "query_id")
    return pairs.where(F.contains(bare(F.coalesce("text", F.lit(""))), bare(F.col("snippet")))).select("query_id", "snippet_no", "rank")


def retrieval_metrics(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, hit, mrr, precision, recall). Without snippets all are 1; without results all are 0."""
    found = snippet_hits(results, golden)
    per = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.countDistinct("rank").alias("relevant"), F.countDistinct("snippet_no").alias("covered"))
    shown = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    wanted = golden.select("query_id", F.size(F.filter("snippets", lambda s: F.length(bare(s)) > 0)).alias("wanted"))
    all_in = wanted.join(per, "query_id", "left").join(shown, "query_id", "left")
    free = F.col("wanted") <= 0
    value = lambda c: F.when(free, 1.0).otherwise(F.round(F.coalesce(c, F.lit(0.0)), 9))
    return all_in.select("query_id", value(F.when(F.col("first").isNotNull(), 1.0)).alias("hit"), value(1.0 / F.col("first")).alias("mrr"),
                         value(F.col("relevant") / F.col("shown")).alias("precision"), value(F.col("covered") / F.when(~free, F.col("wanted"))).alias("recall"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries, NaN and null left out, and their number; null means where there are no queries."""
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 9).alias(c)
    return metrics.agg(*[mean(c) for c in ("hit", "mrr", "precision", "recall")], F.count(F.lit(1)).alias("n"))


def gate(means: DataFrame, least: dict[str, float]) -> DataFrame:
    """(metric, value, least, ok) for each metric with a least value; a missing value fails."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("least")) for m, v in least.items()]
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("ok", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def result_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, overlap): shared chunks of two result lists over all of them; 0 if either is empty."""
    ids = lambda d, name: d.groupBy("query_id").agg(F.collect_set("chunk_id").alias(name))
    both = ids(first, "a").join(ids(second, "b"), "query_id", "full")
    shared, every = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return both.select("query_id", F.coalesce(F.round(shared / F.when(every > 0, every), 9), F.lit(0.0)).alias("overlap"))


def latency_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, least and most of the values of each key."""
    v = F.col(value)
    return samples.groupBy(key).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
