"""The graph of chunks: neighbours in a document and chunks near each other that share keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.analysis import is_stop_word, positions

WINDOW, TAGS, LEAST_SHARED = 5, 8, 2  # fixed values
SENT = 200_000  # terms whose numbers are broadcast to the postings


def placed(chunks: DataFrame) -> DataFrame:
    """Chunks with their place (from 1) among those of their document."""
    return chunks.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("chunk_index", "chunk_id")))


def adjacent_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, rel, weight) between each chunk and the next of its document, both ways."""
    following = chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(W.partitionBy("path").orderBy("chunk_index", "chunk_id")).alias("dst")).where("dst IS NOT NULL")
    both = following.unionByName(following.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.select("src", "dst", F.lit("adjacent").alias("rel"), F.lit(1.0).alias("weight"))


def tags(chunks: DataFrame, document_frequency: DataFrame, totals: DataFrame, n: int = TAGS) -> DataFrame:
    """(chunk_id, tags): each chunk's n terms of largest tf-idf, as a sorted array."""
    return tags_of(positions(chunks, "chunk_id", F.col("text")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf")), document_frequency, totals, n)


def _common(frequencies: DataFrame) -> Column:
    """Which terms are so frequent that no more than SENT are: from half, a quarter and so on of the most frequent one's number."""
    seen = {r["bits"]: r["n"] for r in frequencies.groupBy(F.floor(F.log2("df")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    at, most = max(seen, default=0) + 1, SENT
    while at > 0 and (most := most - seen.get(at - 1, 0)) >= 0:
        at -= 1
    return F.log2("df") >= at


def tags_of(postings: DataFrame, document_frequency: DataFrame, totals: DataFrame, n: int = TAGS) -> DataFrame:
    """tags from an index's (chunk_id, term, tf), without reading the texts. Numbers of the most frequent terms, which most
    postings have, are broadcast, so only the best of a chunk's where they are read are shuffled; only rare terms' postings
    all are."""
    common, own = _common(document_frequency), postings.select("chunk_id", "term", "tf").where(~is_stop_word(F.col("term")))
    known = F.broadcast(document_frequency.where(common).select("term", "df"))  # SENT rows at most
    rare = own.join(known.select("term"), "term", "left_anti").join(document_frequency.where(~common), "term")
    order = W.partitionBy("chunk_id").orderBy(F.col("weight").desc(), "term")

    def best(rows: DataFrame) -> DataFrame:
        weight = F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 0.5)), 9)
        weighed = rows.crossJoin(F.broadcast(totals.select("n"))).select("chunk_id", "term", weight.alias("weight"))  # one row
        return weighed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")

    both = best(own.join(known, "term")).unionByName(best(rare))
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).groupBy("chunk_id").agg(F.array_sort(F.collect_list("term")).alias("tags"))


def keyword_edges(chunks: DataFrame, tagged: DataFrame) -> DataFrame:
    """(src, dst, rel, weight) between chunks up to five places apart that share two tags or more, both ways."""
    rows = placed(chunks).join(tagged, "chunk_id").select("path", "place", "chunk_id", "tags")
    reach = rows.withColumn("at", F.explode(F.sequence(F.col("place") + 1, F.col("place") + WINDOW)))  # five places: an equi-join, no band
    later = rows.select("path", F.col("place").alias("at"), F.col("chunk_id").alias("dst"), F.col("tags").alias("theirs"))
    shared = F.size(F.array_intersect("tags", "theirs"))
    found = reach.join(later, ["path", "at"]).withColumn("shared", shared).where(F.col("shared") >= LEAST_SHARED)
    one = found.select(F.col("chunk_id").alias("src"), "dst", F.least(F.lit(1.0), F.col("shared") / TAGS).alias("weight"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.select("src", "dst", F.lit("keyword").alias("rel"), "weight")


def merged_edges(adjacent: DataFrame, keyword: DataFrame) -> DataFrame:
    """One edge for each pair; adjacency holds over keywords."""
    best = F.max_by(F.struct("rel", "weight"), F.when(F.col("rel") == "adjacent", 2.0).otherwise(F.col("weight")))
    return adjacent.unionByName(keyword).groupBy("src", "dst").agg(best.alias("e")).select("src", "dst", "e.rel", "e.weight")


def graph_expand(primary: DataFrame, edges: DataFrame, top_k: int, slots: int = 2, per_seed: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, extra): ranked results whose last places up to `slots` went to neighbours in the graph.

    Each result offers its per_seed heaviest edges; new chunks count once, in the order of results and edges, up to
    a cap; `allowed` (chunk_id) then keeps those in scope."""
    cap = max(slots * 4, slots * per_seed, slots + 4)
    seeds = primary.select("query_id", F.col("chunk_id").alias("src"), F.col("rank").alias("seed_rank"))
    best = edges.withColumn("edge_rank", F.row_number().over(W.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))).where(F.col("edge_rank") <= per_seed)
    offered = seeds.join(best, "src").select("query_id", F.col("dst").alias("chunk_id"), "seed_rank", "edge_rank")
    new = offered.join(primary.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = new.groupBy("query_id", "chunk_id").agg(F.min(F.struct("seed_rank", "edge_rank")).alias("at"))
    q = W.partitionBy("query_id").orderBy("at")
    found = first.withColumn("n", F.row_number().over(q)).where(F.col("n") <= cap)
    found = found if allowed is None else found.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    extras = found.withColumn("n", F.row_number().over(q)).where(F.col("n") <= slots)
    used = extras.groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    kept = primary.join(used, "query_id", "left").where(F.col("rank") <= F.greatest(F.lit(0), F.lit(top_k) - F.coalesce("g", F.lit(0))))
    rows = kept.select("query_id", "chunk_id", F.lit(0).alias("extra"), F.col("rank").alias("n")).unionByName(extras.select("query_id", "chunk_id", F.lit(1).alias("extra"), "n"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("extra", "n"))).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "rank", (F.col("extra") == 1).alias("extra"))
