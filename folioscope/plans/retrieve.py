"""Whole retrieval pipelines over a batch of queries (query_id, text[, embedding])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.functions.citations import with_snippet
from folioscope.operators import fusion, lexical, vector
from folioscope.functions.analysis import rank_keywords
from folioscope.operators.clusters import ClusterIndex, search
from folioscope.operators.graph import graph_expand
from folioscope.operators.ingest import in_scope
from folioscope.operators.substring import GramIndex
from folioscope.session import cut


def hybrid(index: lexical.LexicalIndex, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, terms: DataFrame, top_k: int, root: str | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Full text and vectors, fused by rank, reranked and thinned. Rows: query_id, chunk_id, path, text, rank.

    The scope applies to full-text candidates after their pool is cut and to vectors before. Where the first
    full-text candidate is a strong hit, half as many vector candidates are taken."""
    fts = lexical.fts_pool(index, chunks, terms, config.fts_pool, config)
    if root is not None:
        fts = fusion.renumbered(fts.where(in_scope(F.col("path"), root)))
        vectors = vectors.join(chunks.where(in_scope(F.col("path"), root)).select("chunk_id"), "chunk_id", "left_semi")
    named = fts.where("rank = 1").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    strong = lexical.strong_hit(named)
    near = vector.vector_topk(queries.where("embedding IS NOT NULL"), vectors, config.vector_pool, config.unit_eps)
    pool = F.when(F.coalesce("strong", F.lit(False)) & F.lit(config.strong_match_degrade), max(12, config.vector_pool // 2)).otherwise(config.vector_pool)
    near = near.join(strong, "query_id", "left").where(F.col("rank") <= pool)
    fused = fusion.rrf_merge(fts, near, config.rrf_k)
    n = max(config.rerank_pool, 2 * top_k)
    head = fused.where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "rrf").join(chunks, "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    if config.cross_rerank:
        head = fusion.cross_rerank(head, config.rerank_pool)
    return fusion.postprocess(head, max(4 * top_k, 12), config)


def displayable(rows: DataFrame, top_k: int) -> DataFrame:
    """The first top_k rows of each query whose excerpt isn't empty."""
    shown = cut(with_snippet(rows))  # else the filter, pushed down, would copy the excerpt's steps into each other
    return fusion.renumbered(shown.where("snippet <> ''").drop("snippet"), top_k)


def retrieve(index: lexical.LexicalIndex, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, terms: DataFrame, top_k: int = 4, root: str | None = None, edges: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig(), grams: GramIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, source): the hybrid results; for queries without any full text alone; for those without that, substrings.

    A branch is computed for the queries that the ones before left without results. Substrings are looked for among the
    keywords of analysis.rank_keywords, through `grams` if they are given."""
    cap = min(200, max(8 * top_k, top_k))
    columns = ["query_id", "chunk_id", "path", "text", "rank"]
    scope = lambda d: d if root is None else fusion.renumbered(d.where(in_scope(F.col("path"), root)))
    first = hybrid(index, chunks, vectors, queries, terms, top_k, root, config).select(*columns).withColumn("source", F.lit("hybrid"))
    first = cut(first)  # the next branches ask which queries have results
    missing = lambda d, done: d.join(done.select("query_id").distinct(), "query_id", "left_anti")
    second = lexical.fts_reranked(index, chunks, missing(terms, first), cap, config).select(*columns).withColumn("source", F.lit("fts"))
    shown = cut(displayable(scope(first.unionByName(second)), top_k))
    left = cut(rank_keywords(missing(queries, shown).select("query_id", "text"), missing(terms, shown)))
    if left.isEmpty():
        out = shown.select("query_id", "chunk_id", "rank", "source")
    else:
        limit = 120 if root is None else min(800, max(120, 40 * top_k))
        third = lexical.like_fallback(chunks, left, cap, limit, config, grams).select(*columns).withColumn("source", F.lit("like"))
        out = shown.unionByName(displayable(scope(third), top_k)).select("query_id", "chunk_id", "rank", "source")
    if edges is None or not config.graph:
        return out
    allowed = None if root is None else chunks.where(in_scope(F.col("path"), root)).select("chunk_id")
    grown = graph_expand(out, edges, top_k, config.graph_slots, config.graph_per_seed, allowed).join(chunks.select("chunk_id", "text"), "chunk_id")
    return displayable(grown, top_k).select("query_id", "chunk_id", "rank", F.when(F.col("extra"), "graph").otherwise("primary").alias("source"))


def retrieve_fast(index: lexical.LexicalIndex, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, terms: DataFrame, top_k: int = 4, root: str | None = None, clusters: ClusterIndex | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, chunk_id, path, rank): both candidate lists, fused where there are vector hits, scoped and thinned in one pass.

    terms: those of analysis.fast_terms. clusters: an index of the vectors, for queries that name their model."""
    n = 2 * top_k
    fts = lexical.fts_pool(index, chunks, terms, min(200, max(n * config.oversample, n)), config)
    asked = queries.where("embedding IS NOT NULL")
    near = vector.vector_topk(asked, vectors, n, config.unit_eps) if clusters is None else search(clusters, asked, n, exact=False)
    fused = fusion.rrf_merge(fts, near, config.rrf_k, n).select("query_id", "chunk_id", "rank")
    fused = fused.join(near.select("query_id").distinct(), "query_id", "left_semi")
    plain = fts.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "rank")
    rows = fused.unionByName(plain).join(chunks.select("chunk_id", "path", "text"), "chunk_id")
    rows = rows if root is None else rows.where(in_scope(F.col("path"), root))
    return fusion.greedy_dedup_cap(rows, top_k, config.max_chunks_per_doc)


def reference_list(rows: DataFrame) -> DataFrame:
    """(query_id, refs): the heading and a numbered line for each result's file."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.element_at(F.split("path", "/"), -1))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return listed.select("query_id", F.concat(F.lit("引用\n\n"), F.array_join(F.col("l.line"), "\n")).alias("refs"))


def prompt_blocks(rows: DataFrame, context_chars: int = 2400) -> DataFrame:
    """(query_id, blocks): the numbered sources of a prompt; excerpts are cleaned, cut and left out if empty."""
    shown = cut(with_snippet(rows)).withColumn("excerpt", F.substring("snippet", 1, context_chars)).where("excerpt <> ''")
    shown = shown.withColumn("no", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    head = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] 来源资料名称: "), F.element_at(F.split("path", "/"), -1), F.lit(" | 片段序号: "), F.col("chunk_index").cast("string"), F.lit("\n"), F.col("excerpt"))
    listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", head.alias("block")))).alias("l"))
    return listed.select("query_id", F.array_join(F.col("l.block"), "\n\n").alias("blocks"))


def fallback_answer(rows: DataFrame) -> DataFrame:
    """(query_id, answer): the question, an excerpt of each result and the list of files, for when no model answers."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    said = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(flat, 1, 220), F.when(F.length(flat) > 220, "...").otherwise(""))
    ref = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.element_at(F.split("path", "/"), -1), F.lit("（chunk="), F.col("chunk_index").cast("string"), F.lit("）"))
    listed = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said"), ref.alias("ref")))).alias("l"))
    answer = F.concat_ws("\n", F.concat(F.lit("问题："), F.col("query")), F.lit(""), F.lit("已检索到以下高相关资料片段："), F.array_join(F.col("l.said"), "\n"), F.lit(""), F.lit("引用："), F.array_join(F.col("l.ref"), "\n"))
    return listed.select("query_id", answer.alias("answer"))
