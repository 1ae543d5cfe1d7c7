"""Best chunks by BM25 without scoring what can't be among them.

Postings lie in blocks of chunks, written where texts are read: of each term and block its chunks with their counts and
lengths. What the terms of a query can give at most bounds a block; a task opens no block that is bounded below the k-th
best score of its most promising ones, and only its best chunks leave it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.analysis import tokens
from folioscope.operators import lexical
from folioscope.operators.lexical import K1, B, LexicalIndex
from folioscope.session import checkpoint_dir, cut

BLOCK = 8  # chunks in a block: larger ones are fewer rows and looser bounds
SLACK = 1e-8  # more than a score's rounding
DEALT = 500_000  # postings of a batch in a task, four times as many if that were more tasks than the session's partitions


@dataclass(frozen=True)
class BlockIndex:
    """blocks as read gives them, frequencies (term, df), totals (n, avgdl: one row); no positions, so phrases need a LexicalIndex.
    split: what parts its texts, and the terms asked of it, into tokens."""

    blocks: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    split: Callable[[Column], Column] = tokens


def _lists(at: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)


def _blocked(block: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (chunk_id, tokens, dls): (term, block, n, chunk_ids, tfs, dls) in the terms' order within lexical.AT_ONCE
    tokens; rows without a term hold the lengths of all chunks. A chunk stands once for each of its lengths."""

    def blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for texts in (part for batch in batches for part in lexical._parts(batch)):
            ids, dl, m = texts.column(0), texts.column(2).flatten().to_numpy(zero_copy_only=False), pc.list_value_length(texts.column(2)).to_numpy(zero_copy_only=False)
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(texts.num_rows)), texts.column(1)], ["row", "tokens"])
            for packed in lexical._packed([numbered]):
                row, tf = (packed.column(x).flatten().to_numpy(zero_copy_only=False) for x in (1, 2))
                term = np.repeat(np.arange(packed.num_rows), pc.list_value_length(packed.column(1)).to_numpy(zero_copy_only=False))
                head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row // block, prepend=-1) != 0))  # of each term and block
                upto = np.cumsum(m[row]) - m[row]
                each = np.repeat(np.arange(len(row)), m[row])
                own = dl[(np.cumsum(m) - m)[row[each]] + np.arange(len(each)) - upto[each]]
                lists = [ids.take(pa.array(row[each])), pa.array(tf[each], pa.int32()), pa.array(own, pa.int32())]
                columns = [packed.column(0).take(pa.array(term[head])), pa.array(first + row[head] // block), pa.array(np.diff(np.append(head, len(row))), pa.int32()), *[_lists(upto[head], x) for x in lists]]
                yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "chunk_ids", "tfs", "dls"])
            first += -(-texts.num_rows // block)

    return blocked


def _of(chunks: DataFrame, block: int) -> DataFrame:
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "tokens", "dls").mapInArrow(_blocked(block), f"term string, block long, n int, chunk_ids array<{kind}>, tfs array<int>, dls array<int>")


def of_texts(chunks: DataFrame, block: int = BLOCK, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(term, block, n, chunk_ids, tfs, dls) of (chunk_id, text), counted where a text is read: nothing is shuffled but the ids, to
    find those that stand twice. Rows of one id count as one text, but each has its own length, as in SQL."""
    rows = chunks.select("chunk_id", split(F.col("text")).alias("tokens"))
    twice = cut(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("twice")))
    if twice.isEmpty():
        return _of(rows.withColumn("dls", F.array(F.size("tokens"))), block)
    same = F.col("chunk_id").eqNullSafe(F.col("twice"))
    merged = rows.join(twice, same, "left_semi").groupBy("chunk_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.collect_list(F.size("tokens")).alias("dls"))
    return _of(rows.join(twice, same, "left_anti").withColumn("dls", F.array(F.size("tokens"))).unionByName(merged), block)


def build(index: LexicalIndex, block: int = BLOCK) -> DataFrame:
    """The same of an index whose texts aren't at hand: its postings are shuffled once, by chunk."""
    each = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int"))))
    held = index.postings.groupBy(F.col("chunk_id").alias("of")).agg(each.alias("tokens"))
    lengths = index.lengths.groupBy("chunk_id").agg(F.collect_list(F.col("dl").cast("int")).alias("dls"))
    whole = lengths.join(held, F.col("chunk_id").eqNullSafe(F.col("of")), "left")
    return _of(whole.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), block)


def write(blocks: DataFrame, path: str) -> None:
    """As they come: in the order of terms within each part of the texts, so that a pushed list of terms skips pages."""
    blocks.write.mode("overwrite").parquet(path)


def _gain(tf, dl, avgdl):
    """lexical.gain of columns or arrays."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _totals(raw: DataFrame) -> DataFrame:
    return raw.where("term IS NULL").select(F.explode("dls").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(term, block, n, chunk_ids, tfs, dls) with top, what n chunks of a term gain at most (the largest count in the shortest
    chunk), and posts, their gains. Both are reckoned from the mean length, not stored."""
    raw = spark.read.parquet(path)
    mean = F.lit(_totals(raw).first()["avgdl"]).cast("double")
    posts = F.transform(F.arrays_zip("chunk_ids", "tfs", "dls"), lambda p: F.struct(p["chunk_ids"].alias("chunk_id"), _gain(p["tfs"], p["dls"], mean).alias("gain")))
    return raw.where("term IS NOT NULL").withColumns({"top": _gain(F.array_max("tfs"), F.array_min("dls"), mean), "posts": posts})


def _path(spark: SparkSession, path: str | None) -> str:
    return path or f"{checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"


def stored(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """The blocks written under path (default: a new one in the shared folder) and read from there."""
    spark = blocks.sparkSession
    path = _path(spark, path)
    write(blocks, path)
    return read(spark, path)


def stored_texts(chunks: DataFrame, block: int = BLOCK, split: Callable[[Column], Column] = tokens, path: str | None = None) -> BlockIndex:
    """Blocks of (chunk_id, text) and their counts, written under path (default: a new one in the shared folder)."""
    spark = chunks.sparkSession
    path = _path(spark, path)
    write(of_texts(chunks, block, split), f"{path}/blocks")
    raw = spark.read.parquet(f"{path}/blocks")
    raw.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")
    _totals(raw).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return BlockIndex(read(spark, f"{path}/blocks"), spark.read.parquet(f"{path}/frequencies"), spark.read.parquet(f"{path}/totals"), split)


def _kth(group: np.ndarray, score: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest score of each group, minus infinity where there are fewer."""
    order = np.lexsort((-score, group))
    n = np.bincount(group, minlength=groups)
    at = np.cumsum(n) - n + k - 1
    out = np.full(groups, -np.inf)
    out[n >= k] = score[order[at[n >= k]]]
    return out


class _Hits:
    """A task's hits (query_id, block, weight, chunk_ids, tfs, dls) with all rows of each of its blocks: the chunks that may be among a
    query's k best here (query, chunk, score: numbers of queries and chunks), and which pairs of query and block were opened."""

    def __init__(self, hits: pa.Table, k: int, avgdl: float):
        column = lambda name: hits.column(name).combine_chunks()
        asked, chunks = column("query_id").dictionary_encode(null_encoding="encode"), column("chunk_ids")
        self.queries, q = asked.dictionary, asked.indices.to_numpy().astype(np.int64)
        block, self.weight = column("block").to_numpy(), column("weight").to_numpy()
        held = chunks.flatten().dictionary_encode(null_encoding="encode")
        self.chunks, self.chunk = held.dictionary, held.indices.to_numpy().astype(np.int64)
        self.gone = np.append(self.chunks.is_null().to_numpy(zero_copy_only=False), False)  # a chunk without an id is no result
        self.tf, self.dl, self.avgdl = column("tfs").flatten().to_numpy(), column("dls").flatten().to_numpy(), avgdl
        self.n = pc.list_value_length(chunks).to_numpy()
        self.start = np.cumsum(self.n) - self.n
        top = self.weight * _gain(np.maximum.reduceat(self.tf, self.start), np.minimum.reduceat(self.dl, self.start), avgdl)
        self.order = np.lexsort((block, q))
        head = np.flatnonzero((np.diff(q[self.order], prepend=-1) != 0) | (np.diff(block[self.order], prepend=-1) != 0))
        self.rows = np.diff(np.append(head, len(q)))  # of each pair
        self.of, self.postings = q[self.order][head], np.add.reduceat(self.n[self.order], head)
        bound = np.add.reduceat(top[self.order], head)
        best = np.lexsort((-bound, self.of))
        n = np.bincount(self.of, minlength=len(self.queries))
        self.open = np.zeros(len(head), dtype=bool)
        self.open[best[np.arange(len(head)) - np.repeat(np.cumsum(n) - n, n) < k]] = True  # the k blocks of largest bounds hold k chunks to measure the others by, or are all
        first = self._scored(self.open)
        rest = ~self.open & (bound >= _kth(first[0], first[2], k, len(self.queries))[self.of] - SLACK)
        self.open |= rest
        query, chunk, score = (np.concatenate(x) for x in zip(first, self._scored(rest), strict=True))
        near = score >= _kth(query, score, k, len(self.queries))[query] - SLACK
        self.query, self.chunk, self.score = query[near], chunk[near], score[near]

    def _scored(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = self.order[np.repeat(pairs, self.rows)]
        n = self.n[row]
        at = np.repeat(self.start[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(np.repeat(self.of[pairs], self.rows[pairs]), n) * len(self.chunks) + self.chunk[at]
        part = np.repeat(self.weight[row], n) * _gain(self.tf[at], self.dl[at], self.avgdl)
        kept = ~self.gone[self.chunk[at]]
        key, where = np.unique(key[kept], return_inverse=True)
        return key // max(1, len(self.chunks)), key % max(1, len(self.chunks)), np.bincount(where, part[kept], len(key))


def _over(k: int, avgdl: float, found: Callable[[_Hits], list[pa.Array]], names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over hits by block: what is found of a task's."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.RecordBatch.from_arrays(found(_Hits(pa.Table.from_batches(held), k, avgdl)), names)
            yield from (rows.slice(at, 10_000) for at in range(0, rows.num_rows, 10_000))

    return over


def _best(hits: _Hits) -> list[pa.Array]:
    return [hits.queries.take(pa.array(hits.query)), hits.chunks.take(pa.array(hits.chunk)), pa.array(hits.score)]


def _counted(hits: _Hits) -> list[pa.Array]:
    n = lambda w=None: pa.array(np.bincount(hits.of, w, len(hits.queries)).astype(np.int64))
    return [hits.queries, n(), n(hits.open), n(hits.postings), n(hits.postings * hits.open)]


def _dealt(index: LexicalIndex | BlockIndex, blocks: DataFrame, parts: DataFrame) -> tuple[DataFrame, float]:
    """The hits of terms of one token, all of a block in one task, and the mean length. Of the blocks only the batch's terms are shuffled."""
    spark = blocks.sparkSession
    known = parts.select("query_id", "term").join(index.frequencies, "term").crossJoin(F.broadcast(index.totals.select("n")))  # one row
    asked = cut(known.withColumn("weight", lexical.weight()).groupBy("query_id", "term").agg(F.sum("weight").alias("weight"), F.max("df").alias("df")))
    rows, n = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    some = asked.select("query_id", "term", "weight")
    held = blocks.where(lexical.listed(asked, "term")).select("term", "block", "chunk_ids", "tfs", "dls")
    hits = held.join(F.broadcast(some) if rows <= lexical.SENT else some, "term").select("query_id", "block", "weight", "chunk_ids", "tfs", "dls")
    tasks = max(math.ceil(n / (4 * DEALT)), min(math.ceil(n / DEALT), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    return hits.repartition(tasks, "block"), index.totals.first()["avgdl"]


def bm25_best(index: LexicalIndex | BlockIndex, blocks: DataFrame, terms: DataFrame, k: int, whole: Callable[[], LexicalIndex] | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25, bm25_rank): the k best chunks of each query as ranking all of lexical.bm25 gives them,
    ties by chunk_id. Phrases have no bounds: queries with one are ranked in full, by the index that whole gives.

    Null or unknown terms find nothing, a term that stands twice in a query counts twice; a query without a hit has no row."""
    parts = lexical.parts_of(index, terms)
    phrased = cut(parts.where("n > 1").select("query_id").distinct())
    hits, avgdl = _dealt(index, blocks, parts.join(phrased, "query_id", "left_anti"))
    kinds = [hits.schema["query_id"].dataType.simpleString(), hits.schema["chunk_ids"].dataType.elementType.simpleString()]
    best = hits.mapInArrow(_over(k, avgdl, _best, ["query_id", "chunk_id", "score"]), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    found = best.select("query_id", "chunk_id", F.round(-F.col("score"), 9).alias("bm25"))
    if not phrased.isEmpty():
        found = found.unionByName(lexical.bm25(whole() if whole else index, terms.join(phrased, "query_id", "left_semi")))
    return lexical.ranked(found, k, F.col("bm25"), F.col("chunk_id"), name="bm25_rank")


def opened(index: LexicalIndex | BlockIndex, blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, blocks, opened, postings, scored) of queries without a phrase: blocks with any term and those opened,
    their postings and those scored."""
    parts = lexical.parts_of(index, terms)
    hits, avgdl = _dealt(index, blocks, parts.join(parts.where("n > 1").select("query_id").distinct(), "query_id", "left_anti"))
    names = ["blocks", "opened", "postings", "scored"]
    each = hits.mapInArrow(_over(k, avgdl, _counted, ["query_id", *names]), f"query_id {hits.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names))
    return each.groupBy("query_id").agg(*[F.sum(x).alias(x) for x in names])
