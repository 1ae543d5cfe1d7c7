"""Substring search by postings of three-character runs.

A text is indexed in lower case with two end marks, so that every run of one to three of its characters begins some run of
three. A pattern's literal parts name the runs that its chunks must have; the rarest of them are met with the postings,
and only the chunks that have them all are read and compared with the pattern itself."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import checkpoint_dir, cut, removed

END = "\x00\x00"  # after a text; a pattern with it is matched by comparing alone
SIZE = 3
AT_ONCE = 1 << 21  # characters whose runs are sorted together


@dataclass(frozen=True)
class GramIndex:
    """postings (gram, chunk_ids) by gram, the chunks of a part of the texts in a row; frequencies (gram, df)."""

    postings: DataFrame
    frequencies: DataFrame


def _runs_of(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
    """(gram, chunk_ids): the distinct runs of texts with their end marks."""
    at = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = at[:-2] << 42 | at[1:-1] << 21 | at[2:]
    own = row[:-2] == row[2:]
    code, row = code[own], row[:-2][own]
    order = np.lexsort((row, code))
    code, row = code[order], row[order]
    first = (np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
    code, row = code[first], row[first]
    head = np.flatnonzero(np.diff(code, prepend=-1))
    letters = np.stack([code[head] >> 42, code[head] >> 21 & 0x1FFFFF, code[head] & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    found = pa.ListArray.from_arrays(pa.array(np.append(head, len(code)), pa.int32()), ids.take(pa.array(row)))
    return pa.RecordBatch.from_arrays([pa.array([letters[i : i + SIZE] for i in range(0, len(letters), SIZE)], pa.string()), found], ["gram", "chunk_ids"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, begin, chars = [], 0, 0
        for i, t in enumerate(batch.column(1)):
            texts.append(t.as_py())
            chars += len(texts[-1])
            if chars >= AT_ONCE or i == batch.num_rows - 1:
                yield _runs_of(texts, batch.column(0).slice(begin, len(texts)))
                texts, begin, chars = [], i + 1, 0


def build(chunks: DataFrame) -> GramIndex:
    """Of (chunk_id, text); null texts have none. Runs are gathered where a text is read, without a row for each in a shuffle."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    marked = chunks.where(F.col("text").isNotNull()).select("chunk_id", F.concat(F.lower("text"), F.lit(END)).alias("text"))
    postings = marked.mapInArrow(_packed, f"gram string, chunk_ids array<{kind}>")
    return GramIndex(postings, postings.groupBy("gram").agg(F.sum(F.size("chunk_ids")).alias("df")))


def stored(index: GramIndex, path: str | None = None) -> GramIndex:
    """The index written under path (default: a new one in the shared folder), sorted by gram, so that a search reads few row groups."""
    spark = index.postings.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    raw = f"{path}-raw"
    index.postings.write.mode("overwrite").parquet(raw)  # read twice, for the ranges and to be dealt
    held = spark.read.parquet(raw).withColumn("first", F.element_at("chunk_ids", 1))
    held.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").drop("first").write.mode("overwrite").parquet(f"{path}/postings")
    removed(spark, raw)
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("chunk_ids")).alias("df")).sort("gram").write.mode("overwrite").parquet(f"{path}/frequencies")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"))


def _heads(frequencies: DataFrame) -> DataFrame:
    """(head, gram, df): the grams that begin with each run of one to three characters."""
    heads = F.array_distinct(F.array(*[F.substring("gram", 1, n) for n in range(1, SIZE + 1)]))
    return frequencies.select(F.explode(heads).alias("head"), "gram", "df")


def runs(index: GramIndex, patterns: DataFrame, rarest: int = 3) -> DataFrame:
    """(pattern_id, head): the `rarest` runs that the literal parts of (pattern_id, pattern) hold, patterns of LIKE without regard to case."""
    parts = patterns.select("pattern_id", F.explode(F.array_distinct(F.split(F.lower("pattern"), "[%_]"))).alias("part")).where("part <> ''")
    long = F.transform(F.sequence(F.lit(1), F.char_length("part") - (SIZE - 1)), lambda i: F.substring("part", i, F.lit(SIZE)))
    heads = parts.select("pattern_id", F.explode(F.when(F.char_length("part") >= SIZE, long).otherwise(F.array("part"))).alias("head")).where(~F.contains("head", F.lit(END[0]))).distinct()
    weight = _heads(index.frequencies).groupBy("head").agg(F.sum("df").alias("df"))
    weighed = heads.join(weight, "head", "left").withColumn("df", F.coalesce("df", F.lit(0)))  # a run that no text has rules its pattern out
    place = F.row_number().over(W.partitionBy("pattern_id").orderBy("df", "head"))
    return weighed.withColumn("place", place).where(F.col("place") <= rarest).select("pattern_id", "head")


def candidates(index: GramIndex, named: DataFrame, list_upto: int = 200) -> DataFrame:
    """(pattern_id, chunk_id) of the chunks that have all `runs` of a pattern. Up to list_upto runs are pushed to the scan as a list."""
    begun = cut(named.select("head").distinct().join(_heads(index.frequencies), "head").select("head", "gram"))
    some = [r["gram"] for r in begun.select("gram").distinct().limit(list_upto + 1).collect()]
    postings = index.postings.where(F.col("gram").isin(some)) if len(some) <= list_upto else index.postings
    held = postings.join(begun, "gram").join(named, "head").select("pattern_id", "head", F.explode("chunk_ids").alias("chunk_id")).groupBy("pattern_id", "chunk_id").agg(F.count_distinct("head").alias("n"))
    needed = named.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return held.join(needed, ["pattern_id", "n"]).select("pattern_id", "chunk_id")


def like(low: Column, pattern: Column) -> Column:
    """Whether a text in lower case is LIKE %pattern%; a backslash stands for itself."""
    plain = F.replace(F.lower(pattern), F.lit("\\"), F.lit("\\\\"))
    wild = F.like(low, F.concat(F.lit("%"), plain, F.lit("%")))
    return F.when(pattern.rlike("[%_]"), wild).otherwise(F.contains(low, F.lower(pattern)))


def possible(index: GramIndex, chunks: DataFrame, patterns: DataFrame, rarest: int = 1) -> DataFrame:
    """(pattern_id, chunk_id) that hold every match and more: chunks with a pattern's rarest run, all chunks for one without any run."""
    named = cut(runs(index, patterns, rarest))
    loose = patterns.join(named.select("pattern_id").distinct(), "pattern_id", "left_anti").agg(F.collect_list("pattern_id").alias("loose"))  # one row
    each = chunks.where(F.col("text").isNotNull()).select("chunk_id").crossJoin(F.broadcast(loose)).where(F.size("loose") > 0).select(F.explode("loose").alias("pattern_id"), "chunk_id")
    return candidates(index, named).unionByName(each)


def search(index: GramIndex, chunks: DataFrame, patterns: DataFrame, rarest: int = 3, list_upto: int = 200) -> DataFrame:
    """(pattern_id, chunk_id) of the chunks whose text matches %pattern%, whatever the case; % and _ are wildcards.

    Null texts and patterns match nothing, an empty pattern every text. Patterns without a literal part (or with an end
    mark in it) are compared with all chunks, the batch of them as one row; all others with those that their runs name."""
    texts = chunks.where(F.col("text").isNotNull()).select("chunk_id", "text")
    known = cut(patterns.where(F.col("pattern").isNotNull()).select("pattern_id", "pattern"))
    named = cut(runs(index, known, rarest))
    maybe = candidates(index, named, list_upto).join(known, "pattern_id").groupBy("chunk_id").agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("asked"))  # at most the batch
    fit = F.transform(F.array(F.lower("text")), lambda low: F.filter("asked", lambda p: like(low, p["pattern"])))[0]  # a text is read and lower-cased once
    found = maybe.join(texts, "chunk_id").select("chunk_id", F.explode(fit).alias("p")).select("p.pattern_id", "chunk_id")
    loose = known.join(named.select("pattern_id").distinct(), "pattern_id", "left_anti").agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("loose"))  # one row
    each = texts.crossJoin(F.broadcast(loose)).where(F.size("loose") > 0).withColumn("p", F.explode("loose"))
    return found.unionByName(each.where(like(F.lower("text"), F.col("p.pattern"))).select("p.pattern_id", "chunk_id"))
