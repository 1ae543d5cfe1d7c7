"""Incremental indexing of a folder as a stream of files. The batch operators do the work; this only drives them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscope.plans.reconcile import reconcile
from folioscope.sources.files import described, parse_files


def watch(spark: SparkSession, root: str, checkpoint: str, on_files: Callable[[DataFrame, int], None], pattern: str = "*.txt", trigger: dict | None = None) -> StreamingQuery:
    """Calls on_files with each batch of new files (path, modificationTime, length, content).

    A batch is delivered again after a failure under the same number, so on_files should write by that number."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_files).trigger(**(trigger or {"availableNow": True})).start()


def index_new_files(spark: SparkSession, root: str, library_root: str, checkpoint: str, pattern: str = "*.txt", **options) -> StreamingQuery:
    """Reconciles the library with each batch of new files. A batch that comes again finds its files known and skips them."""
    return watch(spark, root, checkpoint, lambda batch, _: reconcile(spark, library_root, parse_files(described(batch)), full=False, **options), pattern)


def deduplicated_questions(questions: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """A stream of (query_hash, ts, ...) without repeats within the time to live."""
    return questions.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["query_hash"])
