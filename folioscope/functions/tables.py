"""The chunkers as table functions of SQL: SELECT d.doc_id, c.* FROM docs d, LATERAL sentence_chunks(d.text) c.

A call sees one text and yields its chunks as they are made, so a document's chunks are never held as one array. Sizes are
arguments with defaults and may be named: sentence_chunks(d.text, size => 400)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import chunk_document, chunk_semantic, hashed_encoder

COLUMNS = "chunk_index int, chunk string"


class SentenceChunks:
    """Chunks of whole sentences; none for a null or blank text."""

    def eval(self, text: str, size: int = 900, overlap: int = 120) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk_document(text, *_sizes(size, overlap)))


def _sizes(size: int | None, overlap: int | None) -> tuple[int, int]:
    """Sizes as given; a null one is an error, as are sizes by which a text would never end."""
    if size is None or overlap is None or size < 1 or not 0 <= overlap < size:
        raise ValueError(f"chunks need a size of 1 or more and an overlap below it, not {size} and {overlap}")
    return size, overlap


def semantic(encoder: Callable[[list[str]], list[list[float]]]) -> type:
    """Chunks that end where sentences differ by an encoder, as a table function."""

    class SemanticChunks:
        def eval(self, text: str, size: int = 900, overlap: int = 120, percentile: float = 78.0) -> Iterator[tuple[int, str]]:
            yield from enumerate(chunk_semantic(text, *_sizes(size, overlap), percentile=float(percentile), encoder=encoder))

    return SemanticChunks


def register(spark: SparkSession, encoder: Callable[[list[str]], list[list[float]]] = hashed_encoder) -> None:
    """Makes sentence_chunks(text, size, overlap) and semantic_chunks(text, size, overlap, percentile) known to a session's SQL."""
    for name, handler in (("sentence_chunks", SentenceChunks), ("semantic_chunks", semantic(encoder))):
        spark.udtf.register(name, F.udtf(handler, returnType=COLUMNS, useArrow=True))


def lateral(docs: DataFrame, call: str) -> DataFrame:
    """(doc_id, chunk_index, text) by SQL from docs (doc_id, text); call is a table function's call on d.text.

    Documents without a chunk have no row, as with `text.chunks`."""
    sql = f"SELECT CAST(d.doc_id AS BIGINT) AS doc_id, c.chunk_index, c.chunk AS text FROM {{docs}} d, LATERAL {call} c"
    return docs.sparkSession.sql(sql, docs=docs.select("doc_id", "text"))
