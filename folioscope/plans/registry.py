"""Named queries over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.analysis import query_terms
from folioscope.operators import blocks, clusters, lexical, substring
from folioscope.session import cut, fingerprint, ship_package, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Corpus under its name, with its SQL."""

    def add(f: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Corpus(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple, object] = {}


class Corpus:
    """The test tables as an index: a document is one chunk, its source the path; benchmark passages are the questions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def stored(self, what: str, name: str, build: Callable[[DataFrame], object]):
        """What is built of a table, by the first query of an application that needs it and again once its files have changed."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, what, fingerprint(self.spark, f"{self.sf_dir}/{name}.parquet"))
        if key not in _STORED:
            _STORED[key] = build(self.table(name))
        return _STORED[key]

    @cached_property
    def places(self) -> DataFrame:
        """Chunks without their texts."""
        index = F.expr("CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT)")
        return self.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), index.alias("chunk_index"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Places are numbered over ids alone; texts join them afterwards."""
        texts = self.table("documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
        return self.places.join(texts, "chunk_id").select("chunk_id", "path", "title", "chunk_index", "text")

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        return self.stored("postings", "documents", lambda docs: lexical.stored(lexical.build_index(docs.select(F.col("doc_id").alias("chunk_id"), "text"))))

    @cached_property
    def blocks(self) -> blocks.BlockIndex:
        """The texts' counts in blocks of chunks, without positions."""
        return self.stored("blocks", "documents", lambda docs: blocks.stored_texts(docs.select(F.col("doc_id").alias("chunk_id"), "text")))

    @cached_property
    def grams(self) -> substring.GramIndex:
        return self.stored("grams", "documents", lambda docs: substring.stored(substring.build(docs.select(F.col("doc_id").alias("chunk_id"), "text"))))

    @cached_property
    def clusters(self) -> clusters.ClusterIndex:
        return self.stored("clusters", "embeddings", lambda _: clusters.build(self.vectors.select("chunk_id", "model", "embedding"), n_clusters=32))

    @cached_property
    def frequencies(self) -> DataFrame:
        return self.index.document_frequency()

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def document_questions(self) -> DataFrame:
        """Documents with a vector whose id is divisible by 100, as questions."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        return self.table("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text").join(vectors, "query_id")

    def terms_of(self, questions: DataFrame) -> DataFrame:
        return cut(query_terms(questions, self.frequencies, self.index.totals))

    @cached_property
    def terms(self) -> DataFrame:
        return self.terms_of(self.questions)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("cluster"), F.lit("given").alias("model"), F.size("embedding").alias("dim"), "embedding")

    @cached_property
    def vector_questions(self) -> DataFrame:
        return self.vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")

    @cached_property
    def pool(self) -> DataFrame:
        """40 reranked candidates of each question."""
        return lexical.fts_pool(self.index, self.chunks, self.terms, 40)


from folioscope.plans import queries_retrieval, queries_text  # noqa: E402, F401  (they register themselves)
