"""BM25 by bounded blocks against ranking every chunk."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks, lexical

TERMS = "query_id long, pos int, term string"


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(1500)]
    rows += [(2000, ""), (2001, None), (2002, "w5 " * 4000)] + [(3000 + i, rows[7][1]) for i in range(30)]  # empty, very long, ties
    index = lexical.stored(lexical.build_index(spark.createDataFrame(rows, "chunk_id long, text string")))
    return index, blocks.stored(blocks.build(index, block=16))


def want(index, terms, k):
    return {tuple(r) for r in lexical.ranked(lexical.bm25(index, terms), k, F.col("bm25"), F.col("chunk_id"), name="bm25_rank").collect()}


def test_same_rows_as_a_whole_ranking(spark, library):
    index, held = library
    rng = random.Random(5)
    rows = [(q, p, f"w{rng.randint(0, 199)}") for q in range(40) for p in range(rng.randint(1, 8))]
    rows += [(50, 0, "w0"), (51, 0, "w150"), (51, 1, "w150"), (52, 0, "nowhere"), (53, 0, None), (54, 0, "w1 w0"), (54, 1, "w9"), (55, 0, "w5")]
    terms = spark.createDataFrame(rows, TERMS)
    for k in (1, 7, 5000):
        assert {tuple(r) for r in blocks.bm25_best(index, held, terms, k).collect()} == want(index, terms, k)


def test_few_postings_are_scored(spark, library):
    index, held = library
    terms = spark.createDataFrame([(1, 0, "w0"), (1, 1, "w160"), (2, 0, "w1"), (2, 1, "w120")], TERMS)
    total = blocks.opened(index, held, terms, 5).agg(F.sum("postings").alias("p"), F.sum("scored").alias("s"), F.sum("blocks").alias("b"), F.sum("opened").alias("o")).first()
    assert total["p"] == index.postings.where("term IN ('w0', 'w160', 'w1', 'w120')").count()
    assert 0 < total["o"] < total["b"] / 2 and total["s"] < total["p"] / 2


def test_bounds_hold_and_blocks_are_bounded(library):
    index, held = library
    assert held.agg(F.max("n")).first()[0] <= 16
    assert held.where(F.exists("posts", lambda p: p["gain"] > F.col("top"))).count() == 0
    assert held.agg(F.sum("n")).first()[0] == index.postings.count()


def test_an_empty_index_finds_nothing(spark):
    index = lexical.stored(lexical.build_index(spark.createDataFrame([], "chunk_id long, text string")))
    held = blocks.stored(blocks.build(index))
    assert blocks.bm25_best(index, held, spark.createDataFrame([(1, 0, "a")], TERMS), 3).collect() == []


def test_blocks_of_texts_are_those_of_their_index(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"c{i:04}", " ".join(rng.choices([f"w{j}" for j in range(90)], [1 / (j + 1) for j in range(90)], k=rng.randint(0, 40)))) for i in range(400)]
    rows += [("d1", ""), ("d2", None), (None, "w1 w80 w80"), ("e", "w3 " * 900)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    index, held = lexical.stored(lexical.build_index(chunks)), blocks.stored_texts(chunks, block=5)
    assert {tuple(r) for r in held.frequencies.collect()} == {tuple(r) for r in index.frequencies.collect()}
    assert [tuple(r) for r in held.totals.collect()] == [tuple(r) for r in index.totals.select("n", "avgdl").collect()]
    assert held.blocks.agg(F.max("n"), F.sum("n")).first() == (5, index.postings.count())
    asked = [(q, p, f"w{rng.randint(0, 89)}") for q in range(30) for p in range(rng.randint(1, 6))] + [(40, 0, "w1 w0"), (40, 1, "w2"), (None, 0, "w80")]
    terms = spark.createDataFrame(asked, TERMS)
    for dealt in (blocks.DEALT, 40):  # one task and many
        monkeypatch.setattr(blocks, "DEALT", dealt)
        for k in (1, 6, 900):
            assert {tuple(r) for r in blocks.bm25_best(held, held.blocks, terms, k, whole=lambda: index).collect()} == want(index, terms, k)


def test_rows_of_one_id_score_as_in_sql(spark, tmp_path):
    import duckdb

    from folioscope.plans.registry import ORACLE_SQL, QUERIES

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices([f"w{j}" for j in range(60)], [1 / (j + 1) for j in range(60)], k=n))
    docs = [(i if i % 7 else 14, text(rng.randint(1, 50)), "en", f"s{i % 3}") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, text(9)) for i in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["bm25_bounded"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(ORACLE_SQL["bm25_bounded"]).fetchall()) and any(r[1] == 14 for r in got)


def test_a_corpus_is_neither_shuffled_nor_stored_with_positions(spark, tmp_path):
    from folioscope.plans import registry
    from test_segments import shuffled

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5000)]
    docs = [(i, " ".join(rng.choices(words, k=1000)), "en", "s") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = shuffled(spark)
    assert registry.QUERIES["bm25_bounded"](spark, str(tmp_path)).count() == 300
    assert shuffled(spark) - before < sum(len(d[1]) for d in docs)  # the batch has more than 200 terms, so blocks of all terms are read
    assert not [k for k in registry._STORED if k[1] == str(tmp_path) and k[2] == "postings"]


def test_no_texts_have_no_blocks(spark):
    held = blocks.stored_texts(spark.createDataFrame([], "chunk_id long, text string"))
    assert blocks.bm25_best(held, held.blocks, spark.createDataFrame([(1, 0, "a")], TERMS), 3).collect() == []
    held = blocks.stored_texts(spark.createDataFrame([(1, ""), (2, None)], "chunk_id long, text string"))
    assert blocks.bm25_best(held, held.blocks, spark.createDataFrame([(1, 0, "a")], TERMS), 3).collect() == []
