"""Cluster search and substring search against whole scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import clusters, substring, vector

VECTORS = "chunk_id long, model string, embedding array<float>"


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        v = centre[rng.integers(0, 12)] + rng.normal(size=8) * 0.1
        v = v / np.linalg.norm(v) * rng.choice([1.0, 1.0005, 3.0])  # of length one, nearly so, and longer
        rows.append((i, "m" if i % 3 else "n", [float(x) for x in np.round(v, 2)]))  # rounded: ties
    rows += [(1000, "m", None), (1001, "m", [0.0] * 8), (1002, None, [1.0, 0.0]), (1003, None, [0.5, 0.5]), (1004, "m", rows[7][2])]
    df = spark.createDataFrame(rows, VECTORS)
    return df, clusters.build(df, n_clusters=16, block=20, sample=400, rounds=5)


def test_exact_cluster_search_is_a_whole_scan(spark, library):
    v, index = library
    q = v.where("chunk_id % 9 = 0 OR chunk_id > 1000").withColumnRenamed("chunk_id", "query_id")
    got = {tuple(r) for r in clusters.search(index, q, 7, first=2).collect()}
    for model in ("m", "n", None):
        own = F.col("model").eqNullSafe(F.lit(model))
        want = {tuple(r) for r in vector.vector_topk(q.where(own), v.where(own), 7).select("query_id", "chunk_id", "similarity", "rank").collect()}
        ids = {r["query_id"] for r in q.where(own).collect()}
        assert {r for r in got if r[0] in ids} == want
    assert index.clusters.agg(F.sum("n")).first()[0] == v.where("embedding IS NOT NULL").count()


def test_the_cheaper_mode_keeps_its_recall_and_reads_few_clusters(spark, library):
    v, index = library
    q = v.where("chunk_id % 7 = 0 AND model = 'm'").withColumnRenamed("chunk_id", "query_id")
    exact = vector.vector_topk(q, v.where("model = 'm'"), 7)
    assert vector.recall(clusters.search(index, q, 7, exact=False), exact).agg(F.avg("recall")).first()[0] >= 0.9
    known = {r["model"]: r["probes"] for r in index.probes.where("width = 8").collect()}
    n = index.clusters.where("model = '-m' AND width = 8").count()
    assert known["-m"] < n / 2
    one = clusters.search(index, q.limit(1), 7, exact=False)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cluster#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # other folders aren't read


def test_a_model_of_one_vector_and_none(spark):
    one = spark.createDataFrame([(5, "m", [1.0, 2.0])], VECTORS)
    index = clusters.build(one, n_clusters=8)
    asked = spark.createDataFrame([(1, "m", [1.0, 2.0]), (2, "x", [1.0, 2.0]), (3, "m", [1.0]), (4, "m", None)], "query_id long, model string, embedding array<float>")
    for exact in (True, False):
        assert [tuple(r) for r in clusters.search(index, asked, 3, exact=exact).collect()] == [(1, 5, 1.0, 1)]
    assert clusters.search(clusters.build(one.limit(0)), asked, 3).collect() == []


def like(text, pattern):
    import re

    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.search(rx, text.lower(), re.S) is not None


def test_substring_search_against_every_pair(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abAB1 %_\\汉字é\n", k=rng.randint(0, 14))) for _ in range(200)] + [None, "", "x" * 3000 + "needle", "a\x00b", "50% off", "a_b"]
    patterns = ["".join(rng.choices("abB1%_\\汉é", k=rng.randint(0, 5))) for _ in range(120)] + [None, "", "%", "___", "nEEdle", "edle", "le", "e", "\x00", "50%", "a_b", "xxxx", "zzz", "q", "ab%12", "𝒳"]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    want = {(i, j) for i, x in enumerate(patterns) for j, y in enumerate(texts) if x is not None and y is not None and like(y, x)}
    for index, options in ((substring.build(t), {}), (substring.stored(substring.build(t)), {"list_upto": 2, "rarest": 1})):
        assert {tuple(r) for r in substring.search(index, t, p, **options).collect()} == want
    plan = substring.search(substring.stored(substring.build(t)), t, p.where("pattern_id = 124"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "In(gram" in plan  # only the runs of the pattern are read


def test_fallback_without_a_nested_loop(spark):
    from folioscope.operators import lexical

    chunks = spark.createDataFrame([(1, "p", "t", 0, "costs 50% more"), (2, "p", "t", 1, "costs 50 more"), (3, "p", "t", 2, "nothing")], "chunk_id long, path string, title string, chunk_index int, text string")
    terms = spark.createDataFrame([(1, 1, "50%"), (2, 1, "noth"), (2, 2, "COST")], "query_id long, pos int, term string")
    got = lexical.like_fallback(chunks, terms, 5)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_runs_are_gathered_where_a_text_is_read(spark, monkeypatch):
    texts = [(1, "ABcab"), (2, None), (3, ""), (4, "\U0001f600ab\U0001f600ab"), (5, "x")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    index = substring.build(chunks)
    got = {(r["gram"], i) for r in index.postings.collect() for i in r["chunk_ids"]}
    assert got == {((t.lower() + substring.END)[k : k + 3], i) for i, t in texts if t is not None for k in range(len(t))}
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, "\U0001f600ab"), (2, "b\U0001f600a"), (3, "CA"), (4, "bca%")], "pattern_id long, pattern string")
    found = sorted(map(tuple, substring.search(substring.stored(index), chunks, asked).collect()))
    assert found == [(1, 4), (2, 4), (3, 1), (4, 1)]


@pytest.mark.parametrize("first", [(), (1,), (1, 2), (16, 64)])
def test_fallback_takes_the_first_chunks_of_all(spark, monkeypatch, first):
    from folioscope.operators import lexical

    monkeypatch.setattr(lexical, "FIRST", first)
    words = ["red", "fox", "tree", "rare"]
    texts = [(i, f"{words[i % 3]} number {i}" + (" Rare" if i in (5, 37, 39) else "")) for i in range(40)]
    chunks = spark.createDataFrame([(i, "p%d" % i, "t", i, t) for i, t in texts], "chunk_id long, path string, title string, chunk_index int, text string")
    terms = spark.createDataFrame([(1, 1, "rare"), (2, 1, "red"), (2, 2, "fox"), (3, 1, "none such")], "query_id long, pos int, term string")
    got = lexical.like_fallback(chunks, terms, 50, limit=4).collect()
    assert {q: sorted(r["chunk_id"] for r in got if r["query_id"] == q) for q in (1, 2, 3)} == {1: [5, 37, 39], 2: [0, 1, 3, 4], 3: []}
