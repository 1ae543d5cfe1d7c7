import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.functions.analysis import query_terms
from folioscope.operators import cache, evaluate, fusion, graph, ingest, lexical, vector

TEXTS = ["red fox red", "blue fox", "green fox hunts", "a new-york story", "york new tale of the red sea"]


def test_bm25_agrees_with_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    chunks = spark.createDataFrame(list(enumerate(TEXTS, 1)), "chunk_id long, text string")
    for words in (["red"], ["fox"], ["red", "fox", "story"], ["new-york"]):
        match = " OR ".join(f'"{w}"' for w in words)
        want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        terms = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "query_id long, pos int, term string")
        got = {r["chunk_id"]: r["bm25"] for r in lexical.bm25(lexical.build_index(chunks), terms).collect()}
        assert got == pytest.approx(want, abs=1e-8)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, path string, text string, rank int")


def test_greedy_pass_differs_from_windows_where_a_full_path_hides_a_beginning(spark):
    rows = ranked(spark, [(1, 1, "a", "p", 1), (1, 2, "a", "same", 2), (1, 3, "b", "same", 3)])
    greedy = [r["chunk_id"] for r in fusion.greedy_dedup_cap(rows, 5, 1).orderBy("rank").collect()]
    windows = [r["chunk_id"] for r in fusion.postprocess(rows, 5, RetrievalConfig(max_chunks_per_doc=1)).orderBy("rank").collect()]
    assert greedy == [1, 3] and windows == [1]


def test_rrf_ties_go_to_the_first_list(spark):
    a, b = ranked(spark, [(1, 7, "", "", 1)]), ranked(spark, [(1, 3, "", "", 1)])
    assert [r["chunk_id"] for r in fusion.rrf_merge(a, b).orderBy("rank").collect()] == [7, 3]


def test_equal_scores_take_half(spark):
    c = spark.createDataFrame([(1, i, -1.0, "x", "t", ["k"]) for i in range(2)], "query_id long, chunk_id long, bm25 double, text string, title string, keywords array<string>")
    assert {r["rr"] for r in lexical.rerank(c).collect()} == {0.5}


def test_vectors_are_scaled_guarded_and_matched_by_width(spark):
    v = spark.createDataFrame([(1, "m", 2, [3.0, 4.0]), (2, "m", 2, [0.0, 0.0]), (3, "m", 3, [1.0, 0.0, 0.0]), (4, "n", 2, [0.0, 2.0])], "chunk_id long, model string, dim int, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 5.0])], "query_id long, embedding array<float>")
    got = {r["chunk_id"]: r["similarity"] for r in vector.vector_topk(q, vector.of_model(v, "m", 2), 5).collect()}
    assert got == {1: 0.8, 2: 0.0}
    assert {r["chunk_id"] for r in vector.of_model(v, "other", 2).collect()} == {1, 2, 4}


def test_all_clusters_probed_is_exact(spark):
    v = spark.createDataFrame([(i, i % 4, [float(i % 7), float(i % 5) + 0.5]) for i in range(40)], "chunk_id long, cluster int, embedding array<float>")
    q = v.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector.vector_topk(q, v, 5).select("query_id", "chunk_id", "rank").collect()
    probed = vector.ivf_probe(q, vector.centroids_by_label(v), v, 5, probes=4).select("query_id", "chunk_id", "rank").collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, probed))


def test_adjacency_holds_over_keywords(spark):
    e = "src long, dst long, rel string, weight double"
    got = graph.merged_edges(spark.createDataFrame([(1, 2, "adjacent", 1.0)], e), spark.createDataFrame([(1, 2, "keyword", 0.5), (1, 3, "keyword", 0.25)], e)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "adjacent", 1.0), (1, 3, "keyword", 0.25)]


def test_graph_replaces_the_tail_and_respects_scope(spark):
    primary = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, chunk_id long, rank int")
    edges = spark.createDataFrame([(10, 20, "adjacent", 1.0), (10, 21, "keyword", 0.5), (11, 22, "adjacent", 1.0)], "src long, dst long, rel string, weight double")
    allowed = spark.createDataFrame([(21,), (22,)], "chunk_id long")
    got = [r["chunk_id"] for r in graph.graph_expand(primary, edges, 3, 2, 2, allowed).orderBy("rank").collect()]
    assert got == [10, 21, 22]


def entries(spark, rows):
    return spark.createDataFrame(rows, "model string, query_hash string, query_text string, answer_text string, created_ts double, entry_id long, embedding array<float>")


def test_cache_keys_thresholds_and_eviction(spark):
    new = entries(spark, [("m", "", "What  is IT", "eight ch", 1.0, 1, [1.0, 0.0]), ("m", "", "short", "seven c", 2.0, 2, [0.0, 1.0]), ("m", "", "what is it ", "a newer answer", 3.0, 3, [1.0, 0.0])])
    held = cache.store(new.limit(0), new, 400)
    assert [r["entry_id"] for r in held.collect()] == [3]
    asked = spark.createDataFrame([(1, "m", " WHAT is\nit", [1.0, 0.0]), (2, "m", "else", [0.951, 0.309]), (3, "m", "else again", [0.949, 0.3153])], "query_id long, model string, text string, embedding array<float>")
    got = {r["query_id"]: r["kind"] for r in cache.lookup(asked, held, 0.95).collect()}
    assert got == {1: "exact", 2: "semantic"}
    many = entries(spark, [("m", str(i), "q", "answer text", float(i), i, None) for i in range(33)])
    assert cache.evict(many, 32).agg(F.min("entry_id")).first()[0] == 1


def test_metrics_without_snippets_results_or_with_wide_blanks(spark):
    golden = spark.createDataFrame([(1, []), (2, ["x"]), (3, ["a　b"])], "query_id long, snippets array<string>")
    results = spark.createDataFrame([(3, 1, "no"), (3, 2, "A B here")], "query_id long, rank int, text string")
    got = {r["query_id"]: tuple(r)[1:] for r in evaluate.retrieval_metrics(results, golden).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 0.5, 0.5, 1.0)}
    assert evaluate.mean_metrics(evaluate.retrieval_metrics(results, golden.limit(0))).first()["hit"] is None


@pytest.mark.parametrize("disk, stored, action", [
    ((2.0, 5, "s", 9), (0.0, 5, "s", 1), "SKIP"), ((2.1, 5, "s", 9), (0.0, 5, "s", 1), "TOUCH"), ((0.0, 6, "t", 9), (0.0, 5, "s", 1), "REPLACE"),
    ((0.0, 5, "s", 9), (0.0, 5, "s", 0), "REPLACE"), ((0.0, 5, "s", 9), None, "INSERT"), ((0.0, 5, "s", 0), None, "ERROR")])
def test_upsert_table(spark, disk, stored, action):
    m, size, sha, chars = disk
    d = spark.createDataFrame([("p", m, size, sha, "sentence", ".pdf", chars)], "path string, mtime double, fsize long, sha256 string, profile string, ext string, chars int")
    s = spark.createDataFrame([("p", *stored[:3], "sentence", stored[3])] if stored else [], "path string, mtime double, fsize long, sha256 string, profile string, n_chunks int")
    assert ingest.upsert_actions(d, s).first()["action"] == action


def test_percent_in_keywords_is_a_pattern(spark):
    chunks = spark.createDataFrame([(1, "a", "t", 0, "rose 50% up"), (2, "b", "t", 0, "507 items"), (3, "c", "t", 0, "none")], "chunk_id long, path string, title string, chunk_index int, text string")
    terms = spark.createDataFrame([(1, 1, "50%")], "query_id long, pos int, term string")
    assert {r["chunk_id"] for r in lexical.like_fallback(chunks, terms, 5).collect()} == {1, 2}


def test_query_of_stop_words_is_its_own_term(spark):
    q = spark.createDataFrame([(1, " the of "), (2, "river bank")], "query_id long, text string")
    df = spark.createDataFrame([("river", 1)], "term string, df long")
    got = query_terms(q, df, spark.createDataFrame([(10,)], "n long")).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["term"]) for r in got] == [(1, "the of"), (2, "bank"), (2, "river")]


def test_an_index_is_counted_without_a_row_for_each_token(spark, monkeypatch):
    texts = [(1, "One two one. Two one"), (2, None), (3, ""), (4, "two"), (5, "x " * 50 + "one two"), (6, "one"), (6, "two one"), (None, "one"), (None, "one two")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    want = {}
    for i, t in texts:
        for at, w in enumerate((t or "").lower().replace(".", "").split()):
            want.setdefault((w, i), []).append(at)
    index = lexical.build_index(chunks)
    assert {(r["term"], r["chunk_id"]): r["positions"] for r in index.postings.collect()} == {k: sorted(v) for k, v in want.items()}
    assert all(r["tf"] == len(r["positions"]) for r in index.postings.collect())
    kept = chunks.where("chunk_id < 6")
    held = lexical.stored(lexical.build_index(kept))
    assert sorted(map(str, held.postings.collect())) == sorted(map(str, lexical.build_index(kept).postings.collect()))
    assert sorted(map(tuple, held.lengths.collect())) == [(1, 5), (2, 0), (3, 0), (4, 1), (5, 52)]
    plan = lexical.build_index(chunks.where("chunk_id < 6")).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_tokens_are_counted_in_parts():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["a"] * 3, [], ["b"] * 9, ["c"]])], ["chunk_id", "tokens"])
    counted = lambda: sorted((r for b in lexical._unpacked(x.filter(lexical.pc.is_valid(x.column(0))) for x in lexical._packed([rows])) for r in b.to_pylist()), key=lambda r: r["chunk_id"])
    whole = counted()
    lexical_at, lexical.AT_ONCE = lexical.AT_ONCE, 4
    try:
        assert [p.num_rows for p in lexical._parts(rows)] == [2, 1, 1]
        assert counted() == whole
        assert [r["tfs"] for b in lexical._packed([rows]) for r in b.to_pylist() if r["term"] is None] == [[3, 0], [9], [1]]
    finally:
        lexical.AT_ONCE = lexical_at
    assert whole[1] == {"term": "b", "chunk_id": 3, "tf": 9, "positions": list(range(9))}


@pytest.mark.parametrize("most", [0, 200_000])
def test_phrases_start_from_their_rarest_token(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "SENT", most)
    texts = [(i, "the cat sat") for i in range(30)] + [(40, "the the rare the the the rare the"), (41, "rare the"), (42, "the the"), (43, "sat the cat sat the cat")]
    index = lexical.stored(lexical.build_index(spark.createDataFrame(texts, "chunk_id long, text string")))
    terms = spark.createDataFrame([(1, 1, "the-rare-the"), (2, 1, "the rare the"), (3, 1, "the the"), (4, 1, "sat the cat"), (5, 1, "cat the"), (6, 1, "the unseen"), (7, 2, "rare"), (8, 1, "the the the")], "query_id long, pos int, term string")
    got = {(r["query_id"], r["term_no"], r["chunk_id"]): r["tf"] for r in lexical.matches(index, terms).collect()}
    assert got == {(1, 1, 40): 2, (2, 1, 40): 2, (3, 1, 40): 3, (3, 1, 42): 1, (4, 1, 43): 2, (7, 2, 40): 2, (7, 2, 41): 1, (8, 1, 40): 1}
    spots = lexical._phrases(index, lexical.parts_of(index, terms.where("query_id = 1")), lexical.F.lit(True))
    assert "Generate explode(positions" not in spots._jdf.queryExecution().toString()


def test_postings_are_written_where_texts_are_read(spark):
    texts = [(i, f"one w{i % 7} w{i % 3} rare{i}") for i in range(60)] + [(60, ""), (61, None)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(4)
    held = lexical.stored(lexical.build_index(chunks))
    files = held.postings.withColumn("file", F.input_file_name()).groupBy("chunk_id").agg(F.countDistinct("file").alias("n"), F.sum("tf").alias("tf")).collect()
    assert len(held.postings.inputFiles()) == 4 and {r["n"] for r in files} == {1}  # dealt by term, a chunk's would be shuffled
    assert {r["chunk_id"]: r["dl"] for r in held.lengths.collect()} == {r["chunk_id"]: r["tf"] for r in files} | {60: 0, 61: 0}
    for file in held.postings.inputFiles():
        terms = [r["term"] for r in spark.read.parquet(file).collect()]
        assert terms == sorted(terms)


@pytest.mark.parametrize("sent", [0, 3, 12, 200_000])
def test_tags_of_frequent_and_rare_terms(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT", sent)
    texts = [(i, " ".join(f"t{j}" for j in range(20) if (i * 7 + j * j) % (j + 2) == 0) + f" own{i} own{i}") for i in range(40)]
    index = lexical.build_index(spark.createDataFrame(texts, "chunk_id long, text string"))
    df = {r["term"]: r["df"] for r in index.frequencies.collect()}
    weight = lambda t, w: round(t.split().count(w) * math.log(41 / (df[w] + 0.5)), 9)
    want = {i: sorted(sorted(set(t.split()), key=lambda w: (-weight(t, w), w))[:8]) for i, t in texts}
    tags = graph.tags_of(index.postings, index.frequencies, index.totals)
    assert {r["chunk_id"]: r["tags"] for r in tags.collect()} == want
    common = index.frequencies.where(graph._common(index.frequencies)).count()
    assert common <= sent and (common > 0) == (sent > 0)


def test_clusters_are_probed_by_blocks(spark):
    rows = [(i, None if i % 23 == 0 else i % 3, None if i % 17 == 4 else [float(i * i % 7) - 3, float(i % 5) - 0.5, float(i % 2)]) for i in range(150)] + [(200, 9, [5.0, 5.0, 5.0]), (201, 9, None)]
    v = spark.createDataFrame(rows, "chunk_id long, cluster int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.2, 0.1]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [5.0, 5.0, 4.0])], "query_id long, embedding array<float>")
    centroids = vector.centroids_by_label(v)
    unit = lambda x: x if x is None or abs((n := sum(a * a for a in x) ** 0.5) - 1) < 1e-3 or n < 1e-12 else [a / n for a in x]
    means, want = {r["cluster"]: r["centroid"] for r in centroids.collect()}, set()
    for i, x in [(r["query_id"], unit(r["embedding"])) for r in q.collect()]:
        gap = lambda c: (0 if x is None else round(sum((a - b) ** 2 for a, b in zip(x, means[c])) ** 0.5, 6), -1 if c is None else c)
        near = sorted(means, key=gap)[:2]
        like = [(k, None if x is None or e is None else round(sum(a * b for a, b in zip(x, unit(e))), 6)) for k, c, e in rows if c is not None and c in near]
        best = sorted(like, key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:60]
        want |= {(i, k, s, n) for n, (k, s) in enumerate(best, 1)}
    found = vector.ivf_probe(q, centroids, v, 60, probes=2).select("query_id", "chunk_id", "similarity", "rank")
    assert {(r[0], r[1], r[2] if r[2] is None else r[2] + 0.0, r[3]) for r in found.collect()} == {(a, b, s if s is None else s + 0.0, n) for a, b, s, n in want}
    assert "_best" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) or "best(" in plan  # no row for each pair


def test_postings_of_a_batch_are_dealt_by_their_number(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"red fox w{i % 5}") for i in range(50)], "chunk_id long, text string")
    index = lexical.stored(lexical.build_index(chunks))
    terms = spark.createDataFrame([(1, 1, "w1"), (1, 2, "red"), (2, 1, "w2"), (2, 2, "fox w3")], "query_id long, pos int, term string")
    whole = sorted(map(tuple, lexical.bm25(index, terms).collect()))
    monkeypatch.setattr(lexical, "DEALT", 10)
    dealt = lexical.bm25(index, terms)
    assert "(chunk_id#" in (plan := dealt._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression" in plan and ", 7" in plan  # 70 postings of single words
    assert sorted(map(tuple, dealt.collect())) == whole
