import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.functions import analysis, questions
from folioscope.functions.text import html_to_text
from folioscope.operators import ingest, lexical, vector
from folioscope.plans import reconcile, retrieve
from folioscope.sources import files
from folioscope.streaming import reindex

FILE = "path string, ext string, mtime double, fsize long, sha256 string, title string, text string, error string"


def parsed(spark, rows):
    return spark.createDataFrame([(p, ".txt" if not p.endswith("pdf") else ".pdf", m, len(t or ""), t or "", p, t, e) for p, m, t, e in rows], FILE)


def report(spark, *a, **k):
    return {r["path"]: r["action"] for r in reconcile.reconcile(spark, *a, **k).collect()}


def test_a_folder_and_its_library_are_brought_in_step(spark, tmp_path):
    root, config = str(tmp_path / "lib"), RetrievalConfig(graph=True)
    first = [("a", 1.0, "red fox jumps. " * 100, None), ("b", 1.0, "blue whale sings.", None), ("c", 1.0, "green tea.", None), ("x.pdf", 1.0, "", None)]
    assert report(spark, root, parsed(spark, first), config=config) == {"a": "INSERT", "b": "INSERT", "c": "INSERT", "x.pdf": "ERROR"}
    second = [("a", 9.0, "red fox jumps. " * 100, None), ("b", 1.0, "blue whale dives deep.", None), ("d", 1.0, "new owl.", None), ("e", 1.0, None, "ValueError: bad")]
    got = report(spark, root, parsed(spark, second), config=config)
    assert got == {"a": "TOUCH", "b": "REPLACE", "c": "PURGE", "d": "INSERT", "e": "ERROR"}
    held = reconcile.library(spark, root)
    assert {r["path"]: r["mtime"] for r in held["documents"].collect()} == {"a": 9.0, "b": 1.0, "d": 1.0}
    index = reconcile.library_index(spark, root)
    whole = lexical.build_index(held["chunks"])
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(index.postings.select("term", "chunk_id", "tf", "positions")) == rows(whole.postings.select("term", "chunk_id", "tf", "positions"))
    assert rows(index.frequencies) == rows(whole.frequencies) and index.totals.first()["n"] == held["chunks"].count()
    assert not {r["term"] for r in index.frequencies.collect()} & {"sings", "tea"} and held["edges"].count() > 0
    assert reconcile.versions(spark, root) == [1, 2] and set(report(spark, root, parsed(spark, second[:3]), config=config).values()) == {"SKIP"}


def test_new_files_are_indexed_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.txt").write_text(f"{name} text.")
        reindex.index_new_files(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "cp")).awaitTermination(120)
    held = reconcile.library(spark, str(tmp_path / "lib"))
    assert sorted(r["text"] for r in held["chunks"].collect()) == ["one text.", "two text."]


def test_han_words_are_found_by_pairs(spark):
    chunks = spark.createDataFrame([(1, "机器学习很有用"), (2, "学习机器翻译"), (3, "无关"), (4, "abc机def 龙")], "chunk_id long, text string")
    index = lexical.build_index(chunks)
    assert [r["t"] for r in chunks.select(analysis.tokens(F.col("text")).alias("t")).orderBy("chunk_id").collect()][3] == ["abc", "机", "def", "龙"]
    terms = spark.createDataFrame([(1, 1, "机器学习"), (2, 1, "学习"), (3, 1, "龙")], "query_id long, pos int, term string")
    got = {(r["query_id"], r["chunk_id"]) for r in lexical.matches(index, terms).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 4)}


def test_terms_fall_back_in_the_order_of_the_rules(spark):
    q = spark.createDataFrame([(1, "rivers and mountains"), (2, "the river"), (3, "the of"), (4, "x yes x"), (5, " ")], "query_id long, text string")
    df, n = spark.createDataFrame([("the", 9)], "term string, df long"), spark.createDataFrame([(10,)], "n long")
    of = lambda t: {i: [r["term"] for r in t.orderBy("pos").collect() if r["query_id"] == i] for i in range(1, 6)}
    assert of(analysis.query_terms(q, df, n)) == {1: ["rivers", "mountains"], 2: ["river"], 3: ["the of"], 4: ["x", "yes"], 5: []}
    fast = analysis.fast_terms(q, df, n)
    assert of(fast)[4] == ["yes"]
    assert of(analysis.rank_keywords(q, fast))[4] == ["yes"] and of(analysis.rank_keywords(q, fast))[3] == ["the of"]


def test_pages_show_what_readers_see(spark):
    rows = [("a &eacute; &#x4e2d;&amp;lt;", "a é 中&lt;"), ("x<script>never closed", "x"), ("p<nav>q</nav >r", "p\nr".replace("\n", "")), ("<!-- open", ""), ("&lt;b&gt; &copy;", "<b> ©"), (None, "")]
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string")
    assert [r["t"] for r in d.select("i", html_to_text(F.col("h")).alias("t")).orderBy("i").collect()] == [t for _, t in rows]


def test_vectors_clusters_and_hooks(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], "m" if i % 2 else "n") for i in range(200)] + [(900, None, "m"), (901, [1.0, 0.0], "m")], "chunk_id long, embedding array<double>, model string")
    q = v.where("chunk_id % 20 = 0 AND size(embedding) = 8").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector.vector_topk(q, v, 5, query_block=3, vector_block=17)
    rows = {r["chunk_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in v.where("chunk_id < 200").collect()}
    for i in {r["query_id"] for r in q.collect()}:
        want = sorted(rows, key=lambda c: (-round(float(rows[i] @ rows[c]), 6), c))[:5]
        assert [r["chunk_id"] for r in exact.where(f"query_id = {i}").orderBy("rank").collect()] == want
    cells = vector.ivf_build(v.where("chunk_id < 200"), 4)
    assert vector.recall(vector.ivf_probe(q, *cells, 5, probes=4), exact).agg(F.min("recall")).first()[0] == 1.0
    empty = vector.ivf_probe(q, cells[0], cells[1].limit(0), 5, everything=v)
    assert vector.recall(empty, exact).agg(F.min("recall")).first()[0] == 1.0
    raw = spark.createDataFrame([(np.array([1.5, -2.0], dtype="<f4").tobytes(),), (b"abc",), (None,)], "vec binary")
    assert [r["embedding"] for r in vector.imported(raw).collect()] == [[1.5, -2.0], None, None]
    texts = spark.createDataFrame([(1, "a")], "i int, text string")
    assert vector.encode(texts, lambda t: [[1.0, 2.0]] * len(t)).first()["dim"] == 2
    failed = vector.encode(texts, lambda t: 1 / 0).first()
    assert failed["embedding"] is None and "ZeroDivisionError" in failed["encode_error"]


def test_models_rewrite_and_answer(spark):
    rows = spark.createDataFrame([(1, " how? ", True), (2, "clear enough", False), (3, "same", True), (4, None, True)], "query_id long, text string, vague boolean")
    got = {r["query_id"]: (r["search_text"], r["rewrite"]) for r in questions.rewritten(rows, "vague", lambda q: ["better\nmore" if x == "how?" else x for x in q]).collect()}
    assert got == {1: ("better", "better"), 2: ("clear enough", None), 3: ("same", None), 4: ("", None)}
    assert questions.rewritten(rows, "vague").where("rewrite IS NOT NULL").count() == 0
    said = questions.chatted(rows.select(F.col("text").alias("prompt")), lambda p: 1 / 0).first()
    assert said["answer"] is None and "ZeroDivisionError" in said["chat_error"]


def test_paths_metadata_and_pages(spark, tmp_path):
    d = spark.createDataFrame([("/r/a", '{"k": "v"}'), ("/r/../s/a", "{bad"), ("../r2/x", None), ("b/../c", "[]"), ("/r", " ")], "p string, m string")
    assert [r["c"] for r in d.select(ingest.contained(F.col("p"), "/r/").alias("c")).collect()] == [True, False, False, True, False]
    assert [r["m"] for r in d.select(ingest.metadata(F.col("m")).alias("m")).collect()] == [{"k": "v"}, {}, {}, {}, {}]
    assert [r["id"] for r in ingest.page(spark.range(30), 5, 20, "id").collect()] == [20, 21, 22, 23, 24]
    assert files.library_root(" ", str(tmp_path), "/d") == str(tmp_path.resolve()) and files.library_root(None, "/no/such", "/d") == "/d"
    files.write_metrics(spark.createDataFrame([("mrr", 0.5)], "name string, value double"), str(tmp_path / "m"))
    assert pd.concat([pd.read_json(f, lines=True) for f in (tmp_path / "m").glob("*.json")])["value"].tolist() == [0.5]


def test_whole_retrieval_over_a_small_corpus(spark):
    chunks = spark.createDataFrame([(i, f"/lib/{i % 3}", f"t{i}", i, t) for i, t in enumerate(["red fox hunts at night", "blue whale sings in the sea", "a zebra-like pattern", "foxes and whales", "nothing here"])], "chunk_id long, path string, title string, chunk_index int, text string")
    vectors = chunks.select("chunk_id", F.array(F.col("chunk_id").cast("double") + 1, F.lit(1.0)).alias("embedding"), F.lit("m").alias("model"))
    q = spark.createDataFrame([(1, "red fox", [1.0, 1.0]), (2, "ebra-lik", None), (3, "whale sea", None)], "query_id long, text string, embedding array<double>")
    index = lexical.build_index(chunks)
    terms = analysis.query_terms(q, index.frequencies, index.totals)
    got = {}
    for r in retrieve.retrieve(index, chunks, vectors, q, terms, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["source"]))
    assert got[1][0] == (0, "hybrid") and got[3][0][0] == 1 and got[2] == [(2, "like")]
    fast = retrieve.retrieve_fast(index, chunks, vectors, q, analysis.fast_terms(q, index.frequencies, index.totals), 2)
    assert fast.where("query_id = 1 AND rank = 1").first()["chunk_id"] == 0
    scoped = retrieve.retrieve(index, chunks, vectors, q, terms, 2, root="/lib/1")
    assert {r["chunk_id"] for r in scoped.collect()} <= {1, 4}
