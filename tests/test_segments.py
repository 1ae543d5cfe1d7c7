"""Segments of a library: a batch writes its own rows only, merging keeps what lives, reads equal a full rebuild."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.operators import graph, lexical
from folioscope.plans import reconcile

FILE = "path string, ext string, mtime double, fsize long, sha256 string, title string, text string, error string"
WORDS = "red fox owl sea salt iron moss fern lake dune".split()


def rows(df):
    return sorted(map(str, df.collect()))


def parsed(spark, held):
    return spark.createDataFrame([(p, ".txt", m, len(t), t, p, t, None) for p, (m, t) in held.items()], FILE)


def equals_rebuild(spark, root, held):
    lib = reconcile.library(spark, root)
    index, whole = reconcile.library_index(spark, root), lexical.build_index(lib["chunks"])
    assert {r["path"]: r["mtime"] for r in lib["documents"].collect()} == {p: m for p, (m, _) in held.items()}
    assert {r["path"]: "".join(x["text"] for x in sorted(lib["chunks"].where(F.col("path") == r["path"]).collect(), key=lambda x: x["chunk_index"])) for r in lib["documents"].collect()} == {p: t for p, (_, t) in held.items()}
    for of in (lambda i: i.postings.select("term", "chunk_id", "tf", "positions"), lambda i: i.frequencies, lambda i: i.lengths):
        assert rows(of(index)) == rows(of(whole))
    assert rows(index.totals) == rows(whole.totals)
    adjacent = lib["edges"].where("rel = 'adjacent'")
    assert rows(adjacent.select("src", "dst")) == rows(graph.adjacent_edges(lib["chunks"]).select("src", "dst"))


def test_any_batches_read_as_a_rebuild(spark, tmp_path):
    rng, root, held = random.Random(11), str(tmp_path / "lib"), {}
    config = RetrievalConfig(graph=True)
    seen = []
    for step in range(6):
        batch = {}
        for p in rng.sample("abcdef", rng.randint(1, 2)):
            known = held.get(p)
            text = known[1] if known and rng.random() < 0.3 else rng.choice(seen) if seen and rng.random() < 0.2 else " ".join(rng.choices(WORDS, k=rng.randint(1, 5))) + "."
            batch[p] = (10.0 * step, text)
            seen.append(text)
        full = step == 3  # the folder as it is: what isn't there goes
        if full:
            batch |= {p: held[p] for p in list(held)[:1]}
            held = {}
        reconcile.reconcile(spark, root, parsed(spark, batch), full=full, config=config)
        held |= batch
    equals_rebuild(spark, root, held)
    state = reconcile.segments(spark, root)
    classes = [int(__import__("math").log(max(1, n), reconcile.FANOUT)) for _, n in state.names]
    assert all(classes.count(c) < reconcile.FANOUT for c in classes) and len(state.names) < 6 and any("-" in n for n, _ in state.names)


def test_one_file_writes_its_own_rows(spark, tmp_path):
    root = str(tmp_path / "lib")
    many = {f"p{i}": (1.0, f"common words and own{i}.") for i in range(60)}
    reconcile.reconcile(spark, root, parsed(spark, many))
    reconcile.reconcile(spark, root, parsed(spark, {"p7": (9.0, "another text.")}), full=False)
    read = lambda t: spark.read.parquet(f"{root}/segment-2/{t}")
    assert read("chunks").count() == 1 and read("documents").count() == 1 and read("dead").count() == 1
    assert {r["term"] for r in read("postings").collect()} == {"another", "text"}
    assert {(r["term"], r["df"]) for r in read("frequencies").collect()} == {("another", 1), ("text", 1), ("common", -1), ("words", -1), ("and", -1), ("own7", -1)}
    before = {p: os.stat(p).st_mtime_ns for p, _, f in os.walk(f"{root}/segment-1") if f}
    equals_rebuild(spark, root, many | {"p7": (9.0, "another text.")})
    assert before == {p: os.stat(p).st_mtime_ns for p, _, f in os.walk(f"{root}/segment-1") if f}
    reconcile.reconcile(spark, root, parsed(spark, {"p7": (9.0, "another text.")}), full=False)
    assert [n for n, _ in reconcile.segments(spark, root).names] == ["1", "2"]  # nothing new, no segment


def test_blank_books_are_errors(spark, tmp_path):
    blank = spark.createDataFrame([("x.pdf", ".pdf", 1.0, 4, "h", "x", "\n\n\n\n", None), ("y.txt", ".txt", 1.0, 4, "h", "y", "\n 　", None)], FILE)
    for want in ({"x.pdf": "ERROR", "y.txt": "INSERT"}, {"x.pdf": "ERROR", "y.txt": "REPLACE"}):
        got = reconcile.reconcile(spark, str(tmp_path / "lib"), blank).collect()
        assert {r["path"]: r["action"] for r in got} == want and [r["error"] for r in got if r["path"] == "x.pdf"] == ["no text in x.pdf"]


@pytest.mark.parametrize("name", ["a [1], {b}*.txt"])
def test_a_refresh_reads_only_what_changed(spark, tmp_path, name):
    folder, root = tmp_path / "in", str(tmp_path / "lib")
    folder.mkdir()
    for n in (name, "two.txt", "three.txt"):
        (folder / n).write_text(f"{n} says hello.")
    get = lambda: {r["path"].rsplit("/", 1)[-1].replace("%20", " "): r["action"] for r in reconcile.refresh(spark, root, str(folder)).collect()}
    assert set(get().values()) == {"INSERT"} and reconcile.library(spark, root)["chunks"].count() == 3
    stat = (folder / "two.txt").stat()
    (folder / "two.txt").write_text("two.txt says jello.")  # of the same size and time: nothing is read, so nothing is seen
    os.utime(folder / "two.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.utime(folder / "three.txt", (time.time() + 60, time.time() + 60))
    assert get() == {name: "SKIP", "two.txt": "SKIP", "three.txt": "TOUCH"}
    (folder / "three.txt").write_text("three is new.")
    (folder / "two.txt").unlink()
    assert get() == {name: "SKIP", "two.txt": "PURGE", "three.txt": "REPLACE"}
    assert {r["title"] for r in reconcile.library(spark, root)["documents"].collect()} == {name[:-4], "three"}


def shuffled(spark):
    """Bytes that were shuffled so far."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_not_shuffled(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path / "lib")
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(500)]
    held = {f"p{i:02}": (1.0, " ".join(rng.choices(words, k=3000)) + ".") for i in range(60)}
    later = {p: (m, t) if i % 3 else (9.0, t[::-1]) for i, (p, (m, t)) in enumerate(held.items()) if i % 5}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many files
    try:
        for batch in (held, later):
            stored = str(tmp_path / f"files{len(batch)}")
            parsed(spark, batch).withColumn("sha256", F.md5("text")).write.parquet(stored)
            before = shuffled(spark)
            got = reconcile.reconcile(spark, root, spark.read.parquet(stored)).groupBy("action").count().collect()
            assert shuffled(spark) - before < sum(len(t) for _, t in batch.values()) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["action"]: r["count"] for r in got} == {"SKIP": 32, "REPLACE": 16, "PURGE": 12}
    assert {r["path"]: r["mtime"] for r in reconcile.library(spark, root)["documents"].collect()} == {p: m for p, (m, _) in later.items()}
    index, whole = reconcile.library_index(spark, root), lexical.build_index(reconcile.library(spark, root)["chunks"])
    assert rows(index.frequencies) == rows(whole.frequencies) and rows(index.totals) == rows(whole.totals) and rows(index.lengths) == rows(whole.lengths)


def test_marked_rows_are_those_and_no_others(spark, tmp_path):
    spark.range(70_000).selectExpr("id", "concat('t', id) AS text").repartition(2).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for some in ("id % 7 = 0", "id < 3", "id >= 0", "id < 0"):
        marks = reconcile._marks(table.where(some).select(*reconcile._place()))
        got = reconcile._marked(table, marks)
        told = lambda t: rows(t.agg(F.count("id"), F.bit_xor(F.xxhash64("id", "text"))))
        assert told(got) == told(table.where(some))


def test_of_a_repeated_path_the_newest_file_counts(spark, tmp_path):
    root = str(tmp_path / "lib")
    twice = [("a", 1.0, "old words."), ("a", 5.0, "new words."), ("b", None, "no time."), ("b", None, "no time."), ("c", None, "without."), ("c", 2.0, "with.")]
    files = spark.createDataFrame([(p, ".txt", m, len(t), t, p, t, None) for p, m, t in twice], FILE)
    assert {r["path"]: (r["action"], r["n_chunks"]) for r in reconcile.reconcile(spark, root, files).collect()} == {p: ("INSERT", 1) for p in "abc"}
    assert {r["path"]: r["text"] for r in reconcile.library(spark, root)["chunks"].collect()} == {"a": "new words.", "b": "no time.", "c": "with."}
