"""The folder of books as a data source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.sources import books, files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", "a"), ("sub/b, [x].TXT", "bb"), ("c.epub", "no zip"), ("empty.txt", ""), ("~$a.txt", "lock"), ("requirements.txt", "r"), ("d.md", "d")):
        (tmp_path / name).write_text(text)
    return tmp_path


def _names(df):
    return sorted(os.path.basename(r["path"]) for r in df.select("path").collect())


def test_rows_are_those_of_the_scan(spark, folder):
    books.register(spark)
    got = spark.read.format("books").load(str(folder))
    want = files.scan_files(spark, str(folder)).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    key = lambda df: sorted((r["path"].replace("%20", " "), r["ext"], round(r["mtime"], 3), r["fsize"], r["sha256"], bytes(r["content"])) for r in df.collect())
    assert key(got.where("fsize > 0")) == key(want)  # binary files without a byte are no rows of Spark's own
    assert len(got.collect()) == 4
    parsed = {os.path.basename(r["path"]): r for r in files.parse_files(got).collect()}
    assert parsed["b, [x].TXT"]["text"] == "bb" and parsed["c.epub"]["error"]


def test_listing_reads_no_content(spark, folder):
    books.register(spark)
    listed = spark.read.format("books").option("content", "false").load(str(folder))
    assert {(r["fsize"], r["sha256"], r["content"]) for r in listed.collect()} == {(0, None, None), (1, None, None), (2, None, None), (6, None, None)}
    reader = books.BookReader({"path": str(folder), "content": "false", "partitionBytes": str(1 << 20)})
    parts = reader.partitions()
    for r in listed.collect():
        os.remove(r["path"])
    assert sum(len(list(reader.read(p))) for p in parts) == 4  # the files are gone: nothing was opened


def test_options_choose_what_is_read(spark, folder):
    """By path and time; one DataFrame gives all its rows again after a filter was laid over it."""
    books.register(spark)
    os.utime(folder / "a.txt", (1000, 1000))
    load = lambda **o: spark.read.format("books").options(**o).load(str(folder))
    assert _names(load(only=json.dumps([str(folder / "a.txt"), "none"]))) == ["a.txt"]
    assert _names(load(only="[]")) == []
    assert _names(load(modifiedBefore="1001")) == ["a.txt"] and _names(load(modifiedBefore="1000")) == []
    assert _names(load(modifiedAfter="1000")) == ["b, [x].TXT", "c.epub", "empty.txt"]
    all_ = load()
    assert _names(all_.where("ext = '.txt' AND fsize > 0")) == ["a.txt", "b, [x].TXT"] and len(_names(all_)) == 4


def test_partitions_by_bytes(folder):
    parts = books.BookReader({"path": str(folder), "content": "true", "partitionBytes": str(3)}).partitions()
    assert [[f[3] for f in p.files] for p in parts] == [[1], [6], [0, 2]]
    assert len(books.BookReader({"path": str(folder), "content": "true", "partitionBytes": str(1 << 20)}).partitions()) == 1


def test_only_changed_files_are_read(spark, folder):
    books.register(spark)
    known = spark.read.format("books").option("content", "false").load(str(folder)).select("path", "mtime", "fsize")
    stored = spark.createDataFrame(known.collect(), "path string, mtime double, fsize long")
    assert books.changed(spark, str(folder), stored).count() == 0
    (folder / "a.txt").write_text("longer")
    (folder / "new.txt").write_text("n")
    assert _names(books.changed(spark, str(folder), stored)) == ["a.txt", "new.txt"]
