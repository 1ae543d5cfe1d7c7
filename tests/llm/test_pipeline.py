import importlib

from pyspark.sql import functions as F


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, " ".join(f"w{(i * 7 + k) % 211}x{i % 40}" for k in range(60)), "en", f"s{i % 4}", 100) for i in range(80)]
    rows += [(100, rows[3][1].upper(), "en", "s0", 100), (101, rows[5][1] + " tail", "en", "s1", 100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["quality classifier"] == {r[0] for r in rows}
    assert kept["exact dedup"] == {r[0] for r in rows} - {3}  # the larger id of equal texts stays
    gone = kept["exact dedup"] - kept["near dedup"]
    assert 101 in gone and 5 not in gone
    pieces = p.run(spark, str(tmp_path))
    assert pieces.select(F.countDistinct("doc_id")).first()[0] == len(kept["mixing"])


def test_every_stage_takes_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(50))
    rows = [(i, text(i), "en", f"s{i % 3}", 200) for i in range(40)] + [(7, text(7), "en", "s1", 200), (None, None, None, None, None), (50, "", "en", None, 0), (51, None, "en", "s1", None), (52, text(52) + " long" * 30_000, "de", "s2", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("kept", "score", "keep_id", "group_size", "h", "depth", "size", "copies", "component_id", "node", "piece", "length"):
        docs = docs.withColumn(c, F.lit("own"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    brute = {"quality classifier": None, "exact dedup": None, "near dedup": None, "mixing": None}
    for name, stage in p.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        brute[name] = [r["doc_id"] for r in docs.collect()]
        assert {tuple(r) for r in docs.collect()} <= set(before), name  # rows come out as they went in
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert sorted(x for x in brute["exact dedup"] if x is not None) == [*range(40), 51, 52]  # 50 and 51 are both empty, 7 stood twice
    assert sorted(x for x in brute["near dedup"] if x is not None) == [*range(40), 51, 52]  # these texts share little
    assert set(brute["mixing"]) <= set(range(40)) | {52}
    packed = p.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() >= len(brute["mixing"])


def test_entry_lists_the_dealt_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert importlib.util.find_spec("folioscope.llm")
