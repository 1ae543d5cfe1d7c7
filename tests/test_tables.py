"""Chunkers as table functions of SQL."""

import pytest

from folioscope.functions import tables, text

ROWS = [(1, "One. Two! Three?\n\nFour."), (2, None), (3, "  \n\n "), (4, "a, " * 700), (5, "x" * 2000), (5, "x" * 2000), (6, "甲乙。丙丁！" * 300)]


def _rows(df):
    return sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in df.collect())


@pytest.mark.parametrize(("call", "strategy"), [("sentence_chunks(d.text)", "sentence"), ("semantic_chunks(d.text)", "semantic")])
def test_lateral_is_chunks(spark, call, strategy):
    """Nulls and blank texts have no row, repeated rows give theirs twice, as with the chunker over a DataFrame."""
    tables.register(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert _rows(tables.lateral(docs, call)) == _rows(text.chunks(docs, strategy))
    assert tables.lateral(docs.limit(0), call).count() == 0


def test_sizes_as_arguments(spark):
    tables.register(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert _rows(tables.lateral(docs, "sentence_chunks(d.text, size => 100, overlap => 10)")) == _rows(text.chunks(docs, "sentence", 100, 10))
    with pytest.raises(Exception, match="overlap below"):
        tables.lateral(docs, "sentence_chunks(d.text, 10, 10)").collect()


def test_encoder_is_an_argument(spark):
    """An encoder of its own decides where chunks end: here every other sentence turns."""
    tables.register(spark, encoder=lambda parts: [[1.0, 0.0] if i // 2 % 2 else [0.0, 1.0] for i in range(len(parts))])
    docs = spark.createDataFrame([(1, " ".join(f"Sentence {i} {'z' * 90}." for i in range(8)))], "doc_id long, text string")
    assert [len(r["text"]) > 150 for r in tables.lateral(docs, "semantic_chunks(d.text, 900, 0, 55.0)").collect()] == [True] * 4
