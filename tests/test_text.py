import pytest
from pyspark.sql import functions as F

from folioscope.functions import citations, questions, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_wide_sentences_split_at_runs_of_marks(spark):
    assert one(spark, "甲。乙！？丙", text.sentences) == ["甲。", "乙！？", "丙"]


@pytest.mark.parametrize("value, parts", [("Foo bar. Baz", ["Foo bar.", "Baz"]), ("", []), ("no end", ["no end"]), ("句。Then this. And that", ["句。", "Then this.", "And that"])])
def test_latin_sentences(spark, value, parts):
    assert one(spark, value, text.sentences) == parts
    assert text._sentences(value) == parts or value == ""


def test_joined_sentences_lose_the_blank_between():
    assert text.chunk_document("Foo bar. Baz") == ["Foo bar.Baz"]


@pytest.mark.parametrize("extra, n", [(0, 1), (1, 2)])
def test_paragraphs_share_a_chunk_up_to_the_size(extra, n):
    assert len(text.chunk_document("a" * 448 + "\n\n" + "b" * (450 + extra))) == n


def test_overlong_sentences_split_at_weak_marks_then_sentence_marks_then_the_size():
    weak = "x" * 600 + "，" + "y" * 1000
    first, second, *_ = text.split_long(weak, 900, 120)
    assert first.endswith("，") and len(first) == 601 and second.startswith("x" * 119 + "，")
    plain = list(text.split_long("z" * 2000, 900, 120))
    assert [len(p) for p in plain] == [900, 900, 440]
    marked = next(iter(text.split_long("q" * 850 + "." + "r" * 1000, 900, 120)))
    assert len(marked) == 851


def test_chunks_never_exceed_the_size_and_keep_all_characters():
    t = ". ".join("word " * n for n in range(1, 60))
    got = text.chunk_document(t)
    assert max(map(len, got)) <= 900
    assert "".join("".join(got).split()) == "".join(t.split())


def test_semantic_chunks_break_at_turns_and_fall_back_for_short_texts():
    assert text.chunk_semantic("One. Two.") == text.chunk_document("One. Two.")
    t = " ".join(["cats purr and sleep all day long." for _ in range(20)] + ["engines burn fuel under high pressure." for _ in range(20)])
    assert len(text.chunk_semantic(t, min_chunk=50)) > 1


def test_html_drops_hidden_parts(spark):
    html = "<html><head><style>a{}</style><script>x</script></head><body><nav>menu</nav><p>One &amp; two</p><noscript>n</noscript>three</body></html>"
    assert one(spark, html, text.html_to_text) == "One & two\nthree"


@pytest.mark.parametrize("line, noise", [
    ("参考文献", True), ("张三，2001 出版社，2001", True), ("北京：人民社，1999", True), ("[5]", True), ("总目录", True), ("毛泽东文集：第一卷", True),
    ("[3] 这是某人", True), ("这是为中共中央起草的指示电报稿。", True), ("王力.汉语史与", True), ("This is an ordinary sentence of prose.", False), ("他在北京住了很久。", False)])
def test_noise_lines(spark, line, noise):
    assert one(spark, line, citations.is_noise_line) is noise


def test_snippets(spark):
    rows = spark.createDataFrame([(1, "词汇表\n" + "\n".join(f"Term{i} word\n术语解释{i}" for i in range(6))), (2, "好。这是一个完整的句子，它说了很多东西。还有下一句没有"), (3, None), (4, "甲：第一卷\n乙丙：第二卷"), (5, "Plain prose stays as it is.")], "id int, text string")
    got = {r["id"]: r["snippet"] for r in citations.with_snippet(rows).collect()}
    assert got[1] == "" and got[3] == "" and got[5] == "Plain prose stays as it is."
    assert got[2].startswith("这是一个完整的句子")


@pytest.mark.parametrize("q, route", [("机器学习方法", "general"), ("import os", "code"), ("", "kb"), ("what does the second chapter say about rivers?", "kb")])
def test_routes(spark, q, route):
    assert one(spark, q, questions.route) == route


def test_references_are_cut(spark):
    assert one(spark, "a\nb\n## References\nc", questions.strip_references) == "a\nb"
    assert one(spark, "a [1] b [2](u)", questions.escape_citations) == r"a \[1\] b [2](u)"


def test_trimming_is_that_of_unicode_white_space(spark):
    odd = [chr(c) for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x180E, 0x1680, *range(0x1FFF, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600]]
    rows = spark.createDataFrame([(c + " a" + c + "b\n" + c,) for c in odd] + [(c,) for c in odd] + [("",), (None,)], "t string")
    got = rows.select("t", text.trimmed(F.col("t")).alias("x"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got]
    assert "regexp" not in rows.select(text.trimmed(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()  # each regular expression reads the whole text


def test_texts_are_split_once(spark, tmp_path):
    from folioscope.plans.registry import QUERIES

    spark.createDataFrame([(1, "One. Two!\nThree", "en"), (2, "", "en"), (3, None, "en"), (4, "好。\u3000行！！ a. b", "zh")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda name: QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan("sentence_split") if "Filter" in line and "split(" in line]
    assert {r["doc_id"]: r["n"] for r in QUERIES["sentence_split"](spark, str(tmp_path)).collect()} == {1: 3, 4: 4}
    assert sum(line.count("split(text") for line in plan("glossary_blocks")) == 1


def test_long_texts_are_chunked_in_parts():
    import pyarrow as pa

    long = "A sentence of some words. " * (text.AT_ONCE // 20)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([long, None, "short", long])], ["doc_id", "text"])
    parts = [p.to_pydict() for p in text._chunked(text.chunk_document)([batch])]
    assert [sorted(set(p["doc_id"])) for p in parts] == [[1], [3, 4]]
    want = [(d, i, c) for d, t in ((1, long), (3, "short"), (4, long)) for i, c in enumerate(text.chunk_document(t))]
    assert [x for p in parts for x in zip(p["doc_id"], p["chunk_index"], p["text"])] == want
