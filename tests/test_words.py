"""Han words: counts, lexicon and best paths against brute force, and an index of words."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from folioscope.functions import words
from folioscope.functions.analysis import query_terms
from folioscope.operators import lexical

WORDS = ["机器", "学习", "数据", "分析", "北京", "大学", "图书馆", "语言"]


def corpus(n=400):
    rng = random.Random(2)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9))) + rng.choice(["。", " plain words ", ""]) for _ in range(n)]


def test_grams_count_every_place_of_long_runs_too(spark, monkeypatch):
    monkeypatch.setattr(words, "PIECE", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choices("甲乙丙", k=n)) for n in (1, 2, 6, 7, 8, 14, 15, 40)] + ["甲a乙乙", "", None, "abc", "𠀀𠀁甲"]
    want = Counter()
    for t in texts:
        for run in "".join(c if c not in "abc" else " " for c in t or "").split():
            for i in range(len(run)):
                for n in range(1, min(4, len(run) - i) + 1):
                    want[run[i : i + n], run[i - 1 : i] if i else "", run[i + n : i + n + 1]] += 1
    got = words.grams(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {(r["word"], r["before"], r["after"]): r["n"] for r in got} == dict(want)


def test_best_path_is_the_least_of_all_paths():
    rng = random.Random(4)
    for _ in range(300):
        cost = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 4))): rng.randint(1, 12) for _ in range(12)}
        run, unknown = "".join(rng.choices("甲乙丙丁", k=rng.randint(1, 9))), 13
        paths = []
        for marks in itertools.product((0, 1), repeat=len(run) - 1):
            ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
            path = [run[a:b] for a, b in zip([0, *ends], ends)]
            if all(len(w) == 1 or (w in cost and len(w) <= 4) for w in path):
                paths.append((sum(cost.get(w, unknown) for w in path), [-len(w) for w in path], path))
        assert words.best_path(run, cost, unknown, 4) == min(paths)[2]


def test_the_lexicon_holds_the_words_and_not_what_lies_across_them(spark):
    lexicon = words.learn(spark.createDataFrame([(t,) for t in corpus()], "text string"))
    learned = {r["word"] for r in lexicon.where("length(word) > 1").collect()}
    assert learned == set(WORDS)
    texts = [(1, "机器学习数据"), (2, "我在北京大学 Library图书馆"), (3, None), (4, ""), (5, "plain Été"), (6, "学" * 3000)]
    split = words.splitter(lexicon)
    got = {r[0]: r[1] for r in spark.createDataFrame(texts, "id int, text string").select("id", split(F.col("text"))).collect()}
    assert got[1] == ["机器", "学习", "数据"]
    assert got[2] == ["我", "在", "北京", "大学", "library", "图书馆"]
    assert got[3] == got[4] == [] and got[5] == ["plain", "ete"] and len(got[6]) == 3000


def test_a_corpus_without_han_teaches_nothing(spark):
    for rows in ([], [("abc",), (None,), ("",)]):
        lexicon = words.learn(spark.createDataFrame(rows, "text string"))
        assert lexicon.collect() == []
        split = words.splitter(lexicon)
        assert spark.createDataFrame([("甲乙 c",)], "text string").select(split(F.col("text"))).first()[0] == ["甲", "乙", "c"]


def test_an_index_of_words_finds_words(spark):
    chunks = spark.createDataFrame(list(enumerate(corpus())), "chunk_id long, text string")
    split = words.splitter(words.learn(chunks))
    index = lexical.stored(lexical.build_index(chunks, split=split))
    asked = spark.createDataFrame([(1, "图书馆"), (2, "大学语言"), (3, "plain")], "query_id long, text string")
    terms = query_terms(asked, index.frequencies, index.totals, split=split)
    assert {(r["query_id"], r["term"]) for r in terms.collect()} == {(1, "图书馆"), (2, "大学"), (2, "语言"), (3, "plain")}
    hits = {(r["query_id"], r["chunk_id"]) for r in lexical.matches(index, terms).collect()}
    texts = dict(enumerate(corpus()))
    assert hits == {(q, i) for i, t in texts.items() for q, ws in ((1, ["图书馆"]), (2, ["大学", "语言"]), (3, ["plain"])) if any(w in t for w in ws)}
    assert {r[0] for r in lexical.bm25(index, terms).select("query_id").distinct().collect()} == {1, 2, 3}
