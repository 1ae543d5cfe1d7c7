"""URL rules against a plain reading of their contract; trees by what they learn from URLs that differ."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import urlfilter
from folioscope.llm.urlfilter import UrlFilterSpec

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [
    None, "", "example.net/en/1", "http://example.net", "http://net/", "https://a.EXAMPLE.net/en/x?y#z", "https://a.example.net/de/x", "ftp://notexample.net/en/", "http://x.example.com/de/",
    "http://example.com/de", "http://badexample.com/de/1", "http://example.org/fr/2#q", "http://org/fr/", "http://cyborg/fr/", "x://y://z/en?://", "http://É.NET/É?a/b", "://net/", "http:///path", "http://a.net?x=/",
    "http://a.net:80/", "http://a.net\n/b", "http://a.net/\nb?c\nd", "http://" + "a." * 20_000 + "net/" + "x" * 300_000,
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def constant(spark, share):
    return urlfilter.UrlModel(None, spark.createDataFrame([], "suffix string, seen double, rate double"), 0.0, share, UrlFilterSpec())


def test_rules_against_a_plain_reading(spark):
    rng = random.Random(1)
    urls = URLS + ["http://" + ".".join(rng.choices(["example", "net", "org", "com", "a"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/de/x", "/fr/?", "?/en/", "#"]) for _ in range(300)]
    rows = [(i, u, "own") for i, u in enumerate(urls)] + [(None, URLS[4], "own"), (4, URLS[4], "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumns({"rule": F.lit(1), "score": F.lit("own"), "depth": F.lit(2)})
    got = urlfilter.judge(pages, RULES, constant(spark, 0.7)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "block"), r["url"] and r["url"][:80]
    assert urlfilter.judge(pages.limit(0), RULES, constant(spark, 0.7)).collect() == []
    twice = urlfilter.judge(pages.where("page_id = 4"), [("allow", "net/"), ("block", "net/")], constant(spark, 0.1)).collect()
    assert {r["verdict"] for r in twice} == {"block"}


def test_features_against_brute_force(spark):
    urls = ["https://Ab-1.example.com:80/a/b//c.html?x=1&y=%20&&z#f", "", "http://x.org", "é😀é://h/p?q"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in urlfilter.features(F.col("url"), F.lit(0.0), F.lit(0.5)).items()]).collect()}
    r = got[0]
    assert (r["depth"], r["parameters"], r["labels"], r["longest_word"], r["hyphens"], r["escapes"], r["fragment"], r["secure"], r["port"]) == (3, 3, 3, 7, 1, 1, 1, 1, 1)
    for i, u in enumerate(urls):
        n = max(1, len(u))
        assert got[i]["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(u).values()), abs=1e-9)
        assert got[i]["digits"] == pytest.approx(sum(c.isdigit() for c in u) / n) and got[i]["length"] == len(u)


def test_trees_learn_what_labels_say_and_leave_the_held_out_alone(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        host = f"{word(4)}-{word(5)}.{rng.choice(['info', 'com'])}" if bad else f"{word(7)}.{rng.choice(['org', 'com'])}"
        rows.append((i, f"http://{host}/{word(3)}/{word(6)}" + ("?a=1&b=%20&c=9" if bad and rng.random() < 0.7 else ""), int(bad)))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model = urlfilter.fit(labelled, UrlFilterSpec(trees=8))
    held = urlfilter.scored(labelled, model).where(F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert sum((r["score"] >= 0.5) == bool(r["bad"]) for r in held) >= 0.97 * len(held) and len(held) > 150
    stats = {r["suffix"]: r["rate"] for r in model.suffixes.collect()}
    assert stats["info"] > 0.7 > 0.3 > stats["org"]
    again = urlfilter.fit(labelled.repartition(7), UrlFilterSpec(trees=8))
    assert [r["score"] for r in urlfilter.scored(labelled, again).orderBy("page_id").collect()] == pytest.approx([r["score"] for r in urlfilter.scored(labelled, model).orderBy("page_id").collect()])
    swapped = labelled.withColumn("bad", F.when(F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("bad")).otherwise(F.col("bad")))
    blind = urlfilter.fit(swapped, UrlFilterSpec(trees=8))  # held-out labels teach nothing
    assert [r["score"] for r in urlfilter.scored(labelled.limit(50), blind).collect()] == pytest.approx([r["score"] for r in urlfilter.scored(labelled.limit(50), model).collect()])


def test_labels_of_one_class_or_none(spark):
    for rows, score in (([], 0.0), ([(i, "http://a.com/", 0) for i in range(30)], 0.0), ([(i, None, 1) for i in range(30)], 1.0), ([(None, "http://a.com/", 1), (1, "http://a.com/", None)], 0.0)):
        model = urlfilter.fit(spark.createDataFrame(rows, "page_id long, url string, bad int"))
        assert {r["score"] for r in urlfilter.scored(spark.createDataFrame([(1, "http://b.org/"), (2, None)], "page_id long, url string"), model).collect()} == {score}
