import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import exactdup, neardup

SCHEMA = "doc_id long, text string, kept string, component string"


def test_exact_groups_against_brute_force(spark):
    texts = ["Same", "sAME", None, "", "É", "é", "other", "Same", "long " * 30_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "own", "own") for i, t in enumerate(texts)], SCHEMA)
    spec = exactdup.IndexSpec(capacity=1, max_depth=6)  # every bucket splits until the directory's bound
    got = exactdup.exact_groups(docs, spec=spec).collect()
    norm = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i if i != 3 else None)
    assert len(got) == len(texts)
    for r in got:
        g = groups[norm(r["text"])]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_leaves_one_of_repeated_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (1, "a", "x", "y"), (2, "b", "x", "y"), (0, "A", "z", "z")], SCHEMA)
    got = exactdup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", "y"), (2, "b", "x", "y")]
    assert exactdup.exact_dedup(docs.limit(0)).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    index = spark.range(200).select(F.xxhash64("id").alias("h"), F.lit(1).alias("n"))
    spec = exactdup.IndexSpec(capacity=10, max_depth=8)
    d = exactdup.directory(index, spec)
    held = index.withColumn("cell", exactdup.prefix(F.col("h"), 8)).join(d, "cell").groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in held) == 200 and max(r["count"] for r in held) <= 10 and max(r["depth"] for r in held) > 3


def test_documents_look_their_texts_up_in_the_buckets_of_the_directory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 60}", "own", "own") for i in range(150)], SCHEMA)
    spec = exactdup.IndexSpec(capacity=4, max_depth=8, mark_bits=8)
    cells, index = exactdup.build_index(docs, spec=spec)
    held = index.groupBy("depth", "bucket").count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) <= 4 and index.count() == 60
    assert {r["group_size"] for r in exactdup.exact_groups(docs, spec=spec).collect()} == {2, 3}
    whole = exactdup.located
    monkeypatch.setattr(exactdup, "located", lambda rows, cells, spec: whole(rows, cells, spec).withColumn("bucket", F.lit(0) if "__doc" in rows.columns else F.col("bucket")))
    assert 1 in {r["group_size"] for r in exactdup.exact_groups(docs, spec=spec).collect()}  # a wrong bucket finds nothing


def test_texts_that_share_a_hash_are_chained_apart(spark, monkeypatch):
    real = exactdup.F.xxhash64
    monkeypatch.setattr(exactdup.F, "xxhash64", lambda *c: (real(*c) % 3).cast("long"))  # every text collides with many
    docs = spark.createDataFrame([(i, f"T{i % 7}" if i % 2 else f"t{i % 7}", "own", "own") for i in range(40)], SCHEMA)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdup.exact_groups(docs).collect()}
    of = {k: [i for i in range(40) if i % 7 == k] for k in range(7)}
    assert got == {i: (max(of[i % 7]), len(of[i % 7])) for i in range(40)}


def brute(texts: dict, size: int, percent: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_groups_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts, base = {}, [[rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(30)]
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[i] = " ".join(t + passage * (i % 5 == 0))
    texts |= {90: None, 91: "", 92: " \n ", 93: "one", 94: "ONE", 95: "one two", 96: texts[3], 97: "x " * 5000}
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(docs, neardup.NearDupSpec(shingle_words=4, block=4)).collect()}
    assert got == brute(texts, 4)


def test_near_groups_of_nothing_and_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert [r["component_id"] for r in neardup.near_groups(docs).collect()] == [None, None]
    assert neardup.near_groups(docs.limit(0)).count() == 0


def test_rows_repeated_under_one_id_and_very_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words))] * 4 + [(2, " ".join(words[:-1]) + " other")] * 3 + [(3, "a b c d e f g")] * 2 + [(3, "p q r s t u v")] + [(4, "A b c d e f g")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 29_996, 1), (2, 29_996, 1), (3, 3, 3), (4, 3, 3)}


def test_links_away_from_the_hub_are_found(spark):
    rng, base = random.Random(3), [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(150):  # copies with a few or many own words, so that many aren't near their hubs but near each other
        t = list(base)
        for k in rng.sample(range(12), rng.choice([0, 1, 2, 3, 5])):
            t[k * 10] = f"own{rng.randrange(2)}-{k}"
        texts[i] = " ".join(t)
    spec = neardup.NearDupSpec(shingle_words=4, block=16, block_shingles=1500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spec).collect()}
    assert got == brute(texts, 4) and len({c for _, c in got.values()}) > 1


def test_chains_contract_to_their_smallest_node(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["component"] for r in neardup.contract(edges).collect()} == {0}


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    factors = neardup._factors(256)
    sketch = [neardup.odd_sketch(neardup.minhash(np.unique(np.concatenate([common, x])), factors), 1024) for x in (a, b)]
    odd = int(np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[1].view(np.uint64)).sum())
    estimate = 1 + 1024 / (4 * 256) * np.log(1 - 2 * odd / 1024)
    assert abs(estimate - 0.9) < 0.06


@pytest.mark.parametrize("least", [0.66, 0.8])
def test_most_odd_bits_inverts_the_estimate(least):
    odd = neardup.most_odd_bits(least, 256, 1024)
    assert 1 + np.log(1 - 2 * odd / 1024) >= least - 1e-3 > 1 + np.log(1 - 2 * (odd + 2) / 1024) - 5e-3


def test_an_id_with_different_texts_is_one_component(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(3, b), (5, b), (5, a), (9, a), (11, a + " more words"), (20, "alone in its own words here")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_groups(docs, neardup.NearDupSpec(shingle_words=4)).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (11, 3), (20, 20)}


@pytest.mark.parametrize("hashes,chains", [(0, 0), (10_000, 10), (10**8, 10**6), (10**12, 10**10)])
def test_directory_and_marks_follow_the_counts(hashes, chains):
    spec = exactdup.IndexSpec().sized(hashes, chains)
    assert spec.capacity << spec.max_depth >= 2 * hashes and spec.max_depth <= 20 and spec.mark_bits <= 28
    assert spec.mark_bits == 28 or chains * 8 <= 1 << spec.mark_bits
