import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import hostrules, mixing, packing, sharding


def brute_targets(sizes, weights=(1, 2, 3), share=1.0, most=3.0):
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    for _ in range(200):  # pour what is left by weight into those with room, over and over
        room = [s for s in order if got[s] < most * sizes[s] - 1e-9]
        if not room or left < 1e-9:
            break
        per, left_now = left / sum(w[s] for s in room), left
        for s in room:
            add = min(per * w[s], most * sizes[s] - got[s])
            got[s] += add
            left_now -= add
        left = left_now
    return got


def test_targets_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        sizes = {s: rng.choice([0, 1, 10, 1000]) for s in rng.sample(["a", "b", "c", "é", "z", None], 4)}
        assert mixing.targets(list(sizes.items())) == pytest.approx(brute_targets(sizes), abs=1e-6)


def test_knapsack_against_all_subsets():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 4), reverse=True)
        counts, budget = [rng.randint(1, 3) for _ in lengths], rng.randint(1, 80)
        sums = {sum(k * s for k, s in zip(ks, lengths)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(taken.get(s, 0) <= c for s, c in zip(lengths, counts))
        assert sum(s * k for s, k in taken.items()) == max(x for x in sums if x <= budget)


def test_fit_hits_large_budgets():
    hist = {s: 50 for s in range(1, 400)}
    take = mixing.fit(hist, 1_234_567, last=5000)
    assert sum(s * k for s, k in take.items()) == 1_234_567 and all(take[s] <= 50 for s in hist)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), ["a", "b", None][i % 3]) for i in range(300)] + [(300, None, "b"), (301, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("own"))
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    for s in ("a", "b", None, "empty"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in own) and own[0]["source_size"] == sum(r["size"] for r in own)
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert repeated.groupBy("doc_id").count().collect().__len__() == sum(r["copies"] > 0 for r in got)
    assert repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shards_weigh_alike_and_slots_are_gapless(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("IF(id = 5, NULL, repeat('ab', CAST(id % 97 AS INT)))").alias("text"), F.lit(1).alias("shard"))
    got = sharding.shard(docs, 5, 512).collect()
    sizes, slots = [0] * 5, [[] for _ in range(5)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and max(sizes) - min(sizes) <= 200
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sharding.shard(docs.limit(0), 5, 512).count() == 0


def test_maps_are_versioned_and_edits_move_few_slots(spark, tmp_path):
    weights = {i: 100 + i % 7 for i in range(64)}
    one = sharding.SlotMap.initial(4, 64).rebalanced(weights)
    grown = one.rebalanced(weights, 5)
    assert all(a == b or b == 4 for a, b in zip(one.shards, grown.shards))
    shrunk = grown.rebalanced(weights, 3)
    assert set(shrunk.shards) == {0, 1, 2}
    for m in (one, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shards == one.shards
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).version == 2


def test_host_rules_edges(spark):
    good = " ".join(f"w{i}" for i in range(40))
    bad = "spam spam eggs"
    rows = [(i, good, "fine") for i in range(20)] + [(100 + i, bad, "rotten") for i in range(20)] + [(200, good, "rotten"), (201, good, None), (202, None, None), (203, "a b c d e f g h i j k l m n o p q r s t " * 2, "fine"), (204, "# x\n\n# x\ny", "fine")]
    got = {r["doc_id"]: r for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit(9))).collect()}
    assert got[1]["kept"] and not got[100]["kept"]
    assert not got[200]["kept"] and not got[200]["base_failed"]  # its host is rejected
    assert got[201]["kept"] and not got[202]["kept"] and got[202]["n_words"] == 0
    assert got[203]["n_repeat_words"] == 40 and got[203]["base_failed"]
    assert (got[204]["n_dup_lines"], got[204]["n_symbols"], got[204]["word_chars"]) == (1, 2, 5)


def test_one_failure_does_not_condemn_a_small_host(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 else "x", f"h{i % 50}") for i in range(1000)] + [(5000, "x", "tiny"), (5001, good, "tiny")]
    got = {r["doc_id"]: r for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5001]["kept"] and got[5001]["host_rate"] < 0.5


def test_the_prior_decides_which_hosts_are_out_of_the_common(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(h * 100 + i, good if i >= 5 + h % 3 else "x", f"h{h}") for h in range(40) for i in range(100)]
    rows += [(9000 + i, good if i >= 35 else "x", "odd") for i in range(100)] + [(9900, good, "odd"), (9901, good, None), (None, good, "h1"), (9902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("own"))
    got = hostrules.judge(docs).collect()
    assert {r["host"] for r in got if not r["base_failed"] and not r["kept"]} == {"odd"}  # at 35% against 6%
    assert {r["kept"] for r in got if r["host"] != "odd" and not r["base_failed"]} == {True}
    assert hostrules.judge(docs.limit(0)).count() == 0


def test_repeated_ids_share_the_copies_of_their_source_and_size(spark):
    rows = [(1, "z z z", "s1"), (1, "z z z", "s1"), (1, "a a a", "s2"), (1, "a a a", "s2"), (1, "b b b", "s2"), (2, "c d", None), (None, "e f g h", "s1"), (3, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("own"))
    want = {(r["source"], r["size"]): r["n"] for r in mixing.mix(docs).groupBy("source", "size").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {(r["source"], r["size"]): r["n"] for r in out.groupBy("source", mixing.word_count(F.col("text")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and want[("s1", 3)] >= 1


def test_packing_against_whole_texts(spark):
    texts = [(1, None), (2, "it's Ünder-x 12ab ... Wörld.,; <|endoftext|> 你好"), (3, "alpha, beta " * 5000), (4, ""), (5, "x\x1cy z"), (6, "ΣΑΣ. İstanbul é"), (7, "a <|endoftext|>b <|ENDOFTEXT|> x<|startoftext|>"), (None, "no id")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit("own")), capacity=512).toPandas()
    from tokenizers import Tokenizer
    import zlib, numpy as np  # noqa: E401

    t = Tokenizer.from_file(packing.word_bpe_path())
    for d, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id.isna() if d is None else got.doc_id == d].sort_values("piece")
        assert own["length"].sum() == len(ids) and own["start"].tolist() == list(range(0, len(ids), 512))
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.asarray(ids[i : i + 512], dtype="<u4").tobytes()) for i in range(0, len(ids), 512)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 512 and s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_encode_as_whole_texts():
    import numpy as np
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(1, 0x250), 0x300, 0x307, 0x3A3, 0x3C2, 0x4E2D, 0x2028, 0x3000, 0x1F600, 0xAC00]] + list("'sdtmvrel  ,.") * 20
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1500)]
    t, mine = Tokenizer.from_file(packing.word_bpe_path()), packing.WordEncoder(packing.word_bpe_path())
    for text, got in zip(texts, mine.encode_texts(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_sum_of_squares_places_every_piece_where_the_counts_stay_smallest():
    import numpy as np

    rng, capacity = np.random.default_rng(4), 50
    lengths = np.sort(rng.integers(1, 50, 200))[::-1]
    at, n = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def cost(g):
        counts = [0] * (capacity + 1)
        for v in g.values():
            counts[v] += v > 0
        return sum(c * c for c in counts)

    for s, b in zip(lengths.tolist(), at.tolist()):
        fits = [x for x, g in gaps.items() if g >= s]
        if fits:
            assert b in gaps
            assert cost(gaps | {b: gaps[b] - s}) == min(cost(gaps | {x: gaps[x] - s}) for x in fits)
        gaps[b] = gaps.get(b, capacity) - s
    best_fit: list[int] = []
    for s in lengths.tolist():
        i = min((i for i, g in enumerate(best_fit) if g >= s), key=lambda i: best_fit[i], default=len(best_fit))
        best_fit[i:] = [best_fit[i] - s, *best_fit[i + 1 :]] if i < len(best_fit) else [capacity - s]
    assert n == len(set(at.tolist())) <= len(best_fit) and min(gaps.values()) >= 0
