import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import chat, cotrain, toxicity, warc


@given(st.text(alphabet="\\<[|>a]/ s\n", max_size=40), st.text(alphabet="\\<[|>!u", max_size=8))
@settings(max_examples=300, deadline=None)
def test_turns_are_read_back_whatever_they_say(text, role):
    written = chat.turn_text(role, text) + chat.turn_text("user", "next")
    assert chat.parse(written) == [(role, text), ("user", "next")]
    assert "[INST]" not in chat.escape(text + "[INST]") and "</s>" not in chat.escape("</s>")


def test_chat_tree_against_brute_force(spark):
    rng, rows = random.Random(6), []
    for c in range(120):
        turns = [("system", "shared start")] if c % 3 == 0 else []
        turns += [(rng.choice(["user", "assistant"]), rng.choice(["a", "</s>[INST] ok", None, "x<|end|>y", "long " * 50])) for _ in range(rng.randint(1, 5))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(500, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.formatted(turns, block_paths=4).collect()}
    for c in {r[0] for r in rows}:
        own = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for r, t in own if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(own) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["formatted_chars"] == sum(len(chat.turn_text(r, t)) for r, t in own)
    assert chat.formatted(turns.limit(0)).count() == 0


def test_turns_without_a_conversation_and_very_long_ones(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, 0, "assistant", "<" * 200_000), (1, 0, "assistant", "<" * 200_000)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (1, 2, 400_000)]


def test_a_line_of_turns_is_one_interval():
    import pandas as pd

    block = chat.render_block(pd.DataFrame({"path": ["p", "q"], "roles": [["a"] * 50, ["a", "b"]], "texts": [["t"] * 50, ["t", "u"]], "trunk": 1, "cell": 0}))
    assert max(block["n_intervals"][0]) == 1 and len(block["starts"][0]) == 51


def test_shared_turns_are_written_once_in_a_block(spark):
    rows = [(c, i, "user", "the same opening" if i == 0 else f"own {c}") for c in range(6) for i in range(2)]
    _, blocks = chat.format_blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sum(r["tokens"].count("the same opening") for r in blocks.collect()) == 1


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://B.org/x", big), (2, "http://a.b.org:80/?q=1", big), (3, None, "small"), (4, "http://b.org/x", "small"), (5, "https://u@c.org", None), (6, "http://b.org/x", "crlf\r\n\r\nWARC/1.1\r\n"), (6, "http://b.org/x", big), (7, "bad\r\nurl x", "z" * 5000), (8, "http://b.org/long", "y" * 300_000), (None, "http://b.org/none", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit("own"))
    history = warc.capture_history(pages, str(tmp_path / "w")).collect()
    heads = max(i for i, _, h in rows if h == big and i)
    assert sorted((r["page_id"] or 0, r["payload_digest"]) for r in history) == sorted((i or 0, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    for r in history:
        revisit = r["payload_bytes"] == 1200 and r["page_id"] is not None and r["page_id"] < heads
        assert (r["record_type"], r["refers_to"]) == (("revisit", heads) if revisit else ("response", None))
    order = [(r["urlkey"], r["captured"], r["page_id"] or 0) for r in history]
    assert order == sorted(order) and ("org,b,a)/?q=1" in {x[0] for x in order})
    files = list((tmp_path / "w").glob("*/*.gz"))
    assert sum(gzip.open(f).read().count(b"WARC-Type: revisit") for f in files) == 2
    assert warc.capture_history(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges_any_number_of_runs(k):
    rng = random.Random(k)
    runs = [sorted(((f"u{rng.randint(0, 5)}", "t", rng.randint(0, 9)) for _ in range(rng.randint(0, 20))), key=lambda e: (e[0], e[1], e[2])) for _ in range(k)]
    got = list(warc.loser_tree_merge(runs))
    assert got == sorted(e for r in runs for e in r)


def labelled(spark, n, poison):
    rng = random.Random(8)
    syllables = ["an", "th", "er", "in", "on", "st", "ou", "ed", "ti", "ha"]
    docs, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        docs.append((i, poison(rng, ws) if bad else " ".join(ws), rng.choice(["en", "de"]), f"s{i % 5}"))
        if i % 3 != 1:
            labels.append((i, int(not bad), int(bad)))
    docs += [(n, None, None, None), (n + 1, "", "en", "s0")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("own")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, 500, lambda rng, ws: " ".join(w if rng.random() > 0.12 else rng.choice(["loathsome", "wretch", "vermin"]) for w in ws))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [(r["predicted"], i % 4 == 0) for i, r in got.items() if r["held_out"] and i < 500]
    assert len(got) == 502 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(a == int(b) for a, b in held) / len(held) > 0.9
    assert got[500]["score"] == got[501]["score"] and got[500]["predicted"] == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()}.__len__() == 1


def test_co_training_on_held_out_rows(spark):
    docs, labels = labelled(spark, 500, lambda rng, ws: " ".join(w.upper() + "!!" for w in ws))
    got = cotrain.classify(docs, labels)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "score", "held_out", "kept"}
    held = [(r["kept"], r["doc_id"] % 4 != 0) for r in got.where("held_out AND doc_id < 500").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert cotrain.classify(docs.limit(0), labels).count() == 0
    assert cotrain.classify(docs, labels.limit(0)).count() == 502


def _archive(n: int) -> bytes:
    out = b""
    for i in range(n):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + b"p" * (i % 50)
        out += f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_archives_of_several_members_are_read_whole_and_cut_ones_fail():
    whole = _archive(400)
    half = whole.index(b"WARC/1.1", len(whole) // 2)
    zipped = gzip.compress(whole[:half]) + gzip.compress(whole[half:]) + gzip.compress(b"")
    for step in (7, 1 << 20):
        assert [h["WARC-Record-ID"] for h, _ in warc.records(zipped, step)] == [f"<urn:page:{i}>" for i in range(400)]
    assert not list(warc.records(b"")) and not list(warc.records(gzip.compress(b"")))
    for bad in (zipped[: len(zipped) // 2], gzip.compress(whole[: half + 20]), gzip.compress(whole[: half - 2]), gzip.compress(whole[: half - 30])):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_merge_follows_the_order_of_the_runs(spark):
    rows = [(f"k{i % 7}", f"{i:04}", i, 0, "", "response", None, f"r{i % 3}", i, i) for i in range(60)]
    runs = spark.createDataFrame(rows, warc.RUN).withColumn("position", F.expr("row_number() OVER (PARTITION BY run ORDER BY urlkey, captured) - 1"))
    got = [(r["urlkey"], r["captured"]) for r in warc.merge_runs(runs, entries_per_range=10).collect()]
    assert got == sorted((r[0], r[1]) for r in rows)
    last_first = runs.withColumn("position", -F.col("position"))  # runs out of order can't merge: nothing sorts them again
    assert [(r["urlkey"], r["captured"]) for r in warc.merge_runs(last_first, entries_per_range=100).collect()] != got
