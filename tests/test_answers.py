"""The stream of remembered answers against a plain cache, over restarts on one checkpoint."""

import random
import time
from datetime import datetime, timedelta, timezone

from folioscope.streaming import answers

ROWS = "model string, query_id long, text string, answer_text string, ts timestamp, extra int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
TTL = 3600


def run(spark, tmp_path, batches, ttl=TTL, wait=0.0, **options):
    """What each batch's start gives, as sorted rows."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/b=*")
        got = []
        q = (answers.remembered(stream, ttl, **options).writeStream.option("checkpointLocation", f"{tmp_path}/at")
             .foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.select("model", "query_id", "kind", "answer_text").collect())).trigger(once=True).start())
        assert q.awaitTermination(60) and q.exception() is None
        out.append(sorted(got, key=repr))
        time.sleep(wait)
    return out


def plain(batches):
    held, out = {}, []
    for rows in batches:
        said, told = [], {}
        for model, qid, text, answer, ts, _ in rows:
            key = model or "", " ".join((text or "").lower().split())
            if answer is None:
                at, known = held.get(key, (None, None))
                hit = at is not None and (ts is None or ts < at + timedelta(seconds=TTL))
                said.append((key[0], qid, "hit" if hit else "miss", known if hit else None))
            elif key[1] and len(answer.strip()) >= 8 and ts is not None:
                told[key] = max(told.get(key, (ts, "")), (ts, answer.strip()))
        for key, new in told.items():
            held[key] = max(held.get(key, new), new)
        out.append(sorted(said, key=repr))
    return out


def test_hits_expiry_late_and_repeated_questions(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [("m", 1, "What is  it?", None, at(0), 1), ("m", 1, "what is it?", "It is a test.", at(1), 1), ("m", 2, "", "an answer to nothing", at(1), 1), ("m", 3, "short", "brief", at(1), 1)],
        [("m", 4, " WHAT is it? ", None, at(30), 1), ("m", 4, "what is it?", None, at(30), 1), ("m", 5, "what is it?", None, at(61), 1), ("m", 6, "what is it?", None, at(-500), 1),
         ("n", 7, "what is it?", None, at(30), 1), ("m", 8, None, None, at(2), 1), ("m", 9, "short", None, at(2), 1), (None, 10, "what is it?", None, None, 1), ("m", 11, "what is it?", None, None, 1)],
        [("m", 12, "what is it?", "It is an older one.", at(-5), 1), ("m", 13, "what is it?", "It is a newer one.", at(50), 1)],
        [("m", 14, "what is it?", None, at(100), 1), ("m", 15, "what is it?", None, at(110), 1)],
    ]
    got = run(spark, tmp_path, batches)
    assert got == plain(batches)
    assert got[3] == [("m", 14, "hit", "It is a newer one."), ("m", 15, "miss", None)]


def test_a_hot_question_is_dealt_to_groups(spark, tmp_path):
    rng = random.Random(6)
    batches = [[("m", 1000 * b + i, "hot" if rng.random() < 0.5 else f"q{rng.randint(0, 20)}", None if rng.random() < 0.8 else f"answer number {rng.randint(0, 9)}", START + timedelta(minutes=40 * b + rng.randint(0, 30)), 0)
                for i in range(300)] for b in range(3)]
    assert run(spark, tmp_path, batches, parts=3) == plain(batches)


def test_the_state_forgets_by_the_clock(spark, tmp_path):
    batches = [[("m", 1, "q", "a good answer", START, 0)], [("m", 2, "q", None, START, 0)]]
    assert run(spark, tmp_path, batches, ttl=0.5, wait=0.6) == [[], [("m", 2, "miss", None)]]
