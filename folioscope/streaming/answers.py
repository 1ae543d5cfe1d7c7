"""Answers remembered for a time, as a stateful stream over questions and the answers they were given."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions.text import trimmed
from folioscope.operators.cache import query_hash

OUT = "model string, query_id long, asked_at long, kind string, answer_text string, answered_at long"
STATE = "at long, answer_text string, until long"
NEVER = -(2**62)  # the moment of a question without one
LEAST_CHARS, MOST_CHARS = 8, 120_000  # of an answer: shorter ones aren't remembered, longer ones are cut


def _remember(ttl_us: int):
    def run(key: tuple, rows: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One question key of a model. Rows come in Arrow batches of any order, so what a question sees is the answer
        held when the batch began."""
        if state.hasTimedOut:
            state.remove()
            return
        now, ttl = state.getCurrentProcessingTimeMs(), max(1, ttl_us // 1000)
        at, text, until = state.get if state.exists else (None, None, None)
        held = newest = None if at is None or until <= now else (at, text)
        for pdf in rows:
            told = pdf[pdf["answer_text"].notna()]
            if len(told):
                best = max(zip(told["at"].tolist(), told["answer_text"]))
                newest = best if newest is None else max(newest, best)
            asked = pdf[pdf["answer_text"].isna()]
            if len(asked):
                known = [held is not None and at < held[0] + ttl_us for at in asked["at"].tolist()]
                yield pd.DataFrame({"model": key[0], "query_id": asked["query_id"].tolist(), "asked_at": asked["at"].tolist(), "kind": ["hit" if k else "miss" for k in known],
                                    "answer_text": [held[1] if k else None for k in known], "answered_at": pd.array([held[0] if k else None for k in known], "Int64")})
        if newest is None:
            state.remove()
        else:
            until = now + ttl if newest != held else until
            state.update((*newest, until))
            state.setTimeoutDuration(max(1, until - now))

    return run


def remembered(rows: DataFrame, ttl_seconds: float = 3600, parts: int = 8) -> DataFrame:
    """(model, query_id, asked_at, kind, answer_text, answered_at) of each question in a stream (model, query_id, text,
    answer_text, ts): rows without an answer ask, rows with one tell what was answered. kind is hit or miss.

    A question sees the newest answer that earlier batches brought to its key (text without case and white space) and its
    model, if it was asked less than ttl after that answer, early or late. Of answers of one moment the larger text counts.
    The state forgets an answer ttl after it was written, so a question that comes later than that is a miss whatever its
    time. Answers under eight characters, to blank questions or without a time aren't remembered; a null model is "", a
    question without a time is older than any. Repeated questions each get a row; other columns are left out.

    One key may hold most rows: questions of a key are dealt to `parts` groups by their id, and its answers go to each.
    A group is read in Arrow batches and its state is one answer. As state is forgotten by the clock, an availableNow
    trigger never finds its end: run it by processingTime, or batch by batch with once."""
    text, answer = F.coalesce("text", F.lit("")), trimmed(F.col("answer_text"))
    asks = F.col("answer_text").isNull()
    fit = asks | ((trimmed(text) != "") & (F.length(answer) >= LEAST_CHARS) & F.col("ts").isNotNull())
    own = F.array(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    keyed = rows.where(fit).select(
        F.coalesce("model", F.lit("")).alias("model"), query_hash(text).alias("query_hash"), F.explode(F.when(asks, own).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))).alias("part"),
        F.col("query_id").cast("long").alias("query_id"), F.substring(answer, 1, MOST_CHARS).alias("answer_text"), F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"))
    groups = keyed.groupBy("model", "query_hash", "part")
    return groups.applyInPandasWithState(_remember(int(ttl_seconds * 1_000_000)), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
