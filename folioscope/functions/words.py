"""Words of Han text: a lexicon learned from the corpus, and the best path through a run's words.

Han script has no blanks between words. A run of characters is a word where it is frequent, its parts stand together more
often than by chance, and many different characters stand on either side of it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.analysis import folded
from folioscope.session import cut

LONGEST = 4  # characters of a learned word at most
PIECE = 1000  # places of a run that one row holds
SCALE = 1 << 16  # costs are whole numbers of 1/65536 nat, so sums are exact
RUNS = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def grams(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, before, after, n): every run of up to `longest` Han characters of all texts with its neighbours, an empty
    one where the Han text ends. Long runs are read in pieces that overlap, so no row holds more than a piece."""
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{IsHan}+"), F.lit(0))).alias("run")).withColumn("size", F.length("run"))
    pieces = runs.select("run", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PIECE).cast("int"))).alias("piece"))
    begin = F.col("piece") * PIECE  # places before the piece's own
    held = pieces.select(F.least(F.lit(PIECE), F.col("size") - begin).alias("own"), (F.col("piece") > 0).cast("int").alias("lead"),
                         F.split(F.substring(F.col("run"), F.greatest(begin, F.lit(1)), F.lit(PIECE + longest + 1)), "").alias("chars"))
    at = held.select("lead", "chars", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i")).withColumn("i", F.col("i") + F.col("lead"))
    each = at.select("chars", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("chars") - F.col("i") + 1))).alias("len"))
    char = lambda place: F.coalesce(F.try_element_at("chars", F.when(place > 0, place)), F.lit(""))
    word = F.array_join(F.slice("chars", F.col("i"), F.col("len")), "")
    return each.select(word.alias("word"), char(F.col("i") - 1).alias("before"), char(F.col("i") + F.col("len")).alias("after")).groupBy("word", "before", "after").agg(F.count(F.lit(1)).alias("n"))


def _freedom(counted: DataFrame, side: str) -> DataFrame:
    """(word, side): the entropy of what stands there; every end of a run counts as a neighbour of its own."""
    by = counted.groupBy("word", side).agg(F.sum("n").alias("c"))
    spent = F.sum(F.when(F.col(side) != "", F.col("c") * F.log("c")).otherwise(0.0))
    return by.groupBy("word").agg((F.log(F.sum("c")) - spent / F.sum("c")).alias(side))


def learn(texts: DataFrame, least: int = 5, cohesion: float = 1.5, freedom: float = 0.7, longest: int = LONGEST) -> DataFrame:
    """(word, n, cost): the lexicon of (text). Of two characters or more those that stand `least` times, whose weakest
    division is e^cohesion times as frequent as chance has it, with entropy `freedom` on either side; and every character.

    Counts are of all texts. Texts without Han, null or empty ones and empty tables teach nothing; a repeated text counts
    as often as it stands. cost is -log(n / characters) in steps of 1/65536."""
    counted = cut(grams(texts, longest))
    counts = cut(counted.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("length(word) = 1").agg(F.sum("n").alias("total"))  # one row
    frequent = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cuts = frequent.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    parts = cuts.select("word", "n", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("head"), F.substring(F.col("word"), F.col("at") + 1, F.length("word")).alias("tail"))
    parts = parts.join(counts.select(F.col("word").alias("head"), F.col("n").alias("n_head")), "head").join(counts.select(F.col("word").alias("tail"), F.col("n").alias("n_tail")), "tail")
    bound = parts.crossJoin(F.broadcast(total)).groupBy("word").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("n_head") * F.col("n_tail")))).alias("cohesion"))
    near = counted.join(frequent.select("word"), "word", "left_semi")
    kept = frequent.join(bound.where(F.col("cohesion") >= cohesion), "word").join(_freedom(near, "before").where(F.col("before") >= freedom), "word").join(_freedom(near, "after").where(F.col("after") >= freedom), "word")
    rows = kept.select("word", "n").unionByName(counts.where("length(word) = 1").select("word", "n"))
    return rows.crossJoin(F.broadcast(total)).select("word", "n", F.round(-F.log(F.col("n") / F.col("total")) * SCALE).cast("long").alias("cost"))


def best_path(run: str, cost: dict[str, int], unknown: int, longest: int) -> list[str]:
    """The words of a run at least cost, the longer first word of equals. Characters that aren't known cost `unknown`."""
    n = len(run)
    total, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        total[i] = cost.get(run[i], unknown) + total[i + 1]
        for size in range(2, min(longest, n - i) + 1):
            c = cost.get(run[i : i + size])
            if c is not None and c + total[i + size] <= total[i]:
                total[i], step[i] = c + total[i + size], size
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def splitter(lexicon: DataFrame, most: int = 200_000) -> Callable[[Column], Column]:
    """A function that gives a text's tokens: letters and digits in a row as analysis.tokens has them, Han runs as words.

    Broadcast are the `most` words of least cost, a documented bound; rarer ones are read as their parts. Texts without
    Han don't leave the JVM."""
    rows = lexicon.orderBy("cost", "word").limit(most).collect()
    cost = {r["word"]: r["cost"] for r in rows}
    unknown, longest = max(cost.values(), default=0) + SCALE, max(map(len, cost), default=1)
    shared = lexicon.sparkSession.sparkContext.broadcast(cost)

    @F.pandas_udf("array<string>")
    def words(runs: pd.Series) -> pd.Series:
        table = shared.value
        return runs.map(lambda parts: None if parts is None else [w for p in parts for w in (best_path(p, table, unknown, longest) if _is_han(p) else [p])])

    def tokens(text: Column) -> Column:
        runs = F.regexp_extract_all(folded(text), F.lit(RUNS), F.lit(0))
        return F.coalesce(words(F.when(text.rlike(r"\p{IsHan}"), runs)), runs, F.array().cast("array<string>"))

    return tokens


def _is_han(run: str) -> bool:
    """RUNS never mixes scripts, and the JVM's letters that aren't Han are none of these."""
    c = ord(run[0])
    return 0x2E80 <= c <= 0x2FDF or c in (0x3005, 0x3007) or 0x3021 <= c <= 0x3029 or 0x3038 <= c <= 0x303B or 0x3400 <= c <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x3FFFF
