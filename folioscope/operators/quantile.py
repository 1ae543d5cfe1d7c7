"""Exact percentiles by group, without a group's values in one place.

The range that holds the wanted ranks is cut into bins, counted, and narrowed to the bin of the ranks, until the two
ranks that a percentile lies between fall into different bins or into a bin of one value. A round sends a row for each
group and bin; what a group holds doesn't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut


def percentile(rows: DataFrame, by: str, value: str, share: float, bins: int = 1024) -> DataFrame:
    """(by, percentile, n): between the values at ranks share * (n - 1), rounded down, and the next, in proportion.

    Nulls, NaN and infinite values are left out; a group without others has no row; a null group is a group. A round
    narrows a range a thousandfold, so values of a few decimal powers take two or three."""
    v = F.col(value).cast("double")
    values = cut(rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.struct(F.col(by).alias("key")).alias("g"), v.alias("v")))
    place = F.lit(float(share)) * (F.col("n") - 1)
    state = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = cut(state.select("g", "n", F.floor(place).alias("k"), F.least(F.floor(place) + 1, F.col("n") - 1).alias("k2"), (place - F.floor(place)).alias("part"), "low", "high", F.lit(0).cast("long").alias("before")))
    done = None
    names = ("n", "k", "k2", "part", "before")
    while not state.isEmpty():
        width = F.col("high") / 2 - F.col("low") / 2  # halves, as the difference may be beyond a double
        at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / width * bins))).otherwise(0)
        within = values.join(state, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).withColumn("bin", at)
        counted = within.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), *[F.first(c).alias(c) for c in names])
        upto = F.col("before") + F.sum("c").over(W.partitionBy("g").orderBy("bin"))  # at most `bins` rows
        ranked = counted.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
        of = lambda k, x: F.max(F.when((F.col("from") <= F.col(k)) & (F.col(k) < F.col("upto")), F.col(x)))
        found = ranked.groupBy("g").agg(*[F.first(c).alias(c) for c in ("n", "k", "k2", "part")], of("k", "from").alias("before"), of("k", "bin").alias("b"), of("k2", "bin").alias("b2"),
                                        of("k", "least").alias("low"), of("k", "most").alias("high"), of("k2", "least").alias("next"))
        found = cut(found)
        apart, single = F.col("b") != F.col("b2"), F.col("low") == F.col("high")
        first, second = F.col("high"), F.when(apart, F.col("next")).otherwise(F.col("high"))
        ended = found.where(apart | single).select("g", "n", (first + (second - first) * F.col("part")).alias("percentile"))
        done = ended if done is None else done.unionByName(ended)
        state = found.where(~apart & ~single).select("g", "n", "k", "k2", "part", "low", "high", "before")
    if done is None:
        done = state.select("g", "n", F.col("part").alias("percentile"))
    return done.select(F.col("g.key").alias(by), "percentile", "n")
