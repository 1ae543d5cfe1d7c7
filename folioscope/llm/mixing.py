"""Mixing sources to target weights by exact token lengths.

Documents are counted by (source, length). A source's target is met with whole epochs of all its documents and,
for what remains, a subset: the same share of every length count first, then bounded-knapsack dynamic programming
over the length counts left for the last words. Only then are documents chosen, by a seeded order among those of
equal length, so the choice depends on seed and ids and not on partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD
from folioscope.session import cut, ship_package


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_epochs: float = 3.0) -> dict[str | None, float]:
    """Words wanted from each source: share of all words by weight, at most max_epochs times the source.

    Sources in code point order, null last, take the weights in turn. What a capped source can't take goes to
    the others by weight, again and again until no target is above its cap. Empty sources get 0."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: max_epochs * n for s, n in order}
    left, free, out = share * sum(n for _, n in order), [s for s, n in order if n > 0], {s: 0.0 for s, _ in order}
    while free:
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if per * weight[s] >= cap[s]]
        if not full:
            return out | {s: per * weight[s] for s in free}
        for s in full:
            out[s] = float(cap[s])
            left -= cap[s]
            free.remove(s)
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum comes nearest to budget without passing it.

    Bounded-knapsack dynamic programming over reachable sums, kept as bits of an integer: each length's count is
    split into powers of two, and the sets after each piece allow the way back. O(budget / 64) words a piece."""
    pieces, reach, sets = [], 1, [1]
    mask = (1 << (budget + 1)) - 1
    for s, c in zip(lengths, counts):
        c, k = min(c, budget // s if s else 0), 1
        while c > 0:
            k = min(k, c)
            pieces.append((s, k))
            reach |= (reach << (s * k)) & mask
            sets.append(reach)
            c, k = c - k, 2 * k
        if reach.bit_length() == budget + 1:  # budget itself is reachable
            break
    at, taken = reach.bit_length() - 1, {}
    for i in range(len(pieces) - 1, -1, -1):
        s, k = pieces[i]
        if not sets[i] >> at & 1:
            taken[s] = taken.get(s, 0) + k
            at -= s * k
    return taken


def fit(hist: dict[int, int], budget: int, last: int = 1 << 15) -> dict[int, int]:
    """Documents to take of each length (hist: documents there are) for a sum near budget, never above it.

    Every length gives the same share of its documents, rounded down; lengths with the largest remainders give
    one more until fewer than about `last` words are wanted, and the knapsack fits those."""
    total = sum(s * c for s, c in hist.items())
    if budget >= total:
        return dict(hist)
    take = {s: c * budget // total for s, c in hist.items()}
    rest = budget - sum(s * c for s, c in take.items())
    for s in sorted(hist, key=lambda s: (-(hist[s] * budget % total), s)):
        if 0 < s <= rest - last // 2 and take[s] < hist[s]:
            take[s] += 1
            rest -= s
    for s in sorted(hist, reverse=True):  # what very long documents have left
        more = min(hist[s] - take[s], max(0, rest - last // 2) // s if s else 0)
        take[s] += more
        rest -= more * s
    free = sorted((s for s in hist if 0 < s <= rest and hist[s] > take[s]), reverse=True)
    for s, k in knapsack(free, [hist[s] - take[s] for s in free], rest).items():
        take[s] += k
    return take


def _plan(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Per source (one row, its length counts in arrays): epochs for all, and how many documents of each length get one more."""
    for pdf in it:
        out = []
        for r in pdf.itertuples():
            hist = {int(s): int(c) for s, c in zip(r.sizes, r.counts)}
            epochs = int(r.target // r.source_size) if r.source_size else 0
            want = round(r.target - epochs * r.source_size)
            extra = fit(hist, want) if want > 0 else {}
            out += [(r.source_key, s, epochs, extra.get(s, 0)) for s in hist]
        yield pd.DataFrame(out, columns=["source_key", "size", "epochs", "extra"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_epochs: float = 3.0, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cells: int = 128) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and rank; one row per row of docs.

    copies is how often the mix takes the document, taken = copies * size. A null text has size 0; such and
    empty texts are never taken. Null sources are one source. Rows repeated under one id are separate rows.
    A length's documents are ranked by seeded hash in `cells` cells: counts of the cells before give the first
    rank of a cell, so no task holds a whole length or source."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
               .withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("cell", F.shiftrightunsigned("order", 57) % cells)
               .withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("?"))))
    by_cell = cut(rows.groupBy("source_key", "size", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    by_source = by_cell.groupBy("source_key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    found = by_source.collect()  # one row per source
    goal = targets([(r["source"], r["source_size"]) for r in found], weights, share, max_epochs)
    goals = spark.createDataFrame([(r["source_key"], r["source_size"], goal[r["source"]]) for r in found], "source_key string, source_size long, target double")
    by_size = by_cell.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    # a source's length counts: as many entries as it has distinct lengths
    hists = by_size.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("h")).join(goals, "source_key")
    hists = hists.select("source_key", "source_size", "target", F.col("h.size").alias("sizes"), F.col("h.n").alias("counts"))
    plan = hists.mapInPandas(_plan, "source_key string, size long, epochs int, extra long")
    before = "coalesce(sum(n) OVER (PARTITION BY source_key, size ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    firsts = cut(by_cell.withColumn("first", F.expr(before)).join(plan, ["source_key", "size"]).join(goals, "source_key")
                 .select("source_key", "size", "cell", "first", "epochs", "extra", "source_size", "target"))
    ranked = rows.withColumn("in_cell", F.expr("row_number() OVER (PARTITION BY source_key, size, cell ORDER BY order, doc_id) - 1"))
    out = ranked.join(firsts, ["source_key", "size", "cell"]).withColumn("rank", F.col("first") + F.col("in_cell"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (F.col("rank") < F.col("extra")).cast("int")).otherwise(F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rank")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with the columns of docs, each as often as the mix takes it.

    Rows that share id, source and size divide the copies of all of them, the first by their columns taking one more.
    Documents without words, null texts among them, have nothing to mix and are left out."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = cut(plan.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0"))
    named = docs.select(F.struct(*docs.columns).alias("__all")).withColumns({
        "__id": F.col(f"__all.{id_col}"), "__source": F.col(f"__all.{source_col}"), "__size": word_count(F.col(f"__all.{text_col}"))})
    same = [named[c].eqNullSafe(plan[c]) for c in ("__id", "__source", "__size")]
    found = named.join(plan, same[0] & same[1] & same[2]).select("__all", *[plan[c] for c in ("__id", "__source", "__size", "__copies", "__rows")])
    alone = found.where("__rows = 1").select("__all", "__copies")
    rest = ", ".join(f"__all.`{c}`" for c, t in docs.dtypes if not t.startswith(("map", "variant")))  # what can't be ordered
    order = f"row_number() OVER (PARTITION BY __id, __source, __size ORDER BY {rest})"
    shared = found.where("__rows > 1").withColumn("__n", F.expr(order)).select("__all", F.expr("__copies div __rows + IF(__n <= __copies % __rows, 1, 0)").alias("__copies"))
    each = alone.unionByName(shared).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return each.select("__all.*")
