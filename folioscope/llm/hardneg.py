"""Hard negatives by a two-dimensional block matrix product: rows in blocks, dimensions in chunks, tiles of int64 scores.

A block of anchors and a block of rows meet chunk by chunk; the partial tiles of a pair of blocks are shuffled to one
task, added, and reduced at once to the best few rows of each anchor, so no score outlives its tile. This is done
twice: for positives blocks meet within groups of labels only; for negatives all anchors that have positives meet all
blocks, and a tile is reduced within the score window of each anchor and positive. A task holds one chunk of a block
of rows and `reach` chunks of anchors; blocks are bounded by counts, however common a label is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.session import ship_package


@dataclass(frozen=True)
class HardNegativeSpec:
    """positives, negatives: how many at most; low, high: per cent of the positive's score; scale: steps of a component;
    rows, anchors: of a block, about; dims, chunks: a chunk has dims dimensions, more if there would be more chunks;
    reach: blocks of anchors in a task; groups: of labels at most, a power of two."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    rows: int = 2048
    anchors: int = 256
    dims: int = 32
    chunks: int = 8
    reach: int = 8
    groups: int = 4096


BLOCK = "block long, chunk int, ids array<long>, labels array<long>, width int, kind string, matrix binary, anchors array<int>, scores array<long>, windows array<long>"
PARTIAL = "i long, j long, chunk int, ids array<long>, labels array<long>, q_ids array<long>, q_labels array<long>, anchors array<int>, scores array<long>, windows array<long>, tile binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def quantised(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, x, anchor): components as whole numbers floor(scale * component). Rows that take no part are left out."""
    x = F.col(vector_col)
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    some = rows.where(x.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~broken)
    some = some.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("x"), anchor.alias("anchor")).alias("r"))
    return some.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    """BLOCK rows of (id, label, x, block) and, for anchors, positives: one for each chunk of a block's dimensions."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        n = -(-max(1, max(map(len, pdf["x"]))) // dims)
        m = np.zeros((len(pdf), n * dims), dtype=np.int64)  # shorter vectors end in zeros
        for i, v in enumerate(pdf["x"]):
            m[i, :len(v)] = v
        kind = np.promote_types(np.min_scalar_type(m.min(initial=0)), np.min_scalar_type(-1 - abs(int(m.max(initial=0))))).str
        wins = [(i, w["score"], w["id"]) for i, ws in enumerate(pdf["windows"]) for w in ws] if "windows" in pdf else []
        head = [pdf["id"].tolist(), pdf["label"].tolist(), dims, kind]
        tail = [[w[k] for w in wins] for k in range(3)]
        rest = [None, None, dims, kind], [None] * 3  # what is said of rows goes with the first chunk
        parts = [np.ascontiguousarray(m[:, c * dims:(c + 1) * dims].astype(kind)).tobytes() for c in range(n)]
        return pd.DataFrame([[pdf["block"].iloc[0], c, *(rest[0] if c else head), x, *(rest[1] if c else tail)] for c, x in enumerate(parts)], columns=_names(BLOCK))

    return rows.groupBy("block").applyInPandas(pack, BLOCK)


def _multiplied(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Partial tiles of one chunk of a block of rows with a few blocks of anchors. Products of doubles are exact below 2^53;
    beyond that whole numbers are multiplied."""
    of = lambda r: np.frombuffer(r.matrix, dtype=r.kind).reshape(-1, r.width)
    out = []
    for r in b.itertuples():  # one
        rows = of(r)
        most = int(np.abs(rows.astype(np.int64)).max(initial=0)) * r.width
        for q in a.itertuples():
            ours = of(q)
            bound = most * int(np.abs(ours.astype(np.int64)).max(initial=0))
            if bound >= 2**62:
                raise ValueError("scores may exceed 64 bits: use a smaller scale")
            tile = (ours.astype(float) @ rows.T.astype(float)).astype(np.int64) if bound < 2**53 else ours.astype(np.int64) @ rows.T.astype(np.int64)
            out.append([q.block, r.block, r.chunk, r.ids, r.labels, q.ids, q.labels, q.anchors, q.scores, q.windows, tile.tobytes()])
    return pd.DataFrame(out, columns=_names(PARTIAL))


def _first(score: np.ndarray, ids: np.ndarray, some: np.ndarray, most: int) -> np.ndarray:
    """Of the places in some, the `most` with the highest scores, ties by smaller id."""
    if len(some) > most:
        s = score[some]
        some = some[s >= np.partition(s, len(s) - most)[len(s) - most]]  # with all ties of the last
    return some[np.lexsort((ids[some], -score[some]))][:most]


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, object]:
    """The tile of a pair of blocks, its chunks added; and the row that says whose scores they are."""
    head = pdf[pdf["chunk"] == 0].iloc[0]
    tile = np.zeros((len(head["q_ids"]), len(head["ids"])), dtype=np.int64)
    for x in pdf["tile"]:
        tile += np.frombuffer(x, dtype=np.int64).reshape(tile.shape)
    return tile, head


def _positives(most: int) -> Callable:
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, head = _summed(pdf)
        out, labels, ids = [], np.asarray(head["labels"]), np.asarray(head["ids"])
        for score, anchor, label in zip(tile, head["q_ids"], head["q_labels"]):
            out += [(anchor, ids[k], score[k]) for k in _first(score, ids, np.flatnonzero((labels == label) & (ids != anchor)), most)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    return best


def _negatives(spec: HardNegativeSpec) -> Callable:
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, head = _summed(pdf)
        out, labels, ids = [], np.asarray(head["labels"]), np.asarray(head["ids"])
        for a, positive_score, positive in zip(head["anchors"], head["scores"], head["windows"]):
            p, score = int(positive_score), tile[a]
            low, high = -(-spec.low * p // 100), spec.high * p // 100
            fit = np.flatnonzero((score >= low) & (score <= high) & (labels != head["q_labels"][a]))
            out += [(head["q_ids"][a], positive, p, ids[k], score[k]) for k in _first(score, ids, fit, spec.negatives)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return best


def _met(anchors: DataFrame, blocks: DataFrame, spec: HardNegativeSpec, reduce: Callable, schema: str) -> DataFrame:
    """reduce over the summed tile of every anchor block with the blocks low to high that its rows name."""
    sent = anchors.withColumn("j", F.explode(F.sequence("low", "high"))).drop("low", "high").withColumn("team", F.floor(F.col("block") / spec.reach))
    teams = sent.where("chunk = 0").select(F.col("team").alias("to_team"), F.col("j").alias("to")).distinct()
    here = blocks.join(teams, F.col("block") == F.col("to"))
    parts = sent.groupBy("team", "j", "chunk").cogroup(here.groupBy("to_team", "to", "chunk")).applyInPandas(_multiplied, PARTIAL)
    return parts.groupBy("i", "j").applyInPandas(reduce, schema)


def hard_negatives(rows: DataFrame, anchor: Column, spec: HardNegativeSpec = HardNegativeSpec(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` marks.

    A score is the inner product of components floored after scaling; the higher comes first, of equals the smaller id. An
    anchor's positives are its first other rows of its label; for each, the first rows of other labels whose score is
    within low and high per cent of the positive's. Rows with a null id or label, a null vector or a null or
    non-finite component take no part; of rows with one id the one with the smallest label, then vector, stands.
    A shorter vector is as if it ended in zeros. A null mark is no mark. Empty tables and anchors without a positive
    or a fitting negative give no rows; other columns are ignored."""
    spark = rows.sparkSession
    ship_package(spark)
    slim = quantised(rows, F.coalesce(anchor, F.lit(False)), id_col, label_col, vector_col, spec.scale)
    slim = written(slim.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(spec.groups)).cast("int")), "hard-negative-rows")
    counts = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("q"), F.max(F.size("x")).alias("w")).collect()  # at most `groups` rows
    total, width = sum(r["n"] for r in counts), max([1, *(r["w"] for r in counts)])
    n_anchors, dims = sum(r["q"] for r in counts), -(-max(spec.dims, -(-width // spec.chunks)) // 8) * 8
    groups = 1
    while groups * 2 <= min(spec.groups, total // spec.rows):
        groups *= 2
    at, q_at, table = 0, 0, []
    for g in range(groups):
        n, q = (sum(r[c] for r in counts if r["bucket"] % groups == g) for c in ("n", "q"))
        blocks, q_blocks = -(-n // spec.rows), -(-q // spec.anchors)
        table.append((g, at, blocks, q_at, q_blocks))
        at, q_at = at + blocks, q_at + q_blocks
    plan = F.broadcast(spark.createDataFrame(table, "grp int, first long, blocks long, q_first long, q_blocks long"))  # at most `groups` rows
    dealt = slim.withColumn("grp", F.col("bucket") % groups).join(plan, "grp")
    spread = F.xxhash64(F.lit(5), "id")
    blocks = written(_packed(dealt.select("id", "label", "x", (F.col("first") + F.pmod(spread, "blocks")).alias("block")), dims), "hard-negative-blocks")
    own = dealt.where("anchor").select("id", "label", "x", (F.col("q_first") + F.pmod(spread, "q_blocks")).alias("block"), "first", "blocks")
    where = own.select("block", F.col("first").alias("low"), (F.col("first") + F.col("blocks") - 1).alias("high")).distinct()
    near = _met(_packed(own.select("id", "label", "x", "block"), dims).join(where, "block"), blocks, spec, _positives(spec.positives), "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))).where(F.col("n") <= spec.positives)
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id"))).alias("windows"))  # `positives` each
    asking = slim.where("anchor").join(windows, "id").select("id", "label", "x", "windows", F.pmod(spread, F.lit(max(1, -(-n_anchors // spec.anchors)))).alias("block"))
    asking = written(_packed(asking, dims), "hard-negative-anchors").withColumns({"low": F.lit(0).cast("long"), "high": F.lit(max(0, at - 1)).cast("long")})
    found = _met(asking, blocks, spec, _negatives(spec), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
