"""Cluster search with bounds: k-means clusters of every model, stored a folder a cluster, searched exactly or nearly so.

A vector at distance g of its centroid is at least |d - g| from a query at distance d of it. A cluster is therefore left
out once its nearest possible member is farther than the k-th best found, and so is a block of it: members are stored in the
order of their distance, each block with its least and largest. Exact search leaves out nothing else; the cheaper mode asks
as many of the nearest clusters as a sample of the stored vectors needed for the recall that was asked of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.vector import DIGITS, best_rows
from folioscope.session import checkpoint_dir, cut

KEY = ["model", "width"]
MATRIX = "model string, width int, ids array<long>, matrix binary"
CENTROIDS = "model string, width int, centroids binary"


def named() -> Column:
    """A model as the name of a folder, which can't be empty; a null model is the empty one."""
    return F.concat(F.lit("-"), F.coalesce("model", F.lit(""))).alias("model")


@dataclass(frozen=True)
class ClusterIndex:
    """clusters (model, width, cluster, centroid, n, radius, longest): radius holds all members; blocks (ids, matrix, low,
    high; model, width, cluster from the folder): unit vectors by their distance to the centroid; probes (model, width,
    probes): clusters that the cheaper mode asks."""

    clusters: DataFrame
    blocks: DataFrame
    probes: DataFrame | None = None


def _units(v: list, width: int, eps: float) -> np.ndarray:
    m = np.array(v, dtype=float).reshape(len(v), width)
    n = np.sqrt((m * m).sum(axis=1))
    n[(np.abs(n - 1) < eps) | (n < 1e-12)] = 1.0
    return m / n[:, None]


def _packed(rows: DataFrame, size: int, eps: float) -> DataFrame:
    """MATRIX rows of (id, model, embedding): up to `size` unit vectors of a model and width. Null vectors are left out."""

    def pack(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def block(at: tuple) -> pd.DataFrame:
            part = held.pop(at)
            return pd.DataFrame({"model": [at[0]], "width": [at[1]], "ids": [[i for i, _ in part]], "matrix": [_units([v for _, v in part], at[1], eps).tobytes()]})

        for pdf in it:
            for i, model, v in zip(pdf["id"], pdf["model"], pdf["embedding"]):
                held.setdefault((model, len(v)), []).append((i, v))
                if len(held[model, len(v)]) == size:
                    yield block((model, len(v)))
        for at in list(held):
            yield block(at)

    return rows.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "model", "embedding").mapInPandas(pack, MATRIX)


def _of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=float).reshape(-1, width)


def _distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * m @ c.T))


def _sums(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block of the sample: its members' number and sum by nearest centroid."""
    for pdf in it:
        for r in pdf.itertuples():
            m, c = _of(r.matrix, r.width), _of(r.centroids, r.width)
            near = _distances(m, c).argmin(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, near, m)
            yield pd.DataFrame({"model": [r.model], "width": [r.width], "n": [np.bincount(near, minlength=len(c)).astype(float).tobytes()], "total": [total.tobytes()], "centroids": [r.centroids]})


def _renewed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A model's next centroids; one without members stays."""
    width = int(pdf["width"].iloc[0])
    n, total = sum(np.frombuffer(x, dtype=float) for x in pdf["n"]), sum(_of(x, width) for x in pdf["total"])
    c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], _of(pdf["centroids"].iloc[0], width))
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "width": [width], "centroids": [c.tobytes()]})


def _first_centroids(pdf: pd.DataFrame) -> pd.DataFrame:
    width = int(pdf["width"].iloc[0])
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "width": [width], "centroids": [_units(pdf.sort_values("h")["embedding"].tolist(), width, 0.0).tobytes()]})


def fit(vectors: DataFrame, n_clusters: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 42, eps: float = 1e-3) -> DataFrame:
    """CENTROIDS of every model and width of (chunk_id, model, embedding), all in one job a round.

    The fit reads about `sample` vectors of each, chosen by seeded hash; a model has at most half as many clusters as
    vectors, and one at least."""
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("id"), named(), F.size("embedding").alias("width"), "embedding")
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    counts = F.broadcast(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))  # a row for each model and width
    some = cut(hashed.join(counts, KEY).where(F.pmod("h", F.lit(1 << 30)) < F.ceil(F.lit(float(sample << 30)) / F.col("n"))))
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("h", "id"))  # over the sample
    starts = some.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(1), F.least(F.lit(n_clusters), F.expr("n div 2").cast("int"))))
    centroids = cut(starts.select(*KEY, "h", "embedding").groupBy(*KEY).applyInPandas(_first_centroids, CENTROIDS))
    blocks = cut(_packed(some, 4096, eps))
    for _ in range(rounds):
        sums = blocks.join(F.broadcast(centroids), KEY).mapInPandas(_sums, "model string, width int, n binary, total binary, centroids binary")
        centroids = cut(sums.groupBy(*KEY).applyInPandas(_renewed, CENTROIDS))
    return centroids


def _assigned(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for r in pdf.itertuples():
            m, c = _of(r.matrix, r.width), _of(r.centroids, r.width)
            d = _distances(m, c)
            near = d.argmin(axis=1)
            yield pd.DataFrame({"model": r.model, "width": r.width, "cluster": near.astype(np.int32), "gap": d[np.arange(len(m)), near], "id": r.ids, "long": np.sqrt((m * m).sum(axis=1)), "v": [x.tobytes() for x in m]})


def _zones(size: int):
    """For mapInPandas over rows by model, width, cluster and gap: blocks of neighbours."""

    def zones(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def blocks(pdf: pd.DataFrame, whole: bool) -> Iterator[pd.DataFrame]:
            runs = [g for _, g in pdf.groupby([*KEY, "cluster"], sort=False)]
            for k, g in enumerate(runs):
                end = len(g) if whole or k < len(runs) - 1 else len(g) // size * size  # the last run may go on
                for i in range(0, end, size):
                    p = g.iloc[i:i + size]
                    yield pd.DataFrame({"ids": [p["id"].tolist()], "matrix": [b"".join(p["v"])], "low": [p["gap"].iloc[0]], "high": [p["gap"].iloc[-1]], "model": [p["model"].iloc[0]], "width": [p["width"].iloc[0]], "cluster": [p["cluster"].iloc[0]]})
                if end < len(g):
                    held.append(g.iloc[end:])

        for pdf in it:
            rows = pd.concat([*held, pdf], ignore_index=True)
            held.clear()
            yield from blocks(rows, False)
        if held:
            yield from blocks(pd.concat(held, ignore_index=True), True)

    return zones


def build(vectors: DataFrame, path: str | None = None, n_clusters: int = 64, top_k: int = 10, target: float = 0.95, trials: int = 200, block: int = 1024, eps: float = 1e-3, **fitting) -> ClusterIndex:
    """The index of (chunk_id, model, embedding) written under path (default: a new one in the shared folder); every vector is in it.

    The cheaper mode's number of clusters is the least that gives about `trials` vectors of each model, searched for
    exactly, `target` of their top_k."""
    spark = vectors.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    centroids = fit(vectors, n_clusters, eps=eps, **fitting)
    packed = _packed(vectors.select(F.col("chunk_id").alias("id"), named(), "embedding"), 1024, eps)
    kinds = "model string, width int, cluster int, gap double, id long, long double, v binary"
    rows = cut(packed.join(F.broadcast(centroids), KEY).mapInPandas(_assigned, kinds))
    order = [*KEY, "cluster", "gap", "id"]
    zones = rows.repartitionByRange(*order).sortWithinPartitions(*order)  # a large cluster is several ranges
    zones.mapInPandas(_zones(block), "ids array<long>, matrix binary, low double, high double, model string, width int, cluster int").write.partitionBy(*KEY, "cluster").parquet(f"{path}/blocks")
    spread = rows.groupBy(*KEY, "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("long").alias("longest"))

    def each(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                c = _of(r.centroids, r.width)
                yield pd.DataFrame({"model": r.model, "width": r.width, "cluster": np.arange(len(c), dtype=np.int32), "centroid": c.tolist()})

    centroids.mapInPandas(each, "model string, width int, cluster int, centroid array<double>").join(spread, [*KEY, "cluster"]).write.parquet(f"{path}/clusters")
    _calibrated(read(spark, path), vectors, top_k, target, trials, eps).write.parquet(f"{path}/probes")
    return read(spark, path)


def _calibrated(index: ClusterIndex, vectors: DataFrame, top_k: int, target: float, trials: int, eps: float) -> DataFrame:
    """(model, width, probes): by the places of the clusters that hold the exact results of a hashed sample."""
    sizes = F.broadcast(index.clusters.groupBy(*KEY).agg(F.sum("n").alias("n")))
    own = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("model").alias("own"), named(), F.size("embedding").alias("width"), "embedding")
    some = own.join(sizes, KEY).where(F.pmod(F.xxhash64(F.lit(9), "chunk_id"), F.lit(1 << 30)) < F.ceil(F.lit(float(trials << 30)) / F.col("n")))
    some = cut(some.select(F.xxhash64("chunk_id", *KEY).alias("query_id"), F.col("own").alias("model"), "embedding"))
    found = _searched(index, some, top_k, 3, False, eps).select("query_id", *KEY, "cluster")
    pairs = _asking(index, some, eps).mapInPandas(_chosen(1 << 30, False), PAIRS)
    placed = pairs.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("gap", "cluster")))  # as many as clusters
    return found.join(placed, ["query_id", *KEY, "cluster"]).groupBy(*KEY).agg(F.percentile("place", target).alias("p")).select(*KEY, F.ceil("p").cast("int").alias("probes"))


def read(spark: SparkSession, path: str) -> ClusterIndex:
    kinds = "ids array<long>, matrix binary, low double, high double, model string, width int, cluster int"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/probes")
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return ClusterIndex(spark.read.parquet(f"{path}/clusters"), spark.read.schema(kinds).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/probes") if known else None)


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cluster")
    flat = lambda c: pdf[c].to_numpy(dtype=float).tobytes()
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "width": [pdf["width"].iloc[0]], "numbers": [pdf["cluster"].tolist()], "centroids": [np.array(pdf["centroid"].tolist(), dtype=float).tobytes()],
                         "radius": [flat("radius")], "longest": [flat("longest")]})


TEAMS = "model string, width int, cluster int, q_ids array<long>, q_matrix binary, gaps array<double>, limits array<double>, `from` double, `to` double"
PAIRS = "query_id long, model string, width int, cluster int, gap double, limit double, q binary"


def _chosen(first: int | None, more: bool):
    """For mapInPandas over blocks of queries with their model's clusters and, by query, the least similarity that counts:
    the nearest clusters (first of them, or as many as calibrated), or (more) those beyond whose bound doesn't rule them out."""

    def choose(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                q, numbers = _of(r.matrix, r.width), np.asarray(r.numbers)
                d, longest = _distances(q, _of(r.centroids, r.width)), np.frombuffer(r.longest, dtype=float)
                rank = d.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                limit, take = np.full_like(d, np.inf), rank < (r.probes if first is None else first)
                if more:
                    least = dict(zip(r.known_ids, r.known))
                    s = np.array([least.get(i, -np.inf) for i in r.ids])
                    limit = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + longest[None] ** 2 - 2 * s[:, None])) + 1e-9
                    take = ~take & (d - np.frombuffer(r.radius, dtype=float)[None] <= limit)
                i, k = np.nonzero(take)
                yield pd.DataFrame({"query_id": np.asarray(r.ids)[i], "model": r.model, "width": r.width, "cluster": numbers[k].astype(np.int32), "gap": d[i, k], "limit": limit[i, k], "q": [q[j].tobytes() for j in i]})

    return choose


def _teams(size: int):
    """For mapInPandas over pairs by cluster and gap: blocks of queries that ask one cluster, with the range of distances they want."""

    def teams(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at, g in pdf.groupby([*KEY, "cluster"], sort=False):
                for i in range(0, len(g), size):
                    p = g.iloc[i:i + size]
                    yield pd.DataFrame({"model": [at[0]], "width": [at[1]], "cluster": [at[2]], "q_ids": [p["query_id"].tolist()], "q_matrix": [b"".join(p["q"])], "gaps": [p["gap"].tolist()], "limits": [p["limit"].tolist()],
                                        "from": [float((p["gap"] - p["limit"]).min())], "to": [float((p["gap"] + p["limit"]).max())]})

    return teams


def _scanned(top_k: int):
    """For mapInPandas over queries and a block of a cluster that they ask: the best rows of the block by query."""

    def scan(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                gaps, limits = np.asarray(r.gaps), np.asarray(r.limits)
                wanted = (gaps - limits <= r.high) & (gaps + limits >= r.low)
                if wanted.any():
                    best = best_rows(np.asarray(r.q_ids)[wanted], _of(r.q_matrix, r.width)[wanted], np.asarray(r.ids), _of(r.matrix, r.width), top_k)
                    yield best.assign(model=r.model, width=r.width, cluster=r.cluster)

    return scan


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _asking(index: ClusterIndex, queries: DataFrame, eps: float) -> DataFrame:
    """Blocks of queries with the clusters of their model and width."""
    kinds = "model string, width int, numbers array<int>, centroids binary, radius binary, longest binary"
    tables = index.clusters.groupBy(*KEY).applyInPandas(_table, kinds)  # a row for each model and width
    tables = tables.withColumn("probes", F.lit(None).cast("int")) if index.probes is None else tables.join(F.broadcast(index.probes), KEY)
    return _packed(queries.select(F.col("query_id").alias("id"), named(), "embedding"), 512, eps).join(F.broadcast(tables), KEY)


def _searched(index: ClusterIndex, queries: DataFrame, top_k: int, first: int, near: bool, eps: float) -> DataFrame:
    packed = _asking(index, queries, eps)

    def scan(pairs: DataFrame) -> DataFrame:
        sorted_pairs = pairs.repartition(*KEY, "cluster").sortWithinPartitions(*KEY, "cluster", "gap")
        teams = sorted_pairs.mapInPandas(_teams(512), TEAMS)
        teams = cut(teams)
        asked = teams.groupBy(*KEY).agg(F.collect_set("cluster").alias("c")).collect()  # at most all clusters of the models asked
        here = [(F.col("model") == r["model"]) & (F.col("width") == r["width"]) & F.col("cluster").isin(r["c"]) for r in asked]
        folders = index.blocks.where(reduce(Column.__or__, here, F.lit(False)))  # only these are listed and read
        met = folders.join(teams, [*KEY, "cluster"]).where("low <= `to` AND high >= `from`")
        return met.mapInPandas(_scanned(top_k), "query_id long, chunk_id long, similarity double, model string, width int, cluster int")

    if near:
        return _best(scan(packed.mapInPandas(_chosen(None, False), PAIRS)), top_k)
    found = cut(_best(scan(packed.mapInPandas(_chosen(first, False), PAIRS)), top_k))
    known = found.where(F.col("rank") == top_k).select(F.col("query_id").alias("kid"), (F.col("similarity") - 10.0**-DIGITS).alias("least"))
    asked = packed.withColumn("kid", F.explode("ids")).join(known, "kid", "left")
    again = asked.groupBy(*KEY, "ids").agg(*[F.first(c).alias(c) for c in ("matrix", "numbers", "centroids", "radius", "longest", "probes")],
                                          F.collect_list(F.when(F.col("least").isNotNull(), F.col("kid"))).alias("known_ids"), F.collect_list("least").alias("known"))
    return _best(found.drop("rank").unionByName(scan(again.mapInPandas(_chosen(first, True), PAIRS))), top_k)


def search(index: ClusterIndex, queries: DataFrame, top_k: int, exact: bool = True, first: int = 3, eps: float = 1e-3) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) of each of (query_id, model, embedding): its top_k nearest of its model and width.

    exact: the first clusters give a k-th similarity and the others are asked as far as their bound reaches it, so the
    result is that of a whole scan, ties to the smaller chunk_id. Else the calibrated number of nearest clusters is
    asked, and what other clusters hold is missed. Queries without a vector have no rows."""
    return _searched(index, queries, top_k, first, not exact, eps).select("query_id", "chunk_id", "similarity", "rank")
