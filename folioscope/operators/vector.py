"""Cosine search over (chunk_id, model, dim, embedding) tables, exact and through clusters.

Similarities are computed in double precision and rounded to six digits before they order anything."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut

DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_guarded(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector's norm is below 1e-12."""
    return F.when((norm(a) < 1e-12) | (norm(b) < 1e-12), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column, eps: float = 1e-3) -> Column:
    """The vector scaled to length 1; as it is if it nearly has that length, or none."""
    n = norm(a)
    return F.when((F.abs(n - 1) < eps) | (n < 1e-12), a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def of_model(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors of a model; where it has none of this width, those of every model of the width."""
    wide = vectors.where(F.col("dim") == dim)
    own = wide.where(F.col("model") == model)
    none = own.limit(1).agg(F.count(F.lit(1)).alias("owned"))  # one row
    return wide.crossJoin(F.broadcast(none)).where((F.col("owned") == 0) | (F.col("model") == model)).drop("owned")


def _blocks(rows: DataFrame, id_col: str, size: int, eps: float, group: str | None = None) -> DataFrame:
    """(width, ids, matrix[, group]): up to `size` unit vectors of one width (and one value of a long column) as a matrix of
    doubles in bytes. Null vectors are left out."""

    def pack(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def block(key: tuple) -> pd.DataFrame:
            part, width = held.pop(key), key[0]
            m = np.array([v for _, v in part], dtype=float).reshape(len(part), width)
            n = np.sqrt((m * m).sum(axis=1))
            n[(np.abs(n - 1) < eps) | (n < 1e-12)] = 1.0
            out = pd.DataFrame({"width": [width], "ids": [[i for i, _ in part]], "matrix": [(m / n[:, None]).tobytes()]})
            return out if group is None else out.assign(**{group: [key[1]]})

        for pdf in it:
            for i, v, *g in zip(*[pdf[c] for c in pdf.columns]):
                held.setdefault(key := (len(v), *g), []).append((i, v))
                if len(held[key]) == size:
                    yield block(key)
        for key in list(held):
            yield block(key)

    some = rows.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding", *([] if group is None else [F.col(group).cast("long").alias(group)]))
    return some.mapInPandas(pack, "width int, ids array<long>, matrix binary" + ("" if group is None else f", {group} long"))


def best_rows(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, top_k: int) -> pd.DataFrame:
    """(query_id, chunk_id, similarity): of each query's row of q its top_k rows of v, ties of the last by smaller id."""
    near = np.round(q @ v.T, DIGITS)
    k = min(top_k, len(v))
    least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
    i, j = np.nonzero(near >= least[:, None])  # with all ties of the last
    order = np.lexsort((ids[j], -near[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)  # within its query
    i, j = i[place < k], j[place < k]
    return pd.DataFrame({"query_id": q_ids[i], "chunk_id": ids[j], "similarity": near[i, j]})


def _block_best(top_k: int):
    """For mapInPandas over pairs of blocks: each query's top_k of the block's vectors, a frame for each pair."""

    def best(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            for width, ids, matrix, q_ids, q_matrix in zip(*[pdf[c] for c in ("width", "ids", "matrix", "q_ids", "q_matrix")]):
                v, q = (np.frombuffer(m, dtype=float).reshape(-1, width) for m in (matrix, q_matrix))
                yield best_rows(np.asarray(q_ids), q, np.asarray(ids), v, top_k)

    return best


def vector_topk(queries: DataFrame, vectors: DataFrame, top_k: int, eps: float = 1e-3, query_block: int = 512, vector_block: int = 4096, spread: int = 16) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) of each query's top_k nearest chunks; ties go to the smaller chunk_id.

    queries: (query_id, embedding). Blocks of queries meet blocks of vectors of their width as matrix products; of each
    meeting only top_k rows of a query go on to the last ranking. Queries go to `spread` parts of the vectors, so one width
    is no hot key."""
    q = _blocks(queries, "query_id", query_block, eps).withColumnsRenamed({"width": "q_width", "ids": "q_ids", "matrix": "q_matrix"})
    q = q.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(spread))
    pairs = _blocks(vectors, "chunk_id", vector_block, eps).join(q, (F.col("width") == F.col("q_width")) & (part == F.col("q_part")))
    scored = pairs.mapInPandas(_block_best(top_k), "query_id long, chunk_id long, similarity double")
    scored = scored.withColumn("similarity", F.round("similarity", DIGITS))
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def ivf_build(vectors: DataFrame, n_clusters: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(centroids (cluster, centroid), assignments (chunk_id, cluster, embedding)) by k-means on unit vectors.

    At most half as many clusters as vectors; fewer than two vectors a cluster give none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark, n = vectors.sparkSession, vectors.count()
    k = min(n_clusters, n // 2)
    rows = vectors.select("chunk_id", "embedding", array_to_vector(unit(F.col("embedding"))).alias("features"))
    if k < 1 or n_clusters * 2 > n:
        return spark.createDataFrame([], "cluster int, centroid array<double>"), vectors.select("chunk_id", F.lit(None).cast("int").alias("cluster"), "embedding").limit(0)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return centroids, model.transform(rows).select("chunk_id", "cluster", "embedding")


def centroids_by_label(vectors: DataFrame, label: str = "cluster") -> DataFrame:
    """(cluster, centroid): the mean vector of each label."""
    each = vectors.select(F.col(label).alias("cluster"), F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("cluster", F.col("c.x").alias("centroid"))


def ivf_probe(queries: DataFrame, centroids: DataFrame, assigned: DataFrame, top_k: int, probes: int = 3, everything: DataFrame | None = None, spread: int = 16) -> DataFrame:
    """Exact scores within each query's `probes` nearest clusters (Euclidean distance), by matrix products of blocks of one
    cluster's queries and vectors. Queries go to `spread` parts of a cluster, so a large one is no hot key.

    A query without candidates is searched for in `everything` (chunk_id, embedding), if that is given; else it has no
    rows. The clusters left out are missed: operators.clusters searches with bounds."""
    q = queries.select("query_id", unit(F.col("embedding")).alias("q"))
    gap = F.round(F.sqrt(F.aggregate(F.zip_with("q", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), DIGITS)
    near = q.crossJoin(F.broadcast(centroids)).withColumn("gap", gap)  # as many centroids as clusters
    near = near.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("gap", "cluster"))).where(F.col("n") <= probes).drop("n")
    near, assigned = cut(near.where("cluster IS NOT NULL")), assigned.where("cluster IS NOT NULL")
    asked = _blocks(near.select("query_id", "cluster", F.col("q").alias("embedding")), "query_id", 512, float("inf"), "cluster")  # as they are
    asked = asked.withColumnsRenamed({"width": "q_width", "ids": "q_ids", "matrix": "q_matrix", "cluster": "q_cluster"}).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(spread))
    held = _blocks(assigned, "chunk_id", 4096, 1e-3, "cluster").withColumn("part", part)
    pairs = held.join(asked, (F.col("cluster") == F.col("q_cluster")) & (F.col("width") == F.col("q_width")) & (F.col("part") == F.col("q_part")))
    scored = pairs.mapInPandas(_block_best(top_k), "query_id long, chunk_id long, similarity double").withColumn("similarity", F.round("similarity", DIGITS))
    first = lambda rows: rows.select("cluster", "chunk_id", F.row_number().over(W.partitionBy("cluster").orderBy("chunk_id")).alias("n")).where(F.col("n") <= top_k)
    unlike = near.where("q IS NULL").join(first(assigned), "cluster").unionByName(near.where("q IS NOT NULL").join(first(assigned.where("embedding IS NULL")), "cluster"), True)
    scored = scored.unionByName(unlike.select("query_id", "chunk_id", F.lit(None).cast("double").alias("similarity")))  # null vectors are like none and come last
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("chunk_id"))
    found = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    if everything is None:
        return found
    found = cut(found)
    return found.unionByName(vector_topk(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"), everything, top_k))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact results (query_id, chunk_id) that were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def imported(rows: DataFrame, blob_col: str = "vec") -> DataFrame:
    """rows with embedding and dim decoded from little-endian float32 bytes; bytes of another length than 4 times a whole number give null."""

    @F.pandas_udf("array<float>")
    def decoded(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4") for b in blobs])

    return rows.withColumn("embedding", decoded(F.col(blob_col))).withColumn("dim", F.size("embedding"))


def encode(rows: DataFrame, encoder, text_col: str = "text", model: str = "hook") -> DataFrame:
    """Adds embedding, dim, model and encode_error by a model's batch function of texts.

    Where it fails on a batch, the batch's vectors are null and encode_error says why, so the index can be built without."""

    @F.pandas_udf("embedding array<float>, encode_error string")
    def embedded(t: pd.Series) -> pd.DataFrame:
        try:
            out = [None if v is None else [float(x) for x in v] for v in encoder(t.tolist())]
            return pd.DataFrame({"embedding": out, "encode_error": None})
        except Exception as e:
            return pd.DataFrame({"embedding": [None] * len(t), "encode_error": f"{type(e).__name__}: {e}"})

    found = rows.withColumn("__e", embedded(F.col(text_col)))
    return found.withColumns({"embedding": F.col("__e.embedding"), "dim": F.size("__e.embedding"), "model": F.lit(model), "encode_error": F.col("__e.encode_error")}).drop("__e")
