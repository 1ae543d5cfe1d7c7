"""Near-duplicate groups by MinHash with odd sketches.

A text's shingles are hashed and sampled by MinHash. Bands of the samples name buckets, whose members are
candidates; the samples folded into a bitmap of parities (an odd sketch) tell by the population count of two
bitmaps' XOR how alike two texts are, sharply so where they are much alike. Candidates that pass are confirmed on
their full shingle sets, and confirmed links are contracted to components.

Texts with equal sets are one node from the start. In a bucket all are first compared with its smallest member, the
hub, which joins most true groups with as many comparisons as members. Buckets of one hub are then one cell. Where a
cell still holds several components, members outside of its largest one meet all others in blocks: a first pass over
sketches names the members that have a near partner elsewhere, a second one brings these members' full sets, confirms
inside the task and returns links that join components, fewer than members. Pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.session import cut, ship_package


@dataclass(frozen=True)
class NearDupSpec:
    """Texts are linked at `percent` percent of shared shingles or more.

    32 bands of 5 of 256 samples miss a pair of similarity 0.8 once in 300,000, more similar ones far less often.
    least_estimate is five standard deviations below: such pairs fail the confirmation. block: members that meet as
    many others in one task; block_shingles: the same for full sets, in shingles."""

    shingle_words: int = 5
    percent: int = 80
    hashes: int = 256
    bands: int = 32
    band_rows: int = 5
    sketch_bits: int = 1024
    least_estimate: float = 0.66
    block: int = 1024
    block_shingles: int = 1 << 20


_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all of them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of one for all words if these are fewer than size."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = h * _BASE + w[i : len(w) - size + 1 + i]
    return np.unique(_mixed(h))


def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0xF0110)
    return rng.integers(0, _MASK, k, dtype=np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, _MASK, k, dtype=np.uint64, endpoint=True)


def minhash(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest 32-bit value of each hash function over the set."""
    a, b = factors
    out = np.full(len(a), _MASK, dtype=np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(out, (shingles[i : i + 256, None] * a + b).min(axis=0), out=out)
    return out >> np.uint64(32)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 signed words: for each bit the parity of the samples that fall on it."""
    at = _mixed(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * _BASE) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def most_odd_bits(least: float, hashes: int, bits: int) -> int:
    """The largest XOR population count at which the estimated similarity is `least` or more."""
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * hashes * (1 - least))))


def band_keys(samples: np.ndarray, spec: NearDupSpec) -> np.ndarray:
    part = samples[: spec.bands * spec.band_rows].reshape(spec.bands, spec.band_rows)
    key = np.arange(1, spec.bands + 1, dtype=np.uint64)
    for i in range(spec.band_rows):
        key = _mixed(key * _BASE + part[:, i])
    return key.view(np.int64)


def _halves(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & _MASK) - (1 << 63)


SIGNATURE = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def signer(spec: NearDupSpec):
    """For mapInPandas over (doc_id, text_hash, text)."""

    def sign(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        factors = _factors(spec.hashes)
        for pdf in it:
            for i in range(0, len(pdf), 512):
                rows = []
                for text in pdf["text"].iloc[i : i + 512]:
                    s = shingle_set(text, spec.shingle_words)
                    if len(s):
                        m = minhash(s, factors)
                        rows.append((len(s), *_halves(s), band_keys(m, spec), odd_sketch(m, spec.sketch_bits)))
                    else:
                        rows.append((0, 0, 0, None, None))
                yield pd.DataFrame({**pdf[["doc_id", "text_hash"]].iloc[i : i + 512].reset_index(drop=True), **dict(zip(("n_shingles", "h1", "h2", "bands", "sketch"), zip(*rows)))})

    return sign


def set_reader(size: int):
    """For mapInPandas over (node, h1, h2, text): the node's full shingle set, where the text is the node's."""

    def read(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 512):
                rows = []
                for r in pdf.iloc[i : i + 512].itertuples():
                    s = shingle_set(r.text, size)
                    if len(s) and _halves(s) == (r.h1, r.h2):
                        rows.append((r.node, s.view(np.int64)))
                yield pd.DataFrame(rows, columns=["node", "shingles"])

    return read


def odd_bits(a: Column, b: Column) -> Column:
    """The XOR population count of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XOR population counts of each row of sketches a with each of b; a few million words at a time."""
    step = max(1, (1 << 22) // max(1, b.size))
    return np.concatenate([np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32) for i in range(0, len(a), step)])


def whole_meetings(it: Iterable[pd.DataFrame]) -> Iterable[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by (hub, i, j), cut so that each meeting is whole, with the bounds of each."""
    held = None
    for pdf in it:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = pdf[["hub", "i", "j"]].to_numpy()
        ends = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        if ends:
            yield pdf.iloc[: ends[-1]], list(zip([0, *ends], ends))
        held = pdf.iloc[ends[-1] if ends else 0 :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, [(0, len(held))]


def near_pairs(pdf: pd.DataFrame, bounds: list[tuple[int, int]], spec: NearDupSpec) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per meeting the rows of both blocks, and which pairs have near sketches, sizes that allow a link and different components."""
    most = most_odd_bits(spec.least_estimate, spec.hashes, spec.sketch_bits)
    sketch, size = np.stack(pdf["sketch"].to_numpy()).view(np.uint64), pdf["n_shingles"].to_numpy()
    component, side = pdf["component"].to_numpy(), pdf["side"].to_numpy()
    for start, stop in bounds:
        if stop - start < 2:
            continue
        a, b = np.flatnonzero(side[start:stop] != 1) + start, np.flatnonzero(side[start:stop] != 0) + start
        if not (len(a) and len(b)):
            continue
        m, n = size[a, None], size[None, b]
        near = (100 * np.minimum(m, n) >= spec.percent * np.maximum(m, n)) & (component[a, None] != component[None, b])
        if near.any():
            near &= _distances(sketch[a], sketch[b]) <= most
            if near.any():
                yield a, b, near


def seekers(spec: NearDupSpec):
    """For mapInPandas over meetings: the members that have a near partner in another component."""

    def seek(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf, bounds in whole_meetings(it):
            found = np.zeros(len(pdf), dtype=bool)
            for a, b, near in near_pairs(pdf, bounds, spec):
                found[a] |= near.any(axis=1)
                found[b] |= near.any(axis=0)
            yield pdf.loc[found, ["hub", "node", "component", "visitor"]]

    return seek


def block_links(spec: NearDupSpec):
    """For mapInPandas over meetings with full sets: components (a, b) that a confirmed link joins. In a meeting each link joins two that were apart until then."""

    def shares(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """Which of the sets share enough with this one."""
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        held = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        shared = np.add.reduceat(held.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return 100 * shared >= spec.percent * (len(own) + sizes - shared)

    def of_meeting(a: np.ndarray, b: np.ndarray, near: np.ndarray, component: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        out = []
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            own, c, to = a[i], component[a[i]], b[near[i]].tolist()
            for at in range(0, len(to), 256):
                part = [j for j in to[at : at + 256] if find(component[j]) != find(c)]
                for j in np.asarray(part, dtype=int)[shares(sets[own], [sets[j] for j in part])] if part else ():
                    x, y = find(c), find(component[j])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((max(x, y), min(x, y)))
        return out

    def links(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf, bounds in whole_meetings(it):
            component, sets, out = pdf["component"].tolist(), pdf["shingles"].tolist(), []
            for a, b, near in near_pairs(pdf, bounds, spec):
                out += of_meeting(a, b, near, component, sets)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def contract(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it reaches.

    Every round first hangs each node's larger neighbours, then its smaller ones, below the smallest of all (large and
    small stars), until each node has one edge, to its component; rounds grow with the logarithm of its size."""
    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        again = star.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        below = star.select(F.col("b").alias("a")).distinct().join(star, "a", "left_semi")
        if again.unionByName(below).isEmpty():
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        star = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())


def _labelled(rows: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """rows with the component of a node; one without links is its own."""
    of = labels.select(F.col("node").alias(node), F.col("component").alias("__c"))
    return rows.join(of, node, "left").withColumn(name, F.coalesce("__c", node)).drop("__c")


def _meetings(rows: DataFrame, weight: Column, block: int) -> DataFrame:
    """rows (hub, visitor, node, ...) dealt to meetings (hub, i, j) of two blocks of a cell, with their side.

    A block holds members of about `block` weight together. A cell's visitor blocks come first and meet all blocks;
    side is 0 or 1, or 2 for a block that meets itself."""
    sizes = rows.groupBy("hub").agg(*[F.ceil(F.sum(F.when(F.col("visitor") == v, weight).otherwise(0)) / block).alias(n) for v, n in ((True, "guests"), (False, "hosts"))])
    dealt = rows.join(sizes.where("guests > 0"), "hub")
    of = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    own = F.when(F.col("visitor"), of("guests")).otherwise(F.col("guests") + of("hosts"))
    last = F.when(F.col("visitor"), F.col("guests") + F.col("hosts")).otherwise(F.col("guests")) - 1
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side}).drop("own", "other", "guests", "hosts")


def _met(meetings: DataFrame) -> DataFrame:
    """Every meeting's rows in one task, one after the other. The number of tasks is given: rows are few and their work isn't."""
    spark = meetings.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return meetings.repartition(n, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def _across(star: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Links (a, b) between components that share a cell, confirmed on full sets."""
    cell = star.select("hub", "node").unionByName(star.select("hub", F.col("hub").alias("node")).distinct())
    placed = cut(_labelled(cell, "node", labels, "component"))
    parts = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    here = placed.join(split.select("hub", F.col("most.component").alias("largest")), "hub").withColumn("visitor", F.col("component") != F.col("largest")).drop("largest")
    here = cut(here.join(nodes.select("node", "n_shingles", "sketch"), "node"))
    found = _met(_meetings(here, F.lit(1), spec.block)).mapInPandas(seekers(spec), "hub long, node long, component long, visitor boolean")
    found = cut(found.distinct())
    full = found.join(nodes.select("node", "n_shingles", "sketch"), "node").join(sets, "node")
    return cut(_met(_meetings(full, F.col("n_shingles"), spec.block_shingles)).mapInPandas(block_links(spec), "a long, b long"))


def _of_one_id(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of different texts that stand under one id; mostly there are none."""
    ends = some.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("doc_id")
    of = some.join(ends, "doc_id").select("doc_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    return of.join(of.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")


def near_groups(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs.

    Null, empty and blank texts have no shingles and link with nothing; so do rows without an id, which stay
    (component_id null). Repeated rows share a component, and each that has its smallest id is marked kept; different
    texts under one id are that id's, and so one component. Very long texts are read whole. Only id and text are read,
    so no other column can clash. An empty table gives an empty result."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = written(slim.mapInPandas(signer(spec), SIGNATURE), "near-signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    nodes = some.groupBy("h1", "h2").agg(first, *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    nodes = written(nodes.select(F.col("first.doc_id").alias("node"), "first.text_hash", "h1", "h2", "n_shingles", "bands", "sketch"), "near-nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    star = cut(keys.join(hubs, "key").where("node <> hub").select("node", "hub").distinct())

    wanted = star.select("node").unionByName(star.select(F.col("hub").alias("node"))).distinct().join(nodes.select("node", "text_hash", "h1", "h2"), "node")
    texts = slim.withColumnRenamed("doc_id", "node").join(wanted, ["node", "text_hash"])
    texts = texts.groupBy("node", "text_hash", "h1", "h2").agg(F.first("text").alias("text"))  # rows repeated under one id
    sets = written(texts.mapInPandas(set_reader(spec.shingle_words), "node long, shingles array<long>"), "near-sets")

    named = lambda df, node, column, name: df.select(F.col("node").alias(node), F.col(column).alias(name))
    near = star.join(named(nodes, "node", "sketch", "ka"), "node").join(named(nodes, "hub", "sketch", "kb"), "hub")
    near = cut(near.where(odd_bits(F.col("ka"), F.col("kb")) <= most_odd_bits(spec.least_estimate, spec.hashes, spec.sketch_bits)).select("node", "hub"))
    both = near.join(named(sets, "node", "shingles", "sa"), "node").join(named(sets, "hub", "shingles", "sb"), "hub")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = both.where(100 * shared >= spec.percent * (F.size("sa") + F.size("sb") - shared)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labels = contract(linked.unionByName(_of_one_id(some, nodes)))

    links = _across(star, labels, nodes, sets, spec)
    joined = contract(links).select(F.col("node").alias("component"), F.col("component").alias("larger"))
    classes = _labelled(nodes.select("h1", "h2", "node"), "node", labels, "component").join(joined, "component", "left")
    classes = cut(classes.select("h1", "h2", F.coalesce("larger", "component").alias("component")))
    found = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
