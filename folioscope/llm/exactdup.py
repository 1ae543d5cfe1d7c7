"""Exact duplicates through an extendible-hash index kept on shared files.

Every text is normalised and hashed to 64 bits; these slim rows are counted by hash. The directory has 2^g cells, one per
g-bit prefix of the hash. It doubles, each overfull bucket splitting on its next bit, until no bucket holds more than
`capacity` hashes or g reaches its bound. A hash that stands once is an entry as it is. Where it stands more than once, its
texts chain behind it: only these texts are read again, and each is compared with the others of its chain by its bytes, so
that different texts of one hash stay separate entries. Owner tasks write the entries of whole buckets, sorted, as the
index; a document looks its text up in the bucket that the directory names for its hash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, written
from folioscope.session import cut


@dataclass(frozen=True)
class IndexSpec:
    """capacity: hashes of a bucket before it splits. max_depth: bound of the directory, 2^max_depth cells.
    mark_bits: bound of the prefixes that mark where chains are; 2^(mark_bits - 6) words at most are broadcast.

    Both are bounds of what is broadcast: `sized` takes what the counts need. Where they would need more, buckets hold
    more hashes, and more texts that stand alone are shuffled; nothing is lost."""

    capacity: int = 1 << 12
    max_depth: int = 20
    mark_bits: int = 28

    def sized(self, hashes: int, chains: int) -> IndexSpec:
        """For so many hashes, so many of them with chains: a directory deep enough, and marks of which a sixteenth is set."""
        capacity = max(self.capacity, -(-hashes >> max(0, self.max_depth - 3)))
        depth = (-(-hashes // capacity)).bit_length() + 3
        return replace(self, capacity=capacity, max_depth=min(self.max_depth, depth), mark_bits=min(self.mark_bits, max(8, chains.bit_length() + 4)))


def prefix(h: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash as a number from 0."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def normalised(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def marked(rows: DataFrame, hashes: DataFrame, bits: int) -> DataFrame:
    """Rows whose h begins as one of the hashes does: a filter of a fixed size that lets no wanted row go.

    The prefixes are bits of at most 2^(bits - 6) words, which are broadcast."""
    at = prefix(F.col("h"), bits)
    words = hashes.select(F.shiftright(at, 6).alias("__word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 as int))" % (64 - bits)).alias("bit"))
    words = words.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    found = rows.withColumn("__word", F.shiftright(at, 6)).join(F.broadcast(words), "__word")
    return found.where(F.expr("(shiftrightunsigned(__bits, cast(shiftrightunsigned(h, %d) & 63 as int)) & 1) = 1" % (64 - bits))).drop("__word", "__bits")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: IndexSpec = IndexSpec()) -> tuple[IndexSpec, DataFrame, DataFrame]:
    """(spec, hashes, entries). spec: as the counts need it. hashes: h, n. entries, one row per distinct normalised text: h, digest, keep_id (largest id), group_size.

    Grouping a chain by its texts is the byte comparison. Copies combine before the shuffle, so a text that a third of
    all rows share sends one row per map task; a text whose hash stands alone isn't shuffled."""
    norm = normalised(text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("digest"))
    hashes = cut(slim.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"), F.min("digest").alias("digest")))
    counts = hashes.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") > 1).alias("chains")).first()
    spec = spec.sized(counts["all"], counts["chains"])
    chains = hashes.where("n > 1").select("h")
    texts = marked(docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm")), chains, spec.mark_bits)
    groups = texts.groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chained = groups.select("h", F.sha2("norm", 256).alias("digest"), "keep_id", "group_size").join(chains, "h", "left_semi")
    alone = hashes.where("n = 1").select("h", "digest", "keep_id", F.lit(1).cast("long").alias("group_size"))
    return spec, hashes.select("h", "n"), alone.unionByName(chained)


def directory(index: DataFrame, spec: IndexSpec) -> DataFrame:
    """(cell, depth, bucket) for each of at most 2^max_depth cells that have entries.

    A bucket is a prefix of `depth` bits; depth grows from 0 until the entries under the prefix fit."""
    g = spec.max_depth
    cells = index.groupBy(prefix(F.col("h"), g).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # doubling: the same entries counted under each shorter prefix
    under = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(g))).alias("depth"))
    under = under.withColumn("bucket", F.expr(f"shiftright(cell, {g} - depth)"))
    full = under.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fits = under.join(full, ["depth", "bucket"]).where((F.col("held") <= spec.capacity) | (F.col("depth") == g))
    return fits.groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at")).select("cell", "at.depth", "at.bucket")


def located(rows: DataFrame, cells: DataFrame, spec: IndexSpec) -> DataFrame:
    """rows with depth and bucket, the place of their h."""
    return rows.withColumn("__cell", prefix(F.col("h"), spec.max_depth)).join(F.broadcast(cells.withColumnRenamed("cell", "__cell")), "__cell").drop("__cell")


def _indexed(docs: DataFrame, id_col: str, text_col: str, spec: IndexSpec) -> tuple[IndexSpec, DataFrame, DataFrame]:
    spec, hashes, found = entries(docs, id_col, text_col, spec)
    cells = cut(directory(hashes, spec).repartition(8))  # a bounded table: few files
    owned = located(found, cells, spec).repartition("depth", "bucket").sortWithinPartitions("depth", "bucket", "h", "digest")
    return spec, cells, written(owned.select("depth", "bucket", "h", "digest", "keep_id", "group_size"), "exact-index")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: IndexSpec = IndexSpec()) -> tuple[DataFrame, DataFrame]:
    """(cells, index). cells: the directory, at most 2^max_depth rows. index, files in the shared folder written bucket by
    bucket: depth, bucket, h, digest, keep_id, group_size."""
    return _indexed(docs, id_col, text_col, spec)[1:]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: IndexSpec = IndexSpec()) -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept and text_sha256; one row per row of docs.

    Null texts count as empty and so equal each other and empty texts. A null id never stays where another
    copy has an id. Of repeated rows (equal id and text) every one that has the largest id is marked kept; see
    `exact_dedup` for the filter that leaves one. Very long texts are compared whole. Columns of docs with these names
    are replaced. An empty table gives an empty result."""
    spec, cells, index = _indexed(docs, id_col, text_col, spec)
    index = index.where("group_size > 1").select("depth", "bucket", "h", F.col("digest").alias("text_sha256"), "keep_id", "group_size")
    own = ("keep_id", "group_size", "text_sha256", "depth", "bucket", "h")
    kept = [c for c in docs.columns if c == id_col.split(".")[0] or c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__doc"), F.xxhash64(normalised(text_col)).alias("h"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    found = located(rows, cells, spec).join(index, ["depth", "bucket", "h", "text_sha256"], "left")  # a hot text is split by the adaptive skew join
    found = found.select("__doc", *[F.col(c).alias(f"__{c}") for c in own])
    doc_id = F.col(f"__doc.{id_col}")
    keep = F.when(F.col("__group_size").isNull(), doc_id).otherwise(F.col("__keep_id"))
    return found.select("__doc.*", *[x.alias(n) for n, x in (
        ("keep_id", keep), ("group_size", F.coalesce("__group_size", F.lit(1).cast("long"))), ("kept", keep.eqNullSafe(doc_id)), ("text_sha256", F.col("__text_sha256")))])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: IndexSpec = IndexSpec()) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one per text, that with the largest id.

    Rows repeated under the same id and text leave one row."""
    packed = docs.select(F.struct(*docs.columns).alias("__all"), F.monotonically_increasing_id().alias("__row"))
    kept = exact_groups(packed, f"__all.{id_col}", f"__all.{text_col}", spec).where("kept")
    single = kept.where("group_size = 1").select("__all.*")
    tied = kept.where("group_size > 1").groupBy("text_sha256").agg(F.min_by("__all", "__row").alias("__all"))
    return single.unionByName(tied.select("__all.*"))
