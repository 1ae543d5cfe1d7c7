"""Keeping an index in step with a folder of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MTIME_TOLERANCE = 2.0  # seconds; a fixed value


def same_mtime(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= MTIME_TOLERANCE


def upsert_action() -> Column:
    """The action for a file on disk (mtime, fsize, sha256, profile, ext, chars) beside what is stored of it (old_mtime,
    old_fsize, old_sha256, old_profile, old_n_chunks; null if nothing is)."""
    usable = F.coalesce((F.coalesce("old_profile", F.lit("sentence")) == F.col("profile")) & (F.coalesce("old_n_chunks", F.lit(0)) > 0), F.lit(False))
    unchanged = (F.coalesce("old_fsize", F.lit(-1)) == F.col("fsize")) & same_mtime(F.col("mtime"), F.col("old_mtime"))
    known = F.col("old_profile").isNotNull() | F.col("old_sha256").isNotNull() | F.col("old_mtime").isNotNull()
    blank = (F.col("chars") == 0) & F.col("ext").isin(".pdf", ".epub")
    return (F.when(known & usable & F.coalesce(unchanged, F.lit(False)), "SKIP")
            .when(known & usable & F.coalesce(F.col("old_sha256") == F.col("sha256"), F.lit(False)), "TOUCH")
            .when(blank, "ERROR").when(known, "REPLACE").otherwise("INSERT"))


def upsert_actions(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) for files on disk (path, mtime, fsize, sha256, profile, ext, chars) against stored documents
    (path, mtime, fsize, sha256, profile, n_chunks): SKIP, TOUCH, REPLACE, INSERT or ERROR.

    A file is skipped by size, time, profile and chunks, touched if only its time changed, and in error if it is
    a PDF or e-book without text that must be read."""
    old = stored.select("path", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "fsize", "sha256", "profile", "n_chunks")])
    return disk.join(old, "path", "left").select("path", upsert_action().alias("action"))


def purge_missing(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored documents whose file is still on disk."""
    return stored.join(disk.select("path").distinct(), "path", "left_semi")


def delete_document(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents of gone (doc_id), and without what hangs on their chunks."""
    documents, chunks = (tables[t].join(gone.select("doc_id"), "doc_id", "left_anti") for t in ("documents", "chunks"))
    out = {"documents": documents, "chunks": chunks}
    live = chunks.select("chunk_id")
    for name, keys in (("vectors", ["chunk_id"]), ("postings", ["chunk_id"]), ("edges", ["src", "dst"])):
        if name in tables:
            rows = tables[name]
            for k in keys:
                rows = rows.join(live.withColumnRenamed("chunk_id", k), k, "left_semi")
            out[name] = rows
    return out


def library_listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, path, title, n_chunks), also of documents without chunks."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return documents.join(counted, "doc_id", "left").select("doc_id", "path", "title", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def library_status(disk: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, n_chunks, status) of each file: indexed, empty or missing from the index."""
    known = listing.select("path", F.col("n_chunks").alias("held"))
    status = F.when(F.col("held").isNull(), "not indexed").when(F.col("held") == 0, "indexed without chunks").otherwise("indexed")
    return disk.select("path").join(known, "path", "left").select("path", F.coalesce("held", F.lit(0)).cast("long").alias("n_chunks"), status.alias("status"))


def in_scope(path: Column, root: str) -> Column:
    """Whether a path is the root or below it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def scoped_miss(ranked: DataFrame, root: str, first: int = 16) -> DataFrame:
    """(query_id, missed): a query has results, but none of its first `first` lies under the root."""
    top = ranked.where(F.col("rank") <= first)
    return top.groupBy("query_id").agg((~F.bool_or(in_scope(F.col("path"), root))).alias("missed"))


def metadata_json(title: Column, path: Column, ext: Column) -> Column:
    return F.to_json(F.struct(title.alias("doc_title"), path.alias("rel_path"), ext.alias("ext")))


def metadata(meta_json: Column) -> Column:
    """The fields of a metadata string; an empty map where it is null, blank or no JSON object."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.trim(F.coalesce(meta_json, F.lit(""))).startswith("{"), F.coalesce(F.from_json(meta_json, "map<string,string>"), empty)).otherwise(empty)


def contained(path: Column, root: str) -> Column:
    """Whether a path, once its . and .. are gone, is below the root, whatever it passes on its way."""
    steps = F.filter(F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)), r"[/\\\\]"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(walked, "/")).startswith("/" + root.strip("/") + "/")


def page(rows: DataFrame, limit: int, offset: int = 0, *order: str) -> DataFrame:
    """`limit` rows from the offset on, by the given columns."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def prompt_text(context_text: Column, text: Column) -> Column:
    """The context where it isn't blank, else the text."""
    bare = F.trim(F.coalesce(context_text, F.lit("")))
    return F.when(bare != "", bare).otherwise(text)


def fetch_in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the ids (query_id, pos, chunk_id), numbered by the ids' order; unknown ids give nothing."""
    return ids.join(rows, "chunk_id").select("query_id", "pos", "chunk_id", "path", "text")
