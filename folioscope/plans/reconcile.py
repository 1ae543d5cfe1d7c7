"""A library on disk, brought in step with a folder of files: documents, chunks, their index and graph as segments.

A batch writes one segment: the rows of its own files, what it takes away as dead chunks, and by how much the counts of
terms change. Nothing older is written again until segments of like size are merged. A version is a list of segments;
its marker comes last, so a job that is lost on the way leaves the version before as it was and can run again."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.functions.text import chunks as chunked
from folioscope.functions.text import trimmed
from folioscope.operators import graph, ingest, lexical
from folioscope.session import checkpoint_dir, cut, removed
from folioscope.sources import files as sources

DOCUMENTS = "doc_id long, path string, title string, ext string, mtime double, fsize long, sha256 string, profile string, n_chunks long"
FILES = "path string, ext string, mtime double, fsize long, sha256 string, title string, text string, error string"
CHUNKS = "chunk_id long, doc_id long, path string, title string, chunk_index int, text string, meta_json string"
EDGES = "src long, dst long, rel string, weight double"
REPORT = "path string, action string, n_chunks long, error string"
#: Tables of a segment. documents: home is the segment of a document's chunks, gone that it went; dead: chunks of older segments.
TABLES = {
    "documents": DOCUMENTS + ", home string, gone boolean", "chunks": CHUNKS, "edges": EDGES, "dead": "home string, chunk_id long",
    "postings": "term string, chunk_id long, tf long, positions array<int>", "lengths": "chunk_id long, dl long", "frequencies": "term string, df long", "totals": "n long, tokens long",
}
FANOUT = 4  # segments of one size class that are merged
LISTED = 200  # documents or chunks whose ids are pushed to a scan as a list, if they are no more


@dataclass(frozen=True)
class Segments:
    """names: the segments of a version, oldest first, with their number of chunks; dead: whether any chunk is."""

    spark: SparkSession
    root: str
    version: int = 0
    names: tuple[tuple[str, int], ...] = ()
    dead: bool = False

    def raw(self, table: str, only: list[str] | None = None) -> DataFrame:
        """A table's rows in all segments (or some), with their segment."""
        parts = [self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/segment-{n}/{table}").withColumn("segment", F.lit(n)) for n, _ in self.names if only is None or n in only]
        out = self.spark.createDataFrame([], TABLES[table] + ", segment string")
        for i, p in enumerate(parts):
            out = p if i == 0 else out.unionByName(p)
        return out

    def live(self, table: str, key: str = "chunk_id", only: list[str] | None = None) -> DataFrame:
        rows = self.raw(table, only)
        if not self.dead:
            return rows
        gone = self.raw("dead").select(F.col("home").alias("segment"), F.col("chunk_id").alias(key)).distinct()
        return rows.join(gone, ["segment", key], "left_anti")

    def latest(self) -> DataFrame:
        """Of each document the last row that was written of it."""
        order = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(self.names) for x in (n, i)]) if self.names else F.create_map(F.lit(""), F.lit(0))
        rows = self.raw("documents")
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), F.element_at(order, F.col("segment"))).alias("d")).select("doc_id", "d.*")

    def documents(self) -> DataFrame:
        return self.latest().where("NOT gone").select(*[x.split()[0] for x in DOCUMENTS.split(", ")], "home")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole versions below root, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_DONE")))


def segments(spark: SparkSession, root: str, version: int | None = None) -> Segments:
    """The segments of a version (default: the last), none if there is no version."""
    known = versions(spark, root)
    if not known:
        return Segments(spark, root)
    version = known[-1] if version is None else version
    rows = spark.read.schema("place int, name string, n_chunks long, dead boolean").parquet(f"{root}/version={version}/segments").orderBy("place").collect()  # a few for each size class
    return Segments(spark, root, version, tuple((r["name"], r["n_chunks"]) for r in rows), any(r["dead"] for r in rows))


def library(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """documents, chunks, edges and report of a version (default: the last); empty tables if there is none."""
    held = segments(spark, root, version)
    columns = lambda schema: [x.split()[0] for x in schema.split(", ")]
    report = spark.read.schema(REPORT).parquet(f"{root}/version={held.version}/report") if held.version else spark.createDataFrame([], REPORT)
    return {"documents": held.documents().drop("home"), "chunks": held.live("chunks").select(*columns(CHUNKS)), "edges": held.live("edges", "src").select(*columns(EDGES)), "report": report}


def library_index(spark: SparkSession, root: str, version: int | None = None) -> lexical.LexicalIndex:
    """The index of all live chunks: postings and lengths without dead ones, counts as the sums of what segments changed."""
    held = segments(spark, root, version)
    frequencies = held.raw("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = held.raw("totals").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
    return lexical.LexicalIndex(held.live("postings").drop("segment"), frequencies, held.live("lengths").drop("segment"), totals)


def _few(ids: DataFrame, column: str) -> Column:
    """A filter for a scan by ids, if they are few."""
    some = [r[0] for r in ids.select(column).limit(LISTED + 1).collect()]
    return F.col(column).isin(some) if len(some) <= LISTED else F.lit(True)


def _place() -> list[Column]:
    """Where a row of a Parquet table stands: its file and its number there."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _marks(places: DataFrame) -> DataFrame:
    """The places (_file, _row) as a bit for each row: 4 KB for up to 32,768 rows of a file."""
    at = F.col("_row") + 1  # their buckets begin at 1
    return cut(places.groupBy("_file", F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))


def _marked(table: DataFrame, marks: DataFrame) -> DataFrame:
    """The marked rows of a Parquet table. The marks are broadcast, so texts aren't shuffled, however many rows there are."""
    at = F.bitmap_bit_position(F.col("_row") + 1)
    rows = table.select("*", *_place()).withColumn("_bucket", F.bitmap_bucket_number(F.col("_row") + 1))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), ["_file", "_bucket"]).where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*table.columns)


def _dead(held: Segments, gone: DataFrame) -> DataFrame:
    """(home, chunk_id, text) of the chunks of documents that went (doc_id, home)."""
    if not held.names:
        return held.raw("chunks").select(F.col("segment").alias("home"), "chunk_id", "text")
    home = F.regexp_extract(F.col("_metadata.file_path"), "segment-([^/]+)/chunks/[^/]+$", 1)
    chunks = held.spark.read.schema(CHUNKS).parquet(*[f"{held.root}/segment-{n}/chunks" for n, _ in held.names]).where(_few(gone, "doc_id"))
    places = chunks.select("doc_id", home.alias("home"), *_place()).join(gone, ["doc_id", "home"], "left_semi")
    return _marked(chunks.select("*", home.alias("home")), _marks(places)).select("home", "chunk_id", "text")


def _aside(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, kept as Parquet until a version is done, so that what reads no text needn't."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counts(postings: DataFrame, lengths: DataFrame, gone: DataFrame, gone_lengths: DataFrame, span_chars: int) -> tuple[DataFrame, DataFrame]:
    """By how much the counts change: new postings and lengths, less those of the chunks that went (chunk_id, text; dl)."""
    old = lexical.build_index(gone, span_chars)
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(old.postings.groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).unionByName(gone_lengths.agg((-F.count(F.lit(1))).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("tokens")))
    return terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), totals.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


def _write(df: DataFrame, root: str, name: str, table: str, *order: str) -> None:
    columns = [x.split()[0] for x in TABLES[table].split(", ")]
    df = df.select(*columns)
    df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    df.write.mode("overwrite").parquet(f"{root}/segment-{name}/{table}")


def reconcile(spark: SparkSession, root: str, files: DataFrame, profile: str = "sentence", full: bool = True, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Brings the library below root in step with files (path, ext, mtime, fsize, sha256, title, text, error); returns the report.

    The report has a row for each file and for each document that went: path, action (SKIP, TOUCH, REPLACE, INSERT,
    ERROR or PURGE), n_chunks, error. A file in error leaves what was known of it. full: documents whose file isn't
    among files go; a batch of new files alone is reconciled with full=False. Of repeated paths the newest file counts.
    With config.graph the edges of new chunks are written; their keywords are weighed by the counts of that moment."""
    held = segments(spark, root)
    aside = f"{checkpoint_dir(spark).rstrip('/')}/reconcile-{uuid.uuid4().hex}"
    given = files.select(*[F.col(n).cast(t).alias(n) for n, t in map(str.split, FILES.split(", "))]).withColumns({"profile": F.lit(profile), "chars": F.coalesce(F.length(trimmed(F.col("text"))), F.lit(0))})
    files = _aside(given, f"{aside}/files")
    told = [c for c in files.columns if c not in ("path", "text")]
    newest = files.select("path", *told, *_place()).groupBy("path").agg(F.max_by(F.struct(*told, "_file", "_row"), F.struct("mtime", "sha256")).alias("f"))
    disk = newest.select("path", "f.*", F.lit(True).alias("found")).where("path IS NOT NULL OR error IS NOT NULL")
    known = [x.split()[0] for x in DOCUMENTS.split(", ") if not x.startswith("path ")]
    old = held.documents().select("path", *[F.col(c).alias(f"old_{c}") for c in [*known, "home"]])
    action = F.when(F.col("found").isNull(), "PURGE").when(F.col("error").isNotNull(), "ERROR").otherwise(ingest.upsert_action())
    decided = _aside(disk.join(old, "path", "full" if full else "left").withColumn("action", action), f"{aside}/actions")

    version, name = held.version + 1, str(held.version + 1)
    fresh_files = decided.where("action IN ('REPLACE', 'INSERT')")
    gone = decided.where("action IN ('REPLACE', 'INSERT', 'PURGE') AND old_doc_id IS NOT NULL").select(F.col("old_doc_id").alias("doc_id"), F.col("old_home").alias("home"))
    texts = _marked(files, _marks(fresh_files.select("_file", "_row"))).withColumn("doc_id", F.xxhash64("path"))
    parts = chunked(texts, profile, config.chunk_chars, config.chunk_overlap, carried=("path", "title", "ext", "sha256"))
    meta = ingest.metadata_json(F.col("title"), F.col("path"), F.col("ext"))
    parts = parts.select(F.xxhash64("path", "sha256", "chunk_index").alias("chunk_id"), "doc_id", "path", "title", "chunk_index", "text", meta.alias("meta_json"))
    _write(parts.sortWithinPartitions("doc_id", "chunk_index"), root, name, "chunks")
    fresh = spark.read.schema(CHUNKS).parquet(f"{root}/segment-{name}/chunks")
    dead = _dead(held, gone)
    _write(dead, root, name, "dead")
    dead_ids = spark.read.schema(TABLES["dead"]).parquet(f"{root}/segment-{name}/dead")

    counted = fresh.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    n_chunks = F.when(F.col("action").isin("REPLACE", "INSERT"), F.coalesce("n", F.lit(0)).cast("long")).otherwise(F.col("old_n_chunks"))
    now = decided.withColumn("doc_id", F.xxhash64("path")).join(counted, "doc_id", "left").withColumn("n_chunks", n_chunks)
    new = now.where("action IN ('REPLACE', 'INSERT')").withColumns({"home": F.lit(name), "gone": F.lit(False)})
    kept = now.where("action IN ('TOUCH', 'PURGE')").withColumn("old_mtime", F.when(F.col("action") == "TOUCH", F.col("mtime")).otherwise(F.col("old_mtime")))
    kept = kept.select("path", *[F.col(f"old_{c}").alias(c) for c in [*known, "home"]], (F.col("action") == "PURGE").alias("gone"))
    _write(new.select(*kept.columns).unionByName(kept), root, name, "documents")

    index = lexical.build_index(fresh, config.search_span_chars)
    lexical.write_postings(index, f"{root}/segment-{name}")
    read = lambda t: spark.read.schema(TABLES[t]).parquet(f"{root}/segment-{name}/{t}")
    dead_lengths = held.raw("lengths").join(dead_ids.withColumnRenamed("home", "segment"), ["segment", "chunk_id"], "left_semi")
    terms, totals = _counts(read("postings"), read("lengths"), dead.select("chunk_id", "text"), dead_lengths, config.search_span_chars)
    _write(terms, root, name, "frequencies", "term")
    _write(totals.coalesce(1), root, name, "totals")
    n_new, n_dead, n_rows = fresh.count(), dead_ids.count(), read("documents").count()
    after = replace(held, version=version, names=(*held.names, (name, n_new)) if n_rows else held.names, dead=held.dead or n_dead > 0)
    if config.graph:
        sums = after.raw("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        tagged = graph.tags_of(read("postings"), sums, after.raw("totals").agg(F.sum("n").alias("n")))
        edges = graph.merged_edges(graph.adjacent_edges(fresh), graph.keyword_edges(fresh, tagged))
    else:
        edges = spark.createDataFrame([], EDGES)
    _write(edges, root, name, "edges")
    blank = F.when(F.col("action") == "ERROR", F.coalesce("error", F.concat(F.lit("no text in "), "path")))
    report = now.select("path", "action", F.when(F.col("action") != "PURGE", F.col("n_chunks")).alias("n_chunks"), blank.alias("error"))
    out = _finished(_merged(after), report)
    removed(spark, aside)
    return out


def _merged(held: Segments) -> Segments:
    """The version with every FANOUT segments of one size class as one, as often as there are such."""
    k = 0
    while True:
        by_class: dict[int, list[str]] = {}
        for n, chunks in held.names:
            by_class.setdefault(int(math.log(max(1, chunks), FANOUT)), []).append(n)
        together = next((v for _, v in sorted(by_class.items()) if len(v) >= FANOUT), None)
        if together is None:
            return held
        k += 1
        held = _merge(held, together, f"{held.version}-{k}")


def _merge(held: Segments, together: list[str], name: str) -> Segments:
    """Writes what lives of some segments as a new one, which stands last: only rows that nothing later overrides go there."""
    spark, root = held.spark, held.root
    moved = F.col("home").isin(together)
    rows = held.latest().where(F.col("segment").isin(together) | moved).withColumn("home", F.when(moved, F.lit(name)).otherwise(F.col("home")))
    _write(rows, root, name, "documents")
    _write(held.raw("dead").where(~moved & F.col("segment").isin(together)), root, name, "dead")
    _write(held.live("chunks", only=together), root, name, "chunks", "doc_id", "chunk_index")
    _write(held.live("edges", "src", together), root, name, "edges")
    _write(held.live("postings", only=together), root, name, "postings", "term", "chunk_id")
    _write(held.live("lengths", only=together), root, name, "lengths")
    _write(held.raw("frequencies", together).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), root, name, "frequencies", "term")
    _write(held.raw("totals", together).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).coalesce(1), root, name, "totals")
    n = spark.read.parquet(f"{root}/segment-{name}/chunks").count()
    return replace(held, names=(*[x for x in held.names if x[0] not in together], (name, n)))


def _finished(held: Segments, report: DataFrame) -> DataFrame:
    """Writes the version's report, its list of segments and, last, its marker."""
    spark, at = held.spark, f"{held.root}/version={held.version}"
    report.select("path", "action", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "error").write.mode("overwrite").parquet(f"{at}/report")
    listed = [(i, n, c, held.dead) for i, (n, c) in enumerate(held.names)]
    spark.createDataFrame(listed, "place int, name string, n_chunks long, dead boolean").coalesce(1).write.mode("overwrite").parquet(f"{at}/segments")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_DONE")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    return library(spark, held.root)["report"]


def refresh(spark: SparkSession, root: str, folder: str, profile: str = "sentence", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Brings the library in step with a folder: sizes and times decide which files are read at all, hashes which are parsed."""
    stored = segments(spark, root).documents()
    listed = sources.list_files(spark, folder).withColumn("profile", F.lit(profile))
    no_hash = listed.withColumns({"sha256": F.lit(None).cast("string"), "chars": F.lit(1)})
    known = ingest.upsert_actions(no_hash, stored)
    unread = listed.join(known.where("action = 'SKIP'").select("path"), "path", "left_semi")
    found = sources.read_files(spark, [r["path"] for r in known.where("action <> 'SKIP'").select("path").collect()])  # a part of what the file index lists on the driver
    same = found.join(stored.where((F.col("n_chunks") > 0) & (F.coalesce("profile", F.lit("sentence")) == profile)).select("path", "sha256"), ["path", "sha256"], "left_semi").drop("content")
    parsed = sources.parse_files(found.join(same.select("path"), "path", "left_anti"))
    none = {"title": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    rows = parsed.unionByName(same.withColumns(none)).unionByName(unread.drop("profile").withColumns(none | {"sha256": F.lit(None).cast("string")}))
    return reconcile(spark, root, rows, profile, True, config)
