"""A folder of books as a data source: spark.read.format("books").load(folder), once `register` was called.

Rows are (path, ext, mtime, fsize, sha256, content). Options choose files by the listing, so the content of others is never
read: only (a JSON list of paths), modifiedAfter and modifiedBefore (seconds since 1970, both ends left out). With content=false none
is read, and sha256 and content are null. Filters aren't pushed to it: the Spark this was built on keeps a reader with the
filters of one query and gives it to the next one of the same DataFrame, which then lacks rows. Files are read in partitions of about option("partitionBytes") bytes; empty files are rows too, which a scan of binary files leaves out. Any file system that pyarrow.fs knows serves as a folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.sources.files import EXTENSIONS, IGNORED_NAMES

SCHEMA = "path string, ext string, mtime double, fsize long, sha256 string, content binary"


def is_book(name: str) -> bool:
    low = name.lower()
    return low.endswith(EXTENSIONS) and not low.startswith("~$") and low not in IGNORED_NAMES


@dataclass
class Files(InputPartition):
    """(path, ext, mtime, fsize) of the files that a task reads."""

    files: list[tuple[str, str, float, int]]


class BookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.content = options["path"], options.get("content", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.paths = set(json.loads(options["only"])) if "only" in options else None
        self.after, self.before = float(options.get("modifiedAfter", "-inf")), float(options.get("modifiedBefore", "inf"))

    def partitions(self) -> list[InputPartition]:
        """Files by path, as many to a partition as its bytes allow; a file that is larger has one of its own."""
        from pyarrow import fs

        system, root = _located(self.folder)
        infos = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and is_book(i.base_name)]
        rows = sorted((i.path, "." + i.extension.lower(), i.mtime_ns // 1_000_000 / 1e3, i.size) for i in infos)
        out: list[InputPartition] = []
        held = 0
        for row in rows:
            if self.after < row[2] < self.before and (self.paths is None or row[0] in self.paths):
                weight = row[3] if self.content else 256
                if not out or held + weight > self.partition_bytes:
                    out.append(Files([]))
                    held = 0
                out[-1].files.append(row)
                held += weight
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no file is left
            return
        system, _ = _located(self.folder)
        for path, ext, mtime, fsize in partition.files:
            raw = None
            if self.content:
                with system.open_input_stream(path) as f:
                    raw = f.read()
            yield path, ext, mtime, fsize, None if raw is None else hashlib.sha256(raw).hexdigest(), raw


def _located(folder: str):
    """File system and path of a folder's name or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("name the folder of books: load(folder)")
        return BookReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Books)


def changed(spark: SparkSession, folder: str, stored: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """The books of a folder, with their content, whose size or time isn't that of stored (path, mtime, fsize).

    The listing is compared as a join; only the paths that it leaves are read."""
    register(spark)
    old = stored.select("path", F.col("mtime").alias("was"), F.col("fsize").alias("held"))
    same = (F.col("fsize") == F.col("held")) & (F.abs(F.col("mtime") - F.col("was")) <= tolerance)
    listed = spark.read.format("books").option("content", "false").load(folder).select("path", "mtime", "fsize")
    new = [r["path"] for r in listed.join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path").collect()]  # a part of what the source lists
    return spark.read.format("books").option("only", json.dumps(new)).load(folder)
