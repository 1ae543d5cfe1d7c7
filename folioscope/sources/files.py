"""Files as sources: scans of folders, decoding, e-books, golden sets; and sinks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = (".epub", ".pdf", ".txt")
IGNORED_NAMES = ("requirements-kb.txt", "requirements.txt")
ENCODINGS = ("utf-8", "gb18030", "gbk", "big5")


def _books(files: DataFrame) -> DataFrame:
    """Files with ext and mtime, those alone that can be read and aren't to be ignored."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    found = files.withColumn("ext", F.regexp_extract(name, r"(\.[^.]*)$", 1)).where(F.col("ext").isin(*EXTENSIONS) & ~name.startswith("~$") & ~name.isin(*IGNORED_NAMES))
    return found.withColumn("mtime", F.unix_micros("modificationTime").cast("double") / 1e6)


def described(files: DataFrame) -> DataFrame:
    """(path, ext, mtime, fsize, sha256, content) of the readable books among files (path, modificationTime, length, content)."""
    return _books(files).select("path", "ext", "mtime", F.col("length").alias("fsize"), F.sha2("content", 256).alias("sha256"), "content")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, mtime, fsize) of the books below root: nothing of their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    return _books(files).select("path", "ext", "mtime", F.col("length").alias("fsize"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`described` files of given paths."""
    if not paths:
        return spark.createDataFrame([], "path string, ext string, mtime double, fsize long, sha256 string, content binary")
    plain = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", p) for p in paths]  # names, not patterns
    return described(spark.read.format("binaryFile").load(plain))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """`described` files below root, without hidden lock files. Rows have no order; orderBy("path") gives that of a sorted scan."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def library_root(named: str | None, remembered: str | None, default: str) -> str:
    """The folder of books: the first of both that is an existing folder, else the default."""
    for path in (named, remembered):
        if path and path.strip() and (place := Path(path.strip()).expanduser()).is_dir():
            return str(place.resolve())
    return default


def decode_text(raw: bytes) -> str:
    """The first encoding that reads all bytes; else UTF-8 without what it can't read."""
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "ignore")


class _Visible(HTMLParser):
    HIDDEN = ("script", "style", "noscript", "nav")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str) -> str:
    p = _Visible()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def read_epub(raw: bytes) -> tuple[str, str]:
    """(title, text): items in reading order, then documents that the order leaves out, parted by empty lines."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        title = next(((e.text or "").strip() for e in package.iter() if local(e) == "title" and (e.text or "").strip()), "Untitled")
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        pages = [i for i, e in items.items() if "html" in (e.get("media-type") or "")]
        order = [e.get("idref") for e in package.iter() if local(e) == "itemref" and e.get("idref") in items]
        texts = []
        for i in dict.fromkeys([*order, *pages]):
            place = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[i].get("href")))
            if i in pages and place in z.namelist() and (t := visible_text(z.read(place).decode("utf-8", "ignore"))):
                texts.append(t)
    return title, "\n\n".join(texts)


def read_pdf(raw: bytes) -> tuple[str, str]:
    """(no title, text) of a PDF's pages, parted by empty lines; needs a PDF reader to be installed. Its file's name is its title."""
    from pypdf import PdfReader

    pdf = PdfReader(io.BytesIO(raw))
    return "", "\n\n".join(p.extract_text() or "" for p in pdf.pages)


def parse_files(files: DataFrame) -> DataFrame:
    """Adds title, text and error to scanned files; a file that can't be read has an error and no text."""

    def run(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                stem = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    title, text = {".epub": read_epub, ".pdf": read_pdf}.get(r.ext, lambda b: ("", decode_text(b)))(bytes(r.content))
                    rows.append((r.path, r.ext, r.mtime, r.fsize, r.sha256, title or stem, text, None))
                except Exception as e:  # one bad file doesn't stop the others
                    rows.append((r.path, r.ext, r.mtime, r.fsize, r.sha256, stem, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ext", "mtime", "fsize", "sha256", "title", "text", "error"])

    return files.mapInPandas(run, "path string, ext string, mtime double, fsize long, sha256 string, title string, text string, error string")


GOLDEN = "question string, relevant_snippets array<string>, must_contain array<string>, reference string, ground_truth string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, snippets, reference) of a JSON-lines file; blank and # lines and rows without a question are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    as_list = lambda c: F.coalesce(F.from_json(F.get_json_object("value", f"$.{c}"), "array<string>"), F.when(F.get_json_object("value", f"$.{c}").isNotNull(), F.array(F.get_json_object("value", f"$.{c}"))))
    rows = lines.select(F.get_json_object("value", "$.question").alias("text"), F.coalesce(as_list("relevant_snippets"), as_list("must_contain"), F.array().cast("array<string>")).alias("snippets"),
                        F.coalesce(F.get_json_object("value", "$.reference"), F.get_json_object("value", "$.ground_truth")).alias("reference"))
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("query_id", F.xxhash64("text"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
