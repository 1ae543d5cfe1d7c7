"""WARC archives of web captures, and the merge of their capture indexes.

Records are written by Spark's text writer, whose separator is the pair of line ends that closes a record. Each
archive read back gives a run of index entries, sorted by URL key and time. Runs meet in tasks that own a range
of keys, each in its own order; there a loser tree merges them, so the tasks' outputs in order are the global capture
history.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import shared_path, written
from folioscope.session import cut, ship_package

ENTRY = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, record_no long"
RUN = ENTRY + ", position long"  # the entry's place in its run
ORDER = ["urlkey", "captured", "page_id", "record_no"]
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: http://a.b.org:80/x -> org,b,a)/x. Scheme, user and port go."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url)
    if not m:
        return url.lower()
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def resolved(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, captured, refers_to (null: a response).

    Of equal payloads of at least least_bytes bytes, rows with a smaller id than the largest refer to it. A null
    payload is empty. Without a time column a capture's time is its id in seconds, so order is defined."""
    when = F.col(time_col) if time_col else F.timestamp_seconds(F.coalesce(F.col(id_col), F.lit(0)))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    long = rows.where(F.col("payload_bytes") >= least_bytes)
    heads = long.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(cut(heads), ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("head"), F.col("head"))).drop("head")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that aren't null, each with its line end."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in fields])


def record_text(software: str = "folioscope") -> Column:
    """A whole record but for the separator after it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes"))), F.lit(END))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")  # a header holds no control character
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(F.lit(f"WARC/1.1{END}"), _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", name("page_id")), ("WARC-Date", F.col("captured")),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, REVISIT)), ("WARC-Refers-To", F.when(revisit, name("refers_to"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block)),
    ), F.lit(END), block)


#: Payloads from this size on go to archives of their own, so that an archive of many records stays below 256 MB.
LARGE_BYTES = 1 << 18


def write_archives(rows: DataFrame, path: str, records_per_file: int = 1000, large_per_file: int = 8) -> None:
    """Gzipped archives in path/small and path/large, of at most so many records each."""
    for name, some, most in (("small", rows.where(F.col("payload_bytes") < LARGE_BYTES), records_per_file), ("large", rows.where(F.col("payload_bytes") >= LARGE_BYTES), large_per_file)):
        some.select(record_text().alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, a step's worth at a time. A member that doesn't end is an error."""
    at = 0
    while at < len(content):
        gz = zlib.decompressobj(31)
        while not gz.eof:
            if at >= len(content):
                raise ValueError("the archive ends within a gzip member")
            part = content[at : at + step]
            yield gz.decompress(part)
            at += len(part) - len(gz.unused_data)


def records(content: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive; holds one record and a step at a time.

    An archive that ends anywhere but after a record's separator is an error."""
    parts, held, at = unzipped(content, step), bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while True:
        while (head := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(held) > at:
                    raise ValueError("the archive ends within a record's headers")
                return
        lines = held[at:head].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers, at = dict(x.split(": ", 1) for x in lines[1:]), head + 4
        size = int(headers["Content-Length"])
        while len(held) - at < size + 4:
            if not more():
                raise ValueError(f"the archive ends within {headers['WARC-Record-ID']}")
        if held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers['WARC-Record-ID']}: its block isn't as long as stated")
        yield headers, bytes(held[at : at + size])
        at += size + 4


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def index_entry(headers: dict[str, str], block: bytes) -> tuple:
    """The index fields of a record. A response's payload is measured and its digest must hold."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{headers['WARC-Record-ID']}: its payload isn't the one that was digested")
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    refers = headers.get("WARC-Refers-To")
    return url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind, _page(refers) if refers else None


def _sort_key(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0


_NAMES = [x.split()[0] for x in RUN.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_runs(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """For mapInPandas over (path, content): each archive's index entries as one sorted run."""
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            run = "/".join(path.rsplit("/", 2)[-2:])
            found = [(*index_entry(h, b), run, i) for i, (h, b) in enumerate(records(content))]
            found.sort(key=_sort_key)
            yield _frame([(*e, i) for i, e in enumerate(found)])


def loser_tree_merge(runs: list[list[tuple]], key=_sort_key) -> Iterator[tuple]:
    """Merges sorted runs. Inner nodes hold the loser of their match; a new head replays only its own path."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    end = (1,)
    heads = [(0, *key(r[0]), i) if r else end for i, r in enumerate(runs)]
    tree = [-1] * k  # tree[0]: the winner
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node] = winner
                winner = -1
                break
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while heads[w := tree[0]] is not end:
        yield runs[w][at[w]]
        at[w] += 1
        heads[w] = (0, *key(runs[w][at[w]]), w) if at[w] < len(runs[w]) else end
        node = (w + k) // 2
        while node > 0:
            if heads[tree[node]] < heads[w]:
                tree[node], w = w, tree[node]
            node //= 2
        tree[0] = w


def merge_range(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """For mapInPandas over a range of keys, rows run after run: the runs' pieces merged into one order. Holds the range."""
    runs, last = [], None
    for pdf in it:
        pdf = pdf.astype({"page_id": "Int64", "refers_to": "Int64"})
        for row in zip(*[[None if v is pd.NA else v for v in pdf[c].astype(object)] for c in _NAMES]):
            if row[7] != last:
                runs.append([])
                last = row[7]
            runs[-1].append(row)
    out = []
    for row in loser_tree_merge(runs):
        out.append(row)
        if len(out) == 20_000:
            yield _frame(out).drop(columns="position")
            out = []
    yield _frame(out).drop(columns="position")


def merge_runs(runs: DataFrame, entries_per_range: int = 100_000) -> DataFrame:
    """All entries (RUN's columns) in the order of URL key, time and id; a task holds the entries of its range only, about
    entries_per_range. Runs come in the order that their archives' readers gave them.

    Ranges cut through the captures of a hot URL, as time and id are part of the key."""
    parts = max(1, -(-runs.count() // entries_per_range))
    ranged = runs.repartitionByRange(max(parts, runs.sparkSession.sparkContext.defaultParallelism), *ORDER).sortWithinPartitions("run", "position")
    return ranged.mapInPandas(merge_range, ENTRY)


def capture_history(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the archives of pages under path (default: the shared folder), reads them back and merges their indexes.

    One row per record: ENTRY's columns. Rows without an id are responses, as no id compares with theirs; null payloads
    are empty; very long ones have archives of their own; an empty table gives an empty result; repeated rows are
    records each, those that repeat the largest id all responses. Of pages only the named columns are read."""
    spark: SparkSession = pages.sparkSession
    ship_package(spark)
    path = path or shared_path(spark, "warc")
    write_archives(resolved(pages, **columns), path)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{path}/*").select("path", "content")
    return merge_runs(written(files.mapInPandas(read_runs, RUN), "capture-runs"))
