"""Normalising, splitting and chunking of document text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEAK_MARKS = "；;，,、"  # fixed values
SENTENCE_MARKS = "。！？.!?"
#: All that (?U)\s matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
AT_ONCE = 1 << 20  # characters of texts that are chunked together


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end (Spark's trim takes blanks only)."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, blanks single, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\x{3000}]{2,}|[\t\x{3000}]", " ")  # single blanks stay as they are
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """The parts between empty lines of a normalised text, each on one line."""
    parts = F.transform(F.split(normalize_text(text), "\n\n"), lambda p: trimmed(F.regexp_replace(trimmed(p), r"[\n\r\t]+", " ")))
    return F.filter(parts, lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Sentences of one paragraph: up to each run of 。！？ first, then what is left at blanks after . ! or ?.

    A trailing part without such an end stays whole. A lookbehind splits without taking the mark."""
    latin = lambda x: F.split(trimmed(x), r"\s(?<=[.!?]\s)\s*")
    parts = F.split(trimmed(paragraph), r"(?<=[。！？])(?![。！？])")  # linear, where a search for each sentence isn't
    wide = F.flatten(F.transform(parts, lambda x: F.when(x.rlike("[。！？]$"), F.array(x)).otherwise(latin(x))))
    each = F.when(paragraph.rlike("[。！？]"), wide).otherwise(latin(paragraph))
    return F.filter(F.transform(each, trimmed), lambda s: s != "")


def document_sentences(text: Column) -> Column:
    return F.flatten(F.transform(paragraphs(text), sentences))


#: Character references other than those that built-in functions replace.
OTHER_REFERENCE = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|#39);)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def _unescaped(texts: Column) -> Column:
    from html import unescape

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: unescape(t.replace("&nbsp;", " ")), na_action="ignore")

    return run(texts)


def html_to_text(html: Column) -> Column:
    """Visible text of a page: without script, style, noscript, nav and comments; tags part lines, each line trimmed.

    What is hidden and never closed hides the rest. Only texts with character references beyond the common ones
    go through Python."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|\z)", "")
    for tag in ("script", "style", "noscript", "nav"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    odd, plain = out.rlike(OTHER_REFERENCE), out
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    lines = F.filter(F.transform(F.split(F.when(odd, _unescaped(F.when(odd, out))).otherwise(plain), "\n"), trimmed), lambda x: x != "")
    return F.array_join(lines, "\n")


def fixed_chunks(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """Windows of size characters that begin every size - overlap ones."""
    n = F.length(text)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


# What follows is sequential: where a chunk ends depends on all that came before it in its document.

_WIDE_END = re.compile("(?<=[。！？])(?![。！？])")
_LATIN_END = re.compile(r"(?<=[.!?])\s+")


def _normalized(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t　]+", " ", re.sub(r"\r\n?", "\n", text))).strip()


def _paragraphs(text: str) -> list[str]:
    return [p for p in (re.sub(r"[\n\r\t]+", " ", x.strip()).strip() for x in _normalized(text).split("\n\n")) if p]


def _sentences(paragraph: str) -> list[str]:
    *wide, rest = _WIDE_END.split(paragraph)
    return [s for s in (x.strip() for x in [*wide, *([rest] if rest[-1:] in tuple("。！？") else _LATIN_END.split(rest.strip()))]) if s]


def split_long(sentence: str, size: int, overlap: int) -> Iterator[str]:
    """Parts of a sentence of more than size characters, each beginning overlap characters before the last one's end.

    A part ends after its last weak mark, if beyond a quarter of the size (40 characters at least); else after a
    sentence mark within its last 100 characters (not on its first); else at the size."""
    at, n = 0, len(sentence)
    while at < n:
        window = sentence[at : at + size]
        if at + size >= n:
            yield window
            return
        end = max((i + 1 for i in map(window.rfind, WEAK_MARKS) if i > max(40, size // 4)), default=0)
        end = end or max((i + 1 for i in map(lambda m: window.rfind(m, max(1, len(window) - 99)), SENTENCE_MARKS) if i >= 0), default=0)
        end = end or size
        yield window[:end]
        if at + end >= n:
            return
        at = max(at + end - overlap, at + 1)


def chunk_document(text: str | None, size: int = 900, overlap: int = 120) -> list[str]:
    """Chunks of whole sentences, of size characters at most; short paragraphs share a chunk, overlong sentences are split.

    Sentences are joined without the blank that parted them."""
    out: list[str] = []
    held = ""
    for p in _paragraphs(text or ""):
        whole = "".join(parts := _sentences(p))
        if len(both := f"{held}\n\n{whole}" if held else whole) <= size:
            held = both
            continue
        if held:
            out.append(held)
        packed: list[str] = []
        joining = False  # whether the last packed chunk may take more sentences
        for s in parts if len(whole) > size else [whole]:
            if joining and len(packed[-1]) + len(s) <= size:
                packed[-1] += s
            elif len(s) <= size:
                packed.append(s)
                joining = True
            else:
                packed += [x for x in (y.strip() for y in split_long(s, size, overlap)) if x]
                joining = False
        *full, held = packed or [""]
        out += full
    return [c for c in (x.strip() for x in [*out, held]) if c]


def hashed_encoder(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a sentence encoder: words hashed to signed cells, scaled to length 1."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * width
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % width] += 1.0 if h & 0x10000 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def chunk_semantic(text: str | None, size: int = 900, overlap: int = 120, percentile: float = 78.0, min_chunk: int = 150, encoder: Callable = hashed_encoder) -> list[str]:
    """Chunks that end where neighbouring sentences differ more than at `percentile` percent of places.

    Sentences at the end of a chunk, up to overlap characters or just beyond, begin the next one too. Documents of
    two sentences or fewer are chunked by size."""
    import numpy as np

    parts = [s for p in _paragraphs(text or "") for s in _sentences(p)]
    if len(parts) <= 2:
        return chunk_document(text, size, overlap)
    v = np.asarray(encoder(parts), dtype=float)
    gaps = 1.0 - (v[:-1] * v[1:]).sum(axis=1)
    turn = gaps >= np.percentile(gaps, max(55.0, min(99.5, percentile)))
    lengths, out, begin = [len(s) for s in parts], [], 0
    while begin < len(parts):
        end, held = begin + 1, lengths[begin]
        while end < len(parts) and held + lengths[end] <= size and not (held >= min_chunk and turn[end - 1]):
            held += lengths[end]
            end += 1
        out.append("".join(parts[begin:end]).strip())
        if end == len(parts):
            break
        back, again = end, 0
        while back > begin and again < overlap:
            back -= 1
            again += lengths[back]
        begin = max(begin + 1, back)
    return [x for c in out for x in (y.strip() for y in (split_long(c, size, overlap) if len(c) > size else [c])) if x]


def _chunked(split: Callable[[str | None], list[str]]):
    """For mapInArrow over (doc_id, text, ...): (doc_id, chunk_index, text, ...) of texts of about AT_ONCE characters at a time, so
    that a batch of long texts and its chunks are never held whole as Python strings. Further columns stand at each chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "chunk_index", "text", *batch.schema.names[2:]]
            rows, held = ([], [], []), 0
            for n in range(batch.num_rows):
                said = batch.column(1)[n].as_py()
                found = split(said)
                for column, values in zip(rows, ([n] * len(found), range(len(found)), found)):
                    column.extend(values)
                held += len(said or "")
                if held >= AT_ONCE or n + 1 == batch.num_rows:
                    of, index, texts = (pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int32(), pa.string())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), index, texts, *[c.take(of) for c in batch.columns[2:]]], names)
                    rows, held = ([], [], []), 0

    return run


def chunks(docs: DataFrame, strategy: str = "sentence", size: int = 900, overlap: int = 120, encoder: Callable = hashed_encoder, carried: Iterable[str] = (), **options) -> DataFrame:
    """(doc_id, chunk_index, text) of each document's chunks, by the sentence or the semantic strategy; carried: columns of docs
    that its chunks bear too, so that nothing need be joined to them."""
    split = (lambda t: chunk_semantic(t, size, overlap, encoder=encoder, **options)) if strategy in ("semantic", "embedding", "semantic_percentile") else (lambda t: chunk_document(t, size, overlap))
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(_chunked(split), "doc_id long, chunk_index int, text string" + more)
