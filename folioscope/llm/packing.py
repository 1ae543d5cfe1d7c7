"""Sum-of-squares packing of tokenized documents into sequences of a fixed length.

Open bins are counted by the gap they have left. A piece goes where the sum of the squared counts grows least,
so no gap becomes common that later pieces can't fill. Pieces are dealt by hash into groups of a few thousand,
each packed by one task, longest first; a group's last, partly filled sequences are all that splitting costs.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut, ship_package

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
KEPT_WORDS = 1_000_000
_CONTROL = re.compile("[\x1c-\x1f]")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_SPECIAL = "<|"  # fixed value: how the vocabulary's special tokens begin


def is_plain(low: str) -> bool:
    """Whether a lower-case text has no special token, character beyond Latin ones, or control character that Python takes for a blank."""
    return _SPECIAL not in low and not _CONTROL.search(low) and (low.isascii() or not _BEYOND_LATIN.search(low))


def _latin_pieces() -> re.Pattern:
    """The vocabulary's pre-tokenizer for words in lower case of characters up to U+024F."""
    of = {c: "".join(chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^\\s{of['L']}{of['N']}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts as little-endian bytes. Words between blanks are encoded once and remembered.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text's ids are those of its words in
    order. Words of Latin letters are taken in lower case, cut into pre-tokens and these, far fewer, given to the
    vocabulary's model; words with other characters or special tokens go through the tokenizer as they are. At most
    about KEPT_WORDS words are remembered at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces, self.letters = _latin_pieces(), _byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def alone(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def learn(self, plain: set[str], other: set[str]) -> None:
        parts, known = self.parts, self.known
        for w in other:
            if is_plain(w.lower()):
                plain.add(w)
            else:
                known[w] = self.alone(w)
        for w in plain:
            found = self.pieces.findall(w.lower())
            for piece in found:
                if piece not in parts:
                    parts[piece] = self.part(piece)
            known[w] = parts[found[0]] if len(found) == 1 else b"".join([parts[x] for x in found])

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        split, words = [], {True: [], False: []}
        for t in texts:
            low = t.lower()
            plain = is_plain(low)  # then case makes no difference
            # str.split also parts words at four control characters that the tokenizer takes as text
            split.append(low.split() if plain else re.split(r"[\t-\r ]+", t) if _CONTROL.search(t) else t.split())
            words[plain].append(split[-1])
        every = {k: set().union(*v) for k, v in words.items()}
        new = {k: v.difference(self.known) for k, v in every.items()}
        if len(self.known) + len(self.parts) + sum(map(len, new.values())) > KEPT_WORDS:
            self.known.clear()
            self.parts.clear()
            new = every
        self.learn(new[True], new[False])
        for ws in split:
            yield b"".join(map(self.known.__getitem__, ws))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def piece_reader(path: str, end_id: int, capacity: int):
    """For mapInPandas: (doc_id, text) to one row per piece of at most `capacity` ids."""

    def read(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        words, end = encoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        for pdf in it:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            at = 0
            while at < len(ids):  # as many texts at a time as hold about 2 million characters
                stop, chars = at, 0
                while stop < len(ids) and chars < 2_000_000:
                    chars += len(texts[stop] or "")
                    stop += 1
                rows = []
                for doc_id, held in zip(ids[at:stop], words.encode_texts([t or "" for t in texts[at:stop]])):
                    held += end
                    for piece, start in enumerate(range(0, len(held) // 4, capacity)):
                        part = held[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = stop

    return read


def sum_of_squares(lengths: np.ndarray, capacity: int, bins: int | None = None) -> tuple[np.ndarray, int]:
    """The bin of each piece, in the order given, and the number of bins.

    With `bins`, a new bin may be opened while a fitting one is open, if that adds less to the sum of squares and
    fewer than so many exist; without, only when no open bin fits. Ties go to the smallest gap."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full ones aren't open
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = np.empty(len(lengths), dtype=np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            here = count[s:capacity]
            fit = np.flatnonzero(here)
            if fit.size:
                there = count[fit]  # counts at the gaps that would be left
                there[fit == 0] = -1  # closing a bin leaves none: -2N + 1, by halves below
                cost = 2 * (there - here[fit]) + 2 + (fit == 0)
                best = int(np.argmin(cost))
                if bins is None or n >= bins or cost[best] <= 2 * count[capacity - s] + 1:
                    gap = int(fit[best]) + s
        if gap == capacity:
            b, n = n, n + 1
        else:
            b = by_gap[gap].pop()
            count[gap] -= 1
        if gap > s:
            by_gap[gap - s].append(b)
            count[gap - s] += 1
        out[k] = b
    return out, n


def pack_group(capacity: int):
    """For applyInPandas: places the pieces of one group, longest first, by the better of both ways of opening bins."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        least = -(-int(lengths.sum()) // capacity)
        at, n = sum_of_squares(lengths, capacity)
        if n > least:
            at, n = min((at, n), sum_of_squares(lengths, capacity, least), key=lambda x: x[1])
        pdf["sequence_id"] = pdf["bin_group"].astype("int64") * (1 << 32) + at
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    A null text counts as empty and gives the end id alone. Only documents longer than a sequence are cut. Rows
    repeated under one id are packed each. An empty table gives an empty result."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(slim.mapInPandas(piece_reader(tokenizer or word_bpe_path(), end_id, capacity), PIECES))
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInPandas(pack_group(capacity), PIECES + ", sequence_id long, offset long")
