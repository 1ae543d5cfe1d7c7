"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on toxic and one on ordinary text. Trained on raw windows both would
mostly hold what the classes share, so the trainer is shown the shared part first (a dictionary of windows of both
classes, which both compressors begin with) and then, for each class, only those bytes of its texts that the other class
doesn't have as often. A text is cut into windows of a few words; each window's length after the ordinary dictionary less
that after the toxic one is what toxicity saves. Which savings make a document toxic is calibrated across folds: every
calibrating document is measured by dictionaries that other documents trained.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.linear import HELD_OUT_FOLD, Logistic, fit_logistic, fold, hashed_sample
from folioscope.session import cut, ship_package


@dataclass(frozen=True)
class ToxicitySpec:
    """The fit reads at most sample_docs labelled documents of each class; of a longer document, sample_words words in
    ten pieces spread evenly over it. Texts that mostly repeat others of their class don't teach: see distinct_texts."""

    sample_docs: int = 2500
    sample_words: int = 4000
    window_words: int = 4
    shared_bytes: int = 512
    own_bytes: int = 1024
    folds: int = 3
    threshold: float = 0.3
    seed: int = 7


# Every window begins with this text, which both dictionaries end with: a window always has something to match, so
# zstandard never stores it raw and each further match counts.
LEAD = b" folioscope window lead of forty bytes or so "
# A-Z to a-z; what is neither an ASCII letter nor part of a longer character to a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def windows(words: list[bytes], size: int) -> list[bytes]:
    return [LEAD + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """For short inputs after the given text, parsed for the least length; the tables are large enough that no part is forgotten."""
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=13, chain_log=13, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """zstandard's trained dictionary of the samples, exactly `size` bytes with zeros before it; zeros alone where its trainer
    finds too little to learn from (a class without habits of its own)."""
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < 8:
        return bytes(size)
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=GRAM).as_bytes().rjust(size, b"\0")
    except zstandard.ZstdError:
        return bytes(size)


def distinct_texts(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Texts of which at most half of all three words in a row stood in one before; else copies would pass for habits of speech."""
    seen: set[int] = set()
    out = []
    for ws in texts:
        own = {hash((ws[i], ws[i + 1], ws[i + 2])) for i in range(len(ws) - 2)}
        if len(ws) < 3 or len(own & seen) <= 0.5 * len(own):
            out.append(ws)
        seen |= own
    return out


def surprise(n: int, expected: float) -> float:
    """-log10 of the chance of n or more events where so many are expected (Poisson, bounded from above)."""
    if n <= expected:
        return 0.0
    return (expected - n * math.log(expected) + math.lgamma(n + 1) + math.log(1 - expected / (n + 1))) / math.log(10)


GRAM = 6  # bytes; what the trainer counts, too


def _spelled(ws: list[bytes]) -> bytes:
    return b"".join(b" " + w + b" " for w in ws)


def grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each run of GRAM bytes within a word and the blanks round it, as a number, and its place in the spelled words."""
    raw = np.frombuffer(_spelled(ws), dtype=np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        g = (g << np.uint64(8)) | raw[i : n + i]
    gaps = np.concatenate([[0], np.cumsum((raw[:-1] == 32) & (raw[1:] == 32))])
    inside = gaps[:n] == gaps[GRAM - 1 :]
    return g[inside], np.flatnonzero(inside)


def document_counts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(grams(ws)[0]) for ws in texts]
    return np.unique(np.concatenate(each) if each else np.zeros(0, dtype=np.uint64), return_counts=True)


def own_grams(texts: list[list[bytes]], others: list[list[bytes]], least: float = 8.0) -> np.ndarray:
    """Grams in more of the texts than the others' smoothed share allows, by `least` decimal digits against chance."""
    (here, n), (there, m) = document_counts(texts), document_counts(others)
    at = np.searchsorted(there, here)
    known = at < len(there)
    known[known] = there[at[known]] == here[known]
    expected = np.ones(len(here))
    expected[known] += m[at[known]]
    expected *= len(texts) / max(1, len(others))
    some = np.flatnonzero((n >= 3) & (n > expected))
    return here[[i for i in some.tolist() if surprise(int(n[i]), float(expected[i])) >= least]] if len(some) else here[:0]


def stretches(ws: list[bytes], keep: np.ndarray) -> bytes:
    """The bytes of a text that grams of `keep` cover."""
    g, place = grams(ws)
    covered = np.zeros(sum(map(len, ws)) + 2 * len(ws), dtype=bool)
    for p in place[np.isin(g, keep)].tolist():
        covered[p : p + GRAM] = True
    return np.frombuffer(_spelled(ws), dtype=np.uint8)[covered].tobytes()


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes  # the shared dictionary and that of ordinary text
    toxic: bytes
    calibration: Logistic
    window_words: int
    nothing: float = 0.0  # the score of texts none of whose windows saves a byte

    def savings(self, texts: Iterable[list[bytes]]) -> Iterable[np.ndarray]:
        """Per text, how much longer each window is after the ordinary dictionary than after the toxic one."""
        plain, toxic = compressor(self.ordinary).compress, compressor(self.toxic).compress
        for ws in texts:
            yield np.array([len(plain(w)) - len(toxic(w)) for w in windows(ws, self.window_words)] or [0])

    def features(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        """Per text the largest saving, the mean of the three largest, the log of how many are 3 or more, and the log of the windows."""
        rows = [(s.max(), np.sort(s)[-3:].sum() / 3, np.log1p((s >= 3).sum()), np.log(len(s))) for s in self.savings(texts)]
        return np.array(rows, dtype=float).reshape(len(rows), 4)

    def score(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        x = self.features(texts)
        return np.where(x[:, 0] > 0, self.calibration(x), self.nothing) if len(x) else np.zeros(0)


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]], share: float, spec: ToxicitySpec) -> ToxicityModel:
    """share: of toxic texts among all, which the calibration is weighted to."""
    flat = Logistic(np.zeros(4), np.ones(4), np.zeros(4), 0.0)

    def model(t: list[list[bytes]], o: list[list[bytes]]) -> ToxicityModel:
        shown = [x for pair in zip(t, o) for x in pair]  # as many texts of either class
        shared = trained([b" ".join(ws[i : i + 8]) + b" " for ws in shown for i in range(0, len(ws), 8)], spec.shared_bytes, 64)
        own = [trained([stretches(ws, keep) for ws in mine], spec.own_bytes, 16) for mine, keep in ((t, own_grams(t, o)), (o, own_grams(o, t)))]
        return ToxicityModel(shared + own[1], shared + own[0], flat, spec.window_words)

    x, y = [], []
    for k in range(spec.folds):
        rest = [[ws for i, ws in enumerate(c) if i % spec.folds != k] for c in (toxic, ordinary)]
        part = [[ws for i, ws in enumerate(c) if i % spec.folds == k] for c in (toxic, ordinary)]
        x.append(model(*rest).features(part[0] + part[1]))
        y += [1.0] * len(part[0]) + [0.0] * len(part[1])
    x, y = np.vstack(x), np.array(y)
    both = len(y) and 0 < y.mean() < 1
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) if both else np.ones(len(y))
    # without evidence, the share of toxic texts among those of the sample without any; the fit would extrapolate
    w = np.where(x[:, 0] > 0, 0.0, weight)
    return replace(model(toxic, ordinary), calibration=fit_logistic(x, y, weight), nothing=float(((w * y).sum() + share) / (w.sum() + 1)))


def _pieces(spec: ToxicitySpec):
    """For mapInPandas over (doc_id, text, toxic): the words that the fit reads."""

    def read(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            out = []
            for text in pdf["text"]:
                ws = words_of(text)
                if len(ws) > spec.sample_words:
                    step = spec.sample_words // 10
                    ws = [w for at in np.linspace(0, len(ws) - step, 10).astype(int).tolist() for w in ws[at : at + step]]
                out.append(b" ".join(ws))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": out})

    return read


def _trainer(spec: ToxicitySpec, share: float):
    """For mapInPandas in one task over the sample's words: the pickled model."""

    def read(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        rows = sorted({(int(d), int(t), w) for pdf in it for d, t, w in zip(pdf["doc_id"], pdf["toxic"], pdf["words"])}, key=lambda r: (r[2], r[0]))
        np.random.default_rng(spec.seed).shuffle(rows)
        of = {c: distinct_texts([w.split() for _, t, w in rows if t == c]) for c in (0, 1)}
        yield pd.DataFrame({"model": [pickle.dumps(train(of[1], of[0], share, spec))]})

    return read


def fit(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec(), id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Trains in one task on labels outside the held-out fold. Rows labelled twice count as toxic if either says so."""
    known = labels.where((F.coalesce(fold(), F.lit(HELD_OUT_FOLD)) != HELD_OUT_FOLD) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    chosen = hashed_sample(known.where("toxic = 1"), spec.sample_docs, spec.seed).unionByName(hashed_sample(known.where("toxic = 0"), spec.sample_docs, spec.seed))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(cut(chosen)), "doc_id")  # at most 2 * sample_docs rows
    words = texts.select("doc_id", "text", "toxic").mapInPandas(_pieces(spec), "doc_id long, toxic int, words binary")
    share = n.get(1, 0) / max(1, sum(n.values()))
    return pickle.loads(words.repartition(1).mapInPandas(_trainer(spec, share), "model binary").first()["model"])


def classify(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs; whole texts are scored.

    Null and empty texts score as texts whose windows save nothing: the share of toxic ones among such. Without
    labels of both classes all scores are the share of toxic ones. Very long texts are scored whole, a window at a
    time; repeated rows score alike; of docs only id and text are read, so no other column's name can clash. An empty
    table gives an empty result."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels, spec, id_col, text_col)

    def score(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.score([words_of(t) for t in part["text"]])})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInPandas(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))
