"""Quality classifier by co-training of two views.

One view reads the text: how kinds of characters follow each other and how words and lines repeat. The other sees
the page's metadata columns only: language, source and stated length. Both learn from labelled documents; over
rounds each labels the unlabelled ones it is surest of for the other. Their calibrated outputs are then combined.
Features are computed where the texts are, and one task trains on the sample's features; the driver gets the model.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.linear import HELD_OUT_FOLD, Logistic, fit_logistic, fold, hashed_sample
from folioscope.session import cut, ship_package


@dataclass(frozen=True)
class CoTrainSpec:
    """The fit reads at most labelled and pool documents, whole."""

    labelled: int = 4000
    pool: int = 4000
    rounds: int = 3
    per_round: int = 300
    sure: float = 0.95
    threshold: float = 0.5
    seed: int = 11


def _kinds() -> np.ndarray:
    """The kind of each byte, 0 to 15: letters by case, digits, blanks, line ends, bytes of longer characters, punctuation by groups."""
    kind = np.full(256, 15, dtype=np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"-", "#*$%&", "|<>", "{}[]()=;", "@/\\_~^`+", ":"]
    for i, g in enumerate(groups):
        kind[list(g.encode())] = i
    kind[128:] = 14
    return kind


_KIND = _kinds()
_SOURCES, _LANGS = 32, 8
_TEXT, _METADATA = 262, 3 + _LANGS + _SOURCES


def text_view(texts: Iterable[str | None]) -> np.ndarray:
    """Shares of the 256 pairs of adjoining kinds, and of words and lines that aren't new; mean length of words."""
    out = []
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        k = _KIND[np.frombuffer(raw, dtype=np.uint8)].astype(np.int64)
        pairs = np.bincount(k[:-1] * 16 + k[1:], minlength=256) / max(1, len(k) - 1) if len(k) > 1 else np.zeros(256)
        ws, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n = max(1, len(ws))
        phrases = [hash((ws[i], ws[i + 1], ws[i + 2])) for i in range(len(ws) - 2)]
        repeats = 1 - len(set(phrases)) / max(1, len(phrases)) if phrases else 0.0
        twins = sum(a == b for a, b in zip(ws, ws[1:])) / n
        out.append(np.concatenate([np.sqrt(pairs), [repeats, twins, 1 - len(set(lines)) / max(1, len(lines)), min(sum(map(len, ws)) / n, 50), np.log1p(len(ws)), 1 - len(set(ws)) / n]]))
    return np.array(out).reshape(len(out), _TEXT)


def metadata_view(lengths: Iterable[float | None], langs: Iterable[str | None], sources: Iterable[str | None]) -> np.ndarray:
    """The stated length (its logarithm and square, or that none is stated); language and source in hashed cells."""
    out = []
    for n, lang, source in zip(lengths, langs, sources):
        row = np.zeros(_METADATA)
        known = n is not None and n == n
        row[:3] = (np.log1p(max(0.0, n)), np.log1p(max(0.0, n)) ** 2, 0.0) if known else (0.0, 0.0, 1.0)
        row[3 + zlib.crc32(str(lang).encode()) % _LANGS] = 1
        row[3 + _LANGS + zlib.crc32(str(source).encode()) % _SOURCES] = 1
        out.append(row)
    return np.array(out).reshape(len(out), _METADATA)


@dataclass(frozen=True)
class CoTrained:
    text: Logistic
    metadata: Logistic
    combined: Logistic  # of the two views' logits, each calibrated first
    text_scale: Logistic
    metadata_scale: Logistic

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0)
        return self.combined(np.stack([self.text_scale.logit(self.text.logit(a)[:, None]), self.metadata_scale.logit(self.metadata.logit(b)[:, None])], axis=1))


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray, spec: CoTrainSpec) -> CoTrained:
    """y: 1 for good. A third of the labelled rows calibrates and combines; it trains neither view."""
    own = np.arange(len(y)) % 3 != 0
    data = {"text": [a[own], y[own]], "metadata": [b[own], y[own]]}
    pool, left = {"text": pool_a, "metadata": pool_b}, np.arange(len(pool_a))
    views = {v: fit_logistic(x, t, ridge=3.0) for v, (x, t) in data.items()}
    for _ in range(spec.rounds):
        taken: set[int] = set()
        for v, other in (("text", "metadata"), ("metadata", "text")):
            if not len(left):
                break
            p = views[v](pool[v][left])
            order = np.argsort(-np.abs(p - 0.5), kind="stable")
            for label in (0, 1):  # as the labelled rows divide, at most per_round
                quota = max(1, round(spec.per_round * (np.mean(y == label) if len(y) else 0.5)))
                ids = [i for i in order if (p[i] >= 0.5) == bool(label) and max(p[i], 1 - p[i]) >= spec.sure][:quota]
                data[other][0] = np.vstack([data[other][0], pool[other][left[ids]]])
                data[other][1] = np.concatenate([data[other][1], np.full(len(ids), float(label))])
                taken.update(int(left[i]) for i in ids)
        left = np.array([i for i in left if i not in taken], dtype=int)
        views = {v: fit_logistic(x, t, ridge=3.0) for v, (x, t) in data.items()}
    back, t = ~own, y[~own]
    la, lb = views["text"].logit(a[back])[:, None], views["metadata"].logit(b[back])[:, None]
    sa, sb = fit_logistic(la, t), fit_logistic(lb, t)
    both = fit_logistic(np.stack([sa.logit(la), sb.logit(lb)], axis=1), t)
    return CoTrained(views["text"], views["metadata"], both, sa, sb)


def _features(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "a": list(text_view(pdf["text"])), "b": list(metadata_view(pdf["length"], pdf["lang"], pdf["source"]))})


def _trainer(spec: CoTrainSpec):
    """For mapInPandas in one task over the sample's features: the pickled model."""

    def train(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "quality": pd.Series(dtype="int32"), "a": [], "b": []}), *it])
        rows["first"] = [float(x[:-1].sum()) for x in rows["a"]]  # a fixed order where ids repeat
        rows = rows.sort_values(["doc_id", "quality", "first"], kind="stable")
        stack = lambda x, width: np.array(x.tolist(), dtype=float).reshape(len(x), width)
        of = [(stack(part["a"], _TEXT), stack(part["b"], _METADATA)) for part in (rows[rows["quality"] >= 0], rows[rows["quality"] < 0])]
        model = co_train(*of[0], rows.loc[rows["quality"] >= 0, "quality"].to_numpy(dtype=float), *of[1], spec)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    return train


def _slim(docs: DataFrame, id_col: str, text_col: str, length_col: str) -> DataFrame:
    has = set(docs.columns)
    of = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[of(c, "string").alias(c) for c in ("lang", "source")], of(length_col, "double").alias("length"))


def fit(docs: DataFrame, labels: DataFrame, spec: CoTrainSpec = CoTrainSpec(), id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> CoTrained:
    """Trains on labels outside the held-out fold and, as pool, documents without a label. Of two labels the better holds."""
    known = cut(labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))
    learn = hashed_sample(known.where(F.coalesce(fold(), F.lit(HELD_OUT_FOLD)) != HELD_OUT_FOLD), spec.labelled, spec.seed)
    slim = _slim(docs, id_col, text_col, length_col)
    pool = hashed_sample(slim.select("doc_id").where("doc_id IS NOT NULL").join(known, "doc_id", "left_anti"), spec.pool, spec.seed).withColumn("quality", F.lit(-1))
    chosen = F.broadcast(cut(learn.select("doc_id", "quality").unionByName(pool)))  # at most labelled + pool rows
    features = slim.join(chosen, "doc_id").mapInPandas(_features, "doc_id long, quality int, a array<double>, b array<double>")
    return pickle.loads(features.repartition(1).mapInPandas(_trainer(spec), "model binary").first()["model"])


def classify(docs: DataFrame, labels: DataFrame, spec: CoTrainSpec = CoTrainSpec(), id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All columns of docs plus held_out, score (of good quality) and kept; one row per row of docs.

    Null texts count as empty, very long ones are read whole; null or absent lang, source and length are values of
    their own. Repeated rows are scored each, and a sampled id teaches with all of its rows. Columns of docs with
    these names are replaced. Without labels of both classes every score is the share of good ones, one half without
    any. An empty table gives an empty result."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels, spec, id_col, text_col, length_col)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, length: pd.Series) -> pd.Series:
        parts = [slice(i, i + 256) for i in range(0, len(text), 256)]
        out = [model(text_view(text.iloc[p]), metadata_view(length.iloc[p], lang.iloc[p], source.iloc[p])) for p in parts]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    out = docs.drop("held_out", "score", "kept")
    of = lambda c, kind: (F.col(c) if c in out.columns else F.lit(None)).cast(kind)
    scored = out.withColumn("score", score(F.col(text_col), of("lang", "string"), of("source", "string"), of(length_col, "double")))
    return scored.withColumns({"held_out": F.coalesce(fold(id_col) == HELD_OUT_FOLD, F.lit(False)), "kept": F.col("score") >= spec.threshold})
