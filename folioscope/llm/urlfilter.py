"""URL verdicts: rules by host and path first, gradient-boosted trees on lexical features for the rest.

Everything runs in the JVM: features are column expressions, the trees are Spark's own. Labelled URLs teach in
separate parts: one fold gives the statistics of suffixes, two fit the trees, and the held-out one measures.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import LOWER, UPPER, written
from folioscope.llm.linear import HELD_OUT_FOLD, fold
from folioscope.session import checkpoint_dir

SUFFIX_FOLD = 0


@dataclass(frozen=True)
class UrlFilterSpec:
    """trees, depth: of the ensemble; block_from: the score that blocks; suffixes: how many of the commonest have statistics
    of their own; prior: labelled URLs that a suffix's rate is shrunk by."""

    trees: int = 20
    depth: int = 4
    step: float = 0.1
    block_from: float = 0.5
    suffixes: int = 4096
    prior: float = 20.0
    seed: int = 17


@dataclass(frozen=True)
class UrlModel:
    """trees: None where the labels are of one class only; then share is every URL's score. suffixes: (suffix, seen, rate), at most
    spec.suffixes rows; rate: the share of bad ones among the URLs that taught suffixes."""

    trees: Model | None
    suffixes: DataFrame
    rate: float
    share: float
    spec: UrlFilterSpec


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's; null if none.

    rules: (verdict, rule), a rule being host/path as in net/. Of equally long ones that with the longer host stands,
    of the same rule twice the block."""
    parts = sorted({(len(r), r.partition("/")[0], r, v) for v, r in rules}, key=lambda x: (-x[0], -len(x[1]), x[2], x[3] != "block"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, name, rule, verdict in reversed(parts):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(rule[len(name):])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The host's last label, without a port."""
    return F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1)


def features(url: Column, seen: Column, rate: Column) -> dict[str, Column]:
    """Lexical features of a URL; a null one counts as empty. seen, rate: the statistics of its suffix."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.lit(1), F.length(u))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    share = lambda x: F.length(u) - F.length(F.replace(u, x))
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda s, x: F.when(x == "", s).otherwise(s - (share(x) / n) * F.log2(share(x) / n)))
    words = F.split(host, r"[.\-]")
    return {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "labels": F.size(F.split(host, r"\.")), "longest_word": F.array_max(F.transform(words, lambda x: F.length(x))),
        "digits": count(u, "[0-9]") / n, "host_digits": count(host, "[0-9]") / F.greatest(F.lit(1), F.length(host)), "upper": count(u, "[A-Z]") / n, "hyphens": count(host, "-"),
        "marks": count(u, r"[^A-Za-z0-9./:?&=#\-]") / n, "escapes": count(u, "%"), "entropy": entropy, "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "fragment": F.contains(u, F.lit("#")).cast("int"), "secure": F.startswith(F.lower(u), F.lit("https:")).cast("int"), "port": F.rlike(host, F.lit(":[0-9]+$")).cast("int"),
        "suffix_seen": F.log1p(seen), "suffix_rate": rate,
    }


def _assembled(rows: DataFrame, url: str, suffixes: DataFrame, base: float) -> DataFrame:
    """rows with the vector __features."""
    of = F.broadcast(suffixes.select(F.col("suffix").alias("__suffix"), F.col("seen").alias("__seen"), F.col("rate").alias("__rate")))  # at most spec.suffixes rows
    rows = rows.withColumn("__suffix", suffix_of(host_of(F.col(url)))).join(of, "__suffix", "left")
    columns = features(F.col(url), F.coalesce("__seen", F.lit(0.0)), F.coalesce("__rate", F.lit(base)))
    rows = rows.withColumns({f"__{c}": x.cast("double") for c, x in columns.items()})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__features").transform(rows).drop("__suffix", "__seen", "__rate", *[f"__{c}" for c in columns])


def fit(labelled: DataFrame, spec: UrlFilterSpec = UrlFilterSpec(), id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad") -> UrlModel:
    """Trains on all (id, url, bad) outside the held-out fold. Rows without an id or a label teach nothing."""
    checkpoint_dir(labelled.sparkSession)
    known = labelled.where(F.col(bad_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT_FOLD))
    known = written(known.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(bad_col).cast("double").alias("bad"), (fold(id_col) == SUFFIX_FOLD).alias("first")), "labelled-urls")
    got = known.agg(F.avg(F.when(F.col("first"), F.col("bad"))).alias("rate"), F.avg(F.when(~F.col("first"), F.col("bad"))).alias("share"), F.avg("bad").alias("all")).first()
    rate = got["rate"] if got["rate"] is not None else got["all"] or 0.0
    counts = known.where("first").groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count(F.lit(1)).cast("double").alias("seen"), F.sum("bad").alias("n_bad"))
    shrunk = (F.col("n_bad") + spec.prior * rate) / (F.col("seen") + spec.prior)
    suffixes = written(counts.orderBy(F.col("seen").desc(), "suffix").limit(spec.suffixes).select("suffix", "seen", shrunk.alias("rate")), "suffix-statistics")
    if got["share"] in (None, 0.0, 1.0):
        return UrlModel(None, suffixes, rate, got["all"] or 0.0, spec)
    taught = _assembled(known.where("NOT first"), "url", suffixes, rate).select("id", "bad", "__features")
    taught = taught.repartition("id").sortWithinPartitions("id", "bad")  # the same rows in the same order, whatever the input's files
    trees = GBTClassifier(featuresCol="__features", labelCol="bad", maxIter=spec.trees, maxDepth=spec.depth, stepSize=spec.step, seed=spec.seed, predictionCol="__label")
    trees = trees.setProbabilityCol("__p").setRawPredictionCol("__raw")
    return UrlModel(trees.fit(taught), suffixes, rate, got["share"], spec)


def scored(pages: DataFrame, model: UrlModel, url_col: str = "url") -> DataFrame:
    """pages with score, from 0 to 1: higher where the URL is likelier bad."""
    pages = pages.drop("score")
    if model.trees is None:
        return pages.withColumn("score", F.lit(float(model.share)))
    out = model.trees.transform(_assembled(pages, url_col, model.suffixes, model.rate))
    return out.withColumn("score", vector_to_array(F.col("__p"))[1]).drop("__features", "__p", "__raw", "__label")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, url_col: str = "url") -> DataFrame:
    """All columns of pages plus host, path, rule, score and verdict (allow or block); one row per row of pages.

    The longest rule that fits decides, else the trees: they block from spec.block_from on. Null and empty urls have an
    empty host and path, fit no rule and are scored as the empty text; very long ones are read whole; repeated rows are
    judged each. Columns of pages with these names are replaced. An empty table gives an empty result; labels of one
    class give every URL the same score, none at all the score 0. Rules are tried one after the other on every
    row: a list of some hundreds."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score") and c != url_col]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url_col).alias("__url"))
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    rows = scored(rows, model, "__url").withColumns({"host": host, "path": path, "__rule": rule_of(host, path, rules)})
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= model.spec.block_from, "block").otherwise("allow"))
    return rows.select(*kept, F.col("__url").alias(url_col), "host", "path", F.col("__rule.rule").alias("rule"), "score", verdict.alias("verdict"))
