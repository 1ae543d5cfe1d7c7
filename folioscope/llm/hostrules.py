"""Quality rules per document, and verdicts on hosts from the rules' failures.

Every measure is a built-in expression over the whole text. A host's failure rate is shrunk towards the rate
of all hosts with a beta prior whose two parameters are fitted to the hosts by moments, so a host of three
documents isn't condemned by one failure. The prior also says which rates are out of the common: beyond them a host
is rejected. The verdict is then joined back to the host's documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACES
from folioscope.session import cut


@dataclass(frozen=True)
class HostRules:
    """min_words, max_repeat_percent: the base rules. A host is kept up to a shrunk failure rate of `spread` standard
    deviations of the prior above its mean, `times` the mean at least and max_rate at most."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    spread: float = 3.0
    times: float = 2.0
    max_rate: float = 0.5


def _words(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def measure(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """All columns of docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null text has no words. Windows are compared by a 64-bit hash over all of their words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.withColumns({"__words": _words(text), "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # hashes of 1 word, then of 2, 4, ... adjoining words, up to the window
    hashed = first.withColumn("__g", F.transform("__words", lambda w: F.xxhash64(w)))
    width = 1
    while width < window:
        step = min(width, window - width)
        hashed = hashed.withColumn("__g", F.when(F.size("__g") > step, F.zip_with(
            F.slice("__g", F.lit(1), F.size("__g") - step), F.slice("__g", F.lit(1 + step), F.size("__g") - step),
            lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
        width += step
    # only texts with a repeated window look for its places
    dup = hashed.withColumn("__twice", F.size(F.array_distinct("__g")) < F.size("__g"))
    dup = dup.withColumn("__sorted", F.when(F.col("__twice"), F.sort_array("__g")))
    dup = dup.withColumn("__again", F.expr("CASE WHEN __twice THEN array_distinct(filter(__sorted, (x, i) -> i > 0 AND x = __sorted[i - 1])) END"))
    dup = dup.withColumn("__again", F.expr("CASE WHEN __twice THEN map_from_arrays(__again, __again) END"))
    dup = dup.withColumn("__at", F.expr("CASE WHEN __twice THEN filter(transform(__g, (x, i) -> IF(map_contains_key(__again, x), i, NULL)), p -> p IS NOT NULL) END"))
    covered = F.expr(f"CASE WHEN __twice THEN {window} + aggregate(zip_with(__at, slice(__at, 2, size(__at)), (a, b) -> IF(b IS NULL, 0, least({window}, b - a))), 0, (s, x) -> s + x) ELSE 0 END")
    return dup.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("__words", "__lines", "__g", "__twice", "__sorted", "__again", "__at")


def base_failed(rules: HostRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_rates(measured: DataFrame, host_col: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Per host: n_docs, n_failed, host_rate (shrunk), host_limit (of the rate). Rows without a host don't count.

    m is the mean of the hosts' raw rates and v their variance less what chance alone gives hosts of these sizes. The
    prior's weight is m(1-m)/v - 1, held within 1 and 10000 documents; hosts that differ by chance only take the
    largest weight, which brings all of them near the mean."""
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("all"), F.avg(1 / F.col("n_docs")).alias("share"))
    prior = prior.withColumn("p", F.col("m") * (1 - F.col("m"))).withColumn("v", F.col("all") - F.col("p") * F.col("share"))
    prior = prior.withColumn("w", F.when(F.col("v") > 1e-9, F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.col("p") / F.greatest("v", F.lit(1e-9)) - 1))).otherwise(F.lit(10000.0)))
    high = F.greatest(F.col("m") + rules.spread * F.sqrt(F.col("p") / (F.col("w") + 1)), rules.times * F.col("m"))
    prior = prior.select("m", "w", F.least(F.lit(rules.max_rate), high).alias("host_limit"))
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    return joined.select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("m") * F.col("w")) / (F.col("n_docs") + F.col("w"))).alias("host_rate"), "host_limit")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """id, host, the measures, base_failed, host_rate, host_limit and kept, one row per row of docs.

    A document is kept if it passes the base rules and its host isn't rejected. Documents without a host are
    judged by the base rules alone (host_rate null). Repeated rows are judged each and count each; null and empty texts
    have no words and fail; very long texts are measured whole; only id, host and text are read, so no other column can
    clash. An empty table gives an empty result."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = cut(measure(slim, "text", rules.window).drop("text").withColumn("base_failed", base_failed(rules)))
    rates = cut(host_rates(measured, "host", rules).select("host", "host_rate", "host_limit"))
    joined = measured.join(rates, "host", "left")  # small or skewed: the adaptive plan broadcasts or splits by measured size
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= F.col("host_limit"), F.lit(True)))
