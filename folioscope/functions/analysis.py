"""Terms of texts and of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed
from folioscope.session import cut

# Letters that an index without accents folds; both strings in step.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"
# A run of Han characters has no blanks to part its words: its overlapping pairs stand for them, a lone character for itself.
HAN_PAIRS = r"(\p{IsHan})(?=(\p{IsHan}))|(?<=\p{IsHan})\p{IsHan}"

# Words that a query's terms leave out.
STOP_WORDS = frozenset(
    "的 了 和 是 在 有 与 及 或 等 为 以 而 之 也 都 就 要 会 能 可 这 那 其 中 对 从 到 把 被 将 让 使 由 于 吗 呢 吧 啊 么 嘛 很 最 更 还 又 再 "
    "什么 怎么 如何 哪些 是否 可以 应该 如果 因为 所以 但是 然后 一个 一些 这种 这样 进行 通过 根据 关于 以及 或者 还有 不是 没有 需要 请 你 我 我们 你们 他们 它们 "
    "the a an is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from "
    "as into through during before after above below between under again further then once here there when where why how all each both few more most "
    "other some such no nor not only own same so than too very just and but if or because until while although though what which who whom this that "
    "these those am it its their theirs".split()
)


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Letters and digits in a row, in lower case and without accents; an empty array for a null text.

    Han runs give their pairs, so words of two characters are found and longer ones are phrases of pairs."""
    lone = F.regexp_replace(text, r"(?<!\p{IsHan})(\p{IsHan})(?!\p{IsHan})", " $1 ")
    apart = F.regexp_replace(lone, HAN_PAIRS, " $1$2 ")
    apart = F.when(text.rlike(r"\p{IsHan}"), apart).otherwise(text)
    return F.coalesce(F.regexp_extract_all(folded(apart), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def is_stop_word(term: Column) -> Column:
    return term.isin(*sorted(STOP_WORDS))


def positions(rows: DataFrame, id_col: str, text: Column, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(id, pos, term) of each token, pos from 0."""
    return rows.select(id_col, F.posexplode(split(text)).alias("pos", "term"))


def query_terms(queries: DataFrame, document_frequency: DataFrame, n_documents: DataFrame, max_terms: int = 14, least_chars: int = 1, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query_id, pos, term): of each query's max_terms terms of largest tf-idf those that aren't stop words, first come
    first of equals.

    document_frequency: (term, df); n_documents: one row (n). Unseen terms have df 0. A query with fewer than two such
    terms has its first max_terms tokens that aren't stop words, in order and as often as they stand; one without any is
    its own term, trimmed. Terms shorter than least_chars count as stop words. split: how the index parts its texts."""
    seen = cut(positions(queries.select("query_id", "text"), "query_id", F.col("text"), split))
    counted = seen.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first"))
    weighed = counted.join(document_frequency, "term", "left").crossJoin(F.broadcast(n_documents.select("n")))  # one row
    weight = F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5)), 9)
    kept = ~is_stop_word(F.col("term")) & (F.length("term") >= least_chars)
    best = weighed.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(weight.desc(), "first")))
    best = cut(best.where((F.col("place") <= max_terms) & kept).select("query_id", "place", "term"))
    enough = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("query_id")
    number = lambda d, by: d.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(by))).where(F.col("pos") <= max_terms).select("query_id", "pos", "term")
    tfidf = number(best.join(enough, "query_id", "left_semi"), "place")
    plain = number(seen.withColumnRenamed("pos", "at").join(enough, "query_id", "left_anti").where(kept), "at")
    held = tfidf.unionByName(plain)
    bare = queries.join(enough, "query_id", "left_anti").join(seen.where(kept).select("query_id").distinct(), "query_id", "left_anti").where(trimmed(F.col("text")) != "")
    return held.unionByName(bare.select("query_id", F.lit(1).alias("pos"), trimmed(F.col("text")).alias("term")))


def fast_terms(queries: DataFrame, document_frequency: DataFrame, n_documents: DataFrame, max_terms: int = 14) -> DataFrame:
    """query_terms of the quick path: terms of a single character never count."""
    return query_terms(queries, document_frequency, n_documents, min(14, max_terms), least_chars=2)


def rank_keywords(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, pos, term): what rerank and substring search look for. A query's terms if it has two or more; else its
    distinct tokens of two characters or more that aren't stop words, in order; else its text, trimmed."""
    enough = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("query_id")
    own = terms.join(enough, "query_id", "left_semi").select("query_id", "pos", "term")
    short = queries.join(enough, "query_id", "left_anti")
    words = positions(short.select("query_id", "text"), "query_id", F.col("text")).where((F.length("term") >= 2) & ~is_stop_word(F.col("term")))
    words = words.groupBy("query_id", "term").agg(F.min("pos").alias("first")).withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("first")))
    bare = short.join(words.select("query_id").distinct(), "query_id", "left_anti").where(trimmed(F.col("text")) != "")
    return own.unionByName(words.select("query_id", "pos", "term")).unionByName(bare.select("query_id", F.lit(1).alias("pos"), trimmed(F.col("text")).alias("term")))
