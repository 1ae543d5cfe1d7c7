"""What a question is: its route, whether it is vague, its match string; and what models return."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed

# Marks of questions about code, and characters of small talk.
CODE_HINTS = ("traceback", "exception", "syntaxerror", "indentationerror", "def ", "class ", "import ", "报错", "调试", "npm ", "pip ", "git ", "sql", "httperror", "json.decode", "代码", "函数", "编程", "api接口", "```", "typescript", "javascript", "python")
SMALL_TALK = r"(?U)^[\s你好您好谢谢不用谢再见哈嘿呀哦嗯哼\d\w…\.。\!！\?？\,，~～]+$"
CHAT = r"(?U)^[\s你好您好谢谢谢啦不用谢再见哈嗨嘿哟嗯哼哦噢\d\w。！？\.·…~～,\，]{0,32}$"
ASKING_END = r"(吗|呢|嘛)\s*$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def route(text: Column, routing: bool = True) -> Column:
    """code, general or kb; kb for everything where routing is off, and for blank questions."""
    if not routing:
        return F.lit("kb")
    q = trimmed(text)
    hinted = F.lit(False)
    for h in CODE_HINTS:
        hinted = hinted | F.contains(F.lower(q), F.lit(h))
    return F.when(q == "", "kb").when(hinted, "code").when((F.length(q) < 12) & q.rlike(SMALL_TALK), "general").otherwise("kb")


def skips_retrieval(route_: Column, text: Column) -> Column:
    q = trimmed(text)
    return (route_ == "general") & (F.length(q) < 28) & q.rlike(CHAT)


def vague(text: Column, substantive: Column) -> Column:
    """Whether a question wants rewriting; substantive: how many of its best terms, of two characters or more, aren't stop words."""
    q = trimmed(text)
    asking = (F.length(q) < 48) & q.rlike(ASKING_END) & (substantive < 4)
    return F.when(q == "", False).otherwise((F.length(q) < 14) | (substantive < 2) | asking)


def rewritten(queries: DataFrame, vague_col: str, rewrite: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """Adds search_text and rewrite (null: none) to (query_id, text, vague): a language model's rewriting of vague questions.

    rewrite answers a batch of questions; the first line of an answer counts, if it isn't blank or the question itself.
    Without a model, questions stay as they are."""
    text = trimmed(F.col("text"))
    if rewrite is None:
        return queries.withColumns({"search_text": text, "rewrite": F.lit(None).cast("string")})

    @F.pandas_udf("string")
    def answered(asked: pd.Series) -> pd.Series:
        some = [x for x in asked if x]
        said = dict(zip(some, rewrite(some))) if some else {}
        lines = [((said.get(x) or "").splitlines() or [""])[0].strip() if x else "" for x in asked]
        return pd.Series([a if a and a != x else None for a, x in zip(lines, asked)], dtype=object)

    found = queries.withColumn("rewrite", answered(F.when(F.col(vague_col), text)))
    return found.withColumn("search_text", F.coalesce("rewrite", text))


def chatted(prompts: DataFrame, chat: Callable[[list[str]], list[str]], prompt_col: str = "prompt") -> DataFrame:
    """Adds answer and chat_error by a language model's batch function of prompts; a batch that fails has an error each."""

    @F.pandas_udf("answer string, chat_error string")
    def answered(asked: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"answer": pd.Series(chat(asked.tolist()), dtype=object), "chat_error": None})
        except Exception as e:
            return pd.DataFrame({"answer": None, "chat_error": [f"{type(e).__name__}: {e}"] * len(asked)})

    found = prompts.withColumn("__a", answered(F.col(prompt_col)))
    return found.withColumns({"answer": F.col("__a.answer"), "chat_error": F.col("__a.chat_error")}).drop("__a")


def match_string(terms: Column) -> Column:
    """Quoted terms joined by OR; quotes inside terms go."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


def strip_references(text: Column) -> Column:
    """The text before the first line that is a heading of references."""
    lines = F.split(text, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")
    head = F.transform(lines, lambda x: trimmed(x).rlike(r"(?i)^(?:#{1,4}\s*)?(?:引用|参考文献|references)\s*$"))
    at = F.array_position(head, True)
    kept = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)\s+$", "")


def escape_citations(text: Column) -> Column:
    r"""[1] as \[1\], where no ( follows, so that Markdown shows it."""
    return F.regexp_replace(text, r"\[(\d+)\](?!\()", r"\\[$1\\]")


VERDICT = "struct<grounded:string,reason:string,refined_search:string>"


def verdict(raw: Column) -> Column:
    """(grounded, reason, refined_search) from the outermost braces of a model's answer; grounded where it says nothing."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, VERDICT)
    said = F.lower(F.trim(parsed["grounded"]))
    return F.struct(
        F.when(said.isNull(), True).otherwise(said.isin("true", "1", "yes")).alias("grounded"),
        F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 120).alias("reason"),
        F.substring(trimmed(F.coalesce(parsed["refined_search"], F.lit(""))), 1, 200).alias("refined_search"))


def sse_payload(line: Column) -> Column:
    """What a line of an event stream carries: null for comments, other fields and blank lines; [DONE] as it stands."""
    t = trimmed(line)
    return F.when(t.startswith("data:"), trimmed(F.substring(t, 6, 2**31 - 1)))


def sse_delta(line: Column) -> Column:
    """The text that a chat stream's line adds; null where it adds none."""
    body = sse_payload(line)
    chosen = F.from_json(F.when(body != "[DONE]", body), "struct<choices:array<struct<delta:struct<content:string>>>>")
    return F.get(chosen["choices"], F.lit(0))["delta"]["content"]
