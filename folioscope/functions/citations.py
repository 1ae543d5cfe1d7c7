"""Which lines and chunks of a book are apparatus, not prose, and how an excerpt is cut to whole sentences.

Everything is a column expression; a chunk's lines are an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed

# The marks by which apparatus is known.
HEADINGS = "^(参考文献|引用书目|参考资料|引用文献|书目|主要参考文献)"
YEAR_TAIL = r"([，,．.]|\s)\d{4}\s*$"
PUBLISHERS = "(出版社|印书馆|出版公司|出版事业|書店|印刷|三聯|工坊|人民社|编译社)"
CITIES = "(台北|臺北|北京|上海|南京|香港|广州|武汉|杭州|天津|江苏)[：:]"
ROLE_MARK = r"[译編著主][.．]"
AUTHOR_YEAR = r"^[^，,]{1,30}[,，]\s*\d{4}\s*$"
AUTHOR_TITLE = r"^[一-鿿·•]{2,12}[.．]\S+$"
DANGLING = r"(与|及|和|——)\s*$"
TOC_TITLES = ("总目录", "版权页", "插图", "插图目录", "插页", "勘误表")
VOLUME = r"^[^：:\n]{2,55}[：:]\s*第[一二三四五六七八九十百零\d〇○]+卷\s*$"
CAPTION_WORDS = "(起草|转发|复电|批语|电报|决定|审阅|加写|为中共中央|为中央|通报|指示|报告稿|同意)"
GLOSSARY_WORDS = "(翻译词汇表|译者注释|人名专名|用于翻译插件|更多译法详情请见|专有名词解读|更多专有名词)"
GLOSSARY_TITLES = ("词汇表", "译者注释", "人名专名")
ENDED = r"[。！？.!?][」』\"]*\s*$"
CJK = r"[一-鿿]"


def _count(text: Column, mark: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(mark)), F.lit(0))


def is_bibliography_line(line: Column) -> Column:
    s = trimmed(line)
    dated = s.rlike(YEAR_TAIL)
    return (F.length(s) >= 4) & (
        s.rlike(HEADINGS)
        | (dated & s.rlike(PUBLISHERS))
        | (dated & s.rlike(CITIES))
        | (dated & s.rlike(ROLE_MARK) & (_count(s, "[.．]") >= 2))
        | (dated & (F.length(s) < 220) & (_count(s, "[.]") >= 2) & s.rlike("[：:]"))
        | (s.rlike(AUTHOR_YEAR) & s.rlike("出版|书店|印书馆"))
        | ((F.length(s) <= 52) & ~s.rlike("[。！？]") & s.rlike(AUTHOR_TITLE) & s.rlike(DANGLING)))


def is_toc_heading(line: Column) -> Column:
    s = trimmed(line)
    return s.isin(*TOC_TITLES) | (s.rlike(r"^目\s*录$") & (F.length(s) <= 4))


def is_volume_line(line: Column) -> Column:
    return trimmed(line).rlike(VOLUME)


def is_bracket_number(line: Column) -> Column:
    return trimmed(line).rlike(r"^\[\d+\]\s*$")


def is_bracket_caption(line: Column) -> Column:
    return trimmed(line).rlike(r"^\[\d+\]\s*这是")


def _caption_shape(s: Column) -> Column:
    return s.startswith("这是") & F.length(s).between(12, 300) & s.rlike("[。.．]$")


def is_editorial_caption(line: Column) -> Column:
    s = trimmed(line)
    return _caption_shape(s) & s.rlike(CAPTION_WORDS)


def is_noise_line(line: Column) -> Column:
    return is_bibliography_line(line) | is_toc_heading(line) | is_volume_line(line) | is_bracket_number(line) | is_bracket_caption(line) | is_editorial_caption(line)


def full_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), trimmed), lambda x: x != "")


def _how_many(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def is_glossary_block(text: Column) -> Column:
    """Word lists and indexes: pairs of a foreign term and its gloss, or lines in Latin letters with few sentences."""
    return _glossary(full_lines(text))


def _glossary(lines: Column) -> Column:
    n = F.size(lines)
    titled = F.array_join(F.slice(lines, 1, 36), "\n").rlike(GLOSSARY_WORDS) | (_how_many(F.slice(lines, 1, 22), lambda x: x.isin(*GLOSSARY_TITLES)) > 0)
    # a term's line followed by one that glosses it
    term = lambda a: (F.length(a) <= 95) & (_count(a, "[A-Za-z]") >= 3) & ~a.rlike(CJK + "{3,}")
    gloss = lambda b: (F.length(b) <= 110) & (b.rlike(CJK + "{2,}") | b.contains("《"))
    following = F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.size(F.filter(F.zip_with(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), following, lambda a, b: term(a) & gloss(b)), lambda x: x))
    latin = _how_many(lines, lambda x: (F.length(x) <= 130) & ~x.rlike(CJK) & x.rlike("[A-Za-zÀ-ÿĀ-ž]{4,}"))
    spoken = _how_many(lines, lambda x: x.rlike("[。！？]"))
    sparse = (n >= 10) & (latin >= F.greatest(F.lit(6), F.floor(n / 4))) & (spoken <= F.greatest(F.lit(4), F.floor(n / 6)))
    return (n >= 7) & ((pairs >= 5) | (titled & ((pairs >= 3) | (latin >= 4))) | sparse)


def is_toc_block(text: Column) -> Column:
    """Tables of contents: five volume lines, or fewer where the block names itself."""
    return _toc(text, full_lines(text))


def _toc(text: Column, lines: Column) -> Column:
    volumes = _how_many(lines, is_volume_line)
    named = F.substring(text, 1, 1600).rlike("总目录|版权页")
    return (volumes >= 5) | (named & ((volumes >= 3) | ((volumes >= 2) & (F.size(lines) <= 24))))


def is_annotation_block(text: Column) -> Column:
    """Numbers in brackets with captions between, and hardly a line else."""
    return _annotation(full_lines(text))


def _annotation(lines: Column) -> Column:
    numbers = _how_many(lines, is_bracket_number)
    captions = _how_many(lines, lambda x: is_editorial_caption(x) | (_caption_shape(x) & ~F.substring(x, 1, 8).rlike("[「『（“]")))
    n = F.size(lines)
    return (numbers >= 2) & (captions >= F.greatest(F.lit(1), numbers - 1)) & (numbers + captions >= n - F.greatest(F.lit(2), F.floor(n / 6)))


def with_blocks(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds glossary, toc and annotation, whether a text is such a block. Its lines are a column of their own, parted once."""
    lined = rows.withColumn("__lines", full_lines(F.col(text_col)))
    lines = F.col("__lines")
    return lined.withColumns({"glossary": _glossary(lines), "toc": _toc(F.col(text_col), lines), "annotation": _annotation(lines)}).drop("__lines")


def is_incomplete(text: Column) -> Column:
    """A short line that breaks off: nothing, or an unended scrap of an entry or clause in Chinese."""
    s = trimmed(text)
    scrap = s.rlike(CJK + r"{2,10}[.．]\S+") | ((F.length(s) < 96) & s.rlike(DANGLING))
    return (s == "") | (~s.contains("\n") & (F.length(s) <= 140) & ~s.rlike(ENDED) & s.rlike(CJK) & ~s.rlike("[。！？]") & scrap)


def trim_leading(text: Column) -> Column:
    """Without a scrap of up to ten characters before the first sentence mark; quoted beginnings stay."""
    s = trimmed(text)
    return F.when((F.length(s) >= 12) & ~s.rlike(r"^[「『（【“\"]"), F.regexp_replace(s, r"(?s)^[^。！？]{1,10}[。！？]\s*", "")).otherwise(s)


def trim_trailing(text: Column) -> Column:
    """Up to the last sentence mark, if the text doesn't end with one and loses little."""
    s = F.regexp_replace(text, r"(?U)\s+$", "")
    last = F.length(F.regexp_extract(s, r"(?s)^.*[。！？]", 0))
    enough = last - 1 >= F.greatest(F.lit(24), F.floor(F.length(s) / 5))
    return F.when(~s.rlike(ENDED) & (last > 0) & enough, F.regexp_extract(s, r"(?s)^.*[。！？]", 0)).otherwise(s)


def with_snippet(rows: DataFrame, text_col: str = "text", out: str = "snippet") -> DataFrame:
    """Adds a chunk's excerpt: empty if it is apparatus, else without noise lines and broken sentences at its ends.

    Each step is a column of its own, as the next one reads it many times."""
    lines = F.split(F.regexp_replace(trimmed(F.coalesce(F.col(text_col), F.lit(""))), r"\r\n?", "\n"), "\n")
    steps = rows.withColumn("__base", F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))
    base = F.col("__base")
    steps = steps.withColumn("__block", is_glossary_block(base) | is_toc_block(base) | is_annotation_block(base))
    steps = steps.withColumn("__kept", F.array_join(F.filter(F.split(base, "\n"), lambda x: ~is_noise_line(x)), "\n"))
    steps = steps.withColumn("__kept", F.regexp_replace(trimmed(F.col("__kept")), r"(?U)\s*\n\s*\n\s*", "\n\n"))
    steps = steps.withColumn("__kept", trim_leading(F.col("__kept")))
    steps = steps.withColumn("__kept", trimmed(trim_trailing(F.col("__kept"))))
    shown = F.when(F.col("__block") | is_incomplete(F.col("__kept")), "").otherwise(F.col("__kept"))
    return steps.withColumn(out, shown).drop("__base", "__block", "__kept")
