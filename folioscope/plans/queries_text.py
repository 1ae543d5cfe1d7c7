"""Queries of text functions, questions, citations and index upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import analysis, citations, questions, tables, text
from folioscope.operators import ingest, lexical
from folioscope.plans.registry import Corpus, query
from folioscope.plans.sql import STOP, base, toks, trim
from folioscope.session import checkpoint_dir

_NORMAL = trim(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def normalize_text(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace({_NORMAL}, '[\n\r\t]+', ' ', 'g') AS p FROM documents),
    s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))) AS s FROM p)
    SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM s WHERE s <> '' GROUP BY doc_id""")
def sentence_split(c: Corpus) -> DataFrame:
    s = c.table("documents").select("doc_id", F.explode(F.array(text.document_sentences(F.col("text")))).alias("s"))  # a row each: else the filter would split texts too
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|").cast("binary")).alias("digest")).where("n > 0")


def _stripped(html: str) -> str:
    out = rf"regexp_replace({html}, '(?is)<!--.*?(?:-->|\z)', '', 'g')"
    for tag in ("script", "style", "noscript", "nav"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)', '', 'g')"
    out = rf"regexp_replace({out}, '(?s)<[^>]*>', chr(10), 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{mark}')"
    return out


@query(f"""WITH l AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT page_id, string_split({_stripped("coalesce(html, '')")}, chr(10)) AS x FROM pages)),
    t AS (SELECT page_id, i, {trim('line')} AS line FROM l) SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM t WHERE line <> '' GROUP BY page_id""")
def html_to_text(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("""WITH n AS (SELECT doc_id, text, greatest(0, ceil((length(text) - 900) / 780.0))::BIGINT AS last FROM documents WHERE length(text) > 0),
    r AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM n) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 780 + 1, 900) AS chunk FROM r""")
def chunk_fixed(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"))).alias("chunk_index", "chunk"))


# Sentences are taken one by one: what a chunk holds so far decides where the next one goes. A sentence beyond the size is cut
# at its own marks first, where each part begins depends on the one before.
_CHUNKS = rf"""WITH RECURSIVE para AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS raw FROM (SELECT doc_id, string_split({_NORMAL}, chr(10) || chr(10)) AS l FROM documents)),
    para2 AS (SELECT doc_id, p, {trim(rf"regexp_replace({trim('raw')}, '[\n\r\t]+', ' ', 'g')")} AS t FROM para),
    sent AS (SELECT doc_id, p, generate_subscripts(l, 1) AS s, unnest(l) AS t FROM (SELECT doc_id, p, string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS l FROM para2 WHERE t <> '')),
    sent2 AS (SELECT doc_id, p, s, {trim('t')} AS t FROM sent WHERE {trim('t')} <> ''),
    whole AS (SELECT doc_id, p, string_agg(t, '' ORDER BY s) AS t FROM sent2 GROUP BY doc_id, p),
    unit AS (SELECT doc_id, p, s, t FROM sent2 JOIN (SELECT doc_id, p FROM whole WHERE length(t) > 900) USING (doc_id, p) UNION ALL SELECT doc_id, p, 0, t FROM whole WHERE length(t) <= 900),
    cut(doc_id, p, s, k, part, rest) AS (SELECT doc_id, p, s, 0, NULL::VARCHAR, t FROM unit WHERE length(t) > 900
        UNION ALL SELECT doc_id, p, s, k + 1, substr(rest, 1, e), CASE WHEN e < length(rest) THEN substr(rest, greatest(e - 120, 1) + 1) END FROM
            (SELECT *, CASE WHEN length(rest) <= 900 THEN length(rest) WHEN weak > 226 THEN weak WHEN strong > 0 THEN strong ELSE 900 END AS e FROM
                (SELECT *, length(regexp_extract(substr(rest, 1, 900), '(?s)^.*[；;，,、]')) AS weak,
                           CASE WHEN length(regexp_extract(substr(rest, 1, 900), '(?s)^.*[。！？.!?]')) > 801 THEN length(regexp_extract(substr(rest, 1, 900), '(?s)^.*[。！？.!?]')) ELSE 0 END AS strong FROM cut WHERE rest IS NOT NULL))),
    piece AS (SELECT doc_id, p, s, 0 AS k, t, false AS is_part FROM unit WHERE length(t) <= 900 UNION ALL SELECT doc_id, p, s, k, {trim('part')}, true FROM cut WHERE {trim('part')} <> ''),
    placed AS MATERIALIZED (SELECT doc_id, is_part, x.t AS t, length(x.t) AS len, length(w.t) AS whole_len, row_number() OVER (PARTITION BY doc_id ORDER BY p, s, k) AS i,
        row_number() OVER (PARTITION BY doc_id, p ORDER BY s, k) = 1 AS begins FROM piece x JOIN whole w USING (doc_id, p)),
    walk(doc_id, i, c, held, part) AS (SELECT doc_id, i, 0, len, is_part FROM placed WHERE i = 1
        UNION ALL SELECT doc_id, i, CASE WHEN joins THEN c ELSE c + 1 END, CASE WHEN joins AND begins THEN held + 2 + len WHEN joins THEN held + len ELSE len END, is_part FROM
            (SELECT x.*, w.c, w.held, CASE WHEN x.begins THEN w.held + 2 + x.whole_len <= 900 ELSE NOT x.is_part AND NOT w.part AND w.held + x.len <= 900 END AS joins
             FROM walk w JOIN placed x ON x.doc_id = w.doc_id AND x.i = w.i + 1)),
    said AS (SELECT doc_id, c, i, CASE WHEN begins AND i > min(i) OVER (PARTITION BY doc_id, c) THEN chr(10) || chr(10) ELSE '' END || t AS t FROM walk JOIN placed USING (doc_id, i))
    SELECT doc_id, CAST(c AS INTEGER) AS chunk_index, string_agg(t, '' ORDER BY i) AS text FROM said GROUP BY doc_id, c"""


@query(_CHUNKS)
def chunk_text(c: Corpus) -> DataFrame:
    return text.chunks(c.table("documents"))


@query(_CHUNKS)
def chunk_lateral(c: Corpus) -> DataFrame:
    """The same chunks by a table function in SQL."""
    tables.register(c.spark)
    return tables.lateral(c.table("documents"), "sentence_chunks(d.text)")


@query()
def chunk_semantic(c: Corpus) -> DataFrame:
    return text.chunks(c.table("documents"), "semantic")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS fsize FROM documents")
def content_hash(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("fsize"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup(c: Corpus) -> DataFrame:
    return c.table("documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(base() + " SELECT query_id, pos, term FROM terms")
def query_terms(c: Corpus) -> DataFrame:
    return c.terms


@query(base() + """ SELECT query_id, string_agg('"' || replace(term, '"', '') || '"', ' OR ' ORDER BY pos) AS match FROM terms GROUP BY query_id""")
def match_string(c: Corpus) -> DataFrame:
    return lexical.keyword_lists(c.terms).select("query_id", questions.match_string(F.col("keywords")).alias("match"))


_HINTED = " OR ".join(f"contains(lower(q), '{h}')" for h in questions.CODE_HINTS)
_TURN = rf"(SELECT conv_id, turn, {trim('text')} AS q FROM conversations WHERE role = 'user')"
_TALK = "[\\s你好您好谢谢不用谢再见哈嘿呀哦嗯哼\\d\\p{L}\\p{N}_…\\.。\\!！\\?？\\,，~～]+"


@query(f"""SELECT conv_id, turn, CASE WHEN q = '' THEN 'kb' WHEN {_HINTED} THEN 'code' WHEN length(q) < 12 AND regexp_full_match(q, '{_TALK}') THEN 'general' ELSE 'kb' END AS route,
    (NOT ({_HINTED})) AND q <> '' AND length(q) < 12 AND regexp_full_match(q, '{_TALK}') AND regexp_full_match(q, '[\\s你好您好谢谢谢啦不用谢再见哈嗨嘿哟嗯哼哦噢\\d\\p{{L}}\\p{{N}}_。！？\\.·…~～,，]*') AS skips FROM {_TURN}""")
def route_rules(c: Corpus) -> DataFrame:
    t = c.table("conversations").where("role = 'user'").withColumn("route", questions.route(F.col("text")))
    return t.select("conv_id", "turn", "route", questions.skips_retrieval(F.col("route"), F.col("text")).alias("skips"))


@query(rf"""WITH q AS {_TURN}, t AS (SELECT conv_id, turn, unnest({toks('q')}) AS term FROM q), n AS (SELECT conv_id, turn, count(DISTINCT term) AS n FROM t WHERE term NOT IN {STOP} AND length(term) > 1 GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN q = '' THEN false ELSE length(q) < 14 OR least(coalesce(n, 0), 14) < 2 OR (length(q) < 48 AND regexp_matches(q, '(吗|呢|嘛)\s*$') AND coalesce(n, 0) < 4) END AS vague FROM q LEFT JOIN n USING (conv_id, turn)""")
def vague_query(c: Corpus) -> DataFrame:
    t = c.table("conversations").where("role = 'user'")
    content = F.size(F.filter(F.array_distinct(analysis.tokens(F.col("text"))), lambda x: ~analysis.is_stop_word(x) & (F.length(x) > 1)))
    return t.select("conv_id", "turn", questions.vague(F.col("text"), content).alias("vague"))


_YEAR = r"regexp_matches(s, '([，,．.]|\s)\d{4}\s*$')"


@query(rf"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {trim('x')} AS s FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))
    SELECT doc_id, line_no, length(s) >= 4 AND ({_YEAR} AND length(s) < 220 AND length(s) - length(replace(s, '.', '')) >= 2 AND regexp_matches(s, '[：:]')) AS noise FROM l""")
def bibliography_lines(c: Corpus) -> DataFrame:
    lines = c.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", citations.is_bibliography_line(F.col("line")).alias("noise"))


@query()
def glossary_blocks(c: Corpus) -> DataFrame:
    return citations.with_blocks(c.table("documents").select("doc_id", "text")).select("doc_id", "glossary", "toc", "annotation")


@query()
def citation_clean(c: Corpus) -> DataFrame:
    return citations.with_snippet(c.table("documents").select("doc_id", "text")).select("doc_id", "snippet")


@query(rf"""SELECT doc_id, regexp_replace(text, '\s+$', '') || chr(10) || 'tail' AS body FROM documents""")
def strip_references(c: Corpus) -> DataFrame:
    with_list = F.concat(F.regexp_replace("text", r"(?U)\s+$", ""), F.lit("\ntail\n## References\n[1] a book\n"))
    return c.table("documents").select("doc_id", questions.strip_references(with_list).alias("body"))


# Stored and disk halves of the documents: ids not divisible by 5 are stored, those not divisible by 7 are on disk;
# files divisible by 3 changed their time, by 11 their text as well, and documents divisible by 13 have no chunks.
_STORED = "stored AS (SELECT 'd' || doc_id AS path, CAST(doc_id AS DOUBLE) AS mtime, length(text) AS fsize, md5(text) AS sha256, 'sentence' AS profile, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 2 END AS n_chunks FROM documents WHERE doc_id % 5 <> 0)"
_DISK = """disk AS (SELECT 'd' || doc_id AS path, doc_id + CASE WHEN doc_id % 3 = 0 THEN 2.5 ELSE 2.0 END AS mtime, length(text) AS fsize, CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE md5(text) END AS sha256,
    'sentence' AS profile, CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.txt' END AS ext, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE length(text) END AS chars FROM documents WHERE doc_id % 7 <> 0)"""


def _stored(c: Corpus) -> DataFrame:
    return c.table("documents").where("doc_id % 5 <> 0").selectExpr("concat('d', doc_id) AS path", "CAST(doc_id AS DOUBLE) AS mtime", "CAST(length(text) AS BIGINT) AS fsize", "md5(CAST(text AS BINARY)) AS sha256", "'sentence' AS profile", "IF(doc_id % 13 = 0, 0, 2) AS n_chunks")


def _disk(c: Corpus) -> DataFrame:
    return c.table("documents").where("doc_id % 7 <> 0").selectExpr(
        "concat('d', doc_id) AS path", "doc_id + IF(doc_id % 3 = 0, 2.5D, 2.0D) AS mtime", "CAST(length(text) AS BIGINT) AS fsize", "IF(doc_id % 11 = 0, 'new', md5(CAST(text AS BINARY))) AS sha256",
        "'sentence' AS profile", "IF(doc_id % 2 = 0, '.pdf', '.txt') AS ext", "IF(doc_id % 17 = 0, 0, length(text)) AS chars")


@query(f"""WITH {_STORED}, {_DISK} SELECT d.path, CASE
    WHEN s.path IS NOT NULL AND s.n_chunks > 0 AND s.fsize = d.fsize AND abs(s.mtime - d.mtime) <= 2.0 THEN 'SKIP' WHEN s.path IS NOT NULL AND s.n_chunks > 0 AND s.sha256 = d.sha256 THEN 'TOUCH'
    WHEN d.chars = 0 AND d.ext = '.pdf' THEN 'ERROR' WHEN s.path IS NOT NULL THEN 'REPLACE' ELSE 'INSERT' END AS action FROM disk d LEFT JOIN stored s ON s.path = d.path""")
def upsert_actions(c: Corpus) -> DataFrame:
    return ingest.upsert_actions(_disk(c), _stored(c))


@query(f"WITH {_STORED}, {_DISK} SELECT path, sha256 FROM stored WHERE path IN (SELECT path FROM disk)")
def purge_missing(c: Corpus) -> DataFrame:
    return ingest.purge_missing(_stored(c), _disk(c)).select("path", "sha256")


@query("""WITH d AS (SELECT DISTINCT source AS path FROM documents UNION ALL SELECT 'none') SELECT path, 'title ' || path AS title, count(doc_id) AS n_chunks FROM d LEFT JOIN documents ON source = path GROUP BY ALL""")
def library_listing(c: Corpus) -> DataFrame:
    books = c.table("documents").select(F.col("source").alias("path")).distinct().unionByName(c.spark.createDataFrame([("none",)], "path string"))
    books = books.select(F.col("path").alias("doc_id"), "path", F.concat(F.lit("title "), "path").alias("title"))
    return ingest.library_listing(books, c.chunks.select(F.col("path").alias("doc_id"), "chunk_id")).select("path", "title", "n_chunks")


@query(f"""WITH {_STORED}, {_DISK} SELECT d.path, coalesce(s.n_chunks, 0)::BIGINT AS n_chunks, CASE WHEN s.path IS NULL THEN 'not indexed' WHEN s.n_chunks = 0 THEN 'indexed without chunks' ELSE 'indexed' END AS status FROM disk d LEFT JOIN stored s ON s.path = d.path""")
def library_status(c: Corpus) -> DataFrame:
    return ingest.library_status(_disk(c), _stored(c).select("path", F.col("n_chunks").cast("long").alias("n_chunks")))


@query("SELECT doc_id AS chunk_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE source <> 'src1'")
def delete_document(c: Corpus) -> DataFrame:
    docs = c.table("documents").select(F.col("source").alias("doc_id")).distinct()
    tables = {"documents": docs, "chunks": c.chunks.select(F.col("path").alias("doc_id"), "chunk_id"), "vectors": c.vectors.select("chunk_id", "embedding")}
    return ingest.delete_document(tables, docs.where("doc_id = 'src1'"))["vectors"]


# Model answers made of the turns: every kind of reply by the turn's number, the turn's own words as reason or content.
_WORDS = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, substr({_WORDS}, 1, 40) AS w FROM conversations)
    SELECT conv_id, turn, turn % 4 <> 0 AS grounded, CASE WHEN turn % 4 IN (0, 3) THEN w ELSE '' END AS reason, CASE WHEN turn % 4 = 0 THEN 'again' ELSE '' END AS refined_search FROM t""")
def self_rag_verdict(c: Corpus) -> DataFrame:
    """A reply around each turn: refused with a reason, grounded, no JSON at all, a reason only."""
    w = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", ""), 1, 40)
    kind = F.col("turn") % 4
    raw = (F.when(kind == 0, F.concat(F.lit('so: {"grounded": "No", "reason": "'), w, F.lit('", "refined_search": " again "} end'))).when(kind == 1, F.lit('{"grounded": true}'))
           .when(kind == 2, w).otherwise(F.concat(F.lit('{"reason": "'), w, F.lit('"}'))))
    return c.table("conversations").select("conv_id", "turn", questions.verdict(raw).alias("v")).select("conv_id", "turn", "v.*")


@query(f"""WITH t AS (SELECT conv_id, turn, substr({_WORDS}, 1, 40) AS w FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN '[DONE]' WHEN 2 THEN '{{"choices":[{{"delta":{{"content":"' || w || '"}}}}]}}' END AS payload, CASE WHEN turn % 3 = 2 THEN w END AS delta FROM t""")
def sse_parse(c: Corpus) -> DataFrame:
    """A line of an event stream for each turn: a comment, the end, a piece of an answer."""
    w = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", ""), 1, 40)
    kind = F.col("turn") % 3
    line = F.when(kind == 0, F.concat(F.lit(": "), w)).when(kind == 1, F.lit("data: [DONE]")).otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), w, F.lit('"}}]}')))
    return c.table("conversations").select("conv_id", "turn", questions.sse_payload(line).alias("payload"), questions.sse_delta(line).alias("delta"))


@query(r"SELECT doc_id, '\[' || doc_id || '\] [' || doc_id || '](u)' AS escaped FROM documents")
def escape_citations(c: Corpus) -> DataFrame:
    cited = F.concat(F.lit("["), "doc_id", F.lit("] ["), "doc_id", F.lit("](u)"))
    return c.table("documents").select("doc_id", questions.escape_citations(cited).alias("escaped"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'context ' || doc_id ELSE text END AS prompt_text, doc_id || '.txt' AS name FROM documents")
def prompt_text(c: Corpus) -> DataFrame:
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" context "), "doc_id")).otherwise(F.lit("  "))
    return c.table("documents").select("doc_id", ingest.prompt_text(context, F.col("text")).alias("prompt_text"), ingest.file_name(F.concat(F.lit("/a/b/"), "doc_id", F.lit(".txt"))).alias("name"))


@query("""SELECT doc_id, '{"doc_title":"' || lang || '","rel_path":"' || source || '","ext":".txt"}' AS meta FROM documents""")
def metadata_json(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", ingest.metadata_json(F.col("lang"), F.col("source"), F.lit(".txt")).alias("meta"))


_LIBRARY = """first AS (SELECT 'd' || doc_id AS path, 1.0 AS mtime, length(coalesce(text, '')) AS fsize, CASE WHEN lang = 'de' THEN 'old' ELSE md5(coalesce(text, '')) END AS sha256, regexp_matches(coalesce(text, ''), '\\S') AS said FROM documents),
    then_ AS (SELECT 'd' || doc_id AS path, CASE WHEN lang = 'fr' THEN 9.0 WHEN lang = 'de' THEN 5.0 ELSE 1.0 END AS mtime, length(coalesce(text, '')) AS fsize, md5(coalesce(text, '')) AS sha256 FROM documents WHERE coalesce(source, '') <> 'src1')"""


@query(f"""WITH {_LIBRARY} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'PURGE' WHEN a.path IS NULL THEN 'INSERT'
    WHEN a.said AND abs(a.mtime - b.mtime) <= 2.0 AND a.fsize = b.fsize THEN 'SKIP' WHEN a.said AND a.sha256 = b.sha256 THEN 'TOUCH' ELSE 'REPLACE' END AS action
    FROM first a FULL JOIN then_ b ON a.path = b.path""")
def reconcile(c: Corpus) -> DataFrame:
    """All documents as files, reconciled twice: then German ones have new texts, French ones new times, and those of src1 are gone."""
    from folioscope.plans import reconcile as job

    text = F.coalesce("text", F.lit(""))
    sha, d = F.md5(text.cast("binary")), c.table("documents")
    at = lambda mtime, sha256: d.select("source", F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(".txt").alias("ext"), mtime.alias("mtime"), F.length(text).cast("long").alias("fsize"),
                                        sha256.alias("sha256"), F.lit("t").alias("title"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/library-{uuid.uuid4().hex}"
    job.reconcile(c.spark, root, at(F.lit(1.0), F.when(F.col("lang") == "de", "old").otherwise(sha)).drop("source"))
    later = F.when(F.col("lang") == "fr", 9.0).when(F.col("lang") == "de", 5.0).otherwise(1.0)
    return job.reconcile(c.spark, root, at(later, sha).where(F.coalesce("source", F.lit("")) != "src1").drop("source")).select("path", "action")
