"""DuckDB SQL that the registry's queries share."""

from __future__ import annotations

from folioscope.functions.analysis import ACCENTED, PLAIN, STOP_WORDS

STOP = "(" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + ")"


def toks(text: str) -> str:
    return rf"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"
DOC_QUESTIONS = "SELECT doc_id AS query_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0"


def base(questions: str = QUESTIONS, pool: int = 40) -> str:
    """WITH clause: chunks, questions, terms, kw, bm (scores), pool (best by score), rr (reranked pool)."""
    part = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return rf"""WITH chunks AS (SELECT doc_id AS chunk_id, source AS path, lang || ' ' || source AS title, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index, text FROM documents),
    questions AS ({questions}),
    clist AS (SELECT chunk_id, {toks('text')} AS l FROM chunks),
    ctok AS (SELECT chunk_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS term FROM clist),
    lengths AS (SELECT chunk_id, len(l) AS dl FROM clist),
    totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
    dfreq AS (SELECT term, count(DISTINCT chunk_id) AS df FROM ctok GROUP BY term),
    qtok AS (SELECT query_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS term FROM (SELECT query_id, {toks('text')} AS l FROM questions)),
    qcount AS (SELECT query_id, term, count(*) AS tf, min(pos) AS first FROM qtok GROUP BY query_id, term),
    qweight AS (SELECT query_id, term, first, round(tf * ln((n + 1.0) / (coalesce(df, 0) + 0.5)), 9) AS weight FROM qcount LEFT JOIN dfreq USING (term) CROSS JOIN totals),
    qbest AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, first) AS place, term FROM qweight) WHERE place <= 14 AND term NOT IN {STOP}),
    qenough AS (SELECT query_id FROM qbest GROUP BY query_id HAVING count(*) >= 2),
    qplain AS (SELECT query_id, pos AS place, term FROM qtok WHERE term NOT IN {STOP} AND query_id NOT IN (SELECT query_id FROM qenough)),
    terms AS (SELECT query_id, pos, term FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS pos, term FROM
        (SELECT * FROM qbest WHERE query_id IN (SELECT query_id FROM qenough) UNION ALL SELECT * FROM qplain)) WHERE pos <= 14
        UNION ALL SELECT query_id, 1, trim(text) FROM questions WHERE trim(text) <> '' AND query_id NOT IN (SELECT query_id FROM qenough) AND query_id NOT IN (SELECT query_id FROM qplain)),
    kw AS (SELECT query_id, list(term ORDER BY pos) AS keywords FROM terms GROUP BY query_id),
    hits AS (SELECT t.query_id, t.pos AS term_no, c.chunk_id, count(*) AS tf FROM terms t JOIN ctok c ON c.term = t.term GROUP BY ALL),
    tdf AS (SELECT query_id, term_no, count(*) AS df FROM hits GROUP BY ALL),
    bm AS (SELECT h.query_id, h.chunk_id, round(-sum({part}), 9) AS bm25 FROM hits h JOIN tdf USING (query_id, term_no) JOIN lengths USING (chunk_id) CROSS JOIN totals GROUP BY ALL),
    pool AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS INTEGER) AS bm25_rank FROM bm) WHERE bm25_rank <= {pool}),
    feature AS (SELECT p.query_id, p.chunk_id, any_value(p.bm25) AS bm25, sum(contains(c.text, t.term)::INT) / count(*) AS coverage,
                       least(1.0, sum((length(t.term) > 1 AND contains(lower(c.title), lower(t.term)))::INT) / greatest(2.0, count(*))) AS bonus
                FROM pool p JOIN terms t USING (query_id) JOIN chunks c USING (chunk_id) GROUP BY p.query_id, p.chunk_id),
    span AS (SELECT *, min(bm25) OVER (PARTITION BY query_id) AS low, max(bm25) OVER (PARTITION BY query_id) AS high FROM feature),
    scored AS (SELECT *, round(1.0 - CASE WHEN high - low <= 1e-12 THEN 0.5 ELSE (bm25 - low) / (high - low) END + 1.25 * coverage + 0.35 * bonus, 9) AS rr FROM span),
    rr AS (SELECT query_id, chunk_id, path, title, chunk_index, text, bm25, coverage, bonus, rr, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, bm25, chunk_id) AS INTEGER) AS rank FROM scored JOIN chunks USING (chunk_id))"""


def thinned(source: str, top_k: int, most: int = 3) -> str:
    """CTEs deduped, capped and final of ranked rows (query_id, chunk_id, path, text, rank)."""
    return rf""",
    deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {trim('substr(text, 1, 160)')} ORDER BY rank) AS d FROM {source}) WHERE d = 1),
    capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS c FROM deduped) WHERE c <= {most}),
    final AS (SELECT * EXCLUDE (rank, d, c), new_rank AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS new_rank FROM capped) WHERE new_rank <= {top_k})"""


def cos(a: str, b: str) -> str:
    """Inner product of two vectors that are scaled to length 1 unless they nearly have it."""
    n = lambda x: f"(CASE WHEN abs(sqrt(list_inner_product({x}::DOUBLE[], {x}::DOUBLE[])) - 1) < 1e-3 THEN 1.0 ELSE sqrt(list_inner_product({x}::DOUBLE[], {x}::DOUBLE[])) END)"
    return f"round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / ({n(a)} * {n(b)}), 6)"
