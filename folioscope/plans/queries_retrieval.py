"""Queries of ranking, vectors, fusion, graph, cache and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.config import RetrievalConfig
from folioscope.functions.analysis import fast_terms, query_terms
from folioscope.operators import blocks, cache, clusters, evaluate, fusion, graph, ingest, lexical, quantile, substring, vector
from folioscope.plans import retrieve
from folioscope.plans.registry import Corpus, query
from folioscope.session import cut
from folioscope.plans.sql import DOC_QUESTIONS, QUESTIONS, base, cos, thinned, toks, trim

TOP = 10


@query(f"""WITH l AS (SELECT doc_id AS chunk_id, unnest({toks('text')}) AS term FROM documents), p AS (SELECT chunk_id, term, count(*) AS tf FROM l GROUP BY ALL)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS places FROM p GROUP BY term""")
def index_build(c: Corpus) -> DataFrame:
    """Writes the index, if no query of this application has; what it holds of each term."""
    return c.index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("places"))


@query(base() + f" SELECT query_id, chunk_id, bm25, bm25_rank FROM pool WHERE bm25_rank <= {TOP}")
def bm25_topk(c: Corpus) -> DataFrame:
    return lexical.ranked(lexical.bm25(c.index, c.terms), TOP, F.col("bm25"), F.col("chunk_id"), name="bm25_rank")


@query(base() + f" SELECT query_id, chunk_id, bm25, bm25_rank FROM pool WHERE bm25_rank <= {TOP}")
def bm25_bounded(c: Corpus) -> DataFrame:
    """bm25_topk from blocks that may hold one of the best chunks; the index with positions is for phrases only."""
    held = c.blocks
    terms = cut(query_terms(c.questions, held.frequencies, held.totals))
    return blocks.bm25_best(held, held.blocks, terms, TOP, whole=lambda: c.index)


@query(base() + thinned("rr", TOP) + " SELECT query_id, chunk_id, path, rank, rr FROM final")
def fts_reranked(c: Corpus) -> DataFrame:
    return lexical.fts_reranked(c.index, c.chunks, c.terms, TOP).select("query_id", "chunk_id", "path", "rank", "rr")


@query(base() + " SELECT query_id, chunk_id, rank, bm25, rr FROM rr")
def fts_pool(c: Corpus) -> DataFrame:
    return c.pool.select("query_id", "chunk_id", "rank", "bm25", "rr")


@query(base() + " SELECT query_id, chunk_id, round(coverage, 9) AS coverage FROM rr")
def keyword_coverage(c: Corpus) -> DataFrame:
    return c.pool.select("query_id", "chunk_id", F.round(lexical.coverage(F.col("text"), F.col("keywords")), 9).alias("coverage"))


@query("""SELECT doc_id AS chunk_id, round(least(1.0, (contains(lower(lang || ' ' || source), 'en')::INT + contains(lower(lang || ' ' || source), 'src1')::INT + contains(lower(lang || ' ' || source), 'rare')::INT) / 3.0), 9) AS bonus FROM documents""")
def title_bonus(c: Corpus) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("EN", "src1", "rare")])
    return c.chunks.select("chunk_id", F.round(lexical.title_bonus(F.col("title"), words), 9).alias("bonus"))


_LIKE = r""", found AS (SELECT query_id, chunk_id, path, text, title, sum(CASE WHEN lower(text) LIKE '%' || lower(term) || '%' THEN 1 ELSE 0 END) AS any_hit,
        -sum((length(text) - length(replace(text, term, ''))) // length(term))::DOUBLE AS bm25, sum(contains(text, term)::INT) / count(*) AS coverage,
        least(1.0, sum((length(term) > 1 AND contains(lower(title), lower(term)))::INT) / greatest(2.0, count(*))) AS bonus
        FROM chunks CROSS JOIN terms GROUP BY query_id, chunk_id, path, text, title),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS scan_rank FROM found WHERE any_hit > 0) WHERE scan_rank <= 120),
    fspan AS (SELECT *, min(bm25) OVER (PARTITION BY query_id) AS low, max(bm25) OVER (PARTITION BY query_id) AS high FROM first),
    fscored AS (SELECT *, round(1.0 - CASE WHEN high - low <= 1e-12 THEN 0.5 ELSE (bm25 - low) / (high - low) END + 1.25 * coverage + 0.35 * bonus, 9) AS rr FROM fspan),
    franked AS (SELECT query_id, chunk_id, path, text, bm25, rr, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, scan_rank) AS INTEGER) AS rank FROM fscored)"""


@query(base() + _LIKE + thinned("franked", TOP) + " SELECT query_id, chunk_id, rank, bm25, rr FROM final")
def like_fallback(c: Corpus) -> DataFrame:
    return lexical.like_fallback(c.chunks, c.terms, TOP, grams=lambda: c.grams).select("query_id", "chunk_id", "rank", "bm25", "rr")


_PATTERNS = """p AS (SELECT item_id AS pattern_id, CASE item_id % 4 WHEN 0 THEN substr(text, 6, 9) WHEN 1 THEN upper(substr(text, 3, 4)) || '%' || substr(text, 12, 5)
    WHEN 2 THEN substr(text, 2, 3) || '_' || substr(text, 6, 4) ELSE substr(text, 5, 2) END AS pattern FROM benchmark)"""


@query(f"WITH {_PATTERNS} SELECT pattern_id, doc_id AS chunk_id FROM p JOIN documents ON lower(text) LIKE '%' || lower(pattern) || '%'")
def substring_search(c: Corpus) -> DataFrame:
    """Patterns of two to nine characters with and without wildcards, against all documents through their runs of three."""
    p = F.expr("CASE query_id % 4 WHEN 0 THEN substr(text, 6, 9) WHEN 1 THEN upper(substr(text, 3, 4)) || '%' || substr(text, 12, 5) WHEN 2 THEN substr(text, 2, 3) || '_' || substr(text, 6, 4) ELSE substr(text, 5, 2) END")
    asked = c.questions.select(F.col("query_id").alias("pattern_id"), p.alias("pattern"))
    return substring.search(c.grams, c.chunks, asked)


@query(rf"""WITH l AS (SELECT doc_id AS chunk_id, {toks('text')} AS l FROM documents), t AS (SELECT chunk_id, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM l),
    q AS (SELECT item_id AS query_id, ({toks('text')})[1:3] AS w FROM benchmark)
    SELECT q.query_id, a.chunk_id, count(*) AS tf FROM q JOIN t a ON a.term = q.w[1] JOIN t b ON b.chunk_id = a.chunk_id AND b.pos = a.pos + 1 AND b.term = q.w[2]
    JOIN t d ON d.chunk_id = a.chunk_id AND d.pos = a.pos + 2 AND d.term = q.w[3] GROUP BY ALL""")
def phrase_match(c: Corpus) -> DataFrame:
    from folioscope.functions.analysis import tokens

    first = F.array_join(F.slice(tokens(F.col("text")), 1, 3), "-")
    terms = c.questions.select("query_id", F.lit(1).alias("pos"), first.alias("term"))
    return lexical.matches(c.index, terms).select("query_id", "chunk_id", "tf")


_VQ = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"
_VTOP = f"""WITH {_VQ}, s AS (SELECT query_id, vec_id AS chunk_id, {cos('q', 'embedding')} AS similarity FROM q CROSS JOIN embeddings)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= {TOP}"""


@query(_VTOP)
def vector_topk_batch(c: Corpus) -> DataFrame:
    return vector.vector_topk(c.vector_questions, vector.of_model(c.vectors, "given", 64), TOP)


@query(_VTOP)
def vector_topk_all_models(c: Corpus) -> DataFrame:
    """No vector has the model asked for, so all of the width are searched."""
    return vector.vector_topk(c.vector_questions, vector.of_model(c.vectors, "another", 64), TOP)


@query("""SELECT a.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    UNION ALL SELECT -1, 0.0""")
def cosine_guarded(c: Corpus) -> DataFrame:
    a, b = c.vectors.select("chunk_id", "embedding"), c.vectors.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("b"))
    zero = c.spark.createDataFrame([(-1, [0.0, 0.0], [1.0, 0.0])], "chunk_id long, embedding array<float>, b array<float>")
    return a.join(b, "chunk_id").unionByName(zero).select("chunk_id", F.round(vector.cosine_guarded(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {_VQ}, e AS (SELECT label AS cluster, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT cluster, i, avg(x) AS x FROM e GROUP BY ALL), cen AS (SELECT cluster, list(x ORDER BY i) AS c FROM m GROUP BY cluster),
    near AS (SELECT * FROM (SELECT query_id, cluster, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q::DOUBLE[], c), 6), cluster) AS n FROM q CROSS JOIN cen) WHERE n <= 3),
    s AS (SELECT query_id, vec_id AS chunk_id, {cos('q', 'embedding')} AS similarity FROM near JOIN q USING (query_id) JOIN embeddings ON label = cluster)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= {TOP}""")
def ivf_probe(c: Corpus) -> DataFrame:
    return vector.ivf_probe(c.vector_questions, vector.centroids_by_label(c.vectors), c.vectors.select("chunk_id", "cluster", "embedding"), TOP)


@query()
def ivf_kmeans(c: Corpus) -> DataFrame:
    """Clusters by k-means, as many of them asked as a sample needed for a recall of 0.95."""
    return clusters.search(c.clusters, c.vector_questions.withColumn("model", F.lit("given")), TOP, exact=False)


@query(_VTOP)
def ivf_exact(c: Corpus) -> DataFrame:
    """Cluster search by bounds: the result of a whole scan."""
    return clusters.search(c.clusters, c.vector_questions.withColumn("model", F.lit("given")), TOP)


@query(f"""WITH {_VQ} SELECT query_id, 1.0::DOUBLE AS exact_recall, true AS near_is_enough FROM q""")
def ivf_recall(c: Corpus) -> DataFrame:
    """Recall of both modes against the matrix scan: 1 of the exact one for each query, 0.9 or more of the other over all."""
    asked = cut(c.vector_questions.withColumn("model", F.lit("given")))
    scan = cut(vector.vector_topk(asked, c.vectors, TOP))
    near = vector.recall(clusters.search(c.clusters, asked, TOP, exact=False), scan).agg(F.avg("recall").alias("mean"))  # one row
    exact = vector.recall(clusters.search(c.clusters, asked, TOP), scan)
    return exact.crossJoin(F.broadcast(near)).select("query_id", F.col("recall").alias("exact_recall"), (F.col("mean") >= 0.9).alias("near_is_enough"))


_HYBRID_POOL = base(DOC_QUESTIONS, 100)
_NEAR = f""", vs AS (SELECT query_id, vec_id AS chunk_id, {cos('q.embedding', 'e.embedding')} AS similarity FROM questions q CROSS JOIN embeddings e),
    vrank AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM vs)"""


def _rrf(vector_rows: str, name: str = "fused") -> str:
    return f""", near AS ({vector_rows}), joined AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS first_rank, b.rank AS second_rank,
        round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 12) AS rrf FROM (SELECT query_id, chunk_id, rank FROM rr) a FULL JOIN near b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
    {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_rank ASC NULLS LAST, second_rank ASC NULLS LAST) AS INTEGER) AS rank FROM joined)"""


@query(_HYBRID_POOL + _NEAR + _rrf("SELECT query_id, chunk_id, rank FROM vrank WHERE rank <= 100") + " SELECT query_id, chunk_id, rank, rrf FROM fused")
def rrf_merge(c: Corpus) -> DataFrame:
    q = c.document_questions
    fts = lexical.fts_pool(c.index, c.chunks, c.terms_of(q), 100)
    return fusion.rrf_merge(fts, vector.vector_topk(q, c.vectors, 100)).select("query_id", "chunk_id", "rank", "rrf")


_BARE = r"regexp_replace(lower({}), '\s+', '', 'g')"
_STRONG = rf""", strong AS (SELECT r.query_id, (length({_BARE.format('any_value(q.text)')}) >= 10 AND contains({_BARE.format('any_value(r.text)')}, {_BARE.format('any_value(q.text)')}))
        OR (any_value(len(kw.keywords)) >= 2 AND any_value(r.coverage) >= 1.0) AS strong FROM rr r JOIN questions q USING (query_id) JOIN kw USING (query_id) WHERE r.rank = 1 GROUP BY r.query_id)"""
_CROSS = rf""", head AS (SELECT f.query_id, f.chunk_id, f.rank AS old_rank, c.path, c.text, list_distinct({toks('q.text')}) AS qt, {toks('substr(c.text, 1, 2200)')} AS ct
        FROM fused f JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE f.rank <= greatest(20, {2 * TOP})),
    crossed AS (SELECT query_id, chunk_id, path, text, cross_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, old_rank) AS INTEGER) AS rank
        FROM (SELECT *, round(len(list_intersect(qt, ct)) / len(qt), 9) AS cross_score FROM head)) WHERE rank <= 20)"""
_HYBRID = _HYBRID_POOL + _NEAR + _STRONG + _rrf("SELECT v.query_id, v.chunk_id, v.rank FROM vrank v LEFT JOIN strong s USING (query_id) WHERE v.rank <= CASE WHEN coalesce(s.strong, false) THEN 50 ELSE 100 END") + _CROSS


@query(_HYBRID + thinned("crossed", 4 * TOP) + " SELECT query_id, chunk_id, path, rank FROM final")
def hybrid_retrieve(c: Corpus) -> DataFrame:
    q = c.document_questions
    return retrieve.hybrid(c.index, c.chunks, c.vectors, q, c.terms_of(q), TOP).select("query_id", "chunk_id", "path", "rank")


@query(base() + ", fused AS (SELECT query_id, chunk_id, rank FROM rr)" + _CROSS + " SELECT query_id, chunk_id, rank, cross_score FROM crossed")
def cross_rerank(c: Corpus) -> DataFrame:
    rows = c.pool.where("rank <= 20").select("query_id", "chunk_id", "text", "rank").join(c.questions.withColumnRenamed("text", "query"), "query_id")
    return fusion.cross_rerank(rows, 20).select("query_id", "chunk_id", "rank", F.col("cross").alias("cross_score"))


@query()
def retrieve_full(c: Corpus) -> DataFrame:
    q = c.document_questions
    adjacent = graph.adjacent_edges(c.places)
    return retrieve.retrieve(c.index, c.chunks, c.vectors, q, c.terms_of(q), 4, edges=adjacent, config=RetrievalConfig(graph=True), grams=lambda: c.grams)


@query()
def fast_retrieve(c: Corpus) -> DataFrame:
    q = c.document_questions
    return retrieve.retrieve_fast(c.index, c.chunks, c.vectors, q, cut(fast_terms(q, c.frequencies, c.index.totals)), TOP)


@query(rf"""SELECT min(doc_id) AS chunk_id, count(*) AS n FROM documents GROUP BY {trim('substr(text, 1, 160)')}""")
def dedup_prefix(c: Corpus) -> DataFrame:
    return c.table("documents").groupBy(fusion.prefix(F.col("text"))).agg(F.min("doc_id").alias("chunk_id"), F.count(F.lit(1)).alias("n")).select("chunk_id", "n")


@query(base() + " SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS n FROM rr) WHERE n <= 2")
def per_doc_cap(c: Corpus) -> DataFrame:
    return fusion.per_doc_cap(c.pool, 2).select("query_id", "chunk_id", "rank")


@query(base() + thinned("rr", TOP, 2) + " SELECT query_id, chunk_id, rank FROM final")
def postprocess(c: Corpus) -> DataFrame:
    return fusion.postprocess(c.pool, TOP, RetrievalConfig(max_chunks_per_doc=2)).select("query_id", "chunk_id", "rank")


# Row by row in rank order; what was taken so far decides on the next one.
_GREEDY = base().replace("WITH ", "WITH RECURSIVE ", 1) + rf""",
    listed AS MATERIALIZED (SELECT query_id, rank AS i, chunk_id, path, coalesce(path, chr(1)) AS shelf, {trim('substr(text, 1, 160)')} AS start FROM rr),
    walk(query_id, i, starts, shelves, taken) AS (SELECT DISTINCT query_id, 0, []::VARCHAR[], []::VARCHAR[], false FROM listed
        UNION ALL SELECT query_id, i, CASE WHEN ok THEN list_append(starts, start) ELSE starts END, CASE WHEN ok THEN list_append(shelves, shelf) ELSE shelves END, ok FROM
            (SELECT l.*, w.starts, w.shelves, NOT list_contains(w.starts, l.start) AND len(list_filter(w.shelves, lambda x: x = l.shelf)) < 2 AND len(w.starts) < {TOP} AS ok
             FROM walk w JOIN listed l ON l.query_id = w.query_id AND l.i = w.i + 1))
    SELECT query_id, chunk_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INTEGER) AS rank FROM walk JOIN listed USING (query_id, i) WHERE taken"""


@query(_GREEDY)
def fast_dedup_cap(c: Corpus) -> DataFrame:
    return fusion.greedy_dedup_cap(c.pool, TOP, 2)


@query("SELECT doc_id AS chunk_id, source AS path FROM documents WHERE source = 'src1' OR starts_with(source, 'src1/')")
def scope_filter(c: Corpus) -> DataFrame:
    return c.chunks.where(ingest.in_scope(F.col("path"), "src1")).select("chunk_id", "path")


@query(base() + " SELECT query_id, NOT bool_or(path = 'src1') AS missed FROM rr WHERE rank <= 16 GROUP BY query_id")
def scoped_miss(c: Corpus) -> DataFrame:
    return ingest.scoped_miss(c.pool, "src1")


@query(base() + _STRONG + " SELECT query_id, strong FROM strong")
def strong_hit(c: Corpus) -> DataFrame:
    return lexical.strong_hit(c.pool.join(c.questions.withColumnRenamed("text", "query"), "query_id"))


_ADJ = """adj AS (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM documents),
    adjacent AS (SELECT src, dst FROM adj WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM adj WHERE dst IS NOT NULL)"""


@query(f"WITH {_ADJ} SELECT src, dst, 'adjacent' AS rel, 1.0::DOUBLE AS weight FROM adjacent")
def graph_adjacent(c: Corpus) -> DataFrame:
    return graph.adjacent_edges(c.places)


_TAGS = """, ccount AS (SELECT chunk_id, term, count(*) AS tf FROM ctok GROUP BY ALL),
    cw AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln((n + 1.0) / (df + 0.5)), 9) DESC, term) AS r FROM ccount JOIN dfreq USING (term) CROSS JOIN totals WHERE term NOT IN {stop}),
    tag AS (SELECT chunk_id, term FROM cw WHERE r <= 8), place AS (SELECT chunk_id, path, row_number() OVER (PARTITION BY path ORDER BY chunk_index) AS p FROM chunks),
    pairs AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS shared FROM place a JOIN place b ON a.path = b.path AND b.p - a.p BETWEEN 1 AND 5 JOIN tag x ON x.chunk_id = a.chunk_id JOIN tag y ON y.chunk_id = b.chunk_id AND y.term = x.term GROUP BY ALL HAVING count(*) >= 2),
    keyword AS (SELECT src, dst, least(1.0, shared / 8.0)::DOUBLE AS weight FROM pairs UNION ALL SELECT dst, src, least(1.0, shared / 8.0)::DOUBLE FROM pairs)"""
from folioscope.plans.sql import STOP  # noqa: E402

_KEY = base() + _TAGS.replace("{stop}", STOP)


def _keyword(c: Corpus) -> DataFrame:
    return graph.keyword_edges(c.places, graph.tags_of(c.index.postings, c.frequencies, c.index.totals))


@query(_KEY + " SELECT src, dst, 'keyword' AS rel, weight FROM keyword")
def graph_keyword(c: Corpus) -> DataFrame:
    return _keyword(c)


_EDGES = f""", {_ADJ}, edges AS (SELECT src, dst, 'adjacent' AS rel, 1.0::DOUBLE AS weight FROM adjacent UNION ALL
    SELECT src, dst, 'keyword', weight FROM keyword k WHERE NOT EXISTS (SELECT 1 FROM adjacent a WHERE a.src = k.src AND a.dst = k.dst))"""


@query(_KEY + _EDGES + " SELECT src, dst, rel, weight FROM edges")
def graph_edges(c: Corpus) -> DataFrame:
    return graph.merged_edges(graph.adjacent_edges(c.places), _keyword(c))


@query(_KEY + _EDGES + """, prim AS (SELECT query_id, chunk_id, rank FROM rr WHERE rank <= 10),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS er FROM edges) WHERE er <= 2),
    offered AS (SELECT p.query_id, b.dst AS chunk_id, min(p.rank * 1000 + b.er) AS found_at FROM prim p JOIN best b ON b.src = p.chunk_id WHERE NOT EXISTS (SELECT 1 FROM prim x WHERE x.query_id = p.query_id AND x.chunk_id = b.dst) GROUP BY ALL),
    extra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY found_at) AS n FROM offered) WHERE n <= 2), used AS (SELECT query_id, count(*) AS g FROM extra GROUP BY query_id),
    rows AS (SELECT query_id, chunk_id, 0 AS extra, rank AS n FROM prim LEFT JOIN used USING (query_id) WHERE rank <= greatest(0, 10 - coalesce(g, 0)) UNION ALL SELECT query_id, chunk_id, 1, n FROM extra)
    SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY extra, n) AS INTEGER) AS rank, extra = 1 AS extra FROM rows""")
def graph_expand(c: Corpus) -> DataFrame:
    edges = graph.merged_edges(graph.adjacent_edges(c.places), _keyword(c))
    return graph.graph_expand(c.pool.where("rank <= 10"), edges, 10)


# The cache: assistants' answers by the user turn before; questions are the same turns with other case and blanks.
_ENTRIES = r"""entries AS (SELECT u.conv_id * 1000 + u.turn AS entry_id, u.text AS query_text, a.text AS answer_text, CAST(u.conv_id * 1000 + u.turn AS DOUBLE) AS created_ts,
    sha256(regexp_replace(lower(regexp_replace(u.text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS query_hash
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _entries(c: Corpus) -> DataFrame:
    t = c.table("conversations")
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    u = t.where("role = 'user'").join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("text").alias("query_text"), "answer_text")
    return u.select(F.lit("given").alias("model"), cache.query_hash(F.col("query_text")).alias("query_hash"), "query_text", "answer_text", F.col("entry_id").cast("double").alias("created_ts"), "entry_id", F.lit(None).cast("array<float>").alias("embedding"))


_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY created_ts DESC, entry_id DESC) AS n FROM entries) WHERE n = 1)"


@query(f"WITH {_ENTRIES}, {_NEWEST}, asked AS (SELECT entry_id AS query_id, query_hash FROM entries) SELECT query_id, entry_id, answer_text, 'exact' AS kind FROM asked JOIN newest USING (query_hash)")
def cache_exact(c: Corpus) -> DataFrame:
    entries = _entries(c)
    asked = entries.select(F.col("entry_id").alias("query_id"), "model", F.concat(F.lit("  "), F.lower("query_text"), F.lit("\n ")).alias("text"))
    return cache.lookup_exact(asked, entries)


@query(f"WITH {_ENTRIES}, {_NEWEST} SELECT entry_id, query_hash FROM newest")
def cache_store_dedup(c: Corpus) -> DataFrame:
    return cache.newest(_entries(c)).select("entry_id", "query_hash")


@query(f"WITH {_ENTRIES} SELECT entry_id, created_ts FROM entries ORDER BY created_ts DESC, entry_id DESC LIMIT 32")
def cache_evict(c: Corpus) -> DataFrame:
    return cache.evict(_entries(c), 32).select("entry_id", "created_ts")


@query(f"WITH {_ENTRIES}, fit AS (SELECT * FROM entries WHERE trim(query_text) <> '' AND length(trim(answer_text)) >= 8), {_NEWEST.replace('FROM entries', 'FROM fit')} SELECT entry_id FROM newest ORDER BY created_ts DESC, entry_id DESC LIMIT 400")
def cache_store(c: Corpus) -> DataFrame:
    e = _entries(c)
    return cache.store(e.limit(0), e, 400).select("entry_id")


@query(f"""WITH entries AS (SELECT * FROM (SELECT vec_id AS entry_id, embedding FROM embeddings ORDER BY vec_id DESC LIMIT 400)), {_VQ},
    s AS (SELECT query_id, entry_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q CROSS JOIN entries)
    SELECT query_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id DESC) AS n FROM s WHERE similarity >= 0.85) WHERE n = 1""")
def cache_semantic(c: Corpus) -> DataFrame:
    entries = c.vectors.select(F.col("chunk_id").alias("entry_id"), "model", F.lit("").alias("answer_text"), F.col("chunk_id").cast("double").alias("created_ts"), "embedding")
    asked = c.vector_questions.withColumn("model", F.lit("given"))
    return cache.lookup_semantic(asked, entries, 0.85, 400).select("query_id", "entry_id", "similarity")


_EBARE = r"regexp_replace(lower({}), '[\s\x{{3000}}\x{{00A0}}]+', '', 'g')"
_EVAL = base() + thinned("rr", TOP) + rf""", got AS (SELECT f.query_id, f.rank, contains({_EBARE.format('f.text')}, {_EBARE.format('q.text')}) AS hit FROM final f JOIN questions q USING (query_id)),
    m AS (SELECT q.query_id, coalesce(max(hit::INT), 0)::DOUBLE AS hit, round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0.0), 9) AS mrr, round(coalesce(sum(hit::INT) / count(rank), 0.0), 9) AS precision, coalesce(max(hit::INT), 0)::DOUBLE AS recall FROM questions q LEFT JOIN got USING (query_id) GROUP BY q.query_id)"""


def _metrics(c: Corpus) -> DataFrame:
    golden = c.questions.select("query_id", F.array("text").alias("snippets"))
    return evaluate.retrieval_metrics(lexical.fts_reranked(c.index, c.chunks, c.terms, TOP), golden)


@query(_EVAL + " SELECT query_id, hit, mrr FROM m")
def eval_hit_mrr(c: Corpus) -> DataFrame:
    return _metrics(c).select("query_id", "hit", "mrr")


@query(_EVAL + " SELECT query_id, precision, recall FROM m")
def eval_precision_recall(c: Corpus) -> DataFrame:
    return _metrics(c).select("query_id", "precision", "recall")


@query(_EVAL + " SELECT round(avg(hit), 9) AS hit, round(avg(mrr), 9) AS mrr, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, count(*) AS n FROM m")
def eval_means(c: Corpus) -> DataFrame:
    return evaluate.mean_metrics(_metrics(c))


@query(base() + thinned("rr", TOP) + f""", a AS (SELECT query_id, chunk_id FROM final), b AS (SELECT query_id, chunk_id FROM pool WHERE bm25_rank <= {TOP}),
    u AS (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT query_id, round(sum((n = 2)::INT) / count(*), 9) AS overlap FROM u GROUP BY query_id""")
def result_overlap(c: Corpus) -> DataFrame:
    return evaluate.result_overlap(lexical.fts_reranked(c.index, c.chunks, c.terms, TOP), lexical.ranked(lexical.bm25(c.index, c.terms), TOP, F.col("bm25"), F.col("chunk_id")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type")
def latency_stats(c: Corpus) -> DataFrame:
    return evaluate.latency_stats(c.table("events"), "event_type", "value")


@query("""WITH d AS (SELECT label, vec_id, 1.0 - list_inner_product(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS gap FROM embeddings)
    SELECT label, round(quantile_cont(gap, 0.78), 6) AS threshold, count(gap) AS n FROM d GROUP BY label""")
def percentile_break(c: Corpus) -> DataFrame:
    following = F.expr("lead(embedding) OVER (PARTITION BY cluster ORDER BY chunk_id)")
    gaps = c.vectors.withColumn("f", following).select(F.col("cluster").alias("label"), (1.0 - vector.dot(F.col("embedding"), F.col("f"))).alias("gap"))
    return quantile.percentile(gaps, "label", "gap", 0.78).select("label", F.round("percentile", 6).alias("threshold"), "n")


@query(base() + r""", b AS (SELECT query_id, CAST(rank AS BIGINT) AS pos, chunk_id FROM rr WHERE rank <= 5) SELECT query_id, pos, chunk_id, path FROM b JOIN chunks USING (chunk_id)""")
def batch_lookup(c: Corpus) -> DataFrame:
    ids = c.pool.where("rank <= 5").select("query_id", F.col("rank").cast("long").alias("pos"), "chunk_id")
    return ingest.fetch_in_order(ids, c.chunks.select("chunk_id", "path", "text")).select("query_id", "pos", "chunk_id", "path")


@query(base(pool=12) + thinned("rr", 3) + " SELECT query_id, '引用' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || path, chr(10) ORDER BY rank) AS refs FROM final GROUP BY query_id")
def reference_list(c: Corpus) -> DataFrame:
    return retrieve.reference_list(lexical.fts_reranked(c.index, c.chunks, c.terms, 3))


@query(base(pool=12) + thinned("rr", 3) + """, s AS (SELECT *, replace(text, chr(10), ' ') AS flat FROM final)
    SELECT query_id, '问题：' || any_value(q.text) || chr(10) || chr(10) || '已检索到以下高相关资料片段：' || chr(10) || string_agg('[' || rank || '] ' || substr(flat, 1, 220) || CASE WHEN length(flat) > 220 THEN '...' ELSE '' END, chr(10) ORDER BY rank)
        || chr(10) || chr(10) || '引用：' || chr(10) || string_agg('[' || rank || '] ' || path || '（chunk=' || chunk_index || '）', chr(10) ORDER BY rank) AS answer FROM s JOIN questions q USING (query_id) GROUP BY query_id""")
def fallback_answer(c: Corpus) -> DataFrame:
    rows = lexical.fts_reranked(c.index, c.chunks, c.terms, 3).join(c.questions.withColumnRenamed("text", "query"), "query_id")
    return retrieve.fallback_answer(rows)


@query()
def prompt_assembly(c: Corpus) -> DataFrame:
    return retrieve.prompt_blocks(lexical.fts_reranked(c.index, c.chunks, c.terms, 3))
