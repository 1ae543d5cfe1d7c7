"""The dealt queries: each applies its operator to a whole table. The SQL is for DuckDB over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chat, cotrain, exactdup, hardneg, hostrules, mixing, neardup, packing, sharding, toxicity, urlfilter, validtime, warc
from folioscope.llm.common import shared_path
from folioscope.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted(turns.unionByName(extra))


def op6_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_groups(docs, neardup.NearDupSpec(shingle_words=4))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "slot-map")
    sharding.SlotMap.initial(8, 4096).save(spark, path)  # version 0; balancing edits it to version 1
    placed = sharding.shard(docs, n_shards=8, before=sharding.SlotMap.load(spark, path), map_path=path)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "kept")


def op11_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url is labelled by its document: bad where the quality is 0 or it is toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return urlfilter.judge(pages, rules, urlfilter.fit(pages.join(bad, "page_id"))).select("page_id", "host", "path", "rule", "verdict", "score")


def op12_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validtime.enriched(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_toxicity, op3_warc_history, op4_packing, op5_chat_tree, op6_odd_sketch, op7_exact_dedup, op8_host_rules, op9_virtual_slots, op10_co_training,
    op11_url_trees, op12_valid_time, op13_hard_negatives,
)}

# CRC-32 of an id's decimal digits, bit by bit: DuckDB has no such function.
_CRC_STEP = "xor(CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END, xor(c, b) >> 1)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: {_CRC_STEP}), 4294967295)"

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERY_SQL = {
    "op3_warc_history": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', ['host', 'rest']) AS u FROM pages),
        d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest, u FROM p),
        h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < head THEN head END AS refers_to,
               array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || CASE WHEN starts_with(u.rest, '/') THEN u.rest ELSE '/' || u.rest END AS urlkey,
               strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM h""",
    "op5_chat_tree": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + 4 + length(text) + length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')) + 7) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id, own""",
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op8_host_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
                  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
        again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
        m AS (SELECT d.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
              FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
        p AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS spread, avg(1 / n) AS share FROM h),
        v AS (SELECT mean, mean * (1 - mean) AS p, spread - mean * (1 - mean) * share AS var FROM p),
        w AS (SELECT mean, p, CASE WHEN var > 1e-9 THEN greatest(1.0, least(10000.0, p / var - 1)) ELSE 10000.0 END AS weight FROM v),
        r AS (SELECT source, (f + mean * weight) / (n + weight) AS rate, least(0.5, greatest(mean + 3 * sqrt(p / (weight + 1)), 2 * mean)) AS top FROM h, w)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(rate <= top, true) AS kept
        FROM b LEFT JOIN r USING (source)""",
    "op12_valid_time": f"""
        WITH s AS (SELECT row_number() OVER () AS rid, sale_id, client_id, sold_at, greatest(0, least(7, floor(((arrived_at::DATE - DATE '1970-01-01') - 19723) * 8 / 152)))::INT AS bs FROM sales),
        c AS (SELECT *, greatest(0, least(7, floor(((valid_at::DATE - DATE '1970-01-01') + {_CRC} % 4 - 19723) * 8 / 152)))::INT AS bc,
                     floor(100 * balance + 0.5)::BIGINT AS cents
              FROM (SELECT DISTINCT * FROM client_changes) WHERE valid_at IS NOT NULL),
        b AS (SELECT unnest(range(9))::INT AS b),
        sw AS (SELECT b, max(sold_at) - INTERVAL 12 HOUR AS w FROM b LEFT JOIN s ON bs < b GROUP BY b),
        cw AS (SELECT b, max(valid_at) - INTERVAL 12 HOUR AS w FROM b LEFT JOIN c ON bc < b GROUP BY b),
        h AS (SELECT b, CASE WHEN sw.w IS NOT NULL AND cw.w IS NOT NULL THEN least(sw.w, cw.w) END AS h, cw.w AS cw FROM sw JOIN cw USING (b)),
        v AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST, op NULLS FIRST, cents NULLS FIRST) AS k
              FROM c JOIN h ON b = bc WHERE NOT coalesce(valid_at < cw, false) AND client_id IS NOT NULL),
        e AS (SELECT s.*, coalesce((SELECT min(b) FROM h WHERE b BETWEEN bs AND 7 AND (sold_at IS NULL OR sold_at < h)), 8) AS e FROM s),
        held AS (SELECT client_id, e, p.h AS hp, count(*) FILTER (bc <= e) - greatest(0, count(*) FILTER (bc < e AND valid_at <= p.h) - 1) AS n_held,
                        max(k) FILTER (bc < e AND valid_at <= p.h) AS l
                 FROM (SELECT DISTINCT client_id, e FROM e) JOIN v USING (client_id) LEFT JOIN h AS p ON p.b = e - 1 GROUP BY client_id, e, p.h),
        m AS (SELECT rid, max(k) AS k FROM e JOIN held USING (client_id, e) JOIN v USING (client_id)
              WHERE bc <= e AND valid_at <= sold_at AND (bc = e OR k >= coalesce(l, 0)) GROUP BY rid)
        SELECT 'sale' AS rec, sale_id AS id, e::INT AS batch, coalesce(n_held, 0) AS n_held, change_id, cents AS balance_cents, op
        FROM e LEFT JOIN held USING (client_id, e) LEFT JOIN m USING (rid) LEFT JOIN v USING (client_id, k)
        UNION ALL SELECT 'change', change_id, bc, NULL, NULL, NULL, NULL FROM c JOIN h ON b = bc WHERE valid_at < cw""",
    "op13_hard_negatives": """
        WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
              FROM r AS a JOIN r AS b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
