"""The driver's queries for this folder, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytebpe, decontaminate, divergence, importance, mixing, order_minhash, quality, sharding, substring, tokencount, topk, urlfilter, warc
from gridloom.llm.common import scratch_path, table

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS = 16
MAX_TOKENS = 2048


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.judge(pages, URL_RULES, urlfilter.mine(pages.join(labels, "page_id")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.with_score(documents.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sizes, rows = sharding.slot_totals(sharding.sized(documents))
    path = scratch_path(spark, "slots")
    sharding.store(spark, sharding.deal(sizes, SHARDS), path)
    placed = sharding.place(documents, sharding.load(spark, path), rows)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_raked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"))


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op11_bucket_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_baseline_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_transition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


_QUERIES = (op1_order_minhash, op2_warc_index, op3_fixed_block_anchors, op4_pivot_top_k, op5_token_counts, op6_url_rules, op7_quality, op8_virtual_slots, op9_raked_sample, op10_suffix_automaton, op11_bucket_postings, op12_baseline_corrections, op13_transition_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM v) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_TARGET_ROWS = ", ".join(f"('{d}', '{c}', {v!r}::DOUBLE)" for d in mixing.DIMENSIONS for c, v in mixing.TARGETS[d].items())


def _case(d: str) -> str:
    named = ", ".join(f"'{c}'" for c in mixing.TARGETS[d] if c != mixing.REST)
    return f"CASE WHEN {d} IN ({named}) THEN {d} ELSE '{mixing.REST}' END AS cell_{d}"


def _rake_step(d: str, name: str, source: str) -> str:
    share = f"(SELECT sum(v) FROM targets WHERE d = '{d}' AND c IN (SELECT cell_{d} FROM cells WHERE t > 0))"
    target = f"coalesce((SELECT v FROM targets WHERE d = '{d}' AND c = cell_{d}), 0)"
    return f"(SELECT * EXCLUDE (v), v * ((SELECT sum(t) FROM cells) * {target} / {share}) / sum(v) OVER (PARTITION BY cell_{d}) AS v FROM {source}) {name}"


OP9_SQL = f"""
WITH RECURSIVE targets(d, c, v) AS (VALUES {_TARGET_ROWS}), t AS MATERIALIZED (
  SELECT *, {", ".join(map(_case, mixing.DIMENSIONS))} FROM (
    SELECT doc_id, source, lang,
      CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
      coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens
    FROM documents)
), cells AS MATERIALIZED (
  SELECT cell_source, cell_lang, cell_topic, sum(n_tokens)::DOUBLE AS t FROM t GROUP BY ALL
), raked AS (
  SELECT cell_source, cell_lang, cell_topic, 0 AS k, t AS v FROM cells WHERE t > 0
  UNION ALL
  SELECT cell_source, cell_lang, cell_topic, k + 1, v FROM {_rake_step("topic", "x3", _rake_step("lang", "x2", _rake_step("source", "x1", f"(SELECT * FROM raked WHERE k < {mixing.ITERATIONS}) x0")))}
), f AS (
  SELECT cell_source, cell_lang, cell_topic, v / t AS f FROM raked JOIN cells USING (cell_source, cell_lang, cell_topic) WHERE k = {mixing.ITERATIONS}
), filled AS (
  SELECT f, ({mixing.KEEP!r}::DOUBLE * (SELECT sum(t) FROM cells) - coalesce(sum(t) OVER w, 0)) / (sum(t * f) OVER () - coalesce(sum(t * f) OVER w, 0)) AS c
  FROM f JOIN cells USING (cell_source, cell_lang, cell_topic)
  WINDOW w AS (ORDER BY f DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), scale AS (
  SELECT min(c) AS c FROM filled WHERE c * f <= 1 AND f > 0 AND f = (SELECT max(f) FROM filled WHERE c * f <= 1 AND f > 0)
)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability FROM (
  SELECT t.*, coalesce(least(1.0, f * (SELECT c FROM scale)), 1.0) AS p FROM t LEFT JOIN f USING (cell_source, cell_lang, cell_topic)
) WHERE ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < p
"""

OP10_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT k FROM iw), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes)
), hit AS (
  SELECT doc_id, item_id, s, dw.k FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP11_SQL = r"""
WITH bits AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), dw AS MATERIALIZED (
  SELECT r, unnest(w) AS word FROM d
), crc AS MATERIALIZED (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM b), bits
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY 1),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM b)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), summed AS (
  SELECT r, sum(gain)::BIGINT AS total FROM dw JOIN crc USING (word) JOIN gains USING (bucket) GROUP BY 1
), weighed AS (
  SELECT r, doc_id, len(w)::BIGINT AS n, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight FROM d LEFT JOIN summed USING (r)
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank FROM placed
"""

OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS MATERIALIZED (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(n)::HUGEINT AS everywhere FROM c GROUP BY ALL HAVING count(*) >= 10
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(everywhere)::HUGEINT AS lang_total FROM kept GROUP BY 1
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT lang, source, term, sum(n)::HUGEINT AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL
), every AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, everywhere FROM g JOIN kept USING (lang) LEFT JOIN s USING (lang, source, term)
), shares AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (everywhere + 2) // (lang_total + 2 * v) AS q
  FROM every JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), found AS (
  SELECT * FROM every_pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index": OP2_SQL, "op3_fixed_block_anchors": OP3_SQL, "op4_pivot_top_k": OP4_SQL, "op9_raked_sample": OP9_SQL, "op10_suffix_automaton": OP10_SQL, "op11_bucket_postings": OP11_SQL, "op12_baseline_corrections": OP12_SQL}
