"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm import chat, exact_dedup, language_id, line_dedup, mixture, ngram_join, packing, phrases, piece_encoding, prefix_trie, secrets, telephony, token_counts
from parcelforge.llm.common import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.languages(docs, language_id.train(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encoded_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    said = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(probe).alias("text")) for k, role in enumerate(("user", "assistant"))]
    return chat.chat_digest(rows.unionByName(said[0]).unionByName(said[1]))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony_digest(written(telephony.pack_bytes(documents(spark, sf_dir)), "telephony"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_sentencepiece, op4_mixture, op5_secrets, op6_chat, op7_telephony, op8_exact_dedup, op9_line_dedup, op10_ngram_join, op11_prefix_trie, op12_phrases, op13_packing)}


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), wide AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + length('<turn ></turn>') + 1 AS w FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(w)::BIGINT AS formatted_chars
FROM wide GROUP BY conv_id
"""


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS row_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM words GROUP BY source), weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS bound, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, coalesce(least(bound, (SELECT arg_min(level, bound / weight) FROM levels WHERE bound > level * weight) * weight), bound) AS target FROM levels
), seats AS (
  SELECT source, target / (2 * k + 1) AS q, k, (SELECT round(sum(target) / 16) FROM targets) AS n FROM (SELECT *, unnest(range(0, (target / 16 + 3)::BIGINT)) AS k FROM targets) WHERE target > 0
), won AS (SELECT source FROM seats QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) <= n), quotas AS (
  SELECT t.source, source_size, target, (SELECT count(*) FROM won w WHERE w.source IS NOT DISTINCT FROM t.source) AS source_quota, greatest(ceil(source_size / 200000), 1)::BIGINT AS shards FROM targets t
), placed AS (
  SELECT w.*, q.source_size, q.target, q.source_quota, ('0x' || substr(md5(concat_ws('/', 'mix', coalesce(doc_id, -1)::VARCHAR, row_key)), 1, 8))::BIGINT % shards AS shard FROM words w JOIN quotas q ON w.source IS NOT DISTINCT FROM q.source
), shards AS (SELECT source, source_quota, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL), chances AS (
  SELECT *, shard_size / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, (shard_size / 8 + 3)::BIGINT)) AS k FROM shards) WHERE shard_size > 0
), dealt AS (
  SELECT source, shard, count(*) AS quota FROM (SELECT * FROM chances QUALIFY row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) <= source_quota) GROUP BY ALL
), spans AS (
  SELECT p.*, s.shard_size, coalesce(d.quota, 0) AS quota, ceil(s.shard_size / 16)::BIGINT AS blocks,
    sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY ('0x' || substr(md5(concat_ws('/', 'mix-order', coalesce(doc_id, -1)::VARCHAR, row_key)), 1, 8))::BIGINT, doc_id, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e
  FROM placed p JOIN shards s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard LEFT JOIN dealt d ON p.source IS NOT DISTINCT FROM d.source AND p.shard = d.shard
), runs AS (
  SELECT *, e - size AS b, CASE WHEN blocks > 0 THEN least(quota, blocks * 2) // blocks ELSE 0 END AS passes, CASE WHEN blocks > 0 THEN least(quota, blocks * 2) % blocks ELSE 0 END AS rest,
    CASE WHEN blocks > 0 THEN ('0x' || substr(md5(concat_ws('/', 'mix-start', coalesce(source, chr(0)), shard::VARCHAR)), 1, 8))::BIGINT % blocks ELSE 0 END AS first FROM spans
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(least(e, least(greatest(first + rest - blocks, 0) * 16, shard_size)) - greatest(b, 0), 0) + greatest(least(e, least((first + rest) * 16, shard_size)) - greatest(b, first * 16), 0))::BIGINT AS taken FROM runs
"""

OP8_SQL = """
WITH plain AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256 FROM plain WINDOW w AS (PARTITION BY text_sha256)
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), g AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), heads AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda v, b: xor(v >> 8, steps[(xor(v, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc
), said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, digest, nb, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS digest, strlen(text) AS nb FROM said)
), rebuilt AS (
  SELECT c, 0 AS part, pos, digest, nb FROM heads JOIN turns ON conv_id = c - c % 5 AND pos <= h UNION ALL SELECT c, 1, pos, digest, nb FROM heads JOIN turns ON conv_id = c AND pos > h
), steps AS (
  SELECT c, nb, row_number() OVER w AS d, md5(string_agg(digest, '') OVER w) AS key FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), paths AS (SELECT c, d, key, nb FROM steps UNION ALL SELECT c, 0, 'root', 0 FROM heads),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS n FROM paths),
nodes AS (SELECT key, any_value(up) AS up, any_value(d) AS d, any_value(nb) AS nb, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM linked GROUP BY key),
children AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.key, sum((x.n_convs - 1) * x.nb) AS saved, count(*) FILTER (ch.n IS NULL) AS leaves FROM nodes x LEFT JOIN children ch ON ch.key = x.key JOIN paths p ON p.c = x.c AND p.d <= x.d GROUP BY p.key
)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, u.c AS parent_conv_id, x.n_convs, coalesce(ch.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below b ON b.key = x.key LEFT JOIN children ch ON ch.key = x.key LEFT JOIN nodes u ON u.key = x.up
"""

OP12_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
begun AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words), grams AS (SELECT lang, ws, i, unnest(range(1, 6)) AS m FROM begun),
f AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM grams WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
inner_ones AS (
  SELECT lang, array_to_string(ws[s:s + k - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, string_split(phrase, ' ') AS ws, m, f, unnest(range(2, m)) AS k FROM f WHERE m > 2)) GROUP BY ALL
), alone AS (SELECT f.* FROM f LEFT JOIN inner_ones USING (lang, phrase) WHERE m > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, m, unnest(range(1, m)) AS k FROM alone), scores AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.m], ' ') JOIN totals t ON t.lang = c.lang
), weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM weakest
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11_SQL, "op12_phrases": OP12_SQL, "op4_mixture": OP4_SQL, "op6_chat": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_ngram_join": OP10_SQL}
