"""The queries over the operators of this folder, with their production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm.best_fit import pack_documents
from plumeline.llm.bit_slices import SliceParams, top_k
from plumeline.llm.bucket_digest import fingerprint_with_next
from plumeline.llm.byte_bpe import byte_bpe_round_trip
from plumeline.llm.common import table
from plumeline.llm.ftrl import toxicity
from plumeline.llm.lanczos_whitening import whiten
from plumeline.llm.lsh_forest import similarity_join
from plumeline.llm.positive_unlabelled import quality
from plumeline.llm.secret_scan import scan
from plumeline.llm.shard_shuffle import shard_documents
from plumeline.llm.sorted_passes import near_duplicates
from plumeline.llm.sparse_suffixes import repeats
from plumeline.llm.turn_repair import damage, repair_summary


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), rate=0.05)


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16, seed=20)


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.7)


def op4_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op5_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))


def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_sorted_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damage(table(spark, sf_dir, "conversations")))


def op12_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return top_k(rows, rows.filter(F.col("id") % 20 == 0), SliceParams(k=20, scale=64))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=4, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_ftrl_toxicity": op3_ftrl_toxicity,
    "op4_positive_unlabelled_quality": op4_positive_unlabelled_quality,
    "op5_bucket_digest": op5_bucket_digest,
    "op6_lsh_forest_join": op6_lsh_forest_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sorted_projection_passes": op8_sorted_projection_passes,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_sparse_suffix_repeats": op10_sparse_suffix_repeats,
    "op11_turn_repair": op11_turn_repair,
    "op12_bit_sliced_topk": op12_bit_sliced_topk,
    "op13_lanczos_whitening": op13_lanczos_whitening,
}

#: Pairwise, so meant for small tables.
ORACLE_SQL: dict[str, str] = {
    "op6_lsh_forest_join": """WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS weight FROM documents GROUP BY 1),
w AS (SELECT text, rep, weight, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM texts),
g AS (SELECT rep, list_distinct(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS grams FROM w WHERE len(words) > 0),
p AS (SELECT rep, len(grams) AS size, unnest(grams) AS gram FROM g),
met AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n, any_value(x.size) AS sa, any_value(y.size) AS sb FROM p x JOIN p y ON x.gram = y.gram AND x.rep <> y.rep GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE n / (sa + sb - n) >= 0.8),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS rep, sum(weight) AS n FROM links JOIN texts ON texts.rep = b GROUP BY a)
SELECT d.doc_id, CASE WHEN len(words) = 0 THEN d.doc_id ELSE coalesce(class_id, w.rep) END AS class_id, (CASE WHEN len(words) = 0 THEN 0 ELSE coalesce(n, 0) + w.weight - 1 END)::BIGINT AS n_links
FROM documents d JOIN w ON w.text = coalesce(d.text, '') LEFT JOIN class ON class.rep = w.rep LEFT JOIN n ON n.rep = w.rep""",
    "op8_sorted_projection_passes": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    # An audit and its cost as a struct for each state, a row of each conversation at a time; the hash is built from its table.
    "op11_turn_repair": r"""WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT n.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS chance FROM named n, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role, CASE WHEN chance = 1 THEN '' WHEN chance = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN chance = 0 THEN 0 WHEN chance = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS place FROM damaged),
known AS (SELECT conv_id, turn, role, text, place, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM placed),
-- For each state (nothing yet, after s, after u, after a) the cheapest cost and audit.
dp AS (SELECT conv_id, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': ''} AS p0, {'c': 1000000000::BIGINT, 'a': ''} AS p1, {'c': 2::BIGINT, 'a': 'I'} AS p2, {'c': 4::BIGINT, 'a': 'II'} AS p3 FROM (SELECT DISTINCT conv_id FROM known)
UNION ALL SELECT conv_id, place, p0, p1, list_min([p2, {'c': p3.c + 2, 'a': p3.a || 'I'}]), p3 FROM (
  SELECT conv_id, place, p0, p1, p2, list_min([p3, {'c': p2.c + 2, 'a': p2.a || 'I'}]) AS p3 FROM (
    SELECT conv_id, place, p0, p1, list_min([p2, {'c': p0.c + 2, 'a': p0.a || 'I'}, {'c': p1.c + 2, 'a': p1.a || 'I'}]) AS p2, p3 FROM (
      SELECT d.conv_id, k.place, {'c': p0.c + 3, 'a': p0.a || 'D'} AS p0,
        list_min([{'c': p1.c + 3, 'a': p1.a || 'D'}, {'c': p0.c + short + CASE WHEN c = 's' THEN 0 ELSE 1000000000 END, 'a': p0.a || 'K'}]) AS p1,
        list_min([{'c': p2.c + 3, 'a': p2.a || 'D'}] || flatten(list_transform([p0, p1, p3], lambda p: [{'c': p.c + short + CASE WHEN c = 'u' THEN 0 ELSE 1000000000 END, 'a': p.a || 'K'}, {'c': p.c + short + 2, 'a': p.a || 'R'}]))) AS p2,
        list_min([{'c': p3.c + 3, 'a': p3.a || 'D'}, {'c': p2.c + short + CASE WHEN c = 'a' THEN 0 ELSE 1000000000 END, 'a': p2.a || 'K'}, {'c': p2.c + short + 2, 'a': p2.a || 'R'}]) AS p3
      FROM dp d JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000000 END AS short FROM known) k ON k.conv_id IS NOT DISTINCT FROM d.conv_id AND k.place = d.place + 1)))),
best AS (SELECT conv_id, list_min([p0, p3]) AS p FROM dp WHERE (conv_id IS NULL, coalesce(conv_id, 0), place) IN (SELECT (conv_id IS NULL, coalesce(conv_id, 0), max(place)) FROM dp GROUP BY conv_id)),
letters AS (SELECT conv_id, p.a AS audit, unnest(range(1, length(p.a) + 1)) AS i FROM best),
edits AS (SELECT conv_id, i, audit[i] AS letter, length(replace(audit[1:i], 'I', '')) AS place, length(replace(audit[1:i], 'D', '')) AS kept FROM letters),
joined AS (SELECT e.*, k.role, k.text, bool_or(e.kept = 1 AND letter = 'K' AND k.c = 's') OVER (PARTITION BY e.conv_id) AS led FROM edits e LEFT JOIN known k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.place = e.place AND e.letter <> 'I'),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (kept - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired FROM joined WHERE letter <> 'D' GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM known GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(p.c, 0)::BIGINT AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_bit_sliced_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score FROM v q JOIN v r ON len(q.x) = len(r.x) AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
}
