"""Lineage queries: signatures, incremental merges, set operations, the released dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.lineage import changed_pairs, incremental_merge, released, row_digest, table_signature
from plumeline.registry import register
from plumeline.sources.tables import DOCUMENT_OUTCOMES_SQL, document_outcomes


@register("selection_digests", f"""WITH {DOCUMENT_OUTCOMES_SQL} SELECT query_id, sha256(strlen(query_id::VARCHAR)::VARCHAR || ':' || query_id::VARCHAR || strlen(asin)::VARCHAR || ':' || asin || strlen(coalesce(rank_clean::VARCHAR, ''))::VARCHAR || ':' || coalesce(rank_clean::VARCHAR, '')) AS digest FROM outcomes""")
def selection_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every selection."""
    return document_outcomes(spark, sf_dir).select("query_id", row_digest(F.col("query_id"), F.col("asin"), F.col("rank_clean")).alias("digest"))


_HEX15 = "list_sum(list_transform(range(1, 16), lambda i: ((instr('0123456789abcdef', substr(digest, {a} + i, 1)) - 1)::HUGEINT * (16::HUGEINT ** (15 - i))::HUGEINT)))"


@register("selection_signature", f"""WITH {DOCUMENT_OUTCOMES_SQL}, d AS (SELECT sha256(strlen(query_id::VARCHAR)::VARCHAR || ':' || query_id::VARCHAR || strlen(asin)::VARCHAR || ':' || asin || strlen(coalesce(rank_clean::VARCHAR, ''))::VARCHAR || ':' || coalesce(rank_clean::VARCHAR, '')) AS digest FROM outcomes),
s AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(digest, {1 + 15 * i}, 15))::BIGINT) AS s{i}" for i in range(4))} FROM d)
SELECT n, left(sha1(n::VARCHAR || '|' || s0::VARCHAR || '|' || s1::VARCHAR || '|' || s2::VARCHAR || '|' || s3::VARCHAR), 16) AS signature FROM s""")
def selection_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint of all selections, whatever their order."""
    return table_signature(document_outcomes(spark, sf_dir), ["query_id", "asin", "rank_clean"])


@register("incremental_merge", f"""WITH {DOCUMENT_OUTCOMES_SQL}, e AS (SELECT query_id, 'bm25' AS retriever, rank_clean AS rank FROM outcomes WHERE query_id % 2 = 0 UNION ALL SELECT query_id, 'old', rank_clean FROM outcomes WHERE query_id % 4 = 0),
f AS (SELECT query_id, unnest(['bm25', 'dense']) AS retriever, rank_noisy AS rank FROM outcomes), k AS (SELECT * FROM e WHERE retriever <> 'old')
SELECT * FROM k UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = f.query_id AND k.retriever = f.retriever)""")
def incremental_merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept results, without a retired retriever, and fresh ones for what is missing.

    Even ids stand in for the list of queries that an earlier run has kept; all documents are in the result.
    """
    o = document_outcomes(spark, sf_dir)
    bm25 = o.filter("query_id % 2 = 0").select("query_id", F.lit("bm25").alias("retriever"), F.col("rank_clean").alias("rank"))
    old = o.filter("query_id % 4 = 0").select("query_id", F.lit("old").alias("retriever"), F.col("rank_clean").alias("rank"))
    fresh = o.select("query_id", F.explode(F.array(F.lit("bm25"), F.lit("dense"))).alias("retriever"), F.col("rank_noisy").alias("rank"))
    return incremental_merge(bm25.unionByName(old), fresh, ["query_id", "retriever"], retired=("old",))


def _queries(o: DataFrame) -> DataFrame:
    noisy = F.when(F.col("query_id") % 3 == 0, "").when(F.col("query_id") % 5 == 0, F.concat(F.lit(" query "), F.col("query_id"))).otherwise(F.concat(F.lit("qurey "), F.col("query_id")))
    return o.select("asin", F.col("user_id").alias("uid"), F.concat(F.lit("query "), F.col("query_id")).alias("clean"), noisy.alias("noisy"))


_QUERIES_SQL = f"""{DOCUMENT_OUTCOMES_SQL}, q AS (SELECT asin, user_id AS uid, 'query ' || query_id::VARCHAR AS clean, CASE WHEN query_id % 3 = 0 THEN '' WHEN query_id % 5 = 0 THEN ' query ' || query_id::VARCHAR ELSE 'qurey ' || query_id::VARCHAR END AS noisy FROM outcomes)"""


@register("changed_pairs", f"WITH {_QUERIES_SQL} SELECT uid, count(*) AS n, min(noisy) AS first FROM q WHERE trim(noisy) <> '' AND trim(noisy) <> trim(clean) GROUP BY uid")
def changed_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with noise, by user."""
    return changed_pairs(_queries(document_outcomes(spark, sf_dir)), "clean", "noisy").groupBy("uid").agg(F.count("*").alias("n"), F.min("noisy").alias("first"))


@register("released_dataset", f"""WITH {_QUERIES_SQL} SELECT asin, '[' || string_agg('{{"uid":"' || uid || '","clean":"' || clean || '","noisy":"' || noisy || '"}}', ',' ORDER BY uid, clean, noisy) || ']' AS users FROM q GROUP BY asin""")
def released_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's users with their clean and noisy queries."""
    return released(_queries(document_outcomes(spark, sf_dir)))


@register("cohort_sets", f"""WITH {DOCUMENT_OUTCOMES_SQL}, a AS (SELECT DISTINCT user_id FROM outcomes WHERE rank_clean = 1), b AS (SELECT DISTINCT user_id FROM outcomes WHERE rank_noisy = 1)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'clean only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def cohort_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a first place in both, either or only the clean results."""
    o = document_outcomes(spark, sf_dir)
    a, b = o.filter("rank_clean = 1").select("user_id").distinct(), o.filter("rank_noisy = 1").select("user_id").distinct()
    sized = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return sized("both", a.intersect(b)).unionByName(sized("either", a.union(b).distinct())).unionByName(sized("clean only", a.exceptAll(b)))
