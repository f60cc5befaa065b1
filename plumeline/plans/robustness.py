"""Robustness queries: volatility, degradation by noise, reranking. Degradation and reranking start from BM25 ranks of clean and misspelt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.lexical import lexical, lexical_top_k
from plumeline.operators.metrics import fuse, paired_degradation, rerank_flip, rerank_metrics, stage_delta, volatility
from plumeline.operators.ranking import kendall_and_spearman
from plumeline.operators.retrieval import Bm25, term_coverage
from plumeline.operators.selection import joined_one_to_one
from plumeline.plans.retrieval import BM25_SQL, DENSE_SQL, NOISY_SQL, OUTCOMES_SQL, _queries, dense_topk, misspelt, outcomes, targets
from plumeline.registry import register
from plumeline.sources.staged import stage
from plumeline.sources.tables import PER_PRODUCT, table


def _volatility_sql(queries: str) -> str:
    """`s` and `f`, spread and flips by product, of the queries (asin, query_id, rank, v)."""
    return f"""u AS (SELECT * FROM {queries} WHERE asin IN (SELECT asin FROM {queries} GROUP BY asin HAVING count(*) >= 2 AND count(*) = count(rank))),
p AS (SELECT a.asin, a.rank AS ra, b.rank AS rb FROM u a JOIN u b ON a.asin = b.asin AND a.query_id < b.query_id WHERE list_inner_product(a.v, b.v) >= 0.1),
f AS (SELECT asin, avg(((ra <= 1) <> (rb <= 1))::INTEGER) AS f1, avg(((ra <= 5) <> (rb <= 5))::INTEGER) AS f5, avg(((ra <= 10) <> (rb <= 10))::INTEGER) AS f10, avg(((ra <= 20) <> (rb <= 20))::INTEGER) AS f20 FROM p GROUP BY asin),
s AS (SELECT asin, stddev_pop(1.0 / rank) AS rr_std FROM u GROUP BY asin)"""


_VOLATILITY_COLUMNS = """count(*) AS n_products, round(avg(f1), 6) AS flip1_mean, round(avg(f5), 6) AS flip5_mean, round(avg(f10), 6) AS flip10_mean, round(avg(f20), 6) AS flip20_mean,
round(avg(rr_std), 6) AS rr_std_mean, round(median(rr_std), 6) AS rr_std_median, round(stddev_pop(rr_std), 6) AS rr_std_std"""


@register("volatility", f"""WITH vq AS (SELECT (vec_id // {PER_PRODUCT})::VARCHAR AS asin, vec_id AS query_id, CASE WHEN vec_id % 97 > 0 THEN vec_id * 7 % 30 + 1 END AS rank, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL),
{_volatility_sql("vq")} SELECT {_VOLATILITY_COLUMNS} FROM s LEFT JOIN f USING (asin)""")
def volatility_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often similar queries of a product disagree; ranks made up from ids, in all rows, so that every case of a missing rank occurs. `dense_volatility` has found ranks."""
    v = table(spark, sf_dir, "embeddings").filter("label is not null")
    rank = F.when(F.col("vec_id") % 97 > 0, F.col("vec_id") * 7 % 30 + 1)
    q = v.select(F.floor(F.col("vec_id") / PER_PRODUCT).cast("string").alias("asin"), F.col("vec_id").alias("query_id"), rank.alias("rank"), F.col("embedding").alias("vector"))
    return volatility(q, threshold=0.1)


@register("paired_degradation", f"""WITH {OUTCOMES_SQL}, dg AS (SELECT *, coalesce(1.0 / rank_clean, 0) - coalesce(1.0 / rank_noisy, 0) AS delta FROM outcomes)
SELECT count(*) AS n_pairs, {", ".join(f"round(avg(coalesce((rank_clean <= {k})::INTEGER, 0) - coalesce((rank_noisy <= {k})::INTEGER, 0)), 6) AS hit{k}_drop" for k in (1, 5, 10, 20))},
round(avg(delta), 6) AS rr_drop_mean, round(median(delta), 6) AS rr_drop_median, count(*) FILTER (delta > 0) AS n_hurt, count(*) FILTER (delta < 0) AS n_helped, count(*) FILTER (delta = 0) AS n_same FROM dg""")
def paired_degradation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What noise costs each clean query."""
    return paired_degradation(outcomes(spark, sf_dir))


def _headline(rows: DataFrame, rank: str) -> DataFrame:
    return rows.groupBy("user_id").agg(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col(rank) <= 10).cast("int"), F.lit(0))).alias("hit10"))


@register("stage_delta", f"""WITH {OUTCOMES_SQL}, a AS (SELECT user_id, avg(coalesce(1.0 / rank_clean, 0)) AS mrr, avg(coalesce((rank_clean <= 10)::INTEGER, 0)) AS hit10 FROM outcomes WHERE rank_clean IS NOT NULL GROUP BY user_id),
b AS (SELECT user_id, avg(coalesce(1.0 / rank_noisy, 0)) AS mrr, avg(coalesce((rank_noisy <= 10)::INTEGER, 0)) AS hit10 FROM outcomes WHERE rank_noisy IS NOT NULL GROUP BY user_id)
SELECT user_id, round(b.mrr - a.mrr, 6) AS mrr_delta, round(b.hit10 - a.hit10, 6) AS hit10_delta FROM a FULL OUTER JOIN b USING (user_id)""")
def stage_delta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one stage against another's, whichever side has the user."""
    rows = outcomes(spark, sf_dir)
    return stage_delta(_headline(rows.filter("rank_clean is not null"), "rank_clean"), _headline(rows.filter("rank_noisy is not null"), "rank_noisy"), ["user_id"], ["mrr", "hit10"])


@register("stage_delta_all", f"""WITH {OUTCOMES_SQL} SELECT user_id, round(avg(coalesce(1.0 / rank_noisy, 0)) - avg(coalesce(1.0 / rank_clean, 0)), 6) AS mrr_delta,
round(avg(coalesce((rank_noisy <= 10)::INTEGER, 0)) - avg(coalesce((rank_clean <= 10)::INTEGER, 0)), 6) AS hit10_delta FROM outcomes GROUP BY user_id""")
def stage_delta_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy metrics against clean ones over all documents; `stage_delta` has a user on one side or both."""
    rows = outcomes(spark, sf_dir)
    return stage_delta(_headline(rows, "rank_clean"), _headline(rows, "rank_noisy"), ["user_id"], ["mrr", "hit10"])


def candidates(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """(query_id, doc_id, original_rank, score): the forty best documents of each query by BM25; the score is the share of its terms that they hold."""
    q, documents = _queries(spark, sf_dir), table(spark, sf_dir, "documents")
    q = misspelt(q) if noisy else q
    first = stage(lexical_top_k(lexical(q, documents, Bm25()), 40), "candidates")
    return stage(term_coverage(first.select("query_id", "doc_id", F.col("pos").alias("original_rank")), q, documents, Bm25()), "covered")


def _fused_sql(tag: str = "") -> str:
    """`fused{tag}`, and `t{tag}` with the place of each query's target."""
    return f"""held{tag} AS (SELECT query_id, doc_id, count(*) AS held FROM q{tag} JOIN d USING (term) GROUP BY ALL), asked{tag} AS (SELECT query_id, count(*) AS asked FROM q{tag} GROUP BY query_id),
c{tag} AS (SELECT query_id, doc_id, pos::INTEGER AS original_rank, round(held / asked::DOUBLE, 6) AS score FROM ranked{tag} JOIN held{tag} USING (query_id, doc_id) JOIN asked{tag} USING (query_id) WHERE pos <= 40),
k{tag} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c{tag} WHERE original_rank <= 25),
x{tag} AS (SELECT query_id, doc_id, original_rank, score, round(CASE WHEN n > 1 THEN (n - original_rank) / (n - 1)::DOUBLE ELSE 1 END, 6) AS rank_prior, round(score + 0.1 * CASE WHEN n > 1 THEN (n - original_rank) / (n - 1)::DOUBLE ELSE 1 END, 6) AS final FROM k{tag}),
fused{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, original_rank)::INTEGER AS pos FROM x{tag}),
t{tag} AS (SELECT g.query_id, 'A' || (g.query_id // 4)::VARCHAR AS asin, f.pos AS rank, f.pos IS NOT NULL AS is_candidate FROM target g LEFT JOIN fused{tag} f ON f.query_id = g.query_id AND f.doc_id = g.target)"""


_FUSED = f"{BM25_SQL}, {_fused_sql()}"


@register("rerank_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 candidates by model score and rank prior."""
    return fuse(candidates(spark, sf_dir))


def _reranked(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """(query_id, asin, rank, is_candidate): where reranking put each query's target."""
    f = fuse(candidates(spark, sf_dir, noisy)).select("query_id", F.col("doc_id").alias("target"), F.col("pos").alias("rank"))
    found = targets(spark, sf_dir).join(f, ["query_id", "target"], "left")
    return found.select("query_id", F.concat(F.lit("A"), F.floor(F.col("query_id") / 4)).alias("asin"), "rank", F.col("rank").isNotNull().alias("is_candidate"))


_KS = (1, 5, 10, 20, 25)


@register("rerank_metrics", f"""WITH {_FUSED} SELECT count(*) AS n_queries, {", ".join(f"round(avg(coalesce((rank <= {k})::INTEGER, 0)), 6) AS hit{k}" for k in _KS)}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(is_candidate::INTEGER), 6) AS recall_at_candidates FROM t""")
def rerank_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates after reranking."""
    return rerank_metrics(_reranked(spark, sf_dir))


@register("rerank_flip", f"""WITH {_FUSED}, p AS (SELECT asin, count(*) AS n, {", ".join(f"2.0 * count(*) FILTER (rank <= {k}) * (count(*) - count(*) FILTER (rank <= {k})) / (count(*) * (count(*) - 1)) AS f{k}" for k in _KS)}, CASE WHEN count(rank) >= 2 THEN stddev_pop(1.0 / rank) END AS rr_std FROM t GROUP BY asin HAVING count(*) >= 2)
SELECT count(*) AS n_products, {", ".join(f"round(coalesce(avg(f{k}), 0), 6) AS flip{k}_mean" for k in _KS)}, round(coalesce(avg(rr_std), 0), 6) AS rr_std_mean, round(coalesce(median(rr_std), 0), 6) AS rr_std_median, round(coalesce(stddev_samp(rr_std), 0), 6) AS rr_std_std FROM p""")
def rerank_flip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flip rates over all query pairs of a product, in closed form."""
    return rerank_flip(_reranked(spark, sf_dir))


@register("rank_correlation", f"""WITH {_FUSED}, p AS (SELECT a.query_id, sum(sign((a.original_rank - b.original_rank) * (a.pos - b.pos))) AS s FROM fused a JOIN fused b USING (query_id) GROUP BY a.query_id),
r AS (SELECT query_id, count(*) AS n, corr(original_rank, pos) AS rho FROM fused GROUP BY query_id)
SELECT query_id, n, round(CASE WHEN n > 1 THEN s / (n * (n - 1.0)) ELSE 0 END, 6) AS tau, round(CASE WHEN rho IS NULL OR isnan(rho) THEN 0 ELSE rho END, 6) AS rho FROM r JOIN p USING (query_id)""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall and Spearman between the order before and after."""
    out = kendall_and_spearman(fuse(candidates(spark, sf_dir)), "query_id", "original_rank", "pos")
    return out.select("query_id", "n", F.round("tau", 6).alias("tau"), F.round("rho", 6).alias("rho"))


@register("score_diagnostics", f"WITH {_FUSED} SELECT round(score, 4) AS score_bin, count(*) AS n, round(sum(final), 6) AS sum_final, count(*) FILTER (pos <> original_rank) AS n_moved FROM fused GROUP BY ALL")
def score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of model scores and how many candidates moved."""
    return fuse(candidates(spark, sf_dir)).groupBy(F.round("score", 4).alias("score_bin")).agg(F.count("*").alias("n"), F.round(F.sum("final"), 6).alias("sum_final"), F.count_if(F.col("pos") != F.col("original_rank")).alias("n_moved"))


@register("score_summary", f"WITH {_FUSED} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_candidates, count(DISTINCT score) AS n_values, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM fused")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of the scores."""
    f = fuse(candidates(spark, sf_dir))
    return f.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_candidates"), F.countDistinct("score").alias("n_values"), F.round(F.avg("score"), 6).alias("score_mean"), F.round(F.stddev_pop("score"), 6).alias("score_std"))


@register("rerank_degradation", f"""WITH {_FUSED}, {NOISY_SQL}, {_fused_sql("_n")},
dg AS (SELECT a.rank AS rank_clean, b.rank AS rank_noisy, coalesce(1.0 / a.rank, 0) - coalesce(1.0 / b.rank, 0) AS delta FROM t a JOIN t_n b USING (query_id))
SELECT count(*) AS n_pairs, {", ".join(f"round(avg(coalesce((rank_clean <= {k})::INTEGER, 0) - coalesce((rank_noisy <= {k})::INTEGER, 0)), 6) AS hit{k}_drop" for k in _KS)},
round(avg(delta), 6) AS rr_drop_mean, round(median(delta), 6) AS rr_drop_median, count(*) FILTER (delta > 0) AS n_hurt, count(*) FILTER (delta < 0) AS n_helped, count(*) FILTER (delta = 0) AS n_same FROM dg""")
def rerank_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What misspelling costs after reranking."""
    clean, noisy = (_reranked(spark, sf_dir, n).select("query_id", F.col("rank").alias(c)) for n, c in ((False, "rank_clean"), (True, "rank_noisy")))
    return paired_degradation(joined_one_to_one(clean, noisy, ["query_id"]), _KS)


@register("dense_volatility", f"""WITH {DENSE_SQL}, q0 AS (SELECT q.query_id, min(CASE WHEN e.label = o.label THEN pos END) AS rank FROM q JOIN embeddings o ON o.vec_id = q.query_id LEFT JOIN ranked r ON r.query_id = q.query_id AND pos <= 100 LEFT JOIN embeddings e ON e.vec_id = r.doc_id GROUP BY q.query_id),
vq AS (SELECT (query_id // 1000)::VARCHAR AS asin, query_id, rank, list_transform(qv, lambda x: x::DOUBLE) AS v FROM q0 JOIN q USING (query_id)),
{_volatility_sql("vq")} SELECT {_VOLATILITY_COLUMNS} FROM s LEFT JOIN f USING (asin)""")
def dense_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often similar queries disagree on where the first vector of their own label is found by dense retrieval; the twenty queries of a thousand ids are a product."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = labels.filter("vec_id % 50 = 0 and label is not null").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("vector"))
    found = stage(dense_topk(spark, sf_dir).select("query_id", "doc_id", "pos"), "dense")
    hits = found.join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(asked.select("query_id", "own"), "query_id").filter("label = own").groupBy("query_id").agg(F.min("pos").alias("rank"))
    q = asked.join(hits, "query_id", "left").select(F.floor(F.col("query_id") / 1000).cast("string").alias("asin"), "query_id", "rank", "vector")
    return volatility(q, threshold=0.1)
