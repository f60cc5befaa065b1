"""Retrieval queries: BM25, dense, MaxSim and hybrid ranking of the benchmark passages over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.blocked import blocked_fusion, blocked_top_k, cosine_scores, maxsim, sparse_products, token_maxsim
from plumeline.operators.containment import containing
from plumeline.operators.impact_index import build, impact_top_k, opened, thresholds
from plumeline.operators.lexical import Lexical, lexical, lexical_ranks, lexical_top_k
from plumeline.operators.ranking import hit_columns
from plumeline.operators.retrieval import Bm25
from plumeline.operators.selection import joined_one_to_one
from plumeline.registry import register
from plumeline.sources.staged import stage
from plumeline.sources.tables import table

_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_STOP = "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"

def bm25_sql(queries: str, tag: str = "") -> str:
    """`scores{tag}`, `ranked{tag}` of the queries (query_id, text) of a table or subquery over the documents of BM25_DOCS."""
    return f"""qt{tag} AS (SELECT query_id, unnest({_TERMS}) AS term FROM {queries}),
q{tag} AS (SELECT query_id, term, count(*) AS qtf FROM qt{tag} WHERE term NOT IN {_STOP} GROUP BY ALL),
scores{tag} AS (SELECT query_id, doc_id, round(sum(round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 9)::DECIMAL(28, 9)), 6)::DOUBLE AS score
  FROM q{tag} JOIN d USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stats GROUP BY ALL),
ranked{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM scores{tag})"""


BM25_DOCS = f"""docs AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
d AS (SELECT doc_id, term, count(*) AS tf FROM docs WHERE term NOT IN {_STOP} GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM d GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
target AS (SELECT item_id AS query_id, min(doc_id) AS target FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"""
BM25_SQL = f"{BM25_DOCS}, {bm25_sql('(SELECT item_id AS query_id, text FROM benchmark)')}"
#: The same for misspelt queries.
NOISY_SQL = bm25_sql("(SELECT item_id AS query_id, CASE WHEN w = '' THEN text ELSE substr(text, 1, instr(text, w) + length(w) - 2) || substr(text, instr(text, w) + length(w)) END AS text FROM (SELECT item_id, text, regexp_extract(text, '([A-Za-z]{5,})', 1) AS w FROM benchmark))", "_n")
#: Clean and misspelt queries: `outcomes` (query_id, asin, user_id, rank_clean, rank_noisy), null for a target beyond the first hundred.
OUTCOMES_SQL = f"""{BM25_SQL}, {NOISY_SQL},
outcomes AS (SELECT t.query_id, 'A' || (t.query_id // 4)::VARCHAR AS asin, 'u' || (t.query_id % 10)::VARCHAR AS user_id, CASE WHEN a.pos <= 100 THEN a.pos END AS rank_clean, CASE WHEN b.pos <= 100 THEN b.pos END AS rank_noisy
  FROM target t LEFT JOIN ranked a ON a.query_id = t.query_id AND a.doc_id = t.target LEFT JOIN ranked_n b ON b.query_id = t.query_id AND b.doc_id = t.target)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def misspelt(queries: DataFrame) -> DataFrame:
    """(query_id, text): the last letter of each query's first long word dropped."""
    word = F.regexp_extract("text", "([A-Za-z]{5,})", 1)
    end = F.instr("text", word) + F.length(word)
    cut = F.concat(F.substring("text", F.lit(1), end - 2), F.substring("text", end, F.length("text")))
    return queries.select("query_id", F.when(word == "", F.col("text")).otherwise(cut).alias("text"))


def bm25(spark: SparkSession, sf_dir: str) -> Lexical:
    return lexical(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), Bm25())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query, the first document that holds its text."""
    found = containing(_queries(spark, sf_dir), table(spark, sf_dir, "documents")).groupBy("query_id").agg(F.min("doc_id").alias("target"))
    return stage(found, "targets")


@register("target_index", """SELECT b.item_id AS query_id, coalesce(min(d.doc_id), -1) AS target, count(d.doc_id) AS n_documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL""")
def target_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's first document and how many hold it; -1 for a query that none does."""
    q = _queries(spark, sf_dir)
    found = containing(q, table(spark, sf_dir, "documents")).groupBy("query_id").agg(F.min("doc_id").alias("target"), F.count("*").alias("n"))
    return q.join(found, "query_id", "left").select("query_id", F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("n", F.lit(0)).alias("n_documents"))


@register("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 100")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best documents of each query."""
    return lexical_top_k(bm25(spark, sf_dir), 100)


@register("bm25_impact_topk", f"WITH {BM25_SQL} SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 10")
def bm25_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each query by the impact-ordered index."""
    return impact_top_k(build(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), Bm25()), 10)


@register("bm25_blocks_read")
def bm25_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks and postings of its terms each query reads for its ten best, and the share of postings that it leaves."""
    index = build(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), Bm25())
    each = opened(index, thresholds(index, 10)).groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if("read").alias("blocks_read"), F.sum("n").alias("postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("postings_read"))
    return each.withColumn("share_left", F.round(1 - F.col("postings_read") / F.col("postings"), 6))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_ranks(bm25(spark, sf_dir), targets(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, asin, user_id, rank_clean, rank_noisy): BM25 ranks of each query's target, clean and misspelt; null beyond the first hundred.

    Both ranks of a query must be there, once: the join is asserted.
    """
    q, documents = _queries(spark, sf_dir), table(spark, sf_dir, "documents")
    both = q.select((2 * F.col("query_id")).alias("query_id"), "text").unionByName(misspelt(q).select((2 * F.col("query_id") + 1).alias("query_id"), "text"))
    t = targets(spark, sf_dir)
    twice = t.select((2 * F.col("query_id")).alias("query_id"), "target").unionByName(t.select((2 * F.col("query_id") + 1).alias("query_id"), "target"))
    best = lexical_top_k(lexical(both, documents, Bm25()), 100).select("query_id", F.col("doc_id").alias("target"), F.col("pos").alias("rank"))
    ranks = stage(twice.join(best, ["query_id", "target"], "left"), "ranks")
    ranks = ranks.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2 == 1).alias("noisy"), "rank")
    clean, noisy = (ranks.filter(c).select("query_id", F.col("rank").alias(n)) for c, n in (("not noisy", "rank_clean"), ("noisy", "rank_noisy")))
    rows = joined_one_to_one(clean, noisy, ["query_id"])
    return rows.select("query_id", F.concat(F.lit("A"), F.floor(F.col("query_id") / 4)).alias("asin"), F.concat(F.lit("u"), F.col("query_id") % 10).alias("user_id"), "rank_clean", "rank_noisy")


@register("bm25_rank", f"""WITH {BM25_SQL} SELECT t.query_id, target, coalesce(pos, 20001)::INTEGER AS rank, round(1.0 / coalesce(pos, 20001), 6) AS rr,
(coalesce(pos, 20001) <= 1)::INTEGER AS hit1, (coalesce(pos, 20001) <= 5)::INTEGER AS hit5, (coalesce(pos, 20001) <= 10)::INTEGER AS hit10, (coalesce(pos, 20001) <= 20)::INTEGER AS hit20
FROM target t LEFT JOIN ranked r ON r.query_id = t.query_id AND r.doc_id = t.target AND pos <= 20000""")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, reciprocal rank and hits of each query's target; a target beyond 20,000 has rank 20,001."""
    return _ranks(spark, sf_dir).select("query_id", "target", "rank", *hit_columns(F.col("rank")))


@register("bm25_headline", f"""WITH {BM25_SQL}, r AS (SELECT coalesce(pos, 20001) AS rank FROM target t LEFT JOIN ranked r ON r.query_id = t.query_id AND r.doc_id = t.target AND pos <= 20000)
SELECT count(*) AS n_queries, round(avg((rank <= 1)::INTEGER), 6) AS hit1, round(avg((rank <= 5)::INTEGER), 6) AS hit5, round(avg((rank <= 10)::INTEGER), 6) AS hit10, round(avg((rank <= 20)::INTEGER), 6) AS hit20, round(avg(1.0 / rank), 6) AS mrr FROM r""")
def bm25_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hits and reciprocal rank over all queries."""
    r = _ranks(spark, sf_dir).select("rank", *hit_columns(F.col("rank"), round_to=None))
    return r.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit5", "hit10", "hit20")], F.round(F.avg("rr"), 6).alias("mrr"))


DENSE_SQL = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0 AND label IS NOT NULL),
scores AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(list_transform(qv, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM q CROSS JOIN embeddings WHERE query_id <> vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM scores)"""


def _vectors(spark: SparkSession, sf_dir: str, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stated queries, every fiftieth vector, and all vectors."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 50 = 0 and label is not null" if labelled else "vec_id % 50 = 0")
    return q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("d"))


@register("dense_topk", f"WITH {DENSE_SQL} SELECT query_id, pos::INTEGER AS pos, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE pos <= 100")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest vectors of every fiftieth vector by cosine, with their competition rank."""
    return blocked_top_k(*_vectors(spark, sf_dir, labelled=True), cosine_scores, 100, competition=True)


_TOKENS_SQL = """tokens AS (SELECT vec_id, unnest(range(4)) AS t, embedding FROM embeddings),
tv AS (SELECT vec_id, t, list_transform(embedding[(t * 16 + 1):(t * 16 + 16)], lambda x: x::DOUBLE) AS v FROM tokens)"""
_MAXSIM = f"""{_TOKENS_SQL},
q AS (SELECT vec_id AS query_id, t AS qt, v AS qv FROM tv WHERE vec_id % 50 = 0),
best AS (SELECT query_id, qt, vec_id AS doc_id, max(list_cosine_similarity(qv, v)) AS m FROM q CROSS JOIN tv WHERE query_id <> vec_id GROUP BY ALL),
maxsim AS (SELECT query_id, doc_id, round(sum(round(m, 9)), 6) AS score FROM best GROUP BY ALL)"""


@register("maxsim_topk", f"""WITH {_MAXSIM}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM maxsim)
SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 100""")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction: the sum over a query's parts of the best cosine with a document's parts."""
    return blocked_top_k(*_vectors(spark, sf_dir), maxsim(4), 100)


@register("token_maxsim_topk", """WITH rows AS (SELECT vec_id, embedding, vec_id % 5 AS n FROM embeddings),
tv AS (SELECT vec_id, n, t, list_transform(embedding[(t * 16 + 1):(t * 16 + 16)], lambda x: x::DOUBLE) AS v FROM (SELECT vec_id, n, embedding, unnest(range(n)) AS t FROM rows)),
q AS (SELECT vec_id AS query_id, t AS qt, list_transform(embedding[(t * 16 + 1):(t * 16 + 16)], lambda x: x::DOUBLE) AS qv FROM (SELECT vec_id, embedding, unnest(range(3)) AS t FROM embeddings WHERE vec_id % 50 = 0)),
best AS (SELECT query_id, qt, vec_id AS doc_id, max(list_cosine_similarity(qv, v)) AS m, any_value(n) AS n FROM q CROSS JOIN tv WHERE query_id <> vec_id GROUP BY ALL),
found AS (SELECT query_id, doc_id, round(sum(round(CASE WHEN n < 4 THEN greatest(m, 0) ELSE m END, 9)), 6) AS score FROM best GROUP BY ALL),
every AS (SELECT a.query_id, b.vec_id AS doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM q) a CROSS JOIN rows b LEFT JOIN found f ON f.query_id = a.query_id AND f.doc_id = b.vec_id WHERE a.query_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM every)
SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 100""")
def token_maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction over token vectors of varying number: documents of 0 to 4 tokens, filled up to four with tokens that score 0, and three of each query's."""
    q, d = _vectors(spark, sf_dir)
    return blocked_top_k(q, d.select("doc_id", F.slice("d", F.lit(1), F.col("doc_id") % 5 * 16).alias("d")), token_maxsim(16, query_tokens=3, document_tokens=4), 100)


@register("hybrid_topk", f"""WITH {_MAXSIM}, q2 AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
dense AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(list_transform(qv, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM q2 CROSS JOIN embeddings WHERE query_id <> vec_id),
b AS (SELECT d.query_id, d.doc_id, d.score AS s1, m.score AS s2 FROM dense d JOIN maxsim m USING (query_id, doc_id)),
f AS (SELECT query_id, doc_id, round(round((s1 - avg(s1) OVER w) / greatest(stddev_samp(s1) OVER w, 1e-6), 9)::DECIMAL(28, 9) + round((s2 - avg(s2) OVER w) / greatest(stddev_samp(s2) OVER w, 1e-6), 9)::DECIMAL(28, 9), 6)::DOUBLE AS score FROM b WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM f)
SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 20""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and MaxSim scores standardised per query and added."""
    return blocked_fusion(*_vectors(spark, sf_dir), {"dense": (cosine_scores, 1.0), "maxsim": (maxsim(4), 1.0)}, 20)


_SPARSE = """q AS (SELECT vec_id AS query_id, unnest(range(64)) AS term, unnest(embedding)::DOUBLE AS w FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT vec_id AS doc_id, unnest(range(64)) AS term, unnest(embedding)::DOUBLE AS w FROM embeddings),
s AS (SELECT query_id, doc_id, round(sum(round(q.w * d.w, 9)::DECIMAL(28, 9)), 6)::DOUBLE AS score FROM q JOIN d ON q.term = d.term AND d.w > 0.05 AND q.w > 0.05 WHERE query_id <> doc_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM s)"""


@register("sparse_topk", f"WITH {_SPARSE} SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 100")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned-sparse retrieval by an inverted index: coordinates over 0.05 stand for term weights."""
    return blocked_top_k(*_vectors(spark, sf_dir), sparse_products(0.05), 100)


@register("hybrid_three_topk", f"""WITH {_MAXSIM}, q2 AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
dense AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(list_transform(qv, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM q2 CROSS JOIN embeddings WHERE query_id <> vec_id),
w AS (SELECT vec_id, unnest(range(64)) AS term, unnest(embedding)::DOUBLE AS w FROM embeddings),
sparse AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(sum(round(a.w * b.w, 9)::DECIMAL(28, 9)), 6)::DOUBLE AS score FROM w a JOIN w b ON a.term = b.term AND a.w > 0.05 AND b.w > 0.05 WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
b AS (SELECT d.query_id, d.doc_id, d.score AS s1, coalesce(p.score, 0) AS s2, m.score AS s3 FROM dense d JOIN maxsim m USING (query_id, doc_id) LEFT JOIN sparse p USING (query_id, doc_id)),
f AS (SELECT query_id, doc_id, round(round((s1 - avg(s1) OVER w) / greatest(stddev_samp(s1) OVER w, 1e-6), 9)::DECIMAL(28, 9) + round(0.3 * (s2 - avg(s2) OVER w) / greatest(stddev_samp(s2) OVER w, 1e-6), 9)::DECIMAL(28, 9) + round((s3 - avg(s3) OVER w) / greatest(stddev_samp(s3) OVER w, 1e-6), 9)::DECIMAL(28, 9), 6)::DOUBLE AS score FROM b WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM f)
SELECT query_id, pos::INTEGER AS pos, doc_id, score FROM ranked WHERE pos <= 20""")
def hybrid_three_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, sparse and MaxSim scores standardised per query and added with weights 1, 0.3 and 1; no common term is a sparse 0."""
    return blocked_fusion(*_vectors(spark, sf_dir), {"dense": (cosine_scores, 1.0), "sparse": (sparse_products(0.05, none=0.0), 0.3), "maxsim": (maxsim(4), 1.0)}, 20)
