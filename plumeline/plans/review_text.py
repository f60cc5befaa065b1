"""Queries over review texts: sentences, cohorts of users and products, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeline.functions.text import clean_html, hash_bucket, split_name
from plumeline.registry import register
from plumeline.sources.tables import BUCKET_SQL, REVIEWS_SQL, review_sentences, reviews, table, unescape_sql


@register("sentences_per_user", f"""WITH {REVIEWS_SQL}
SELECT user_id, count(*) AS n_sentences, count(DISTINCT asin) AS n_products, min(length(sentence)) AS shortest, max(length(sentence)) AS longest
FROM sentences GROUP BY user_id HAVING count(*) >= 10""")
def sentences_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with at least ten sentences."""
    s = review_sentences(spark, sf_dir)
    grouped = s.groupBy("user_id").agg(F.count("*").alias("n_sentences"), F.countDistinct("asin").alias("n_products"), F.min(F.length("sentence")).cast("long").alias("shortest"), F.max(F.length("sentence")).cast("long").alias("longest"))
    return grouped.filter("n_sentences >= 10")


@register("user_sentences", f"WITH {REVIEWS_SQL} SELECT user_id, asin, review_pos, sent_pos::INTEGER AS sent_pos, sentence FROM sentences")
def user_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its place."""
    return review_sentences(spark, sf_dir)


@register("users_per_product", f"""WITH {REVIEWS_SQL}, eligible AS (SELECT user_id FROM sentences GROUP BY user_id HAVING count(*) >= 10)
SELECT asin, string_agg(DISTINCT user_id, ',' ORDER BY user_id) AS users, count(DISTINCT user_id) AS n_users
FROM reviews WHERE user_id IN (SELECT user_id FROM eligible) GROUP BY asin""")
def users_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and the sorted users who reviewed them, of users with at least ten sentences."""
    eligible = review_sentences(spark, sf_dir).groupBy("user_id").count().filter("count >= 10").select("user_id")
    kept = reviews(spark, sf_dir).join(eligible, "user_id", "left_semi").select("asin", "user_id").distinct()
    return kept.groupBy("asin").agg(F.array_join(F.sort_array(F.collect_list("user_id")), ",").alias("users"), F.count("*").alias("n_users"))


@register("sentence_count_stats", f"""WITH {REVIEWS_SQL}, n AS (SELECT user_id, count(*) AS n FROM sentences GROUP BY user_id),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS place, count(*) OVER () AS total FROM n)
SELECT count(*) AS n_users, min(n) AS least, max(n) AS most, max(CASE WHEN place = total // 2 THEN n END) AS median,
  count(*) FILTER (n >= 100) AS with_100, count(*) FILTER (n >= 50) AS with_50, count(*) FILTER (n >= 20) AS with_20 FROM r""")
def sentence_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of sentences per user; the median is the element n div 2 of the descending order."""
    n = review_sentences(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    by_count = n.groupBy("n").agg(F.count("*").alias("users"))  # distinct counts: far fewer rows than users
    w = Window.orderBy(F.col("n").desc())
    placed = by_count.withColumn("upto", F.sum("users").over(w)).withColumn("total", F.sum("users").over(Window.partitionBy()))
    at = F.floor(F.col("total") / 2)
    median = F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("users") <= at), F.col("n")))
    over = [F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("users"))), F.lit(0)).alias(f"with_{k}") for k in (100, 50, 20)]
    return placed.agg(F.sum("users").alias("n_users"), F.min("n").alias("least"), F.max("n").alias("most"), median.alias("median"), *over)


@register("clean_html_pages", f"""WITH r1 AS (SELECT page_id, {unescape_sql("html", 1)} AS t FROM pages), r2 AS (SELECT page_id, {unescape_sql("t", 1)} AS t FROM r1), r3 AS (SELECT page_id, {unescape_sql("t", 1)} AS t FROM r2)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '<br\\s*/?>', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), ' {{2,}}', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM r3""")
def clean_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text."""
    return table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@register("split_bucket", f"""WITH {REVIEWS_SQL}, b AS (SELECT user_id, {BUCKET_SQL.format(salt="split", text="sentence")} AS bucket FROM sentences)
SELECT user_id, CASE WHEN bucket < 8 THEN 'profile' ELSE 'val' END AS split, count(*) AS n, sum(bucket)::BIGINT AS buckets FROM b GROUP BY ALL""")
def split_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per user and split by the hash of the sentence."""
    s = review_sentences(spark, sf_dir).select("user_id", split_name(F.col("sentence")).alias("split"), hash_bucket(F.col("sentence"), 10, "split").alias("bucket"))
    return s.groupBy("user_id", "split").agg(F.count("*").alias("n"), F.sum("bucket").alias("buckets"))


@register("pair_cohorts", f"""WITH {REVIEWS_SQL}, n AS (SELECT asin, user_id, count(*) AS n FROM sentences GROUP BY ALL HAVING count(*) >= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY user_id) AS place, count(*) OVER (PARTITION BY asin) AS users FROM n)
SELECT asin, user_id, n, place::INTEGER AS place FROM r WHERE users >= 2 AND place <= 2""")
def pair_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two users of each product that at least two users wrote thirty sentences on."""
    n = review_sentences(spark, sf_dir).groupBy("asin", "user_id").agg(F.count("*").alias("n")).filter("n >= 30")
    w = Window.partitionBy("asin")
    ranked = n.withColumn("place", F.row_number().over(w.orderBy("user_id"))).withColumn("users", F.count("*").over(w))
    return ranked.filter("users >= 2 and place <= 2").select("asin", "user_id", "n", "place")


@register("cohort_sample", f"""WITH {REVIEWS_SQL}, n AS (SELECT asin, user_id FROM sentences GROUP BY ALL HAVING count(*) >= 30),
h AS (SELECT s.*, row_number() OVER (PARTITION BY asin, user_id ORDER BY sha256('42|' || review_pos::VARCHAR || '|' || sent_pos::VARCHAR)) AS place FROM sentences s SEMI JOIN n USING (asin, user_id))
SELECT asin, user_id, review_pos, sent_pos::INTEGER AS sent_pos, CASE WHEN place <= 18 THEN 'train' WHEN place <= 24 THEN 'val' ELSE 'test' END AS part FROM h WHERE place <= 30""")
def cohort_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty sentences of each pair with thirty, in hash order, dealt 18 / 6 / 6."""
    s = review_sentences(spark, sf_dir)
    pairs = s.groupBy("asin", "user_id").count().filter("count >= 30").select("asin", "user_id")
    key = F.sha2(F.concat_ws("|", F.lit("42"), "review_pos", "sent_pos"), 256)
    placed = s.join(pairs, ["asin", "user_id"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("asin", "user_id").orderBy(key))).filter("place <= 30")
    part = F.when(F.col("place") <= 18, "train").when(F.col("place") <= 24, "val").otherwise("test")
    return placed.select("asin", "user_id", "review_pos", "sent_pos", part.alias("part"))
