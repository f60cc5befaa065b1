"""The logical tables of product search and how the given tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions.text import sentences

#: Rows of a product: the number of products grows with the tables, their size does not.
PER_PRODUCT = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """The rows dealt over tasks of about `each`, by `keys` if they are given, which saves a sort: where a row is much work, the few splits of a small file leave most cores idle."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, asin, review_pos, text): documents, their source taken as the user, forty in a row as one product's."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("user_id"), F.concat(F.lit("A"), F.floor(F.col("doc_id") / PER_PRODUCT)).alias("asin"), F.col("doc_id").alias("review_pos"), F.coalesce("text", F.lit("")).alias("text"))


def review_sentences(spark: SparkSession, sf_dir: str, each: int | None = None) -> DataFrame:
    """(user_id, asin, review_pos, sent_pos, sentence), sent_pos from 0 within the review; with `each`, dealt over tasks of so many reviews."""
    rows = reviews(spark, sf_dir)
    rows = rows if each is None else spread(rows, each, "review_pos")
    return rows.select("user_id", "asin", "review_pos", F.posexplode(sentences(F.col("text"))).alias("sent_pos", "sentence"))


#: The same in SQL, as common table expressions.
REVIEWS_SQL = f"""reviews AS (
  SELECT source AS user_id, 'A' || (doc_id // {PER_PRODUCT})::VARCHAR AS asin, doc_id AS review_pos, coalesce(text, '') AS text FROM documents),
listed AS (
  SELECT user_id, asin, review_pos, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS parts FROM reviews),
sentences AS (
  SELECT user_id, asin, review_pos, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sent_pos FROM listed)"""


def document_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, asin, user_id, rank_clean, rank_noisy) by document, for what only needs rows with ranks in them; ranks over 30 and 36 stand for misses (null)."""
    d = table(spark, sf_dir, "documents")
    clean, noisy = F.col("n_chars") % 33 + 1, (F.col("n_chars") + 3 * F.col("doc_id")) % 40 + 1
    return d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("A"), F.floor(F.col("doc_id") / PER_PRODUCT)).alias("asin"), F.col("source").alias("user_id"), F.when(clean <= 30, clean).alias("rank_clean"), F.when(noisy <= 36, noisy).alias("rank_noisy"))


DOCUMENT_OUTCOMES_SQL = f"""outcomes AS (SELECT doc_id AS query_id, 'A' || (doc_id // {PER_PRODUCT})::VARCHAR AS asin, source AS user_id,
  CASE WHEN n_chars % 33 + 1 <= 30 THEN n_chars % 33 + 1 END AS rank_clean, CASE WHEN (n_chars + 3 * doc_id) % 40 + 1 <= 36 THEN (n_chars + 3 * doc_id) % 40 + 1 END AS rank_noisy FROM documents)"""


def style_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, user_id, asin, split, z): the first 16 dimensions of embeddings, their label taken as the user."""
    from plumeline.functions.text import split_name

    rows = table(spark, sf_dir, "embeddings").filter("label is not null")
    z = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))
    return rows.select("vec_id", F.concat(F.lit("u"), "label").alias("user_id"), F.concat(F.lit("A"), F.floor(F.col("vec_id") / PER_PRODUCT)).alias("asin"), split_name(F.col("vec_id").cast("string")).alias("split"), z.alias("z"))


BUCKET_SQL = """((list_sum(list_transform(range(1, 41), lambda i: CASE WHEN i = 40 THEN 1 ELSE 6 END * (instr('0123456789abcdef', substr(sha1('{salt}' || '|' || lower(trim({text}, chr(32) || chr(9) || chr(10) || chr(13)))), i, 1)) - 1))) % 10)::INTEGER)"""


def unescape_sql(c: str, rounds: int) -> str:
    """Character references replaced in SQL, `rounds` times: a map of the names, and numbers; names cut short stay as they are."""
    from html.entities import html5

    def chars(x: str) -> str:
        return " || ".join(f"chr({ord(k)})" for k in x)

    names = "MAP {" + ", ".join(f"'&{k}': {chars(v)}" for k, v in html5.items()) + "}"
    pattern = "'&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)'"
    number = "CASE WHEN lower(q[2][3]) = 'x' THEN ('0x' || rtrim(q[2][4:], ';'))::INTEGER ELSE rtrim(q[2][3:], ';')::INTEGER END"
    value = f"CASE WHEN q[2] IS NULL THEN '' WHEN q[2][2] = '#' THEN chr({number}) ELSE coalesce(map_extract({names}, q[2])[1], q[2]) END"
    for _ in range(rounds):
        c = f"CASE WHEN contains({c}, '&') THEN array_to_string(list_transform(list_zip(string_split_regex({c}, {pattern}), regexp_extract_all({c}, {pattern})), lambda q: q[1] || {value}), '') ELSE {c} END"
    return c


VECTORS_SQL = f"""vectors AS (
  SELECT vec_id, 'u' || label::VARCHAR AS user_id, 'A' || (vec_id // {PER_PRODUCT})::VARCHAR AS asin,
    CASE WHEN {BUCKET_SQL.format(salt="split", text="vec_id::VARCHAR")} < 8 THEN 'profile' ELSE 'val' END AS split,
    list_transform(embedding[1:16], lambda x: x::DOUBLE) AS z FROM embeddings WHERE label IS NOT NULL)"""
