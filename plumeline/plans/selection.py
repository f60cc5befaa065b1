"""Eligibility, asserted joins, prompts and the other small rules that decide who and what takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeline.functions.prompts import RERANK_TEMPLATES, first_known, morph_diff, rerank_prompt
from plumeline.functions.text import strip_edges
from plumeline.functions.vectors import cosine
from plumeline.operators import selection as S
from plumeline.operators.places import with_running_total
from plumeline.operators.rules import annotated_tokens, context_signature
from plumeline.plans.attributes import ATTRS_SQL, product_attrs
from plumeline.plans.noise import EDITS_SQL, annotated_sql, user_edits
from plumeline.plans.retrieval import misspelt
from plumeline.plans.style import PARSED_SQL, parsed
from plumeline.registry import register
from plumeline.sources.tables import PER_PRODUCT, REVIEWS_SQL, review_sentences, table

_HASH = "sha256('42|' || {x})"


@register("modelling_users", f"""WITH {REVIEWS_SQL}, n AS (SELECT user_id, count(*) AS n FROM sentences GROUP BY user_id HAVING count(*) >= 30) SELECT user_id, n, (row_number() OVER (ORDER BY {_HASH.format(x='user_id')}) - 1)::INTEGER AS place FROM n""")
def modelling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of thirty sentences and more, in hash order."""
    return S.modelling_users(review_sentences(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")))


@register("profile_sentences", f"""WITH {REVIEWS_SQL}, chosen AS (SELECT user_id FROM reviews GROUP BY user_id HAVING count(DISTINCT asin) >= 3), k AS (SELECT * FROM sentences WHERE user_id IN (SELECT user_id FROM chosen)),
r AS (SELECT user_id, review_pos, sent_pos, sentence, row_number() OVER (PARTITION BY user_id ORDER BY review_pos, sent_pos) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM k)
SELECT user_id, review_pos, sent_pos::INTEGER AS sent_pos, place::INTEGER AS place, length(sentence)::INTEGER AS n_chars FROM r WHERE n >= 30 AND place <= 50""")
def profile_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty sentences of selected users (of three products and more) with at least thirty."""
    s = review_sentences(spark, sf_dir)
    chosen = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("user_id")).agg(F.countDistinct(F.floor(F.col("doc_id") / PER_PRODUCT)).alias("n")).filter("n >= 3")
    return S.first_sentences(s, chosen).select("user_id", "review_pos", "sent_pos", "place", F.length("sentence").alias("n_chars"))


_COUNTED = f"{ATTRS_SQL}, counted AS (SELECT asin, count(*) AS n FROM attrs GROUP BY asin), cohort AS (SELECT asin, unnest(['u' || (length(asin) % 3)::VARCHAR, 'v' || (n % 2)::VARCHAR]) AS user_id FROM counted)"


def _cohort(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(asin, n) attributes of products and (asin, user_id) of their users."""
    counted = product_attrs(spark, sf_dir).groupBy("asin").agg(F.count("*").alias("n"))
    users = F.array(F.concat(F.lit("u"), F.length("asin") % 3), F.concat(F.lit("v"), F.col("n") % 2))
    return counted, counted.select("asin", F.explode(users).alias("user_id"))


@register("pool_products", f"""WITH {_COUNTED} SELECT asin, count(DISTINCT user_id) AS n_users FROM cohort WHERE asin IN (SELECT asin FROM counted WHERE n >= 5) AND asin IN (SELECT asin FROM cohort WHERE user_id IN ('u1', 'v0')) AND asin NOT IN (SELECT asin FROM counted WHERE n >= 9) GROUP BY asin""")
def pool_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products open to query generation: five attributes, an audited user, not trained on."""
    counted, cohort = _cohort(spark, sf_dir)
    valid = cohort.select("user_id").distinct().filter("user_id in ('u1', 'v0')")
    return S.pool_products(cohort, counted, valid, counted.filter("n >= 9").select("asin"))


@register("held_out_products", f"WITH {_COUNTED} SELECT asin, n FROM counted WHERE n >= 5 AND asin NOT IN (SELECT asin FROM counted WHERE n >= 9) ORDER BY {_HASH.format(x='asin')} LIMIT 10")
def held_out_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten products of those not trained on, in hash order."""
    counted, _ = _cohort(spark, sf_dir)
    return S.held_out_products(counted, counted.filter("n >= 9"))


@register("product_order", f"WITH {_COUNTED} SELECT asin, n, row_number() OVER (ORDER BY n DESC, {_HASH.format(x='asin')})::INTEGER AS place FROM counted")
def product_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by number of attributes, equal ones in hash order."""
    return S.by_density(_cohort(spark, sf_dir)[0])


@register("row_offsets", f"""WITH {REVIEWS_SQL}, n AS (SELECT review_pos, count(*) AS n FROM sentences GROUP BY review_pos) SELECT review_pos, n, (coalesce(sum(n) OVER (ORDER BY review_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_row FROM n""")
def row_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each review's sentences begin when all are numbered: running sums inside range partitions, then of the partitions."""
    n = review_sentences(spark, sf_dir).groupBy("review_pos").agg(F.count("*").alias("n"))
    return with_running_total(n, [F.col("review_pos")], "n", "first_row")


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Selected cells (asin, uid, clean, rank) of the benchmark, and noisy pairs (asin, uid, clean, noisy) for those whose text changes."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    keyed = b.join(misspelt(b).withColumnRenamed("text", "noisy"), "query_id").select(F.concat(F.lit("A"), F.floor(F.col("query_id") / 4)).alias("asin"), F.concat(F.lit("u"), F.col("query_id")).alias("uid"), F.col("text").alias("clean"), "noisy", (F.length("text") % 30 + 1).alias("rank"))
    return keyed.select("asin", "uid", "clean", "rank"), keyed.filter("noisy <> clean").select("asin", "uid", "clean", "noisy")


_CELLS = """w AS (SELECT item_id, text, regexp_extract(text, '([A-Za-z]{5,})', 1) AS w FROM benchmark),
cells AS (SELECT 'A' || (item_id // 4)::VARCHAR AS asin, 'u' || item_id::VARCHAR AS uid, text AS clean, length(text) % 30 + 1 AS rank, CASE WHEN w = '' THEN text ELSE substr(text, 1, instr(text, w) + length(w) - 2) || substr(text, instr(text, w) + length(w)) END AS noisy FROM w)"""


@register("noisy_clean_pairs", f"WITH {_CELLS} SELECT asin, uid, rank::INTEGER AS rank, levenshtein(clean, noisy)::INTEGER AS distance FROM cells WHERE noisy <> clean")
def noisy_clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noisy query with the one clean row of its product, user and text; none or two are an error."""
    cells, noisy = _cells(spark, sf_dir)
    return S.joined_one_to_one(noisy, cells, ["asin", "uid", "clean"]).select("asin", "uid", F.col("rank").cast("int").alias("rank"), F.levenshtein("clean", "noisy").alias("distance"))


@register("cached_rows", f"WITH {_CELLS}, t AS (SELECT asin, uid, clean, noisy FROM cells WHERE noisy <> clean AND rank <= 25) SELECT (SELECT count(*) FROM cells WHERE noisy <> clean) AS rows, (SELECT count(*) FROM cells WHERE noisy <> clean AND rank > 25) AS missing, 0::BIGINT AS ambiguous, (SELECT count(*) FROM cells WHERE noisy <> clean AND rank > 25) AS only_first, 0::BIGINT AS only_second")
def cached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the noisy rows meet a cache of those with a rank of at most 25, on product, user and both texts."""
    cells, noisy = _cells(spark, sf_dir)
    keys = ["asin", "uid", "clean", "noisy"]
    cache = noisy.join(cells.filter("rank <= 25"), ["asin", "uid", "clean"], "left_semi").withColumn("score", F.lit(1.0))
    return S.unmatched(noisy, cache, keys).crossJoin(S.key_differences(noisy, cache, keys))


@register("completed_pairs", f"WITH {_CELLS} SELECT asin, uid, clean, CASE WHEN noisy <> clean THEN noisy END AS noisy FROM cells")
def completed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy rows, and clean ones for the cells that have none."""
    cells, noisy = _cells(spark, sf_dir)
    return S.with_clean_rows(noisy, cells.select("asin", "uid", "clean"), ["asin", "uid"])


@register("current_candidates", "SELECT conv_id::VARCHAR AS asin, turn::INTEGER AS local_idx, length(text)::INTEGER AS n_chars FROM conversations WHERE trim(text) <> ''")
def current_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumped candidates checked against the pool they came from; here the turns of conversations against themselves."""
    pool = table(spark, sf_dir, "conversations").filter("trim(text) <> ''").select(F.col("conv_id").cast("string").alias("asin"), F.col("turn").cast("int").alias("local_idx"), "text")
    return S.current_candidates(S.covered(pool, pool.select("asin")), pool).select("asin", "local_idx", F.length("text").alias("n_chars"))


def _prompt_sql(name: str) -> str:
    before, rest = RERANK_TEMPLATES[name].split("{query}")
    between, after = rest.split("{document}")
    quoted = lambda x: " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n"))
    return f"{quoted(before)} || b.text || {quoted(between)} || substr(trim(d.text, chr(32) || chr(9) || chr(10) || chr(13)), 1, 240) || {quoted(after)}"


@register("rerank_prompts", "WITH p AS (" + " UNION ALL ".join(f"SELECT item_id, doc_id, '{n}' AS template, {_prompt_sql(n)} AS prompt FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.k AND d.text IS NOT NULL" for n in RERANK_TEMPLATES) + ") SELECT template, count(*) AS n, sum(length(prompt))::BIGINT AS n_chars, min(sha256(prompt)) AS least FROM p GROUP BY template")
def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the queries, each document with one of them, for both rerankers, as digests."""
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"))
    n = b.count()
    pairs = table(spark, sf_dir, "documents").filter("text is not null").select("text", F.pmod("doc_id", F.lit(max(1, n))).cast("int").alias("k")).join(b, "k")
    prompts = F.array(*[F.struct(F.lit(n).alias("template"), rerank_prompt(F.col("query"), F.col("text"), n).alias("prompt")) for n in RERANK_TEMPLATES])
    rows = pairs.select(F.explode(prompts).alias("p"))
    return rows.groupBy("p.template").agg(F.count("*").alias("n"), F.sum(F.length("p.prompt")).alias("n_chars"), F.min(F.sha2("p.prompt", 256)).alias("least"))


_FORM = "'First=' || CASE WHEN {w}[1] = upper({w}[1]) THEN 'Up' ELSE 'Low' END || '|Last=' || CASE WHEN contains('aeiou', lower(right({w}, 1))) THEN 'Vowel' ELSE 'Other' END || '|Len=' || (length({w}) % 3)::VARCHAR"


@register("morph_changes", f"""WITH {EDITS_SQL}, f AS (SELECT *, {_FORM.format(w='word')} AS a, {_FORM.format(w='typo')} AS b FROM edits WHERE typo <> ''),
g AS (SELECT string_split(a, '|') AS x, string_split(b, '|') AS y FROM f), t AS (SELECT list_filter(list_zip(x, y), lambda q: q[1] <> q[2]) AS q FROM g),
m AS (SELECT array_to_string(list_transform(q, lambda p: split_part(p[1], '=', 1) || ':' || split_part(p[1], '=', 2) || '→' || split_part(p[2], '=', 2)), ';') AS diff FROM t) SELECT diff, count(*) AS n FROM m GROUP BY diff""")
def morph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the features of words change with their misspelling; features stand in for a parser's."""
    e = user_edits(spark, sf_dir).filter("typo <> ''")
    first = lambda c: F.when(F.substring(c, 1, 1) == F.upper(F.substring(c, 1, 1)), "Up").otherwise("Low")
    form = lambda c: F.concat(F.lit("First="), first(c), F.lit("|Last="), F.when(F.contains(F.lit("aeiou"), F.lower(F.right(c, F.lit(1)))), "Vowel").otherwise("Other"), F.lit("|Len="), F.length(c) % 3)
    return e.select(morph_diff(form(F.col("word")), form(F.col("typo"))).alias("diff")).groupBy("diff").agg(F.count("*").alias("n"))


@register("context_signatures", f"""WITH RECURSIVE {PARSED_SQL}, {annotated_sql('k', 'sent_id', 'ws')}, s AS (SELECT pos || '|' || dep || '|' || parent || '|' || len_bucket || '|' || CASE WHEN regexp_full_match(text, '[0-9]+') THEN 'digit' WHEN text = lower(text) THEN 'lower' WHEN text = upper(text) THEN 'upper' WHEN text[1] <> lower(text[1]) AND regexp_matches(text[2:], '[A-Za-z]') AND text[2:] = lower(text[2:]) THEN 'title' WHEN regexp_matches(text, '[0-9]') THEN 'mixed' ELSE 'other' END AS sig FROM x_ WHERE regexp_full_match(text, '[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*|[0-9]+'))
SELECT sig, count(*) AS n FROM s GROUP BY sig""")
def context_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, relation, parent, length and shape of every plain word."""
    t = annotated_tokens(parsed(spark, sf_dir)).filter(F.col("t.text").rlike("^([A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*|[0-9]+)$"))
    return t.groupBy(context_signature(F.col("t")).alias("sig")).agg(F.count("*").alias("n"))


@register("stripped_words", f"WITH {REVIEWS_SQL}, w AS (SELECT unnest(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) AS w FROM sentences) SELECT regexp_replace(regexp_replace(w, '^[^a-zA-Z0-9'']+', ''), '[^a-zA-Z0-9'']+$', '') AS word, count(*) AS n FROM w GROUP BY 1")
def stripped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without the punctuation at their ends."""
    words = review_sentences(spark, sf_dir).select(F.explode(F.filter(F.split("sentence", r"\s+"), lambda w: w != "")).alias("w"))
    return words.groupBy(strip_edges(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


@register("paired_cosine", """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label), c AS (SELECT vec_id, list_cosine_similarity(list_transform(x, lambda v: v::DOUBLE), list_transform(y, lambda v: v::DOUBLE)) AS s FROM p)
SELECT vec_id, round(s, 6) AS similarity, s >= 0.78 AS semantic_pass FROM c""")
def paired_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of paired vectors against the semantic threshold; a vector and the next of its label stand for a clean and a noisy text."""
    v = table(spark, sf_dir, "embeddings").filter("label is not null")
    pairs = v.select("vec_id", "label", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("y")), ["vec_id", "label"])
    s = S.finite_or_null(cosine(first_known(F.col("x")), F.col("y")))
    return pairs.select("vec_id", s.alias("s")).select("vec_id", F.round("s", 6).alias("similarity"), (F.col("s") >= 0.78).alias("semantic_pass"))


@register("model_eval", f"WITH {_COUNTED} SELECT n AS n_attrs, count(*) AS n_products, round(avg(length(asin)), 6) AS mean, round(stddev_pop(length(asin)), 6) AS std FROM counted GROUP BY n")
def model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of a figure of each product, by number of attributes."""
    c = _cohort(spark, sf_dir)[0]
    return c.groupBy(F.col("n").alias("n_attrs")).agg(F.count("*").alias("n_products"), F.round(F.avg(F.length("asin")), 6).alias("mean"), F.round(F.stddev_pop(F.length("asin")), 6).alias("std"))
