"""Corpus queries: cleaned texts and assembled product documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions import corpus_text as C
from plumeline.operators.places import with_places
from plumeline.plans.attributes import product_meta
from plumeline.registry import register
from plumeline.sources.tables import spread, table, unescape_sql


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _garbled_sql(c: str) -> str:
    for bad, good in C.GARBLED.items():
        c = f"replace({c}, {' || '.join(f'chr({ord(x)})' for x in bad)}, {_quoted(good)})"
    return c


_SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"
_WHOLE = _quoted(r"^\s*(?:" + "|".join(C.EMPTY_SENTENCES) + r")\s*$")


def _phrases_sql(c: str) -> str:
    for phrase in C.EMPTY_PHRASES:
        c = f"regexp_replace({c}, {_quoted('(?i)' + phrase)}, ' ', 'g')"
    return c


def clean_sql(source: str, key: str, text: str) -> str:
    """`cleaned` (key, text) as common table expressions."""
    scripts = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0370}-\x{03FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}]"
    allowed = r"""[^\p{L}\p{N}\s\-_/.,:%&+()\[\]'"#]"""
    return f"""p0 AS (SELECT {key} AS k, {text} AS raw FROM {source}),
p1 AS (SELECT k, trim(regexp_replace(regexp_replace(regexp_replace({unescape_sql("raw", 1)}, '<[^>]*>', ' ', 'g'), {_quoted(allowed)}, ' ', 'g'), '\\s+', ' ', 'g'), {_SPACE}) AS t FROM p0),
p2 AS (SELECT k, array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {_SPACE}) <> '' AND NOT regexp_matches(trim(s, {_SPACE}), {_WHOLE})), ' ') AS t FROM p1),
p3 AS (SELECT k, {_phrases_sql("t")} AS t FROM p2),
p4 AS (SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(t, 'https?://\\S+', ' ', 'g'), '\\bwww\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g'), {_SPACE}) AS t FROM p3),
cleaned AS (SELECT k, trim(regexp_replace(regexp_replace(regexp_replace({_garbled_sql("t")}, '[' || chr(194) || chr(226) || '](\\s|$)', '\\1', 'g'), '{scripts}', ' ', 'g'), '\\s+', ' ', 'g'), {_SPACE}) AS t FROM p4)"""


@register("corpus_clean", f"WITH {clean_sql('documents', 'doc_id', 'coalesce(text, chr(32))')} SELECT k AS doc_id, sha256(t) AS digest, length(t)::INTEGER AS n_chars FROM cleaned")
def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through character cleaning, the marketing rules and mending of its encoding."""
    c = table(spark, sf_dir, "documents").select("doc_id", C.clean_field(F.coalesce("text", F.lit(" "))).alias("t"))
    return c.select("doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("digest"), F.length("t").alias("n_chars"))


@register("corpus_numbers", f"WITH {clean_sql('pages', 'page_id', 'html')} SELECT k AS page_id, len(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'))::INTEGER AS n_numbers, len(list_distinct(regexp_extract_all(t, '\\d+(?:\\.\\d+)?')))::INTEGER AS n_distinct FROM cleaned")
def corpus_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in every cleaned page."""
    c = table(spark, sf_dir, "pages").select("page_id", C.numbers(C.clean_field(F.col("html"))).alias("n"))
    return c.select("page_id", F.size("n").alias("n_numbers"), F.size(F.array_distinct("n")).alias("n_distinct"))


def product_documents(lines: DataFrame) -> DataFrame:
    """(asin, line_no, title, brand, categories, dimensions, weight, description, features) -> (asin, doc_idx, doc); categories, description and features are lists.

    Every product's document, cleaned field by field, numbered from 0 by asin over all of them. Lines without a title are left out; of the others that share an asin
    the last one counts. A line without an asin is an error.
    """
    missing = F.raise_error(F.lit("a product has no asin"))
    titled = lines.withColumn("asin", F.coalesce(F.nullif(C.plain_text(F.col("asin")), F.lit("")), missing)).filter("title <> ''")
    fields = [F.col(c) for c in lines.columns if c not in ("asin", "line_no")]
    last = titled.groupBy("asin").agg(F.max(F.struct("line_no", *fields)).alias("line")).select("asin", "line.*").drop("line_no")
    # Numbered before the cleaning, which would otherwise be done once more for the sample of the sort.
    m = spread(with_places(last, [F.col("asin")], "doc_idx"), 2000, "asin")
    cleaned = {c: C.clean_field(F.col(c)) for c in ("brand", "dimensions", "weight")}
    rows = m.withColumns({"title": C.plain_text(F.col("title")), "category": C.clean_categories(F.col("categories")), "description": F.array_join("description", " "), **cleaned}).drop("categories")
    # Generated, so that each field is cleaned once for a product and not in every place, or for every sentence, that reads it.
    rows = rows.select(F.inline(F.array(F.struct(*rows.columns))))
    title, brand, category, dimensions, weight = map(F.col, ("title", "brand", "category", "dimensions", "weight"))
    doc = C.document(title, brand, category, dimensions, weight, C.clean_description(F.col("description"), dimensions, weight, title), C.clean_features(F.col("features"), title))
    return rows.select("asin", "doc_idx", doc.alias("doc"))


@register("corpus_docs")
def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asin, doc_idx, doc): the document of each product, numbered from 0 by asin; its main category and its item are its categories."""
    value = lambda k: F.filter("details", lambda d: d["key"] == k)[0]["value"]
    item, n = value("Item"), F.col("rating_number")
    title = F.concat_ws(" ", value("Type"), item, value("Style"), F.lit("in"), value("Color"))
    size = F.concat(n, F.lit(" x "), n + 1, F.lit(" inches"))
    parts = [
        F.lit("Product Description."), F.concat(F.lit("A "), item, F.lit(" that lasts.")), F.concat(F.lit("It measures "), size, F.lit(".")), F.concat(F.lit("It weighs "), value("Item Weight"), F.lit(".")), F.lit("Makes a great gift."),
        F.concat(F.lit("GREAT FOR EVERY HOME AND OFFICE "), F.upper(item), F.lit(".")), F.lit("See www.example.com now."),
    ]
    lines = product_meta(spark, sf_dir, 2000).select(
        F.coalesce(F.nullif("parent_asin", F.lit("")), "asin").alias("asin"), "line_no", title.alias("title"), "brand", F.array("main_category", item).alias("categories"),
        size.alias("dimensions"), value("Item Weight").alias("weight"), F.array(*parts).alias("description"), "features",
    )
    return product_documents(lines)
