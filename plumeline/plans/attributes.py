"""Attribute queries over product metadata made from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators import attributes as A
from plumeline.registry import register
from plumeline.sources.tables import spread, table


def product_meta(spark: SparkSession, sf_dir: str, each: int | None = None) -> DataFrame:
    """Metadata rows from `part`: details in order, features, fallbacks and numbers; every 13th has no parent_asin. With `each`, dealt over tasks of so many parts."""
    p = table(spark, sf_dir, "part")
    p = p if each is None else spread(p, each, "p_partkey")
    color, item = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    pairs = [
        ("Item model number", F.col("p_brand")), ("Type", F.initcap(F.lower("p_type"))), ("Color", F.concat(color, F.lit(", plain"))), ("Item", item), ("Care", F.when(F.col("p_size") % 3 == 0, "Yes").otherwise(F.concat(F.lit("wash_"), color))),
        ("Item Weight", F.concat(F.col("p_size"), F.lit(" ounces"))), ("Twin", F.upper(item)), ("Style", F.concat(F.initcap(item), F.initcap(color))), ("Use", F.when(F.col("p_size") % 2 == 0, "home and garden and office").otherwise("garden ")), ("Country of Origin", F.lit("Utopia")), ("Note", F.when(F.col("p_size") % 5 == 0, "木 wood").otherwise(F.concat(color, F.lit(" finish")))),
    ]
    details = F.array(*[A.attribute(F.lit(i + 1), F.lit(k), v) for i, (k, v) in enumerate(pairs)])
    features = F.array(F.concat(F.lit("Sturdy "), item), F.lit(" "), F.concat(color, F.lit(" "), item, F.lit(" for all seasons")))
    parent = F.when(F.col("p_partkey") % 13 > 0, F.concat(F.lit("P"), F.col("p_partkey"))).otherwise(F.lit(""))
    return p.select(parent.alias("parent_asin"), F.concat(F.lit("S"), F.col("p_partkey")).alias("asin"), F.col("p_partkey").alias("line_no"), details.alias("details"), features.alias("features"), F.col("p_brand").alias("brand"), F.initcap(F.lower("p_type")).alias("main_category"), F.lit(None).cast("double").alias("average_rating"), F.col("p_size").alias("rating_number"), F.col("p_retailprice").alias("price"))


_SPEAKS = """len(regexp_extract_all({v}, '\\S+')) <= 3 AND lower({v}) NOT IN ('yes', 'no', 'true', 'false') AND regexp_matches({v}, '[A-Za-z]') AND regexp_matches(key, '[A-Za-z]') AND NOT regexp_matches({v}, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]')"""
ATTRS_SQL = f"""b AS (SELECT *, CASE WHEN p_partkey % 13 > 0 THEN 'P' || p_partkey::VARCHAR ELSE 'S' || p_partkey::VARCHAR END AS asin, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS item, upper(p_type[1]) || lower(p_type[2:]) AS kind FROM part),
raw AS (
  SELECT asin, unnest(range(1, 12)) AS pos, unnest(['Item model number', 'Type', 'Color', 'Item', 'Care', 'Item Weight', 'Twin', 'Style', 'Use', 'Country of Origin', 'Note']) AS key,
    unnest([p_brand, kind, color || ', plain', item, CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'wash_' || color END, p_size::VARCHAR || ' ounces', upper(item), upper(item[1]) || item[2:] || upper(color[1]) || color[2:],
      CASE WHEN p_size % 2 = 0 THEN 'home and garden and office' ELSE 'garden' END, 'Utopia', CASE WHEN p_size % 5 = 0 THEN '木 wood' ELSE color || ' finish' END]) AS value FROM b
  UNION ALL SELECT asin, 1000, 'Feature 1', 'Sturdy ' || item FROM b
  UNION ALL SELECT asin, 1002, 'Feature 3', color || ' ' || item || ' for all seasons' FROM b
  UNION ALL SELECT asin, 2000, 'Brand', p_brand FROM b UNION ALL SELECT asin, 2001, 'Main Category', kind FROM b),
wordy AS (SELECT *, row_number() OVER (PARTITION BY asin, lower(value) ORDER BY pos) AS r FROM raw WHERE NOT regexp_matches(value, '[0-9]')),
cut AS (SELECT asin, pos, key, trim(split_part(value, ',', 1)) AS value FROM wordy WHERE r = 1 AND {_SPEAKS.format(v="value")}),
long AS (SELECT * FROM cut WHERE value <> '' AND {_SPEAKS.format(v="value")}),
attrs AS (SELECT * FROM long WHERE asin IN (SELECT asin FROM long GROUP BY asin HAVING count(*) >= 5))"""
_BANNED = "'" + "|".join(A.NUMERIC_KEYS + A.PLAIN_KEYS) + "'"
_RANK = "CASE key " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(A.PRIORITY)) + " ELSE 1000 END"
TOP_SQL = f"""{ATTRS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY {_RANK}, pos)::INTEGER AS place FROM attrs WHERE NOT regexp_matches(lower(key), {_BANNED})),
top AS (SELECT * FROM ranked WHERE place <= 5)"""
_WORD_SQL = "[\\p{L}\\p{N}_]+(?:[''-][\\p{L}\\p{N}_]+)*"
CLEAN_SQL = f"""{ATTRS_SQL},
c0 AS (SELECT asin, pos, key, value AS raw, CASE WHEN lower(key) IN ('brand', 'manufacturer', 'item model number') THEN value ELSE regexp_replace(regexp_replace(replace(value, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') END AS value FROM attrs),
c1 AS (SELECT *, array_to_string(regexp_extract_all(lower(value), '{_WORD_SQL}'), ' ') AS words FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY pos)::INTEGER AS place FROM c1 WHERE words <> '' AND length(words) <= 30 AND NOT (NOT contains(words, ' ') AND NOT contains(raw, ' ') AND length(raw) > 10)),
clean AS (SELECT * FROM c2 WHERE place <= 5)"""
#: A query for every product: all clean values but, for some products, the last; and for some a repeated word.
QUERY_SQL = f"""{CLEAN_SQL},
q AS (SELECT asin, 'find ' || string_agg(value, ' ' ORDER BY place) FILTER (length(asin) % 2 = 0 OR place < 5) || ' now' AS query FROM clean GROUP BY asin)"""


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.product_attributes(product_meta(spark, sf_dir))


def _exploded(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("asin", F.posexplode(column).alias("place", "d")).select("asin", (F.col("place") + 1).alias("place"), "d.pos", "d.key", "d.value")


@register("product_attrs", f"WITH {ATTRS_SQL} SELECT asin, pos::INTEGER AS pos, key, value FROM attrs")
def product_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute that the rules keep."""
    return _exploded(_attrs(spark, sf_dir), "attrs").drop("place")


@register("attr_field_counts", f"WITH {ATTRS_SQL} SELECT key, count(*) AS n, count(DISTINCT value) AS n_values, count(*) FILTER (pos < 1000) AS from_details FROM attrs GROUP BY key")
def attr_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key occurs."""
    return product_attrs(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.count_if(F.col("pos") < 1000).alias("from_details"))


@register("top_attrs", f"WITH {TOP_SQL} SELECT asin, place, pos::INTEGER AS pos, key, value FROM top")
def top_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best attributes of each product."""
    return _exploded(_attrs(spark, sf_dir).withColumn("attrs", A.top_attributes(F.col("attrs"))), "attrs")


@register("attr_prompt", f"""WITH {TOP_SQL} SELECT asin, 'Write one search query of 5-20 words for a product with these ' || count(*)::VARCHAR || ' known attributes: ' || string_agg(key || ': ' || value, '; ' ORDER BY place) AS prompt FROM top GROUP BY asin""")
def attr_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each product."""
    return _attrs(spark, sf_dir).withColumn("top", A.top_attributes(F.col("attrs"))).filter("size(top) > 0").select("asin", A.prompt(F.col("top")).alias("prompt"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attrs(spark, sf_dir).select("asin", A.clean_attributes(F.col("attrs")).alias("attrs"))


@register("clean_attr_values", f"WITH {CLEAN_SQL} SELECT asin, place, key, value FROM clean")
def clean_attr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cleaned values of each product."""
    return _exploded(_clean(spark, sf_dir), "attrs").drop("pos")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).filter("size(attrs) > 0")
    short = F.filter("attrs", lambda d, i: (i < 4) | (F.length("asin") % 2 == 0))
    return rows.withColumn("query", F.concat(F.lit("find "), F.array_join(F.transform(short, lambda d: d["value"]), " "), F.lit(" now")))


@register("content_check", f"""WITH {QUERY_SQL}, t AS (SELECT asin, query, regexp_extract_all(lower(query), '{_WORD_SQL}') AS tokens FROM q),
m AS (SELECT c.asin, string_agg(key, ',' ORDER BY place) FILTER (NOT contains(array_to_string(tokens, ' '), words)) AS missing, flatten(list(regexp_extract_all(lower(value), '{_WORD_SQL}'))) AS known FROM clean c JOIN t USING (asin) GROUP BY c.asin)
SELECT asin, query, coalesce(missing, '') AS missing, len(tokens) <> len(list_distinct(tokens)) AS repeated, len(list_filter(tokens, lambda x: NOT list_contains(known, x)))::INTEGER AS n_extras, missing IS NULL AND len(tokens) = len(list_distinct(tokens)) AS passed FROM t JOIN m USING (asin)""")
def content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate query covers its product's attributes without repeating itself."""
    checks = A.content_check(F.col("query"), F.col("attrs"))
    return _pool(spark, sf_dir).select("asin", "query", F.array_join(checks["missing"], ",").alias("missing"), checks["repeated"].alias("repeated"), F.size(checks["extras"]).alias("n_extras"), checks["passed"].alias("passed"))


@register("pool_filter", f"""WITH {QUERY_SQL}, t AS (SELECT asin, query, array_to_string(regexp_extract_all(lower(query), '{_WORD_SQL}'), ' ') AS normal FROM q)
SELECT asin, query FROM t WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.asin = t.asin AND NOT contains(t.normal, c.words))""")
def pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate queries that hold every attribute."""
    return _pool(spark, sf_dir).filter(A.covers(F.col("query"), F.col("attrs"))).select("asin", "query")
