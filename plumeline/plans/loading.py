"""Loading queries: nested files made from the given tables and read back, sampling, models and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.models import apply_model, hash_scorer, template_generator
from plumeline.plans.attributes import TOP_SQL, attr_prompt
from plumeline.registry import register
from plumeline.sources import jsonl
from plumeline.sources.tables import DOCUMENT_OUTCOMES_SQL, document_outcomes, table
from plumeline.streaming.metrics import windowed


@register("selection_flatten", f"WITH {DOCUMENT_OUTCOMES_SQL} SELECT asin, user_id AS uid, 'query ' || query_id::VARCHAR AS query FROM outcomes")
def selection_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection files in both forms, one line for each product, flattened."""
    o = document_outcomes(spark, sf_dir).withColumn("query", F.concat(F.lit("query "), F.col("query_id")))
    users = F.collect_list(F.struct(F.col("user_id").alias("uid"), "query"))
    nested = o.filter("query_id % 2 = 0").groupBy("asin").agg(F.to_json(F.struct(F.array(F.struct("asin", users.alias("users"))).alias("selections"))).alias("line"))
    flat = o.filter("query_id % 2 = 1").select("asin", F.to_json(F.struct(F.array(F.struct("asin", F.col("user_id").alias("uid"), "query")).alias("selections"))).alias("line"))
    return nested.unionByName(flat).select(F.inline(jsonl.selections(F.col("line"))))


@register("pool_load", """WITH w AS (SELECT 'A' || item_id::VARCHAR AS asin, item_id, regexp_split_to_array(text, '\\s+') AS ws FROM benchmark)
SELECT asin, i::INTEGER AS local_idx, q AS query FROM (SELECT asin, unnest([0, 1, 2]) AS i, unnest([ws[1], CASE WHEN item_id % 2 = 0 THEN ' ' ELSE ws[2] END, ws[3]]) AS q FROM w) WHERE trim(q) <> ''""")
def pool_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pools as lines, wrapped and bare, strings and {text}; empty queries go, places stay."""
    b = table(spark, sf_dir, "benchmark").withColumn("ws", F.split("text", r"\s+"))
    second = F.when(F.col("item_id") % 2 == 0, F.lit(" ")).otherwise(F.get("ws", F.lit(1)))
    queries = F.array(F.get("ws", F.lit(0)), second, F.to_json(F.struct(F.get("ws", F.lit(2)).alias("text"))))
    bare = F.to_json(F.create_map(F.concat(F.lit("A"), F.col("item_id")), queries))
    line = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{"pool":'), bare, F.lit("}"))).otherwise(bare)
    return b.select(F.inline(jsonl.pool(line)))


@register("training_sample", """WITH p AS (SELECT p_partkey, sha256('42|' || p_partkey::VARCHAR) AS h, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Brand: ' || p_brand END AS prompt, p_type AS response FROM part)
SELECT p_partkey, prompt, response FROM p ORDER BY h LIMIT 100""")
def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples in hash order, of three shapes."""
    p = table(spark, sf_dir, "part")
    attrs = F.create_map(F.lit("Brand"), F.col("p_brand"))
    shapes = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.col("p_name").alias("prompt"), F.col("p_type").alias("response")))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(attrs.alias("attrs"), F.col("p_type").alias("query")))).otherwise(F.to_json(F.struct(attrs.alias("attributes"), F.col("p_type").alias("query"))))
    rows = p.select("p_partkey", shapes.alias("line")).orderBy(F.sha2(F.concat(F.lit("42|"), F.col("p_partkey")), 256)).limit(100)
    return rows.select("p_partkey", jsonl.sample(F.col("line")).alias("s")).select("p_partkey", "s.*")


@register("generated_queries", f"""WITH {TOP_SQL} SELECT asin, 'find ' || string_agg(value, ' ' ORDER BY place) || ' option 0' AS query FROM top GROUP BY asin""")
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query of the stand-in generator for each prompt."""
    return apply_model(attr_prompt(spark, sf_dir), "prompt", lambda: template_generator(0), "query", "string").select("asin", "query")


_HEX6 = "list_sum(list_transform(range(1, 7), lambda i: (instr('0123456789abcdef', substr(sha1(text), i, 1)) - 1) * pow(16, 6 - i)))"


@register("model_scores", f"SELECT item_id, round({_HEX6} / pow(16, 6), 6) AS score FROM benchmark")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in scorer over the benchmark."""
    return apply_model(table(spark, sf_dir, "benchmark"), "text", hash_scorer, "score", "double").select("item_id", F.round("score", 6).alias("score"))


@register("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(20, 6))::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour; the same function serves a stream."""
    return windowed(table(spark, sf_dir, "events"))
