"""JSON-lines sources and the loaders of the pipeline's nested files, from paths or from a column of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = "parent_asin string, asin string, details map<string,string>, features array<string>, brand string, main_category string, average_rating double, rating_number long, price string, title string, categories array<string>, description array<string>"
REVIEW_SCHEMA = "user_id string, parent_asin string, text string"
_SELECTION = "struct<selections:array<struct<asin:string,uid:string,query:string,users:array<struct<uid:string,query:string,logp:double,d2:double,margin:double>>>>>"
_SAMPLE = "struct<prompt:string,response:string,attrs:map<string,string>,attributes:map<string,string>,query:string>"


def tolerant(spark: SparkSession, path: str, schema: str = META_SCHEMA) -> DataFrame:
    """Lines that parse (gzip by extension) and have an identifier; blank and broken lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter((F.coalesce(F.nullif("parent_asin", F.lit("")), F.nullif("asin", F.lit("")))).isNotNull())


def placed(spark: SparkSession, path: str, schema: str = META_SCHEMA) -> DataFrame:
    """Every line but blank ones with its record's columns, `broken` for a line that does not parse, and `place`, which orders lines as the files do.

    A place is the file's path, where the line's split of the file begins, and a number that rises within the split; so files count in
    order of their paths and lines in order, however the files are split among tasks.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("place")).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.select("place", parsed.alias("r")).select("place", F.coalesce(F.col("r._broken").isNotNull(), F.lit(True)).alias("broken"), "r.*").drop("_broken")


def last_of_each(rows: DataFrame, key: Column) -> DataFrame:
    """Of `placed` rows the last one of each key, as a loader gives it that fills a dictionary line by line; rows that are broken or without a key are none."""
    fields = [c for c in rows.columns if c not in ("place", "broken")]
    known = rows.filter(~F.col("broken")).withColumn("_key", F.nullif(key, F.lit(""))).filter(F.col("_key").isNotNull())
    return known.groupBy("_key").agg(F.max_by(F.struct(*fields), "place").alias("_last")).select(F.col("_key").alias("key"), "_last.*")


def broken_lines(rows: DataFrame) -> DataFrame:
    """(file, lines, broken) of `placed` rows."""
    return rows.groupBy(F.col("place.file").alias("file")).agg(F.count("*").alias("lines"), F.count_if("broken").alias("broken"))


def strict_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews; a line that does not parse or lacks its product or user fails the job, a missing text is empty."""
    rows = spark.read.schema(REVIEW_SCHEMA).option("mode", "FAILFAST").json(path)
    needed = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a review lacks {c}")))
    return rows.select(needed("user_id").alias("user_id"), needed("parent_asin").alias("parent_asin"), F.coalesce("text", F.lit("")).alias("text"))


def strict_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata for the corpus: types must fit, products without a title are skipped."""
    rows = spark.read.schema(META_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.filter(F.col("title").isNotNull() & (F.trim("title") != ""))


def selections(line: Column) -> Column:
    """array<struct<asin,uid,query>> of a selection file, in the nested and in the flat form."""
    parsed = F.from_json(line, _SELECTION)["selections"]
    flat = lambda asin, uid, query: F.struct(asin.alias("asin"), uid.alias("uid"), query.alias("query"))
    return F.flatten(F.transform(parsed, lambda s: F.when(s["users"].isNotNull(), F.transform(s["users"], lambda u: flat(s["asin"], u["uid"], u["query"]))).otherwise(F.array(flat(s["asin"], s["uid"], s["query"])))))


def pool(line: Column) -> Column:
    """array<struct<asin,local_idx,query>> of a pool file: with or without a wrapper, strings or {text}; empty ones go."""
    body = F.coalesce(F.get_json_object(line, "$.pool"), line)
    by_asin = F.map_entries(F.from_json(body, "map<string,array<string>>"))
    text = lambda q: F.trim(F.when(q.startswith("{"), F.get_json_object(q, "$.text")).otherwise(q))
    listed = F.flatten(F.transform(by_asin, lambda e: F.transform(e["value"], lambda q, i: F.struct(e["key"].alias("asin"), i.alias("local_idx"), text(q).alias("query")))))
    return F.filter(listed, lambda r: r["query"].isNotNull() & (r["query"] != ""))


def sample(line: Column) -> Column:
    """struct<prompt,response> of a training sample in any of its three shapes; other shapes fail the job."""
    s = F.from_json(line, _SAMPLE)
    attrs = F.coalesce(s["attrs"], s["attributes"])
    listed = F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    prompt = F.coalesce(s["prompt"], listed)
    answer = F.coalesce(s["response"], s["query"])
    bad = prompt.isNull() | answer.isNull()
    return F.struct(F.when(bad, F.raise_error(F.lit("a sample has none of the known shapes"))).otherwise(prompt).alias("prompt"), answer.alias("response"))
