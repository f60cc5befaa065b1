"""Files in and out, models, streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumeline.operators.models import apply_model, checked, generate_until, hash_scorer, template_generator
from plumeline.sources import jsonl, published
from plumeline.streaming.metrics import windowed


def write(path, lines):
    data = "\n".join(lines).encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)
    return str(path)


def test_tolerant_lines(spark, tmp_path):
    path = write(tmp_path / "m.jsonl.gz", [json.dumps({"parent_asin": "P1", "details": {"Brand": "x"}}), "", "{broken", json.dumps({"asin": "S2"}), json.dumps({"title": "no key"})])
    got = jsonl.tolerant(spark, path).collect()
    assert sorted(r.parent_asin or r.asin for r in got) == ["P1", "S2"]


def test_strict_lines(spark, tmp_path):
    good = write(tmp_path / "r.jsonl", [json.dumps({"user_id": "u", "parent_asin": "p"})])
    assert jsonl.strict_reviews(spark, good).first().text == ""
    for bad in (json.dumps({"user_id": "u"}), "{broken"):
        with pytest.raises(Exception):
            jsonl.strict_reviews(spark, write(tmp_path / "bad.jsonl", [bad])).collect()
    meta = write(tmp_path / "t.jsonl", [json.dumps({"parent_asin": "a", "title": "T"}), json.dumps({"parent_asin": "b", "title": " "}), json.dumps({"parent_asin": "c"})])
    assert [r.parent_asin for r in jsonl.strict_meta(spark, meta).collect()] == ["a"]


def test_unknown_samples_fail(spark):
    with pytest.raises(Exception):
        spark.createDataFrame([('{"query": "q"}',)], "line string").select(jsonl.sample(F.col("line"))).collect()


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(7).withColumnRenamed("id", "k")
    first = published.publish(a, root, ["k"], expected=5)
    with pytest.raises(ValueError):
        published.publish(b, root, ["k"], expected=6)
    assert published.current(spark, root).count() == 5
    second = published.publish(b, root, ["k"])
    assert published.current(spark, root).count() == 7 and published.current(spark, root, first).count() == 5 and first != second
    assert published.publish(a.orderBy(F.col("k").desc()), root, ["k"]) == first


def test_models(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "k int, text string")
    scored = apply_model(rows, "text", hash_scorer, "score", "double")
    assert checked(rows, scored, "k").count() == 0 and checked(rows, scored.filter("k > 1"), "k").count() == 2
    assert all(0 <= r.score < 1 for r in scored.collect())


def test_generation_stops_when_all_have_enough(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    products = spark.createDataFrame([("A", "attributes: Brand: x; Color: red"), ("B", "attributes: Brand: y")], "asin string, prompt string")
    passes = lambda rows: rows.filter((F.col("asin") == "A") | (F.col("round") > 1))
    got = generate_until(products, template_generator, 2, 6, passes)
    assert {r.asin: r["count"] for r in got.groupBy("asin").count().collect()} == {"A": 2, "B": 2}


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed(stream, late="100 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_the_last_line_of_a_product_wins(spark, tmp_path):
    """Over several files and splits within a file; broken lines are counted and change nothing."""
    first = [json.dumps({"parent_asin": f"P{i % 50}", "title": f"first {i}"}) for i in range(2000)] + ["{broken", "", json.dumps({"title": "no id"}), "[1]"]
    second = [json.dumps({"asin": "P7", "title": "second"}), json.dumps({"parent_asin": "", "asin": "P8", "title": "also"}), "nonsense"]
    (tmp_path / "a.jsonl").write_text("\n".join(first))
    (tmp_path / "b.jsonl").write_text("\n".join(second))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = jsonl.placed(spark, str(tmp_path))
        assert rows.select("place.block").distinct().count() > 5
        key = F.coalesce(F.nullif("parent_asin", F.lit("")), F.col("asin"))
        got = {r.key: r.title for r in jsonl.last_of_each(rows, key).collect()}
        counts = {r.file.rsplit("/", 1)[-1]: (r.lines, r.broken) for r in jsonl.broken_lines(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {f"P{i % 50}": f"first {i}" for i in range(2000)} | {"P7": "second", "P8": "also"}
    assert got == want and counts == {"a.jsonl": (2003, 2), "b.jsonl": (3, 1)}
