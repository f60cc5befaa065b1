"""Error records are classified once for a profile and its summary."""


def test_records_are_read_once(spark):
    from pyspark.sql import functions as F

    from plumeline.operators.profiles import context_profile, cosine_summary

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([("a", "c", "e"), ("a", "d", "e"), ("b", "c", "f"), ("b", "c", "e")], "user_id string, ctx string, x string")
    assert cosine_summary(context_profile(rows.select("user_id", "ctx", seen("x").alias("err")))).count() == 1
    assert read.value == 4
