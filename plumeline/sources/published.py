"""Publishing tables so that readers see a whole result or the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.lineage import table_signature


def publish(rows: DataFrame, root: str, columns: list[str], expected: int | None = None, partition_by: str | None = None) -> str:
    """Write `rows` under a new folder of `root` and only then add it, with its signature, to the list of snapshots.

    A wrong row count leaves the list as it was, so the last published snapshot stays current.
    """
    spark, path = rows.sparkSession, f"{root}/data-{uuid.uuid4().hex}"
    writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
    writer.parquet(path)
    mark = table_signature(spark.read.parquet(path), columns).first()
    if expected is not None and mark.n != expected:
        raise ValueError(f"{mark.n} rows to publish, {expected} expected")
    made = spark.createDataFrame([(path, mark.n, mark.signature)], "path string, n long, signature string")
    made.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/snapshots")
    return mark.signature


def current(spark: SparkSession, root: str, signature: str | None = None) -> DataFrame:
    """The latest snapshot, or the latest with a signature; reuse a stage's result only where its signature matches."""
    found = spark.read.parquet(f"{root}/snapshots")
    if signature is not None:
        found = found.filter(F.col("signature") == signature)
    last = found.orderBy(F.col("at").desc()).first()
    if last is None:
        raise LookupError(f"no snapshot {signature or ''} in {root}")
    return spark.read.parquet(last.path)
