"""Tables written to the folder that driver and executors share, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset is accepted only for a local master (tests), where a temporary folder takes its place."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="plumeline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the tables that `stage` wrote for these frames; nothing that is still to be computed may read them."""
    for frame in frames:
        path = getattr(frame, "_staged_at", None)
        if path:
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
