"""Stages that go on where they were stopped: a part is computed only where its input has changed or its result is missing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _fingerprints(rows: DataFrame) -> DataFrame:
    """(_part, n, fingerprint): a sum over 64-bit hashes of whole rows, so that order does not matter and repeated rows do."""
    content = sorted(c for c in rows.columns if c != PART)
    return rows.groupBy(PART).agg(F.count("*").alias("n"), F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(*content).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *content).cast("decimal(38,0)"))).alias("fingerprint"))


def manifest(spark: SparkSession, root: str) -> dict[int, tuple[str, str, int]]:
    """For each part what was recorded last: (fingerprint, folder, rows)."""
    fs, where = _files(spark, f"{root}/manifest")
    if not fs.exists(where):
        return {}
    rows = spark.read.parquet(f"{root}/manifest").orderBy("at").collect()  # as many as there are parts and runs
    return {r.part: (r.fingerprint, r.folder, r.n) for r in rows}


def resumed(rows: DataFrame, key: list[str], build: Callable[[DataFrame], DataFrame], root: str, name: str, parts: int = 64, batch: int = 8, same_length: bool = True) -> DataFrame:
    """build(rows), part by part, from `root` where it is there already.

    Rows are dealt to `parts` by their key. A part counts as done if the manifest holds the fingerprint of its rows, of `name` (which
    stands for the code and its parameters) and of the number of parts, and its folder holds as many rows as recorded. The others
    are computed `batch` at a time and recorded after each, so a run that is stopped loses one batch. `build` keeps
    the column `_part`, and with `same_length` gives as many rows as it gets; otherwise the job fails and nothing is recorded.
    Folders that the manifest no longer names are deleted at the end.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    wanted = {r[PART]: (f"{name}:{parts}:{r.fingerprint}", r.n) for r in _fingerprints(dealt).collect()}  # a row for each part
    known = manifest(spark, root)
    done = {p: known[p] for p, (mark, _) in wanted.items() if p in known and known[p][0] == mark and _complete(spark, known[p])}
    missing = sorted(set(wanted) - set(done))
    for at in range(0, len(missing), batch):
        some = missing[at : at + batch]
        folder = f"{root}/data-{uuid.uuid4().hex}"
        build(dealt.filter(F.col(PART).isin(some))).write.partitionBy(PART).parquet(folder)
        made = {r[PART]: r.n for r in spark.read.parquet(folder).groupBy(PART).agg(F.count("*").alias("n")).collect()}
        if set(made) - set(some):
            raise ValueError(f"parts {sorted(set(made) - set(some))} are not of this batch")
        wrong = [p for p in some if same_length and made.get(p, 0) != wanted[p][1]]
        if wrong:
            raise ValueError(f"parts {wrong} have another number of rows than their input")
        records = [(p, wanted[p][0], f"{folder}/{PART}={p}", made.get(p, 0)) for p in some]
        spark.createDataFrame(records, "part int, fingerprint string, folder string, n long").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")
        done |= {p: (mark, where, n) for p, mark, where, n in records}
    _purge(spark, root, {where for _, where, n in done.values() if n})
    found = [spark.read.option("basePath", where.rsplit("/", 1)[0]).parquet(where) for _, where, n in done.values() if n]
    if not found:
        return build(dealt.limit(0)).drop(PART)
    return reduce(DataFrame.unionByName, found).drop(PART)


def _complete(spark: SparkSession, record: tuple[str, str, int]) -> bool:
    _, folder, n = record
    if not n:
        return True
    fs, where = _files(spark, folder)
    return fs.exists(where) and spark.read.parquet(folder).count() == n


def _purge(spark: SparkSession, root: str, used: set[str]) -> None:
    fs, where = _files(spark, root)
    if not fs.exists(where):
        return
    kept = {u.rsplit("/", 1)[0].rsplit("/", 1)[1] for u in used}
    for status in fs.listStatus(where):
        folder = status.getPath()
        if folder.getName().startswith("data-"):
            if folder.getName() not in kept:
                fs.delete(folder, True)
                continue
            for part in fs.listStatus(folder):
                name = part.getPath().getName()
                if name.startswith(f"{PART}=") and not any(u.endswith(f"{folder.getName()}/{name}") for u in used):
                    fs.delete(part.getPath(), True)
