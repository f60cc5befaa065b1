"""Fingerprints of tables, incremental merges and the released form of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(*columns: Column) -> Column:
    """SHA-256 over values with their lengths in front, so that no two rows read alike."""
    parts = [F.concat(F.octet_length(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def table_signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, signature): a fingerprint that does not depend on the order of rows.

    Digests are summed by parts, 60 bits each, in a partial aggregation: no row order, no gathered list.
    """
    digest = row_digest(*map(F.col, columns))
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    out = rows.agg(F.count("*").alias("n"), *sums)
    return out.select("n", F.left(F.sha1(F.encode(F.concat_ws("|", "n", *[F.col(f"s{i}").cast("string") for i in range(4)]), "UTF-8")), F.lit(16)).alias("signature"))


def incremental_merge(existing: DataFrame, fresh: DataFrame, keys: list[str], retired: tuple[str, ...] = (), by: str = "retriever") -> DataFrame:
    """`existing` without retired retrievers, and those rows of `fresh` whose keys it lacks."""
    kept = existing.filter(~F.col(by).isin(*retired)) if retired else existing
    return kept.unionByName(fresh.join(kept.select(*keys), keys, "left_anti"))


def changed_pairs(rows: DataFrame, clean: str, noisy: str) -> DataFrame:
    """Rows whose noisy text is there and differs from the clean one."""
    return rows.filter((F.trim(F.col(noisy)) != "") & (F.trim(F.col(noisy)) != F.trim(F.col(clean))))


def released(rows: DataFrame) -> DataFrame:
    """(asin, users): users' clean and noisy queries as JSON, in order; an absent noisy query is the empty string."""
    entry = F.struct("uid", "clean", F.coalesce("noisy", F.lit("")).alias("noisy"))
    return rows.groupBy("asin").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("users"))
