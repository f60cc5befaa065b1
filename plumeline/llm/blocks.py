"""All pairs inside groups, block by block: what is emitted is a row for each member and block pair, never a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.common import stage

#: Up to so many large groups (two numbers each) are broadcast; more are joined by sort and merge.
FEW_GROUPS = 200_000


def block_pairs(members: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """`members` with `_i`, `_j`, `_block` (its own, _i or _j) and `_single` (the group is one block).

    A group of more than `size` members is cut into blocks by a hash of the member; each of its rows goes to every pair
    of blocks that its own is in, so a group of m members is m / size rows for each member in (m / size) ** 2 / 2 tasks.
    Only groups above `size` are looked up, so the members of a hot group need not meet by the group's key.
    """
    large = members.groupBy(group).agg(F.count("*").alias("_size")).filter(F.col("_size") > size)
    large = stage(large.select(group, F.ceil(F.col("_size") / size).cast("int").alias("_blocks")), "large-groups")
    large = F.broadcast(large) if large.count() <= FEW_GROUPS else large.hint("merge")
    rows = members.join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(11), member), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("*", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), (F.col("_blocks") == 1).alias("_single")).drop("_other", "_blocks")
