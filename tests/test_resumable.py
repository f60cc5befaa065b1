"""Resumed stages: what is computed again after a stop, a change, a loss and a new version."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from plumeline.sources.resumable import PART, manifest, resumed


class Counted:
    """Doubles x and remembers which parts it was given; fails at a batch that it is told."""

    def __init__(self, fail_at=None):
        self.parts, self.batches, self.fail_at = [], 0, fail_at

    def __call__(self, rows):
        self.batches += 1
        if self.batches == self.fail_at:
            raise RuntimeError("stopped")
        self.parts += sorted(r[0] for r in rows.select(PART).distinct().collect())
        return rows.withColumn("y", F.col("x") * 2)


@pytest.fixture
def rows(spark):
    return spark.range(500).select("id", (F.col("id") % 7).alias("x"))


def run(rows, build, root, name="v1", **more):
    return sorted(map(tuple, resumed(rows, ["id"], build, root, name, parts=10, batch=3, **more).collect()))


def test_only_what_is_missing_or_changed_is_computed(spark, rows, tmp_path):
    root, want = f"file://{tmp_path}/stage", sorted((i, i % 7, i % 7 * 2) for i in range(500))
    stopped = Counted(fail_at=3)
    with pytest.raises(RuntimeError, match="stopped"):
        run(rows, stopped, root)
    assert len(stopped.parts) == 6 == len(manifest(spark, root))
    again = Counted()
    assert run(rows, again, root) == want and len(again.parts) == 4 and not set(again.parts) & set(stopped.parts)
    nothing = Counted()
    assert run(rows, nothing, root) == want and nothing.parts == []
    changed, touched = rows.withColumn("x", F.when(F.col("id") == 123, 100).otherwise(F.col("x"))), Counted()
    assert (123, 100, 200) in run(changed, touched, root) and len(touched.parts) == 1
    fresh = Counted()
    assert run(changed, fresh, root, name="v2") and len(fresh.parts) == 10
    folders = [f for f in os.listdir(f"{tmp_path}/stage") if f.startswith("data-")]
    assert len(folders) == 4  # the batches of v2 alone: older ones are purged


def test_a_lost_folder_is_computed_again(spark, rows, tmp_path):
    root = f"file://{tmp_path}/stage"
    want = run(rows, Counted(), root)
    shutil.rmtree(manifest(spark, root)[4][1].removeprefix("file://"))
    again = Counted()
    assert run(rows, again, root) == want and again.parts == [4]


def test_wrong_lengths_are_not_recorded(spark, rows, tmp_path):
    root = f"file://{tmp_path}/stage"
    with pytest.raises(ValueError, match="another number of rows"):
        run(rows, lambda r: r.filter("x > 0").withColumn("y", F.lit(1)), root)
    assert manifest(spark, root) == {}
    assert len(run(rows, lambda r: r.filter("x > 0").withColumn("y", F.lit(1)), root, same_length=False)) == 428
    assert resumed(rows.limit(0), ["id"], Counted(), f"{root}-none", "v").count() == 0
