import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_rows import COLUMNS, rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None, "s", "n", 1, 2, 3, 0.5, "l", 7) for i, t in rows()], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"))
