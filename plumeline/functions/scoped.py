"""Naming a value inside an expression, so that what is read often is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body(v) with v a struct of the values, each evaluated once a row. Nested columns are bound as lambda variables,
    so the optimizer does not copy their expressions into every place that reads them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]
