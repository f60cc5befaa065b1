"""Outside models behind one shape: a function from a batch of texts to a batch of results, loaded once for each task.

The models themselves (parser, generator, corrector, encoder, scorer) are not part of this package; the stand-ins here
are deterministic and let the operators around them run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.Series], pd.Series]


def apply_model(rows: DataFrame, column: str, load: Callable[[], Model], result: str, kind: str) -> DataFrame:
    """`rows` with `result`, the model's answer to `column`. Filter before this: each row costs a model call."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != result)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{result: model(batch[column])})

    return rows.drop(result).mapInPandas(run, f"{schema}, `{result}` {kind}")


def checked(rows: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Keys of `rows` that `answered` lacks or has more than once; an empty result means that no row was lost."""
    n = answered.groupBy(key).agg(F.count("*").alias("answers"))
    return rows.select(key).join(n, key, "left").filter(F.coalesce("answers", F.lit(0)) != 1)


def generate_until(products: DataFrame, load: Callable[[int], Model], least: int, rounds: int, passes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(asin, prompt) -> (asin, round, query) until each product has `least` passing queries or `rounds` are over.

    Every round asks only for products that still lack some; rounds are written down, so a lost executor repeats none.
    """
    made: DataFrame | None = None
    for k in range(rounds):
        lacking = products
        if made is not None:
            enough = made.groupBy("asin").count().filter(F.col("count") >= least).select("asin")
            lacking = products.join(enough, "asin", "left_anti")
            if lacking.isEmpty():
                break
        fresh = apply_model(lacking, "prompt", lambda k=k: load(k), "query", "string").withColumn("round", F.lit(k))
        kept = passes(fresh).select("asin", "round", "query")
        made = (kept if made is None else made.unionByName(kept)).dropDuplicates(["asin", "query"]).checkpoint()
    return made


def template_generator(k: int) -> Model:
    """Stands in for a language model: the attribute values of the prompt in an order that the round decides."""

    def model(prompts: pd.Series) -> pd.Series:
        def one(prompt: str) -> str:
            values = [part.split(": ", 1)[-1] for part in prompt.rsplit("attributes: ", 1)[-1].split("; ")]
            return " ".join(["find", *values[k % len(values) :], *values[: k % len(values)], f"option {k}"])

        return prompts.map(one)

    return model


def hash_scorer() -> Model:
    """Stands in for a reranker: a number in [0, 1) from the text's digest."""
    return lambda texts: texts.map(lambda t: int(hashlib.sha1(t.encode()).hexdigest()[:6], 16) / 16**6)
