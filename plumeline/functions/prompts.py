"""Prompts for a reranking model, and differences of morphological features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chat formats that the two rerankers were trained on, with {query} and {document}.
RERANK_TEMPLATES = {
    "instruct": "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n<|im_start|>user\n<Instruct>: Given a web search query, retrieve relevant passages that answer the query\n<Query>: {query}\n<Document>: {document}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n",
    "judge": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are an expert product-search relevance judge. Determine whether the document is relevant to the query. Answer only Yes or No.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n<Query>: {query}\n<Document>: {document}\nIs this document relevant to the query? Answer Yes or No only.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
}


def rerank_prompt(query: Column, document: Column, template: str, limit: int = 240) -> Column:
    """The prompt of a template; a document counts with its first `limit` characters, white space at its ends aside."""
    before, rest = RERANK_TEMPLATES[template].split("{query}")
    between, after = rest.split("{document}")
    return F.concat(F.lit(before), query, F.lit(between), F.substring(F.trim(document, F.lit(" \t\n\r")), 1, limit), F.lit(after))


def morph_diff(original: Column, corrected: Column, most: int = 3) -> Column:
    """`name:old→new` of the first features that differ, by name, of two `Name=Value|...` lists; an absent feature is _."""
    features = lambda c: F.transform(F.filter(F.split(c, r"\|"), lambda x: x.contains("=")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("f"), F.split_part(x, F.lit("="), F.lit(2)).alias("v")))
    value = lambda rows, f: F.coalesce(F.get(F.filter(rows, lambda x: x["f"] == f), F.lit(0))["v"], F.lit("_"))
    old, new = features(original), features(corrected)
    names = F.array_sort(F.array_distinct(F.transform(F.concat(old, new), lambda x: x["f"])))
    changed = F.filter(names, lambda f: value(old, f) != value(new, f))
    return F.array_join(F.transform(F.slice(changed, 1, most), lambda f: F.concat(f, F.lit(":"), value(old, f), F.lit("→"), value(new, f))), ";")


def first_known(*vectors: Column) -> Column:
    """The first vector that is there, in the order given; none at all is an error."""
    return F.coalesce(*vectors, F.raise_error(F.lit("no query vector of any kind")).cast("array<float>"))
