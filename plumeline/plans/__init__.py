"""The registered queries, one module for each part of the pipeline; importing this package registers them."""

from plumeline.plans import attributes, corpus, lineage, loading, noise, retrieval, review_text, robustness, selection, style  # noqa: F401
