"""A corpus through five of the operators: each stage works on all that the one before it kept.

Rows without text or doc_id: a null text is judged as an empty one and stays null; a null doc_id is a document like others, but is not learnt
from. Every stage takes an empty table and gives one. Extra columns, whatever their names, go through all stages but the last
unchanged, apart from `text` and `n_chars`, which stages that change the text keep in step. Ties go to the smallest doc_id, then to
the text's hash, so that repeated rows count as copies of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumeline.llm.best_fit import pack_documents
from plumeline.llm.common import stage, table, unstage
from plumeline.llm.lsh_forest import one_of_each
from plumeline.llm.positive_unlabelled import keep_good
from plumeline.llm.secret_scan import redact
from plumeline.llm.sparse_suffixes import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score under 0.3.

    Nothing is learnt from rows without a label, and without any label all documents stay. Repeated rows score alike. The folds of
    the query hold here too.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"), cut=0.3)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Documents without words, null or empty, are no one's duplicate and stay, each of them. A null doc_id comes after all others.
    """
    return one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier place holds are cut from the texts.

    A document stays even if nothing of its text does. Which of several equal places is the earliest follows doc_id, then the text.
    """
    return without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; overlapping ones by one. A null text stays null; all documents stay."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of at most 2048, a row for each piece; null and empty texts are one token, the separator.

    Pieces of equal length are interchangeable: which goes where is settled by doc_id.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt scores and token ids have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result; a staged table is deleted as soon as the next one is written, but for the last, which the result reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
