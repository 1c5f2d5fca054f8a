"""A corpus pipeline of five stages, each one operator of graphloom.llm over all rows that its predecessor kept.

Four stages return the columns of `documents`; the last one returns the encoded corpus. A stage's result is
written in the shared checkpoint folder and read again, so that lost executors never cost more than a stage; it goes
when the next one has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import cut, table
from graphloom.llm.op1_jaccard import keep_one
from graphloom.llm.op6_pieces import encode_corpus
from graphloom.llm.op8_langid import keep_identified
from graphloom.llm.op9_leaks import drop_leaking
from graphloom.llm.op10_secrets import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; the others go, and so do null, empty and letterless texts.
    Repeated rows are judged alike; an empty table stays empty; all columns stay, whatever their names."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles with Jaccard 0.8 or more join: that of the least
    doc_id, nulls last. Repeated rows are copies; rows without words stay; an empty table stays empty."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an empty benchmark, or items without
    words, drop nothing; repeated rows and equal ids are judged by their texts."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by its kind; null texts stay null, repeated rows stay."""
    return redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document; null and empty texts have no ids."""
    return encode_corpus(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: A trained network, a similarity join and a tokenizer are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), *held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
