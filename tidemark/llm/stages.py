"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs, the last one -> packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import UNKNOWN, identify_language
from tidemark.llm.near_documents import near_documents
from tidemark.llm.passages import drop_passages, repeated_passages
from tidemark.llm.queries import language_model, packed

#: A document stays if at least this share of its words is in spans of its language.
LEAST_SHARE = 0.3


def keep_named_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; rows of one id go or stay together. A null id can't be judged and stays; a null
    or empty text has no language and goes. Texts are judged whole; extra columns stay; an empty table stays empty."""
    named = identify_language(docs, language_model(docs))
    rejected = named.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SHARE)).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class. Rows that repeat its id stay, and so do null ids and
    texts without a word; extra columns stay; an empty table stays empty."""
    dropped = near_documents(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has; those that have lost all words go. Null ids and
    texts stay as they are; extra columns stay; an empty table stays empty."""
    return drop_passages(docs, repeated_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents, null ids and texts included; an empty table gives none."""
    return packed(docs)
