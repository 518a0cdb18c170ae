"""Stages that prepare a corpus for training, in order. Each takes the documents that the one before it kept and, but for the
last, returns those that it keeps, with all their columns.

A row is told apart from its repetitions by the file and place it was read from, so ids may repeat or be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.bpe import encode_documents
from gleanframe.llm.common import stage, table
from gleanframe.llm.decontaminate import contamination
from gleanframe.llm.exact_dedup import exact_duplicates
from gleanframe.llm.language import identify
from gleanframe.llm.near_dedup import near_duplicates

KEY, WHOLE = "_row_key", "_whole_row"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds KEY: doc_id, and then what tells rows with one doc_id apart."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(KEY, F.struct("doc_id", place.alias("place")))
    except AnalysisException:  # not read from files
        return stage(docs, "documents").withColumn(KEY, F.struct("doc_id", place.alias("place")))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with KEY without the rows of keys."""
    return docs.join(keys.select(F.col(KEY).alias("_gone")), F.col(KEY) == F.col("_gone"), "left_anti").drop(KEY)


def known_languages(spark, docs, sf_dir):
    """Documents without a language, those without a letter, go. Where no row has a label to learn from, no language is known, and
    that rejects nobody: documents with a letter stay."""
    whole = docs.select(F.struct("*").alias(WHOLE), "doc_id", "text", "lang")
    known = (F.col("lang_pred") != "und") | F.coalesce(F.col(WHOLE)["text"].rlike(r"\p{L}"), F.lit(False))
    return identify(whole, carry=WHOLE).filter(known).select(f"{WHOLE}.*")


def exact_once(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    docs = keyed(docs)
    return without(docs, exact_duplicates(docs, KEY).filter("NOT kept"))


def near_once(spark, docs, sf_dir):
    """Of a class of near-duplicates one row stays."""
    docs = keyed(docs)
    return without(docs, near_duplicates(docs, KEY).filter("NOT kept"))


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    docs = keyed(docs)
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark"), KEY).filter("contaminated"))


def encoded(spark, docs, sf_dir):
    """The ids of every document's tokens, with the digests of ids and decoded bytes."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", exact_once),
    ("MinHash near-dedup", near_once),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: Regression, signatures and BPE are beyond SQL; tests compare the stages with plain versions or planted cases.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, stage(docs, "documents") if k else docs, sf_dir)
    return docs
