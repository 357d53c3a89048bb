"""The corpus pipeline: quality classifier, near-duplicates, repeated strings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import save, table
from tallyforge.llm.decontamination import drop_leaks
from tallyforge.llm.jaccard_join import keep_one_of_each
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.quality_classifier import keep_quality, train
from tallyforge.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts are empty and scored like them; rows with equal texts go or stay together; without labels nothing is
    learned and the score is 0.5, which keeps all; an empty table stays empty; all columns stay.
    """
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest id stays.

    Texts without words link with nothing and stay; of equal rows one stays; a null id gives way to any id; an empty table
    stays empty; all columns stay.
    """
    return keep_one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte inside a 200-byte string that also starts elsewhere goes; documents stay, if need be empty.

    Null texts become empty ones; a cut inside a character takes what is left of it too, so that texts stay UTF-8; rows
    with equal texts lose the same; n_chars is that of what is left; an empty table stays empty; all columns stay.
    """
    kept = remove_repeats(docs, as_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark passage go.

    Null and empty texts and items match nothing; rows with equal texts go or stay together; without items, or rows, all
    stay as they are; all columns stay.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    A null text is empty, and an empty text is its closing id alone; rows with equal ids are packed each for itself; an
    empty table gives no pieces. Only the pieces' columns are returned.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer and no trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
