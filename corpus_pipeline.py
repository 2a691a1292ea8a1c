"""The corpus pipeline: documents through quality rules, exact dedup, near dedup, mixing and encoding, in this order.

Each stage gets what the one before it kept, as a table, and works on all of it. All stages but the last return the columns
of documents: the first three drop rows, mixing puts the rows in the order of the mix (over the part files and within
them), the last returns each document's token ids.

Defined results: a null or empty text has no words, so the quality rules reject it; of equal texts, and of a component of near
duplicates, the smallest doc_id stays (a null one only where there is no other), and of rows repeated exactly one; in the mix, rows of one
id and text are ordered by a hash of their columns; very long texts are taken whole by every stage; an empty table gives an empty result;
extra columns, whatever their names, stay as they are through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from corpuslens.llm.common import keep_rows, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    judged = exact_dedup.exact_dedup(docs.select("doc_id", "text"), exact_dedup.older_half(docs))
    return keep_rows(docs, judged.select("doc_id", "text_key", "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id."""
    return keep_rows(docs, simhash.representatives(docs.select("doc_id", "text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and its place in the mix: the file that holds it and its row there.

    The files' names are in the order of the mix, so a training job reads by (mix_file, mix_row), however Spark splits the files.
    """
    place = (F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row")) if docs.inputFiles() else ()
    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), place)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: The near-duplicate, mixing and encoding stages are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
