"""A training-data pipeline over `documents`: every stage is one operator applied to all documents
that the stage before it kept.

Stages 1 to 4 return the columns of documents; the last returns the packs.  A stage's result is
written as Parquet and read again as the next stage's input, which also cuts its lineage.

All stages read whole texts, however long, and give an empty result for an empty table.  Extra columns
go through stages 1 to 4 whatever their names, and are ignored by the last.  Null, empty and wordless
texts go with the first stage.  Rows that repeat are treated alike by stages 1 and 2; the third keeps one
of them.  A null doc_id is a document like any other and comes last where ids break ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm._spark import cut, remove, shared_dir
from loamgraph.llm.curve_packing import pack
from loamgraph.llm.language_id import keep_known_languages
from loamgraph.llm.quality_rules import keep_quality
from loamgraph.llm.simhash_dedup import drop_near_duplicates
from loamgraph.llm.substring_dedup import remove_passages


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; `labels` names the trusted ones.

    Null, empty and wordless texts are rejected, a score equal to the threshold is kept, repeated rows stay or
    go together.  Without a trusted document every document with a word is kept.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Texts without a letter trigram are rejected; a cosine equal to the bound is kept; nulls in lang or doc_id
    teach nothing, and without any language all texts with a trigram are kept.
    """
    return keep_known_languages(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest (doc_id, text key) stays, null ids last; of rows that repeat it one stays; texts without words
    are in no group and stay.
    """
    return drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stay elsewhere.

    The occurrence with the smallest (text key, place) stays; texts without words and texts shorter than a
    passage stay as they are; a document of which no word is left goes; rows that repeat are cut alike.
    """
    return remove_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs of neighbouring documents along the curve.

    Texts without words are in no pack; rows that repeat are packed as often as they occur; ties of key, doc_id
    and text are between equal rows.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("curve_packing", packing_stage),
]

#: SQL can express none of the stages' hashes and loops; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of the documents that pass all stages.

    A stage's table is removed when the next stage is written, the last one when the packs are checkpointed,
    and all of them after a failure.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
            docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
            if before:
                remove(spark, before)
            before = f"{base}/{name}"
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, base)
