"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplens.llm import line_dedup, near_copies, packing, quality, substring_dedup
from steplens.llm.common import ship, table
from steplens.sources.scratch import mark, materialise, release, settle

#: No SQL expresses the ranker, the fingerprints or the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, which come first in ``changed`` whatever others are called, with n_chars brought up to date
    where the text has changed."""
    names = [f"_{i}" for i in range(len(changed.columns))]
    columns = {c: F.col(n) for c, n in zip(docs.columns, names, strict=False)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
    return changed.toDF(*names).select(*[v.alias(c) for c, v in columns.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; learned from the labels of the documents given.

    Null and empty texts are scored as empty; equal texts have equal scores, and a score at the threshold is accepted;
    repeated rows are judged alike; where no labels of both kinds can be used every document stays; an empty table gives an empty one."""
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(ranker) >= quality.CUT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier one has.

    Null texts stay null, empty ones empty; of equal runs that with the smallest doc_id stays; rows equal in doc_id and text count
    once and all stay; an empty table gives an empty one."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more over five-word shingles join.

    Null texts count as empty, and of all documents without words one stays; of a group the smallest doc_id stays, with
    every row that has it and a text of the group; an empty table gives an empty one."""
    return near_copies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that stand in more than one place.

    Null texts stay null, short ones as they are; a repeated row repeats all its windows, so both lose them; an empty table
    gives an empty one."""
    return _as_documents(substring_dedup.remove_repeats(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences.

    Null and empty texts are one piece of one id; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before it wrote. What a stage has written on its way is deleted
    as soon as its own table stands."""
    ship(spark)
    docs, begun = table(spark, sf_dir, "documents"), mark(spark)
    for i, (name, stage) in enumerate(STAGES):
        if i:
            docs, done = materialise(docs, name), mark(spark) - 1
            release(spark, begun, done)
            settle(spark)
            begun = done
        docs = stage(spark, docs, sf_dir)
    return docs
