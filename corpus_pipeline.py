"""Corpus pipeline: four stages from raw documents to packed training sequences.

Every stage works on all documents its predecessor kept. Models are trained on
the labelled rows of the tables in ``sf_dir``, as in the operators' queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import ngram_join, packing, quality, toxicity
from shopmetrics.llm.common import table, written
from shopmetrics.llm.folds import held_out
from shopmetrics.llm.queries import WORD_MODEL


ROW = "_near_duplicate_row"  # id and digest of the text


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model; all columns."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; all columns."""
    model = toxicity.train(table(spark, sf_dir, "documents"),
                           table(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return toxicity.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; all columns.

    Rows are told apart by id and text, so different texts under one id are
    different documents; rows that repeat both are one. Rows without id are not
    compared and stay.
    """
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    rows = docs.filter("doc_id IS NOT NULL").withColumn(ROW, F.struct("doc_id", digest.alias("text")))
    kept = ngram_join.ngram_jaccard_join(rows, ROW).filter("kept").select(ROW).distinct()
    stay = rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs, WORD_MODEL)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter),
          ("n-gram jaccard join", near_duplicates), ("best-fit packing", best_fit_packing)]

#: SQL can express neither the models nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
