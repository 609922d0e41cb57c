"""The corpus pipeline: quality rules, near duplicates, secrets, mixing and packing, one stage after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import discard, materialise, read_table
from pagewright.llm.mixing import mixing_stage
from pagewright.llm.ngram_join import near_duplicates_stage
from pagewright.llm.packing import packing_stage
from pagewright.llm.quality_rules import quality_stage
from pagewright.llm.secret_scan import secrets_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("secret_scans", secrets_stage),
    ("mixing_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Near duplicates, random choices and sub-word ids have no form in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    Defined results: a document whose text is null or empty fails the base rules and goes; rows with a null or repeated
    doc_id are documents like any other until one of each group of near duplicates stays; texts of any length pass whole;
    columns of any name pass to the last stage; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces are written by then
    return packed
