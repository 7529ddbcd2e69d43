"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, sequence packing.

Each stage takes the documents that its predecessor kept. All but the last return the columns of ``documents``; the
last returns a row for each packed piece, with its token ids. ``run`` writes each stage's output to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table, written
from palimpsest.llm.jaccard import keep_one
from palimpsest.llm.lines import keep_lines
from palimpsest.llm.mixing import mixed
from palimpsest.llm.packing import pack_ids
from palimpsest.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules. Null or empty text does not; repeated rows are judged alike; ties of
    references do not matter; very long texts are whole. An empty table stays empty, extra columns go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that spread over sites; every line that is not blank counts. A line stays in the
    document of the smallest id (null ids together are one document). Null text stays as it is; documents of which nothing
    but white space is left go. An empty table stays empty, extra columns go."""
    return keep_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Rows go by id and text together; repeated rows
    leave one, null ids are judged by their text, null and empty texts stay. An empty table stays empty, extra columns go."""
    return keep_one(docs)


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as drawn, shuffled. Null source is a source of its own; repeated rows share their draw; text is
    not read. An empty table stays empty, extra columns go."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its sequence and token ids. Null text is empty and one piece of one token; long texts are cut; repeated
    rows are packed each. An empty table gives no rows."""
    return pack_ids(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", poisson_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the tokenizer and the packing rule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
