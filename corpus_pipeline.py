"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.contamination import find_contamination
from quillon.llm.jaccard import jaccard_components
from quillon.llm.language import with_language
from quillon.llm.lines import dedup_lines
from quillon.llm.packing import pack
from quillon.llm.runtime import bounded, free_name, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if it has no letter, or if no language gets this much of its letters' probability.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the recurrent network recognises; the rest go."""
    told = free_name("told", docs)
    known = (F.col(f"{told}.lang_pred") != "und") & (F.col(f"{told}.score") >= LEAST_SCORE)
    return with_language(docs, told).where(known).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines cut; a document of which nothing is left goes."""
    cut = dedup_lines(docs.select(COLUMNS))
    cut = cut.where((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Documents without words or id stay."""
    groups = jaccard_components(docs, size=5, percent=80)
    gone = stored(groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct(), "near-copies")
    return docs.join(bounded(gone), "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(bounded(stored(found.select("doc_id").distinct(), "contaminated")), "doc_id", "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express a recurrent network; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
