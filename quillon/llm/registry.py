"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contamination
from .alignment import alignment_digest
from .contamination import find_contamination
from .erasure import erase_clients, erasure_folder
from .jaccard import jaccard_components
from .language import predict_language
from .lines import dropped_lines
from .lm import score_texts
from .mixing import mix_digest
from .neighbours import nearest_neighbours
from .packing import pack
from .runtime import scratch
from .secrets import scan_secrets
from .token_counts import count_tokens
from .warc import read_archives, write_archives


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of every document."""
    return dropped_lines(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return score_texts(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return predict_language(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).where("ok").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word-ending BPE vocabulary."""
    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final files after the victims' clients, clicks, sales and lines were erased."""
    return erase_clients(*(_table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")), erasure_folder(spark))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of every document."""
    return mix_digest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies over every document, weighed by the corpus's counts of linked ids."""
    return alignment_digest(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_neighbours, op3_contamination, op4_lines, op5_jaccard, op6_packing, op7_lm, op8_language, op9_warc, op10_token_counts, op11_erasure, op12_mixing, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_contamination": contamination.SQL}
