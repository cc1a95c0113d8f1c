"""The corpus pipeline: STAGES applied to documents, each one's Parquet being
the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import lines, nearcopies, packing, pii, quality
from paperloom.llm.common import free_name, table, written

#: Stands for a null id where ids are joined.
NO_ID = -(1 << 63)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go from the text; rejected documents go."""
    verdict = free_name(docs, "kept")
    return quality.quality_rules(docs, verdict).where(F.col(verdict)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one that keeps them."""
    kept = free_name(docs, "kept_text")
    out = lines.line_dedup(docs, names=(free_name(docs, "n_lines"), free_name(docs, "n_dropped"), kept))
    text = F.when(F.col("text").isNotNull(), F.col(kept))
    return out.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays. They are linked by SimHash
    (op2's fingerprints, three bits) and, where more bits differ, by exact comparison
    (five-word likeness of 0.8 or more). The one that stays is of the least id, then the least hash
    of the text; one without an id only where none has an id. Rows of one id and
    different texts are different documents; repeated rows are one."""
    stays = nearcopies.near_copies(docs, fingerprinted=True).where("stays").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text_hash")
    stays = written(stays.distinct(), "stays")
    # joined and told apart by one key, so that texts are dealt once
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(stays, ["key", "text_hash"], "left_semi").groupBy("key", "text_hash").agg(F.first("row").alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, and the sequences that they fill."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The stages are no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
