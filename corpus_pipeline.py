"""The training-data pipeline: each stage is one operator, written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``docs``; the last one adds ``copy``. Extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan_spark.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from leakscan_spark.llm.common import saved, table, unused


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the calibrated classifier."""
    return quality_rules.passing(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller document owns."""
    # Columns named as the operator's own go by another name meanwhile.
    own = ("kept_text", "n_lines", "n_dropped")
    aside = {c: unused(f"{c.lower()}_given", docs) for c in docs.columns if c.lower() in own}
    rows = docs.withColumnsRenamed(aside)
    kept = line_dedup.deduped(rows, line_dedup.ingested(rows))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.representatives(docs, n=5, percent=80)


def remove_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them, numbered in ``copy``."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", remove_benchmark_copies),
    ("mixing", mix_sources),
]

# The classifier, near dedup and alignment have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
