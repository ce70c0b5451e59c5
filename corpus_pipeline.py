"""The corpus pipeline: five stages over documents, each written and read again before the next.

Quality classifier, line dedup, near-duplicate removal, benchmark decontamination, and
the source mix of what is left. All but the last return the columns of documents; a
stage's decisions rest on all rows that its predecessor kept.

In all stages a null text counts as an empty one, texts are read whole, rows that share an
id or repeat each other are told apart by their text or fare alike, a null id is an id of
its own, columns that the stage doesn't know pass through, and an empty table gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayledger.llm import decontaminate, lines, mixing, neardup, quality
from dayledger.llm.common import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go; texts without words, null ones too, all stay or all go by their common score."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one of the smallest id; n_chars follows the text. Null and empty texts stay as they are."""
    return lines.dedup_lines(docs, refresh_n_chars=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five-word shingles, similarity 0.8 or more. Texts without words all stay."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, with all rows of their id; texts without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document that is left: none of a text without words."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
