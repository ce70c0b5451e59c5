"""Filtered extracts of a record table and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_category(code: str, category: str = "category", additions: str | None = None) -> Column:
    """Rows of a category, or with it among their additions (an array; whole items, not parts of them)."""
    own = F.col(category) == code
    return own | F.coalesce(F.array_contains(additions, code), F.lit(False)) if additions else own


def by_category_text(code: str, category: str = "category", additions: str = "category_addition") -> Column:
    """As by_category on raw list text: a part of the text will do, so a code also finds those it begins."""
    return (F.col(category) == code) | F.coalesce(F.contains(F.col(additions), F.lit(code)), F.lit(False))


def by_platforms(names: list[str], platform: str = "platform") -> Column:
    """Rows of some platforms; apply it to canonical names."""
    return F.col(platform).isin(names)


def by_expression(text: str) -> Column:
    """Any SQL expression over the columns."""
    return F.expr(text)


def with_item(column: str, item: str) -> Column:
    """Rows whose array holds an item."""
    return F.array_contains(column, item)


def counters(df: DataFrame, day: str, keyword: str) -> DataFrame:
    """Rows, and rows with keywords, by day."""
    return df.groupBy(F.col(day).cast("date").alias("release")).agg(F.count(F.lit(1)).alias("extract_rows"), F.count(keyword).alias("extract_rows_with_keywords"))


def extract_metadata(df: DataFrame, day: str, keyword: str) -> DataFrame:
    """Counters by day and the number of files that a stored extract has for it."""
    named = df.withColumn("__file", F.col("_metadata.file_path"))
    return named.groupBy(F.col(day).cast("date").alias("release")).agg(F.count_distinct("__file").alias("batch_count"), F.count(F.lit(1)).alias("extract_rows"), F.count(keyword).alias("extract_rows_with_keywords"))
