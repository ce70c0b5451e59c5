"""Incremental refresh: only days that are missing are profiled, late ones and holes alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.functions.stats import finalize
from dayledger.operators.checks import missing_days
from dayledger.operators.profile import profile
from dayledger.operators.spec import Dataset
from dayledger.sources import commits
from dayledger.sources.tables import read_extract, read_statistics, write_extract, write_statistics


def stored_days(spark: SparkSession, path: str, partition: str = "day") -> DataFrame:
    """Days that a table of days has, or that were done without leaving a row; none if there is no table.

    They come from its newest commit, or from the names of its folders if it has none, not from its rows.
    """
    now = commits.state(spark, path)
    days = list(now.days) if now.version else commits.written_days(spark, path, "", partition)
    found = spark.createDataFrame([(d,) for d in days], "day string")
    return found.select(F.try_to_date("day").alias("day")).where("day is not null").distinct()


def _open_days(records: DataFrame, day: Column, path: str, partition: str, known: DataFrame | None) -> tuple[list, str | None]:
    """The days that are to be done, in order, and the state of the source. One date per day of the calendar is collected.

    If the source is as it was at the last refresh, nothing of it is read.
    """
    spark, seen = records.sparkSession, None
    if known is None:
        seen = commits.source_state(records) or None
        if seen and seen == commits.state(spark, path).source:
            return [], seen
    wanted = known.select(F.col("day").cast("date").alias("day")) if known is not None else records.select(day.alias("day"))
    wanted = wanted.where("day is not null").distinct()
    return sorted(r.day for r in missing_days(wanted, stored_days(spark, path, partition)).collect()), seen


def refresh(records: DataFrame, data: Dataset, path: str, tag: str | None = None, filter: Column | None = None, known_days: DataFrame | None = None) -> list:
    """Profiles the days of records that the statistics at path lack, in one job, and adds them in one step.

    Returns the days added. Running it again adds nothing, also for days of which the
    filter leaves no row; a day that arrives late fills its hole. Rows without a day are
    left out. The records are scanned for their days, unless known_days (a column day,
    say from a manifest) has them or records read the same files as at the last
    refresh. The days are a plain filter, so a table partitioned by the day column
    is read only where it must be. A reader sees the table as before or with all days; if
    the run fails, as before.
    """
    day = F.col(data.day).cast("date")
    days, seen = _open_days(records, day, path, "day", known_days)
    if days:
        rows = records.where(day.isin(days))
        write_statistics(profile(rows.where(filter) if filter is not None else rows, data, tag), path, [str(d) for d in days], seen)
    return days


def refresh_extract(records: DataFrame, filter: Column, path: str, day: str, known_days: DataFrame | None = None) -> list:
    """Distils the days that the extract at path lacks; returns them. Days, null days and readers as in refresh()."""
    days, seen = _open_days(records, F.col(day).cast("date"), path, day, known_days)
    if days:
        write_extract(records.where(F.col(day).cast("date").isin(days) & filter), path, day, [str(d) for d in days], seen)
    return days


def summarize_extract(records: DataFrame, filter: Column, extract: str, data: Dataset, path: str, tag: str | None = None, aliases: DataFrame | None = None) -> tuple[list, list]:
    """Distils what the extract lacks, then profiles what the statistics lack, from the extract alone.

    Returns the days of either step. Platforms take their canonical names on the way.
    """
    distilled = refresh_extract(records, filter, extract, data.day)
    stored = read_extract(records.sparkSession, extract, records.schema, data.platform, aliases, data.day)
    return distilled, refresh(stored, data, path, tag, known_days=stored_days(records.sparkSession, extract, data.day))


def combined(spark: SparkSession, path: str) -> DataFrame:
    """All stored days, finalized."""
    return finalize(read_statistics(spark, path))


def reschema(spark: SparkSession, source: str, target: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites stored statistics after a change to every day, finalized."""
    write_statistics(finalize(change(read_statistics(spark, source))), target)
