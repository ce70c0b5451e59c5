"""Distinct counts over the whole history, kept up to date: the first day of every value, and sketches by day.

A refresh reads only the days of a statistics table that it lacks. First days merge by
their minimum, so late days and repeated ones are the same case; sketches merge
by their union, and are for values that are too many to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayledger.functions.stats import SCHEMA
from dayledger.sources import commits

_FIRST = "kind string, value string, first date"


def of_statistics(stats: DataFrame) -> DataFrame:
    """(kind, value, first): platforms with rows, and free texts by their column, null included (for it counts as a value there is)."""
    told = F.when((F.col("column") == "rows") & F.col("platform").isNotNull(), F.struct(F.lit("platform").alias("kind"), F.col("platform").alias("value"))).when(
        F.col("text").isNotNull(), F.struct(F.concat(F.lit("text."), "column").alias("kind"), F.col("text").alias("value"))
    )
    rows = stats.select(told.alias("x"), "start_date").where("x is not null").select("x.kind", "x.value", "start_date")
    return rows.groupBy("kind", "value").agg(F.min("start_date").alias("first"))


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value, first) of everything seen so far."""
    now, root = commits.state(spark, path), path.rstrip("/")
    paths = [f"{root}/{folder}" for folder in now.batches.values()]
    rows = spark.read.schema(_FIRST).option("basePath", root).parquet(*paths).select("kind", "value", "first") if paths else spark.createDataFrame([], _FIRST)
    return rows.groupBy("kind", "value").agg(F.min("first").alias("first"))


def refresh_sightings(spark: SparkSession, statistics: str, path: str) -> list[str]:
    """Adds what the days of the statistics table show first that are new or have been replaced since; returns these days.

    Only these days are read. What is written are values that weren't known, or are seen
    earlier now. A value that a replaced day doesn't show any more stays.
    """
    now, there = commits.state(spark, path), commits.state(spark, statistics)
    days = sorted(d for d, folder in there.days.items() if d not in now.days or now.days[d] != folder)
    if days:
        new = of_statistics(commits.read_days(spark, statistics, SCHEMA, "day", only=days))
        known = read_sightings(spark, path).withColumnRenamed("first", "known")
        fresh = new.join(known, ["kind", "value"], "left").where("known is null or first < known").select("kind", "value", "first")
        now.batches[now.version + 1] = commits.write_folder(fresh, path)
        now.days |= {d: there.days[d] for d in days}
        commits.commit(spark, path, now)
    return days


def compact_sightings(spark: SparkSession, path: str) -> None:
    """One folder with one row a value instead of one for each refresh."""
    now = commits.state(spark, path)
    if len(now.batches) > 1:
        now.batches = {max(now.batches): commits.write_folder(read_sightings(spark, path), path)}
        commits.commit(spark, path, now)


def distinct_values(first: DataFrame) -> DataFrame:
    """(kind, n)."""
    return first.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def cumulative(first: DataFrame, unit: str = "day") -> DataFrame:
    """(kind, period, new, seen): values first seen in each day or month that shows any, and all up to it. Windows see one row per period."""
    new = first.groupBy("kind", F.trunc("first", "month").alias("period") if unit == "month" else F.col("first").alias("period")).agg(F.count(F.lit(1)).alias("new"))
    return new.withColumn("seen", F.sum("new").over(Window.partitionBy("kind").orderBy("period")))


def sketches(records: DataFrame, day: str, values: dict[str, str]) -> DataFrame:
    """(day, kind, sketch): a sketch of the distinct values of columns (kind: column), by day; of fixed size each."""
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in values.items()]))
    rows = records.select(F.col(day).cast("date").alias("day"), told.alias("x")).where("day is not null and x.value is not null")
    return rows.groupBy("day", F.col("x.kind").alias("kind")).agg(F.hll_sketch_agg("x.value", F.lit(14)).alias("sketch"))


def approximate_counts(sketched: DataFrame) -> DataFrame:
    """(kind, n) of merged sketches: within 2 % or so of the distinct values, whatever days are merged."""
    return sketched.groupBy("kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
