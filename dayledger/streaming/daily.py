"""The refresh as a stream, and daily counts as tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dayledger.functions.stats import COLUMNS, KEYS, SCHEMA, merge
from dayledger.operators.profile import profile
from dayledger.operators.spec import Dataset
from dayledger.sources import commits
from dayledger.sources.tables import by_day


def stream_statistics(records: DataFrame, data: Dataset, path: str, checkpoint: str) -> StreamingQuery:
    """Profiles new record files once and commits each micro-batch's statistics to the table at path.

    A batch that is run again replaces its rows, or is passed over if a compaction has
    taken it in, so results are exactly once. Counts of one day from several batches add
    up when they are read with streamed().
    """

    def write(batch: DataFrame, number: int) -> None:
        now = commits.state(batch.sparkSession, path)
        if number > now.through:
            now.batches[number] = commits.write_days(by_day(profile(batch, data)), path, "day")
            commits.commit(batch.sparkSession, path, now)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all batches, merged; means are weighted by count."""
    return merge(commits.read_days(spark, path, SCHEMA, "day", batches=True), KEYS)


def compact(spark: SparkSession, path: str) -> list[str]:
    """Merges the batches so far into the days that they touch, in one step; returns these days.

    Merging is associative, so reading the table gives the same before and after. Other days aren't
    read. Means stay those of the merge, floored once more at each compaction.
    """
    now = commits.state(spark, path)
    if not now.batches:
        return []
    days = sorted({d for folder in now.batches.values() for d in commits.written_days(spark, path, folder, "day")})
    touched = commits.read_days(spark, path, SCHEMA, "day", batches=True).where(F.col("start_date").isin([F.lit(d).cast("date") for d in days]))
    folder = commits.write_days(by_day(merge(touched, KEYS).select(*COLUMNS)), path, "day")
    now.days |= {d: folder for d in commits.written_days(spark, path, folder, "day")}
    now.through, now.batches = max(now.through, *now.batches), {}
    commits.commit(spark, path, now)
    return days


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_windows(events: DataFrame, time: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Counts by day and kind over event time; a plain timestamp is taken as UTC.

    In append mode a day shows when the watermark has passed it.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    out = timed.withWatermark("__t", late).groupBy(F.window("__t", "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").cast("date").alias("day"), kind, "count")
