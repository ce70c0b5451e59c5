"""The statistics table: its schema, row predicates and mergeable aggregates."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["start_date", "end_date", "tag", "platform", "category", "column", "entity", "variant", "text"]
VALUES = ["count", "min", "mean", "max"]
COLUMNS = KEYS + VALUES
SCHEMA = T.StructType(
    [T.StructField(k, T.DateType() if k.endswith("_date") else T.StringType()) for k in KEYS] + [T.StructField(v, T.LongType()) for v in VALUES]
)


class _Any:
    def __repr__(self) -> str:
        return "ANY"


class _Present(_Any):
    def __repr__(self) -> str:
        return "PRESENT"


#: A key that isn't tested, and one that must not be null.
ANY, PRESENT = _Any(), _Present()


def test(name: str, wanted) -> Column | None:
    """The test of one key: ANY, PRESENT, None (is null), a value, or several values."""
    c = F.col(name)
    if wanted is ANY:
        return None
    if wanted is PRESENT:
        return c.isNotNull()
    if wanted is None:
        return c.isNull()
    if isinstance(wanted, Iterable) and not isinstance(wanted, str):
        values = list(wanted)
        found = c.isin([v for v in values if v is not None])
        return found | c.isNull() if None in values else found
    return c == F.lit(wanted)


def predicate(column=ANY, entity=ANY, variant=ANY, tag=ANY, platform=ANY, category=ANY, start_date=ANY) -> Column:
    """Rows of the statistics table by their keys."""
    tests = [test(k, v) for k, v in locals().items()]
    out = F.lit(True)
    for t in tests:
        if t is not None:
            out = out & t
    return out


def within(start: date | Column, end: date | Column) -> Column:
    return (F.col("start_date") >= F.lit(start)) & (F.col("end_date") <= F.lit(end))


def sums(stats: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """The sums from which total() makes statistics merged to keys, and further aggregates; groups of sums add up."""
    weighted = F.expr("cast(mean as decimal(20,0)) * cast(count as decimal(18,0))")
    return stats.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum(weighted).alias("__sum"), F.sum(F.when(F.col("mean").isNotNull(), F.col("count"))).alias("__weight"), *[c.alias(k) for k, c in more.items()]
    )


def total(parts: DataFrame, keys: list[str]) -> DataFrame:
    """What merge() makes of the same rows with weighted means, from their sums by finer keys."""
    out = parts.groupBy(*keys).agg(*[f(c).alias(c) for f, c in ((F.sum, "count"), (F.min, "min"), (F.max, "max"), (F.sum, "__sum"), (F.sum, "__weight"))])
    return out.select(*keys, F.coalesce("count", F.lit(0)).cast("long").alias("count"), "min", F.expr("__sum div nullif(__weight, 0)").alias("mean"), "max")


def merge(stats: DataFrame, keys: list[str], mean: str = "weighted", null_as_zero: bool = False) -> DataFrame:
    """Folds statistics to keys: counts add up, min and max fold, means are weighted by count.

    mean="weighted": floor of sum(mean * count) / sum(count) over rows with a mean; merges
    in any order of one level agree and partial aggregates combine before the shuffle.
    mean="terms": the sum of floor(mean * count / total count), one floor per row, which
    sees each group's total first; it is up to one less per merged row.
    A group without counts has count 0; without means its mean is null, or 0 with null_as_zero.
    """
    exact = "cast(mean as decimal(20,0)) * cast(count as decimal(18,0))"
    rows, weight = stats, F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))
    if mean == "terms":
        rows = rows.withColumn("__total", F.sum("count").over(Window.partitionBy(*keys)))
        sums = F.sum(F.expr(f"({exact}) div nullif(__total, 0)"))
    else:
        sums = F.sum(F.expr(exact))
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"), F.min("min").alias("min"), sums.alias("__sum"), weight.alias("__weight"), F.max("max").alias("max"))
    merged = F.col("__sum").cast("long") if mean == "terms" else F.expr("__sum div nullif(__weight, 0)")
    merged = F.coalesce(merged, F.lit(0).cast("long")) if null_as_zero else merged
    return out.select(*keys, "count", "min", merged.alias("mean"), "max")


def finalize(stats: DataFrame, **options) -> DataFrame:
    """One row per key set, in the table's column order."""
    return merge(stats, KEYS, **options).select(*COLUMNS)


def canonical_order(stats: DataFrame, platforms: DataFrame) -> DataFrame:
    """Output order: by date, then by the platform's place in its domain (null first). platforms: (platform, ordinal)."""
    return stats.join(platforms, "platform", "left").orderBy("start_date", F.col("ordinal").asc_nulls_first()).drop("ordinal").select(*COLUMNS)
