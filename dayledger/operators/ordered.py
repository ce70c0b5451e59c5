"""Running values and numbers over long sequences, without a task that sees a whole one.

A sequence is cut into blocks, each of which one task can hold. What a block adds up to is a row of
a small table, whose running sums tell each block where it begins; the rest is a window within
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of other, whose keys may be null."""
    sides = other.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in other.columns])
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(sides[f"__{c}"])
    return df.join(sides, same).drop(*[f"__{c}" for c in by])


def running_sums(df: DataFrame, keys: list[str], block: str, at: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each value over all rows of the keys' sequence up to the row.

    A sequence is ordered by block, then by the columns at within it. Blocks of a sequence
    are few (as the parts of a file are); one window sees a row for each.
    """
    own = Window.partitionBy(*keys, block).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, block).agg(*[F.sum(v).alias(f"__{n}") for n, v in sums.items()])
    blocks = blocks.select(*keys, block, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = _joined(df, blocks, [*keys, block])
    out = out.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in sums.items()})
    return out.drop(*[f"__{n}" for n in sums])


def last_known(df: DataFrame, keys: list[str], block: str, at: list[str], name: str, value: Column) -> DataFrame:
    """df with the last value that isn't null of the keys' sequence up to the row; blocks as in running_sums()."""
    own = Window.partitionBy(*keys, block).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(*at)
    blocks = df.groupBy(*keys, block).agg(F.max_by(value, F.when(value.isNotNull(), order)).alias("__last"))
    blocks = blocks.select(*keys, block, F.last("__last", ignorenulls=True).over(before).alias("__last"))
    return _joined(df, blocks, [*keys, block]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(own), F.col("__last"))).drop("__last")


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str], write) -> DataFrame:
    """df with its rows numbered from 1 in each group of the columns within, in this order.

    Rows are sorted by ranges, written by ``write`` with their places, and
    counted by range; a window sees one row for each range and group only. Groups may
    have any size. Rows that the order leaves tied are numbered in any way.
    """
    firsts = [F.col(c).asc_nulls_first() for c in within]
    ranged = df.repartitionByRange(*firsts, *order).sortWithinPartitions(*firsts, *order)
    # The low 33 bits of this number are a row's place in its partition.
    placed = write(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = placed.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*within, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__from"))
    return _joined(placed, parts, [*within, "__part"]).withColumn(name, (F.col("__from") + F.col("__place")).cast("int")).drop("__part", "__place", "__from")
