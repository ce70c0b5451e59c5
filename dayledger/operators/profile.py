"""The profile: statistics of every declared column, for each day and stratum, in one pass.

A source row becomes an array of elements (number of the slot, value, x), which is
exploded and counted by slot and value, with partial sums before the shuffle; so the
source is read once whatever the number of declarations, and what is shuffled is the
result's size rather than the input's. One more element of a row is a mask of the counters
that it adds to; a group's masks together tell which counters are to show as zero, so
there is one aggregation.

Where strata are so many that a task sees few rows of each, partial sums spare nothing and
a task's table of them grows with its input. Such rows are written once, in the columns that
the profile needs, and their strata counted. Rows of strata that one task can count are
gathered by stratum, so their counts are whole and are shuffled no more; strata of very many
rows are counted with partial sums, by as many tasks as their rows ask for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.functions.stats import COLUMNS, SCHEMA
from dayledger.operators.spec import KINDS, Dataset, Slot
from dayledger.sources.tables import freed, written

_BY_VALUE = KINDS[:3]


#: Counters in one mask.
_WORD = 62
#: Rows of a gathered part, before Spark puts small ones together; a stratum of more is counted with partial sums.
PART = 1 << 17


def _slots(data: Dataset) -> list[tuple[str, Slot]]:
    """(column, slot) of all specs."""
    out = []
    for spec in data.specs:
        if not callable(getattr(spec, "slots", None)):
            raise TypeError(f"{spec!r} is no declaration: it has no slots()")
        for slot in spec.slots():
            if bad := {kind for _, kind in slot.outputs} - set(KINDS):
                raise ValueError(f"{spec!r} has outputs of unknown kinds: {', '.join(sorted(bad))}")
            out.append((spec.column, slot))
    return out


def _hit(slot: Slot, value: str | None) -> Column | None:
    """Whether a row adds to the slot's counter of a value; None if every row does."""
    is_value = lambda x: x.isNull() if value is None else x.cast("string").eqNullSafe(F.lit(value))
    if slot.many is not None:
        return F.coalesce(F.exists(slot.many, is_value), F.lit(False))
    tests = [t for t in (slot.when, None if slot.value is None else is_value(slot.value)) if t is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def _used(df: DataFrame, made: dict[str, Column], *values: Column) -> tuple[list[str], dict[str, Column]]:
    """What values need: columns of df, if only by the columns made, and of these those that they name."""

    def names(of: DataFrame, *columns: Column) -> set[str]:
        found = of.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])._jdf.queryExecution().analyzed().references().iterator()
        out = set()
        while found.hasNext():
            out.add(found.next().name())
        return out

    direct = names(df.withColumns(made), *values)
    through = {k: c for k, c in made.items() if k in direct}
    return sorted(direct - through.keys() | names(df, *through.values())), through


def needed(df: DataFrame, data: Dataset, end: Column | None = None) -> tuple[list[str], Dataset]:
    """The columns of df that a profile reads, and data with those of the columns made that it needs."""
    own = [F.col(c) for c in (data.day, data.platform, data.category) if c] + ([] if end is None else [end])
    columns, made = _used(df, data.made, *own, *[c for _, s in _slots(data) for c in (s.value, s.x, s.when, s.many) if c is not None])
    return columns, replace(data, made=made)


def _count_gathered(rows: DataFrame, used: list[str], made: dict[str, Column], keys: dict[str, Column], count: Callable[[DataFrame, dict[str, Column]], DataFrame]) -> DataFrame:
    """The counts of rows: of small strata by one task each, of large ones with partial sums."""
    own = {k: f"__{k}" for k in keys}
    # Sorted, for files and shuffled rows that compress well.
    kept = written(rows.select(*used, *[c.alias(own[k]) for k, c in keys.items()]).sortWithinPartitions(*own.values()), free=True)
    keys, near = {k: F.col(c) for k, c in own.items()}, F.xxhash64(*own.values())
    # Strata of one hash count as one here, which is only a matter of where they are counted.
    sizes = kept.groupBy(near.alias("near")).agg(F.count(F.lit(1)).alias("n"))
    with freed(kept.sparkSession):
        small, large = sizes.agg(F.sum(F.when(F.col("n") <= PART, F.col("n"))), F.collect_list(F.when(F.col("n") > PART, F.col("near")))).first()
    # By the keys themselves, so the counts need no further shuffle and Spark splits no part.
    parted = (kept.where(~near.isin(large)) if large else kept).hint("rebalance", -(-(small or 1) // PART), *own.values())
    counted = count(parted.withColumns(made), keys)
    return counted.unionByName(count(kept.where(near.isin(large)).withColumns(made), keys)) if large else counted


def profile(df: DataFrame, data: Dataset, tag: str | None = None, end: Column | None = None) -> DataFrame:
    """Statistics of df, one row per (day, stratum, column, entity, variant, text).

    Rows with a null category are left out when data has a category; dropped_rows()
    counts them. end is the last day of a row's period, its day if not given.
    """
    keys = {
        "start_date": F.col(data.day).cast("date"),
        "end_date": (F.col(data.day) if end is None else end).cast("date"),
        "platform": F.col(data.platform).cast("string") if data.platform else F.lit(None).cast("string"),
        "category": F.col(data.category).cast("string") if data.category else F.lit(None).cast("string"),
    }
    rows = df.withColumns(data.made)
    rows = rows.where(F.col(data.category).isNotNull()) if data.category else rows
    names, slots = list(keys), _slots(data)
    null = F.lit(None)
    element = lambda k, value, x: F.struct(F.lit(k).alias("k"), (null if value is None else value).cast("string").alias("value"), (null if x is None else x).cast("long").alias("x"))
    # Counters that show in every group, if only as zero, but for those that all rows add to.
    must = [(k, v, hit) for k, (_, slot) in enumerate(slots) for v in (slot.known or (() if all(kind in _BY_VALUE for _, kind in slot.outputs) else (None,))) if (hit := _hit(slot, v)) is not None]
    words = [must[a : a + _WORD] for a in range(0, len(must), _WORD)]
    mask = lambda word: reduce(lambda a, b: a.bitwiseOR(b), [F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, _, hit) in enumerate(word)])
    single = [element(k, s.value, s.x) if s.when is None else F.when(s.when, element(k, s.value, s.x)) for k, (_, s) in enumerate(slots) if s.many is None]
    single += [element(-1 - w, None, mask(word)) for w, word in enumerate(words)]
    numbered = lambda k: lambda v: element(k, v, None)
    arrays = ([F.array(*single)] if single else []) + [F.transform(s.many, numbered(k)) for k, (_, s) in enumerate(slots) if s.many is not None]
    if not arrays:
        return df.sparkSession.createDataFrame([], SCHEMA)
    added = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    elements = lambda rows, keys: rows.select(*[c.alias(k) for k, c in keys.items()], F.explode(added).alias("e")).where("e is not null").select(*names, "e.k", "e.value", "e.x")
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") >= 0, F.col("x"))).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    if words:
        counts.append(F.bit_or(F.when(F.col("k") < 0, F.col("x"))).alias("mask"))
    count = lambda rows, keys: elements(rows, keys).groupBy(*names, "k", "value").agg(*counts)
    counted = _count_gathered(rows, *_used(df, data.made, added), keys, count) if data.gather else count(rows, keys)
    if words:
        zero = lambda i, k, v: F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(k).alias("k"), F.lit(v).cast("string").alias("value"))
        every = F.array(*[F.array(*[zero(i, k, v) for i, (k, v, _) in enumerate(word)]) for word in words])
        none = F.lit(None).cast("long")
        lacking = F.filter(F.get(every, -1 - F.col("k")), lambda e: e["bit"].bitwiseAND(F.col("mask")) == 0)
        empty = F.transform(lacking, lambda e: F.struct(e["k"].alias("k"), e["value"].alias("value"), F.lit(0).cast("long").alias("n"), none.alias("s"), none.alias("lo"), none.alias("hi")))
        counted = counted.select(*names, F.explode(F.when(F.col("k") < 0, empty).otherwise(F.array(F.struct("k", "value", "n", "s", "lo", "hi")))).alias("e")).select(*names, "e.*")
    tell = lambda column, entity, kind: F.struct(F.lit(column).alias("column"), F.lit(entity).cast("string").alias("entity"), F.lit(kind).alias("kind"))
    told = F.array(*[F.array(*[tell(column, *output) for output in slot.outputs]) if slot.outputs else F.slice(F.array(tell("", None, "")), 1, 0) for column, slot in slots])
    out = counted.select(*names, "value", "n", "s", "lo", "hi", F.explode(F.get(told, F.col("k"))).alias("t"))
    kind, measured = F.col("t.kind"), F.col("t.kind") == "measure"
    count = F.when(kind == "sum", F.coalesce("s", F.lit(0))).when(kind != "max", F.col("n"))
    return out.select(
        "start_date", "end_date", F.lit(tag).cast("string").alias("tag"), "platform", "category", F.col("t.column").alias("column"),
        F.when(kind == "entity", F.col("value")).otherwise(F.col("t.entity")).alias("entity"), F.when(kind == "variant", F.col("value")).alias("variant"), F.when(kind == "text", F.col("value")).alias("text"),
        count.cast("long").alias("count"), F.when(measured, F.col("lo")).alias("min"), F.when(measured & (F.col("n") > 0), (F.col("s") / F.col("n")).cast("long")).alias("mean"),
        F.when(measured | (kind == "max"), F.col("hi")).alias("max"),
    ).select(*COLUMNS)


def dropped_rows(df: DataFrame, data: Dataset) -> DataFrame:
    """Rows by day that stratification by category leaves out."""
    return df.where(F.col(data.category).isNull()).groupBy(F.col(data.day).cast("date").alias("start_date")).agg(F.count(F.lit(1)).alias("dropped"))


def header(df: DataFrame, day: str, keyword: str, tag: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Five untiered rows per day: batch_count, extract_rows, extract_rows_with_keywords, total_rows, total_rows_with_keywords.

    Totals come from the manifest (release, batch_count, total_rows, total_rows_with_keywords);
    without a tag the extract is the whole table and gives the totals itself. Totals are untagged.
    """
    own = df.groupBy(F.col(day).cast("date").alias("start_date")).agg(F.count(F.lit(1)).alias("extract_rows"), F.count(keyword).alias("extract_rows_with_keywords"))
    if manifest is None:
        own = own.withColumns({c: F.lit(None).cast("long") for c in ("batch_count", "total_rows", "total_rows_with_keywords")})
    else:
        own = own.join(manifest.select(F.col("release").alias("start_date"), "batch_count", "total_rows", "total_rows_with_keywords"), "start_date", "left")
    if tag is None:
        own = own.withColumns({"total_rows": F.col("extract_rows"), "total_rows_with_keywords": F.col("extract_rows_with_keywords")})
    order = ["batch_count", "extract_rows", "extract_rows_with_keywords", "total_rows", "total_rows_with_keywords"]
    rows = own.unpivot(["start_date"], order, "column", "count")
    none = F.lit(None).cast("string")
    return rows.select(
        "start_date", F.col("start_date").alias("end_date"), F.when(~F.col("column").startswith("total_"), F.lit(tag)).cast("string").alias("tag"),
        none.alias("platform"), none.alias("category"), "column", none.alias("entity"), none.alias("variant"), none.alias("text"),
        F.col("count").cast("long").alias("count"), *[F.lit(None).cast("long").alias(v) for v in ("min", "mean", "max")],
    )
