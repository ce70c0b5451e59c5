"""Data quality: value domains, manifests, calendars, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.functions.stats import predicate

MANIFEST = ["batch_count", "total_rows", "total_rows_with_keywords", "extract_rows", "extract_rows_with_keywords"]


def unknown_values(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Values of a column that its domain (a column ``value``) lacks, with their rows."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return found.join(domain.select("value"), "value", "left_anti")


def extended_domain(domain: DataFrame, unknown: DataFrame) -> DataFrame:
    """The domain with new values, numbered without regard to case."""
    every = domain.select("value").unionByName(unknown.select("value")).distinct()
    return every.withColumn("ordinal", F.row_number().over(Window.orderBy(F.lower("value"), "value")))


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replaces names by their canonical ones; aliases has (alias, canonical)."""
    named = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))
    out = df.join(named, df[column] == named["__alias"], "left")
    return out.withColumn(column, F.coalesce("__canonical", column)).drop("__alias", "__canonical")


def find_canonical(names: DataFrame, domain: DataFrame) -> DataFrame:
    """(name, value): names without regard to case; names with a backslash or quote, and unknown ones, have no value."""
    clean = ~F.col("name").rlike(r'[\\"]')
    keyed = domain.select("value", F.lower("value").alias("__k"))
    return names.join(keyed, (F.lower("name") == F.col("__k")) & clean, "left").drop("__k")


def bad_list_items(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose array has items outside the domain, with those items."""
    bad = F.array_except(column, F.array(*[F.lit(a) for a in allowed]))
    return df.withColumn("bad_items", bad).where(F.size("bad_items") > 0)


def calendar(df: DataFrame, day: str) -> DataFrame:
    """Every day from a table's first to its last."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


def missing_days(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Days of ``wanted`` that ``done`` lacks, late ones and holes alike."""
    return wanted.select("day").distinct().join(done.select("day"), "day", "left_anti")


def broken_sequence(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Rows whose index doesn't follow the one before: (by, index, previous)."""
    previous = F.lag(index).over(Window.partitionBy(*by).orderBy(index))
    return df.select(*by, index).withColumn("previous", previous).where(F.col(index) != F.col("previous") + 1)


def manifest_from_stats(stats: DataFrame) -> DataFrame:
    """One row per day from header rows; a day without a counter has null there."""
    heads = stats.where(predicate(column=MANIFEST, entity=None, platform=None))
    return heads.groupBy(F.col("start_date").alias("release")).pivot("column", MANIFEST).agg(F.sum("count"))


def merge_manifests(a: DataFrame, b: DataFrame, values: list[str]) -> DataFrame:
    """The days of both; a value that one has is taken, two that differ are a conflict (a's is kept)."""
    x = a.select("release", *[F.col(v).alias(f"a_{v}") for v in values])
    y = b.select("release", *[F.col(v).alias(f"b_{v}") for v in values])
    differ = [F.coalesce(F.col(f"a_{v}") != F.col(f"b_{v}"), F.lit(False)) for v in values]
    conflict: Column = differ[0]
    for d in differ[1:]:
        conflict = conflict | d
    return x.join(y, "release", "full_outer").select("release", *[F.coalesce(f"a_{v}", f"b_{v}").alias(v) for v in values], conflict.alias("conflict"))


def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (release, problem, detail) from a manifest (release, batch_count) and files (release, batch, digest, expected).

    Problems: missing day, missing batch, batch count, digest, unknown day.
    """
    row = lambda df, problem, detail: df.select("release", F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    days = missing_days(calendar(manifest, "release"), manifest.select(F.col("release").alias("day"))).select(F.col("day").alias("release"))
    seen = files.groupBy("release").agg(F.count(F.lit(1)).alias("n"))
    both = manifest.join(seen, "release", "full_outer")
    out = row(days, "missing day", F.lit(None))
    out = out.unionByName(row(both.where("batch_count is not null and coalesce(n, 0) <> batch_count"), "batch count", F.coalesce("n", F.lit(0))))
    out = out.unionByName(row(manifest.select("release").join(files, "release", "right").join(manifest.select("release"), "release", "left_anti").select("release").distinct(), "unknown day", F.lit(None)))
    out = out.unionByName(row(broken_sequence(files, ["release"], "batch"), "missing batch", F.col("previous") + 1))
    return out.unionByName(row(files.where("digest <> expected"), "digest", F.col("batch")))


def complete_days(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Days whose files are as many as the manifest says, and some."""
    seen = files.groupBy("release").agg(F.count(F.lit(1)).alias("n"))
    return manifest.join(seen, "release").where("n = batch_count and n > 0").select("release")


def digest_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, found, expected) where digests differ or are on one side only."""
    both = found.select("path", F.col("digest").alias("found")).join(expected.select("path", F.col("digest").alias("expected")), "path", "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("expected")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def single_category(df: DataFrame, column: str = "category") -> DataFrame:
    """The one category that all rows share, or null."""
    return df.agg(F.when(F.count_distinct(column) == 1, F.min(column)).alias("category"))


def stratification(stats: DataFrame) -> DataFrame:
    """How a statistics table was made: by category, and with all free text."""
    return stats.agg(F.coalesce(F.bool_or(F.col("category").isNotNull()), F.lit(False)).alias("by_category"), (~F.coalesce(F.bool_or(F.col("entity") == "rows_of_text"), F.lit(False))).alias("all_text"))
