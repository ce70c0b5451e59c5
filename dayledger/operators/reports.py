"""Report tables over the statistics table: timelines, rankings, shares, rolling means,
cumulative distinct counts and outages. Every function is DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.functions.stats import PRESENT, finalize, merge, predicate, sums, total, within
from dayledger.functions.text import NULL_MARK, minify, percent, ratio, upper_limit
from dayledger.operators.ordered import numbered
from dayledger.sources.tables import written


def _all():
    """A window over a whole table; only for tables with a row per key of a closed domain."""
    return Window.partitionBy()


def month(c: str | Column = "start_date") -> Column:
    return F.trunc(c, "MM")


# Lookups and roll-ups


def quantity(stats: DataFrame, what: str = "count", **keys) -> DataFrame:
    """One row with one merged quantity of the rows that the keys select."""
    return merge(stats.where(predicate(**keys)), []).select(F.col(what).alias("value"))


def by_period(stats: DataFrame, period: str = "month") -> DataFrame:
    """Daily statistics merged to months (or another unit of trunc)."""
    first = F.trunc("start_date", period)
    last = F.last_day(first) if period == "month" else F.max("end_date").over(Window.partitionBy(first))
    return finalize(stats.withColumn("end_date", last).withColumn("start_date", first))


def roll_up(stats: DataFrame, members: DataFrame | None = None, mean: str = "weighted") -> DataFrame:
    """Statistics by platform group, (platform, group) in members, or over all platforms.

    Each level is a merge of the level below, so means are weighted at each.
    """
    if members is None:
        rows = stats.withColumn("platform", F.lit(None).cast("string"))
    else:
        rows = stats.join(members.select("platform", "group"), "platform").withColumn("platform", F.col("group")).drop("group")
    return finalize(rows, mean=mean)


def platform_set(stats: DataFrame, platforms: list[str], name: str) -> DataFrame:
    """The statistics of some platforms as those of one."""
    return finalize(stats.where(F.col("platform").isin(platforms)).withColumn("platform", F.lit(name)))


def full_months(stats: DataFrame) -> DataFrame:
    """Only the months that the table's range covers from first to last day."""
    span = stats.agg(F.min("start_date").alias("a"), F.max("end_date").alias("b"))
    span = span.select(F.when(F.dayofmonth("a") == 1, F.col("a")).otherwise(F.add_months(month("a"), 1)).alias("a"), F.when(F.last_day("b") == F.col("b"), F.col("b")).otherwise(F.date_sub(month("b"), 1)).alias("b"))
    return stats.join(F.broadcast(span), within(F.col("a"), F.col("b"))).drop("a", "b")  # one row


# Timelines


def timeline(stats: DataFrame, selector: str | None, what: str = "count", unit: str = "month", labels: DataFrame | None = None, **keys) -> DataFrame:
    """A metric by period and selector (entity or variant), with its period's total and its share.

    labels: (code, label) of a small declared dimension; a code without label shows itself.
    """
    start = month() if unit == "month" else F.col("start_date")
    by = ["period"] + ([selector] if selector else [])
    out = merge(stats.where(predicate(**keys)).withColumn("period", start), by)
    out = out.withColumn("total_count", F.sum("count").over(Window.partitionBy("period"))).withColumn("pct", percent(F.col("count"), F.col("total_count")))
    if labels is not None and selector:
        out = out.join(labels.withColumnRenamed("code", selector), selector, "left").withColumn("label", F.coalesce("label", selector, F.lit(NULL_MARK)))
    return out


def daily_series(stats: DataFrame, source: str = "rows", per: str | None = None, **keys) -> DataFrame:
    """A counter by day, in thousands, or in percent of another counter."""
    names = [source] + ([per] if per else [])
    wide = stats.where(predicate(column=names, entity=None, **keys)).groupBy("start_date").pivot("column", names).agg(F.sum("count"))
    value = percent(F.col(source), F.col(per)) if per else F.col(source) / F.lit(1000.0)
    return wide.select("start_date", value.alias("value"))


def monthly_sum(series: DataFrame, day: str, value: str) -> DataFrame:
    """Sums by month, with the day in mid month that charts put them on."""
    return series.groupBy(month(day).alias("month")).agg(F.sum(value).alias(value)).withColumn("mid_date", F.date_add("month", 14))


def rolling_days(series: DataFrame, day: str, value: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last n days, this one included; days without a row don't count."""
    over = Window.partitionBy(*by).orderBy(F.datediff(day, F.lit(date(1970, 1, 1)))).rangeBetween(-(n - 1), 0)
    return series.withColumn("rolling", F.avg(value).over(over))


def rolling_rows(series: DataFrame, day: str, value: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last n rows; null until there are n."""
    over = Window.partitionBy(*by).orderBy(day).rowsBetween(-(n - 1), 0)
    return series.withColumn("rolling", F.when(F.count(value).over(over) == n, F.avg(value).over(over)))


def fraction(stats: DataFrame, part: str, whole: str, unit: str = "month", rolling: int | None = None, **keys) -> DataFrame:
    """The share of one counter in another by period, in percent, long: (period, kind, pct).

    A month's share is the ratio of its sums.
    """
    wide = stats.where(predicate(column=[part, whole], entity=None, **keys)).groupBy((month() if unit == "month" else F.col("start_date")).alias("period")).pivot("column", [part, whole]).agg(F.sum("count"))
    wide = wide.withColumn("share", percent(F.col(part), F.col(whole)))
    values = ["share"]
    if rolling:
        wide = rolling_rows(wide, "period", "share", rolling)
        values.append("rolling")
    return wide.unpivot(["period"], values, "kind", "pct")


# Rankings and shares


def ranking(table: DataFrame, key: str, value: str = "count") -> DataFrame:
    """Keys by falling value with rank, share and running share; ties by key, null last.

    The table has one row per key of a closed domain; its windows see no more rows.
    """
    order = Window.orderBy(F.desc(value), F.col(key).asc_nulls_last())
    out = table.where(F.col(value) > 0).withColumn("total", F.sum(value).over(_all()))
    out = out.withColumn("pct", percent(F.col(value), F.col("total"))).withColumn("rank", F.row_number().over(order))
    running = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("cum_pct", percent(running, F.col("total")))


def ranking_tail(ranked: DataFrame, rules=((1, 95.0), (2, 90.0), (3, 75.0))) -> DataFrame:
    """What follows the head of a ranking: the first n keys are its head if they hold more
    than the rule's share and others follow; no row if no rule holds."""
    size = F.count(F.lit(1)).over(_all())
    cut = F.lit(None).cast("int")
    for n, least in reversed(rules):
        at = F.max(F.when(F.col("rank") == n, F.col("cum_pct"))).over(_all())
        cut = F.when((size > n) & (at > least), n).otherwise(cut)
    return ranked.withColumn("cut", cut).where(F.col("rank") > F.col("cut"))


def variants(stats: DataFrame, column: str, entity=None, **keys) -> DataFrame:
    return stats.where(predicate(column=column, entity=entity, **keys)).groupBy("variant").agg(F.sum("count").alias("count"))


def keyword_share(stats: DataFrame, column: str, **keys) -> DataFrame:
    """Variants with their share: the null variant of all rows, any other of rows with a variant."""
    out = variants(stats, column, **keys).withColumnRenamed("variant", "keyword")
    everything, named = F.sum("count").over(_all()), F.sum(F.when(F.col("keyword").isNotNull(), F.col("count"))).over(_all())
    return out.withColumn("pct", percent(F.col("count"), F.when(F.col("keyword").isNull(), everything).otherwise(named)))


def text_usage(stats: DataFrame, columns: list[str], **keys) -> DataFrame:
    """Rows by column and free text, ranked: columns from last to first, texts by falling count, ties from last to first; null shows as a mark."""
    out = stats.where(predicate(column=columns, entity=None, **keys)).groupBy("column", "text").agg(F.sum("count").alias("count"))
    return by_count(out.withColumn("text", F.coalesce("text", F.lit(NULL_MARK))), F.desc("column"), ties=("text",))


def by_count(table: DataFrame, *first: Column, ties: tuple[str, ...] = ("variant", "text")) -> DataFrame:
    """The table from its largest count to its smallest within ``first``; ties from last to first, null last. A distributed sort."""
    return table.orderBy(*first, F.col("count").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties])


def value_counts(stats: DataFrame, column: str, entity=None, **keys) -> DataFrame:
    """(variant, text, count) of a column over the whole range, largest first."""
    rows = stats.where(predicate(column=column, entity=entity, **keys)).groupBy("variant", "text").agg(F.sum("count").alias("count"))
    return by_count(rows)


def rows_of_text(stats: DataFrame, columns: list[str]) -> DataFrame:
    return stats.where(predicate(column=columns, entity="rows_of_text")).groupBy("column").agg(F.sum("count").alias("count"))


def platform_totals(stats: DataFrame, least: int = 0, **keys) -> DataFrame:
    """Rows by platform, of those with at least some, with a compact label."""
    out = stats.where(predicate(column="rows", entity=None, platform=PRESENT, **keys)).groupBy("platform").agg(F.sum("count").alias("count"))
    return out.where(F.col("count") >= least).withColumn("label", minify(F.col("count")))


def usage_by_large_platform(stats: DataFrame, column: str, more_than: int, least_pct: float = 0.5) -> DataFrame:
    """Variants of platforms with more than so many rows: counts, and percent of the platform's."""
    large = platform_totals(stats).where(F.col("count") > more_than).select("platform")
    out = stats.where(predicate(column=column, entity=None)).join(large, "platform", "left_semi").groupBy("platform", "variant").agg(F.sum("count").alias("count"))
    return out.withColumn("pct", percent(F.col("count"), F.sum("count").over(Window.partitionBy("platform")))).where(F.col("pct") >= least_pct)


def top_platforms(stats: DataFrame, n: int, always: list[str]) -> DataFrame:
    """The n largest platforms besides some that are always in: (platform, place)."""
    fixed = stats.sparkSession.createDataFrame([(p, i) for i, p in enumerate(always)], "platform string, i int")
    best = platform_totals(stats).join(fixed, "platform", "left_anti").orderBy(F.desc("count"), "platform").limit(n)
    best = best.select("platform", F.row_number().over(Window.orderBy(F.desc("count"), "platform")).alias("place"))
    return best.unionByName(fixed.select("platform", (F.col("i") + n + 1).alias("place")))


def outlier_clamp(table: DataFrame, series: list[str], value: str = "count", factor: float = 1.9) -> DataFrame:
    """Each row with its series' cutoff and a warning where it is beyond.

    The cutoff follows the three largest values: the third, rounded up, if both others are
    factor times it; else the second, if the first is factor times that; else none. Fewer
    than three values have none.
    """
    place = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(value)))
    top = table.withColumn("__p", place).where("__p <= 3").groupBy(*series).agg(*[F.max(F.when(F.col("__p") == i, F.col(value))).alias(f"v{i}") for i in (1, 2, 3)])
    cutoff = F.when((F.col("v1") >= F.col("v3") * factor) & (F.col("v2") >= F.col("v3") * factor), upper_limit(F.col("v3"))).when(F.col("v3").isNotNull() & (F.col("v1") >= F.col("v2") * factor), upper_limit(F.col("v2")))
    return table.join(top.select(*series, cutoff.alias("cutoff")), series, "left").withColumn("warning", F.coalesce(F.col(value) > F.col("cutoff"), F.lit(False)))


# Durations


def mean_delay(stats: DataFrame, column: str, **keys) -> DataFrame:
    """The overall weighted mean in days."""
    return quantity(stats, "mean", column=column, entity=None, **keys).select((F.col("value") / F.lit(86400.0)).alias("days"))


def delay_by_month(stats: DataFrame, column: str, **keys) -> DataFrame:
    out = merge(stats.where(predicate(column=column, entity=None, **keys)).withColumn("period", month()), ["period"])
    return out.select("period", "count", *[(F.col(q) / F.lit(86400.0)).alias(f"{q}_days") for q in ("min", "mean", "max")])


# Distinct counts, coverage, outages


def distinct_platforms(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count_distinct("platform").alias("platforms"), F.max(F.col("platform").isNull().cast("int")).alias("with_null"))


def coverage(stats: DataFrame) -> DataFrame:
    return stats.agg(F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day")).withColumn("days", (F.datediff("last_day", "first_day") + 1).cast("long"))


def first_seen(stats: DataFrame) -> DataFrame:
    """Platforms with their rows and first day."""
    return stats.where(predicate(column="rows", entity=None)).groupBy("platform").agg(F.sum("count").alias("rows"), F.min("start_date").alias("first_day"))


def cumulative_distinct(df: DataFrame, period: str, key: str) -> DataFrame:
    """Distinct keys seen up to each period that has rows: a count of first sightings, added up.

    Periods are days or months; the last window sees one row per period.
    """
    first = df.groupBy(key).agg(F.min(period).alias(period)).where(F.col(key).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("new"))
    spans = df.select(period).distinct()
    out = spans.join(first, period, "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return out.withColumn("seen", F.sum("new").over(Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_platforms(stats: DataFrame, column: str, keyword: str | None = None, unit: str = "month", **keys) -> DataFrame:
    """(period, kind, new, seen): platforms seen up to each period, all of them ("all"), those with any
    variant of the column ("with keywords"), and those with one variant (its name).

    One pass over the statistics finds each platform's first periods; a null platform is none.
    Periods are those that have rows of the column; the last window sees one row per period and kind.
    """
    rows = stats.where(predicate(column=column, entity=None, **keys)).withColumn("period", month() if unit == "month" else F.col("start_date"))
    kinds = {"all": F.lit(True), "with keywords": F.col("variant").isNotNull()} | ({keyword: F.col("variant") == keyword} if keyword else {})
    first = rows.where("platform is not null").groupBy("platform").agg(*[F.min(F.when(test, F.col("period"))).alias(kind) for kind, test in kinds.items()])
    new = first.unpivot(["platform"], list(kinds), "kind", "period").where("period is not null").groupBy("kind", "period").agg(F.count(F.lit(1)).alias("new"))
    spans = rows.select("period").distinct().select("period", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    out = spans.join(new, ["kind", "period"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    over = Window.partitionBy("kind").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("period", "kind", "new", F.sum("new").over(over).alias("seen"))


def gaps(days: DataFrame, key: str, day: str) -> DataFrame:
    """Missing days between neighbouring days of a key: (key, before, after, days)."""
    over = Window.partitionBy(key).orderBy(day)
    out = days.select(key, day).distinct().withColumn("after", F.lead(day).over(over)).withColumn("duration", (F.datediff("after", day) - 1).cast("long"))
    return out.where((F.col("duration") > 0) & F.col(key).isNotNull()).withColumnRenamed(day, "before")


def outage_summary(days: DataFrame, key: str, day: str, most: float = 0.2) -> DataFrame:
    """Keys with gaps: their number, days without and with rows, and whether gaps are rare enough to be outages."""
    with_rows = days.select(key, day).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("days_with"))
    out = gaps(days, key, day).groupBy(key).agg(F.count(F.lit(1)).alias("outages"), F.sum("duration").alias("days_without")).join(with_rows, key)
    return out.withColumn("has_real_outages", ratio(F.col("days_without"), F.col("days_with")) < most)


def outages(days: DataFrame, key: str, day: str, longer_than: int = 1, most: float = 0.2) -> DataFrame:
    """Gaps of more than so many days of keys with real outages, in order of the keys without regard to case, then of time."""
    real = outage_summary(days, key, day, most).where("has_real_outages").select(key)
    return gaps(days, key, day).where(F.col("duration") > longer_than).join(real, key, "left_semi").orderBy(F.lower(F.col(key).cast("string")), key, "before")


# Tags and the summary table


def tag_order(stats: DataFrame) -> DataFrame:
    """Tags from least to most specific: null, others, categories, keywords; then by name."""
    kind = F.when(F.col("tag").isNull(), 0).when(F.col("tag").startswith("STATEMENT_CATEGORY_"), 2).when(F.col("tag").startswith("KEYWORD_"), 3).otherwise(1)
    tags = stats.where(~F.col("column").isin("total_rows", "total_rows_with_keywords")).select("tag").distinct().withColumn("kind", kind)
    return tags.withColumn("place", F.row_number().over(Window.orderBy("kind", F.col("tag").asc_nulls_first())))


#: The counters that open a summary, in their order.
OPENING = ("batch_count", "extract_rows", "extract_rows_with_keywords", "total_rows", "total_rows_with_keywords")


def short_text(c: Column, most: int = 70) -> Column:
    """A free text as a label: white space as one space, no bars, and a mark where it was cut."""
    plain = F.replace(F.regexp_replace(c, r"[\x09-\x0D\x20]+", " "), F.lit("|"), F.lit(""))
    return F.when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


def summary(stats: DataFrame, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(tag, section, ordinal, variable, text, value): every quantity of the table over its whole range, as text.

    Sections: 0 the counters that open it, 1 all other fields, 2 platforms by rows, 3
    platforms by first day. A field's values come by falling count, ties from last to
    first. Durations give count, least, mean and largest; other fields their count, and
    the largest where there is one. A null value of a field that has others is is_null.
    Each free text is a row of its own: variable shortens it for show, text has it whole. Rows are numbered by
    ranges of their order, so they may be many. stats is read once.
    """
    field = ["tag", "column", "entity"]
    # Rows of platforms apart, for sections 2 and 3.
    named = F.when(predicate(column="rows", entity=None, platform=PRESENT), F.col("platform"))
    kept = write(sums(stats.withColumn("platform", named), [*field, "variant", "text", "platform"], start_date=F.min("start_date")))
    merged = total(kept, [*field, "variant", "text"])
    has = merged.groupBy(*[F.col(c).alias("of_" + c) for c in field]).agg(F.max(F.col("variant").isNotNull() | F.col("text").isNotNull()).alias("by_value"))
    rows = merged.join(has, [F.col(c).eqNullSafe(F.col("of_" + c)) for c in field])
    value = F.coalesce(short_text(F.col("text")), F.col("variant"), F.when(F.col("by_value"), F.lit("is_null")))
    timed = F.col("min").isNotNull()
    part = lambda test, i, suffix, v: F.when(test, F.struct(F.lit(i).alias("i"), suffix.alias("suffix"), v.cast("string").alias("value")))
    none = F.lit(None).cast("string")
    parts = F.array_compact(F.array(
        part((F.col("count") > 0) | F.col("max").isNull(), 0, F.when(timed, "count").otherwise(none), F.col("count")),
        part(timed, 1, F.lit("min"), F.col("min")), part(F.col("mean").isNotNull(), 2, F.lit("mean"), F.col("mean")), part(F.col("max").isNotNull(), 3, F.lit("max"), F.col("max")),
    ))
    place = F.array_position(F.array(*map(F.lit, OPENING)), F.col("column"))
    rows = rows.select("tag", F.when(place > 0, 0).otherwise(1).alias("section"), F.when(place > 0, place.cast("string")).otherwise(F.col("column")).alias("a"), F.col("entity").alias("b"), F.col("count").alias("n"), F.col("variant").alias("c"), "text", F.concat_ws(".", "column", "entity", value).alias("name"), F.explode(parts).alias("x"))
    rows = rows.select("tag", "section", "a", "b", "n", "c", F.col("x.i").alias("i"), "text", F.concat_ws(".", "name", "x.suffix").alias("variable"), "x.value")
    seen = kept.where(F.col("platform").isNotNull()).groupBy("tag", "platform").agg(F.sum("count").alias("rows"), F.min("start_date").alias("start_date"))
    one = lambda section, n, what: F.struct(F.lit(section).alias("section"), n.cast("long").alias("n"), F.concat_ws(".", F.lit("platform"), "platform", F.lit(what)).alias("variable"), F.col(what).cast("string").alias("value"))
    seen = seen.select("tag", "platform", F.explode(F.array(one(2, F.col("rows"), "rows"), one(3, -F.unix_date("start_date"), "start_date"))).alias("x"))
    seen = seen.select("tag", "x.section", none.alias("a"), none.alias("b"), "x.n", F.col("platform").alias("c"), F.lit(0).alias("i"), none.alias("text"), "x.variable", "x.value")
    # By code points; a null variant comes last of a field's, and so does a null text.
    order = [F.col("section"), F.col("a"), F.col("b").asc_nulls_first(), F.desc("n"), F.coalesce("text", "c").desc_nulls_last(), F.col("i"), F.col("variable")]
    out = numbered(rows.unionByName(seen), order, "ordinal", ["tag"], write)
    return out.select("tag", "section", "ordinal", "variable", "text", "value")


def intro(stats: DataFrame, tag: str | None = None) -> DataFrame:
    """The quantities that open a report on one tag, in one pass.

    Rows of the extract with the tag and of the whole; platforms and, with the tag,
    distinct free texts, null counting as one of each; rows of the table with a free text;
    first and last day and the days between them, both included.
    """
    tagged = predicate(tag=tag)
    distinct = lambda test, c: F.count_distinct(F.when(test, F.col(c))) + F.coalesce(F.max((test & F.col(c).isNull()).cast("int")), F.lit(0))
    return stats.agg(
        F.sum(F.when(predicate(column="extract_rows", tag=tag), F.col("count"))).alias("extract_rows"), F.sum(F.when(predicate(column="total_rows", tag=None), F.col("count"))).alias("total_rows"),
        distinct(F.lit(True), "platform").alias("platforms"), (F.datediff(F.max("end_date"), F.min("start_date")) + 1).cast("long").alias("days"), F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"),
        F.count_if(tagged & F.col("text").isNotNull()).alias("text_entries"), distinct(tagged, "text").alias("texts"),
    )
