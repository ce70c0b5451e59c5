"""The registered queries: each operator over a given table, with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayledger.functions import stats as st
from dayledger.functions import text as tx
from dayledger.operators import checks, distill
from dayledger.operators import reports as rp
from dayledger.operators.profile import dropped_rows, header, needed, profile
from dayledger.operators.spec import CountsWith, Dataset, Duration, ListStats, NullPattern, Rows, TextCounts, TextRows, ValueCounts
from dayledger.plans import oracle, views
from dayledger.sources.tables import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAG, STATUS, BRAND, WORDS = ValueCounts("flag"), ValueCounts("status"), ValueCounts("brand"), ListStats("words")
PATTERN = NullPattern("decision_type", ("d_vis", "d_mon", "d_pro", "d_acc"), ("vis", "mon", "pro", "acc"))
DELAY, VISIBLE = Duration("delay", "started_at", "ended_at"), CountsWith("d_vis", "end_date")
#: The whole declaration of the shipments view.
SHIPMENTS = (Rows(), FLAG, STATUS, BRAND, WORDS, PATTERN, DELAY, VISIBLE)
EVENTS = (Rows(), ValueCounts("category"))

_FLAGS = [("A", "Accepted"), ("N", "Not returned"), ("R", "Returned")]


def add(name: str, sql: str | None, *needs: str):
    """Registers a query; needs are the views that its SQL reads."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {', '.join(needs)}\n{sql}" if needs else sql
        return f

    return put


def by_month(df: DataFrame, *specs, platform: str | None = "platform", category: str | None = None, tag: str | None = None) -> DataFrame:
    df = df.withColumn("day", rp.month("day"))
    return profile(df, Dataset(tuple(specs), platform=platform, category=category, gather=True), tag, end=F.last_day("day"))


def ship(spark: SparkSession, sf: str, *specs, platform: str | None = "platform", category: str | None = None, tag: str | None = None) -> DataFrame:
    """Monthly statistics of shipments by supplier."""
    made = views.shipped()
    made["day"] = rp.month(made["day"])
    data = Dataset(tuple(specs), platform=platform, category=category, gather=True, made=made)
    end = F.last_day("day")
    columns, data = needed(views.lines(spark, sf), data, end)
    return profile(views.lines(spark, sf, columns), data, tag, end=end)


def log(spark: SparkSession, sf: str, *specs, **options) -> DataFrame:
    """Daily statistics of events by user."""
    return profile(views.events(spark, sf), Dataset(specs or EVENTS, **options))


def docs(spark: SparkSession, sf: str, *specs, tag: str | None = None) -> DataFrame:
    """Statistics of documents by source, on one day."""
    return profile(views.documents(spark, sf).withColumn("day", F.lit(date(2024, 1, 1))), Dataset(specs), tag)


def ship_sql(*specs, **options) -> str:
    return f"ST AS ({oracle.statistics('H', specs, 'month', **options)})"


def log_sql(*specs, **options) -> str:
    return f"ST AS ({oracle.statistics('E', specs or EVENTS, **options)})"


def docs_sql(*specs, **options) -> str:
    return f"DD AS (SELECT *, DATE '2024-01-01' AS day FROM D), ST AS ({oracle.statistics('DD', specs, **options)})"


# Profile


add("profile_rows", "SELECT * FROM ST", views.E, log_sql(Rows()))(lambda s, d: log(s, d, Rows()))
add("profile_value_counts", "SELECT * FROM ST", views.H, ship_sql(FLAG))(lambda s, d: ship(s, d, FLAG))
add("profile_text_counts", "SELECT * FROM ST", views.D, docs_sql(TextCounts("text")))(lambda s, d: docs(s, d, TextCounts("text")))
add("profile_text_rows", "SELECT * FROM ST", views.D, docs_sql(TextRows("text"), TextRows("quality")))(lambda s, d: docs(s, d, TextRows("text"), TextRows("quality")))
add("profile_list_stats", "SELECT * FROM ST", views.H, ship_sql(WORDS))(lambda s, d: ship(s, d, WORDS))
add("profile_null_pattern", "SELECT * FROM ST", views.H, ship_sql(PATTERN))(lambda s, d: ship(s, d, PATTERN))
add("profile_duration", "SELECT * FROM ST", views.H, ship_sql(DELAY))(lambda s, d: ship(s, d, DELAY))
add("profile_counts_with", "SELECT * FROM ST", views.H, ship_sql(VISIBLE))(lambda s, d: ship(s, d, VISIBLE))
add("profile_counts_with_list", "SELECT * FROM ST", views.H, ship_sql(CountsWith("words", "end_date", is_list=True)))(lambda s, d: ship(s, d, CountsWith("words", "end_date", is_list=True)))
add("profile_by_category", "SELECT * FROM ST", views.E, log_sql(Rows(), category="category"))(lambda s, d: log(s, d, Rows(), category="category"))
add("profile_dropped_rows", "SELECT CAST('2024-01-01' AS DATE) AS start_date, count(*) AS dropped FROM D WHERE quality IS NULL HAVING count(*) > 0", views.D)(
    lambda s, d: dropped_rows(views.documents(s, d).withColumn("day", F.lit(date(2024, 1, 1))), Dataset((), category="quality"))
)
add("profile_all", "SELECT * FROM ST", views.H, ship_sql(*SHIPMENTS))(lambda s, d: ship(s, d, *SHIPMENTS))

_HEADER = """SELECT day AS start_date, day AS end_date, {tag} AS tag, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS category, '{c}' AS "column",
  CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS text, CAST({n} AS BIGINT) AS count, CAST(NULL AS BIGINT) AS min, CAST(NULL AS BIGINT) AS mean, CAST(NULL AS BIGINT) AS max FROM E GROUP BY day"""
_HEADERS = "\nUNION ALL ".join(
    _HEADER.format(c=c, n=n, tag="CAST(NULL AS VARCHAR)")
    for c, n in (("batch_count", "NULL"), ("extract_rows", "count(*)"), ("extract_rows_with_keywords", "count(*) FILTER (category = 'purchase')"), ("total_rows", "count(*)"), ("total_rows_with_keywords", "count(*) FILTER (category = 'purchase')"))
)


def _with_keyword(s: SparkSession, d: str) -> DataFrame:
    return views.events(s, d).withColumn("keyword", F.when(F.col("category") == "purchase", F.col("category")))


add("profile_header", f"SELECT * FROM ({_HEADERS})", views.E)(lambda s, d: header(_with_keyword(s, d), "day", "keyword"))


def _minor(s: SparkSession, d: str) -> DataFrame:
    """A manifest of the full log, for extracts of it."""
    full = distill.counters(_with_keyword(s, d), "day", "keyword")
    return full.select("release", F.lit(1).cast("long").alias("batch_count"), F.col("extract_rows").alias("total_rows"), F.col("extract_rows_with_keywords").alias("total_rows_with_keywords"))


_TAGGED = "\nUNION ALL ".join(
    _HEADER.format(c=c, n=n, tag=t)
    for c, n, t in (
        ("batch_count", "1", "'errors'"), ("extract_rows", "count(*) FILTER (category IN ('error', 'purchase'))", "'errors'"), ("extract_rows_with_keywords", "count(*) FILTER (category = 'purchase')", "'errors'"),
        ("total_rows", "count(*)", "CAST(NULL AS VARCHAR)"), ("total_rows_with_keywords", "count(*) FILTER (category = 'purchase')", "CAST(NULL AS VARCHAR)"),
    )
)
add("profile_header_extract", f"SELECT * FROM ({_TAGGED}) WHERE start_date IN (SELECT day FROM E WHERE category IN ('error', 'purchase'))", views.E)(
    lambda s, d: header(_with_keyword(s, d).where(F.col("category").isin("error", "purchase")), "day", "keyword", "errors", _minor(s, d))
)


def _sub_extract(s: SparkSession, d: str) -> DataFrame:
    h = views.shipments(s, d)
    return by_month(h, Rows(), FLAG, tag="all").unionByName(by_month(h.where(distill.with_item("words", "ring")), Rows(), FLAG, tag="ring"))


_SUB = f"{oracle.statistics('H', (Rows(), FLAG), 'month', tag='all')} UNION ALL {oracle.statistics('H', (Rows(), FLAG), 'month', tag='ring', where=chr(39).join(['list_contains(words, ', 'ring', ')']))}"
add("profile_subextract", _SUB, views.H)(_sub_extract)


# Merging


_DAILY = f"DAYS AS ({oracle.statistics('H', (Rows(), DELAY), 'day')})"
_MONTHS = "CAST(date_trunc('month', start_date) AS DATE) AS start_date, last_day(start_date) AS end_date, tag, platform, category, \"column\", entity, variant, text"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return profile(views.shipments(s, d), Dataset((Rows(), DELAY), gather=True))


add("stats_finalize", f"SELECT {oracle.KEYS}, count, min, mean, max FROM ({oracle.merged('(SELECT * FROM ST UNION ALL SELECT * FROM ST)', oracle.KEYS)})", views.H, ship_sql(FLAG, DELAY))(
    lambda s, d: st.finalize(ship(s, d, FLAG, DELAY).unionByName(ship(s, d, FLAG, DELAY)))
)
add("stats_by_month", oracle.merged("DAYS", _MONTHS), views.H, _DAILY)(lambda s, d: rp.by_period(_daily(s, d)))
add(
    "stats_merge_mean",
    f"""SELECT start_date, platform, "column", entity, CAST(sum(count) AS BIGINT) AS count, min(min) AS min, CAST(sum(CAST(mean AS HUGEINT) * count // nullif(total, 0)) AS BIGINT) AS mean, max(max) AS max
FROM (SELECT CAST(date_trunc('month', start_date) AS DATE) AS start_date, platform, "column", entity, count, min, mean, max, sum(count) OVER (PARTITION BY date_trunc('month', start_date), platform, "column", entity) AS total FROM DAYS) GROUP BY ALL""",
    views.H, _DAILY,
)(lambda s, d: st.merge(_daily(s, d).withColumn("start_date", rp.month()), ["start_date", "platform", "column", "entity"], mean="terms"))


def _roll_up(s: SparkSession, d: str) -> DataFrame:
    members = table(s, d, "supplier").select(F.col("s_name").alias("platform"), F.col("s_nationkey").cast("string").alias("group"))
    path = shared_path(s)
    rp.roll_up(ship(s, d, FLAG, DELAY), members).write.parquet(path)  # the level above reads it again
    nations = s.read.schema(st.SCHEMA).parquet(path)
    return nations.unionByName(rp.roll_up(nations))


_NATIONS = f"""NATIONS AS ({oracle.merged("(SELECT ST.* REPLACE (CAST(s_nationkey AS VARCHAR) AS platform) FROM ST JOIN supplier ON s_name = platform)", oracle.KEYS)})"""
add("stats_rollup_platform", f"""SELECT * FROM NATIONS UNION ALL {oracle.merged("(SELECT * REPLACE (CAST(NULL AS VARCHAR) AS platform) FROM NATIONS)", oracle.KEYS)}""", views.H, ship_sql(FLAG, DELAY), _NATIONS)(_roll_up)
_SET = ["Supplier#000000000", "Supplier#000000001", "Supplier#000000002"]
add("stats_platform_set", oracle.merged("(SELECT * REPLACE ('Group' AS platform) FROM ST WHERE platform IN ('Supplier#000000000', 'Supplier#000000001', 'Supplier#000000002'))", oracle.KEYS), views.H, ship_sql(FLAG, DELAY))(
    lambda s, d: rp.platform_set(ship(s, d, FLAG, DELAY), _SET, "Group")
)
add("stats_quantity", f"SELECT count AS value FROM ({oracle.merged('ST', '', where=chr(34).join(['', 'column', ' = ']) + repr('flag') + ' AND variant = ' + repr('R'))})", views.H, ship_sql(FLAG))(
    lambda s, d: rp.quantity(ship(s, d, FLAG), column="flag", variant="R")
)
add("filter_period", "SELECT * FROM ST WHERE start_date >= DATE '1997-03-01' AND end_date <= DATE '1998-02-28'", views.H, ship_sql(FLAG))(lambda s, d: ship(s, d, FLAG).where(st.within(date(1997, 3, 1), date(1998, 2, 28))))
add(
    "filter_period_full_months",
    """SELECT ST.* FROM ST, (SELECT CASE WHEN day(min(start_date)) = 1 THEN min(start_date) ELSE CAST(date_trunc('month', min(start_date)) + INTERVAL 1 MONTH AS DATE) END AS a,
      CASE WHEN last_day(max(end_date)) = max(end_date) THEN max(end_date) ELSE CAST(date_trunc('month', max(end_date)) AS DATE) - 1 END AS b FROM ST) WHERE start_date >= a AND end_date <= b""",
    views.H, f"ST AS ({oracle.statistics('H', (Rows(),), 'day')})",
)(lambda s, d: rp.full_months(profile(views.shipments(s, d), Dataset((Rows(),), gather=True))))


# Extracts


_PICK = ["day", "platform", "category", "part", "started_at"]
_PICKED = "SELECT day, platform, category, part, started_at FROM H WHERE "


def _extract(test):
    return lambda s, d: views.shipments(s, d).where(test()).select(*_PICK)


add("distill_category", _PICKED + "category = '1-URGENT' OR list_contains(words, 'ring')", views.H)(
    lambda s, d: views.shipments(s, d).where((F.col("category") == "1-URGENT") | distill.with_item("words", "ring")).select(*_PICK)
)
add("distill_category_additions", _PICKED + "category = 'ring' OR list_contains(words, 'ring')", views.H)(_extract(lambda: distill.by_category("ring", additions="words")))
add("distill_platforms", _PICKED + "platform IN ('Supplier#000000001', 'Supplier#000000003')", views.H)(_extract(lambda: distill.by_platforms(["Supplier#000000001", "Supplier#000000003"])))
add("distill_expression", _PICKED + "flag = 'R' AND part % 7 = 0", views.H)(_extract(lambda: distill.by_expression("flag = 'R' AND part % 7 = 0")))
add("extract_counters", "SELECT day AS release, count(*) AS extract_rows, count(*) FILTER (category = 'purchase') AS extract_rows_with_keywords FROM E GROUP BY day", views.E)(lambda s, d: distill.counters(_with_keyword(s, d), "day", "keyword"))
add("single_category", "SELECT CASE WHEN count(DISTINCT category) = 1 THEN min(category) END AS category FROM H WHERE category = '1-URGENT'", views.H)(
    lambda s, d: checks.single_category(views.shipments(s, d).where(F.col("category") == "1-URGENT"))
)


# Timelines


_TIMELINE = """SELECT *, sum(count) OVER (PARTITION BY period)::BIGINT AS total_count, count * 100e0 / sum(count) OVER (PARTITION BY period) AS pct
FROM ({merged})"""
_M = "CAST(date_trunc('month', start_date) AS DATE) AS period"


def _timeline_sql(selector: str, unit: str, where: str) -> str:
    return _TIMELINE.format(merged=oracle.merged("ST", f"{_M if unit == 'month' else 'start_date AS period'}, {selector}", where))


add("timeline_monthly", f"SELECT t.*, CASE variant WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Not returned' WHEN 'R' THEN 'Returned' ELSE variant END AS label FROM ({_timeline_sql('variant', 'month', chr(34) + 'column' + chr(34) + ' = ' + repr('flag'))}) t", views.H, ship_sql(FLAG))(
    lambda s, d: rp.timeline(ship(s, d, FLAG), "variant", labels=s.createDataFrame(_FLAGS, "code string, label string"), column="flag", entity=None)
)
add("timeline_daily", _timeline_sql("variant", "day", "\"column\" = 'category'"), views.E, log_sql())(lambda s, d: rp.timeline(log(s, d), "variant", unit="day", column="category", entity=None))
add("timeline_entities", _timeline_sql("entity", "month", "\"column\" = 'decision_type'"), views.H, ship_sql(PATTERN))(lambda s, d: rp.timeline(ship(s, d, PATTERN), "entity", column="decision_type"))
add("monthly_sum", "SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS count, CAST(date_trunc('month', day) AS DATE) + 14 AS mid_date FROM E GROUP BY ALL", views.E)(
    lambda s, d: rp.monthly_sum(views.events(s, d).groupBy("day").agg(F.count(F.lit(1)).alias("count")), "day", "count")
)

_COUNTS = "N AS (SELECT category, day, count(*) AS count FROM E GROUP BY ALL)"


def _counts(s: SparkSession, d: str) -> DataFrame:
    return views.events(s, d).groupBy("category", "day").agg(F.count(F.lit(1)).alias("count"))


for _n in (7, 30):
    add(f"rolling_mean_{_n}d", f"SELECT *, avg(count) OVER (PARTITION BY category ORDER BY day RANGE BETWEEN INTERVAL {_n - 1} DAY PRECEDING AND CURRENT ROW) AS rolling FROM N", views.E, _COUNTS)(
        lambda s, d, n=_n: rp.rolling_days(_counts(s, d), "day", "count", n, ("category",))
    )
add("rolling_mean_rows", "SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(count) OVER w END AS rolling FROM N WINDOW w AS (PARTITION BY category ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", views.E, _COUNTS)(
    lambda s, d: rp.rolling_rows(_counts(s, d), "day", "count", 5, ("category",))
)
add("daily_series", "SELECT day AS start_date, count(*) / 1000e0 AS value FROM E GROUP BY day", views.E)(lambda s, d: rp.daily_series(log(s, d)))
add("daily_percent", "SELECT day AS start_date, count(*) FILTER (category = 'purchase') * 100e0 / count(*) AS value FROM E GROUP BY day", views.E)(
    lambda s, d: rp.daily_series(header(_with_keyword(s, d), "day", "keyword"), "extract_rows_with_keywords", "total_rows")
)
_SHARE = "SELECT {p} AS period, 'share' AS kind, count(*) FILTER (category = 'purchase') * 100e0 / count(*) AS pct FROM E GROUP BY 1"
add("keyword_fraction_daily", f"WITH S AS ({_SHARE.format(p='day')}) SELECT * FROM S UNION ALL SELECT period, 'rolling', CASE WHEN count(*) OVER w = 7 THEN avg(pct) OVER w END FROM S WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)".replace("WITH S AS", "SELECT period, kind, pct FROM (WITH S AS") + ")", views.E)(
    lambda s, d: rp.fraction(header(_with_keyword(s, d), "day", "keyword"), "extract_rows_with_keywords", "total_rows", unit="day", rolling=7)
)
add("keyword_fraction_monthly", _SHARE.format(p="CAST(date_trunc('month', day) AS DATE)"), views.E)(lambda s, d: rp.fraction(header(_with_keyword(s, d), "day", "keyword"), "extract_rows_with_keywords", "total_rows"))


# Rankings and shares


_RANKED = """V AS (SELECT brand AS variant, count(*) AS count FROM H GROUP BY brand),
R AS (SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total, count * 100e0 / sum(count) OVER () AS pct, row_number() OVER (ORDER BY count DESC, variant NULLS LAST) AS rank,
  sum(count) OVER (ORDER BY count DESC, variant NULLS LAST ROWS UNBOUNDED PRECEDING) * 100e0 / sum(count) OVER () AS cum_pct FROM V)"""
add("ranking_cumulative", "SELECT * FROM R", views.H, _RANKED)(lambda s, d: rp.ranking(rp.variants(ship(s, d, BRAND), "brand"), "variant"))
_STATUS = _RANKED.replace("SELECT brand AS variant", "SELECT CASE WHEN part % 20 = 0 THEN flag ELSE 'main' END AS variant").replace("GROUP BY brand", "GROUP BY 1")
add("ranking_tail", "SELECT *, 1 AS cut FROM R WHERE rank > 1 AND (SELECT max(cum_pct) FROM R WHERE rank = 1) > 90", views.H, _STATUS)(
    lambda s, d: rp.ranking_tail(rp.ranking(rp.variants(by_month(views.shipments(s, d).withColumn("kind", F.when(F.col("part") % 20 == 0, F.col("flag")).otherwise("main")), ValueCounts("kind")), "kind"), "variant"), ((1, 90.0),))
)
add("keyword_share", "SELECT quality AS keyword, count(*) AS count, count(*) * 100e0 / CASE WHEN quality IS NULL THEN (SELECT count(*) FROM D) ELSE (SELECT count(quality) FROM D) END AS pct FROM D GROUP BY quality", views.D)(
    lambda s, d: rp.keyword_share(docs(s, d, ValueCounts("quality")), "quality")
)
add("text_usage", "SELECT 'text' AS \"column\", coalesce(text, '␀') AS text, count(*) AS count FROM D GROUP BY ALL UNION ALL SELECT 'quality', coalesce(quality, '␀'), count(*) FROM D GROUP BY ALL", views.D)(
    lambda s, d: rp.text_usage(docs(s, d, TextCounts("text"), TextCounts("quality")), ["text", "quality"])
)
add("rows_of_text", "SELECT 'text' AS \"column\", count(*) FILTER (length(text) > 0) AS count FROM D UNION ALL SELECT 'toxic', count(*) FILTER (length(toxic) > 0) FROM D", views.D)(
    lambda s, d: rp.rows_of_text(docs(s, d, TextRows("text"), TextRows("toxic")), ["text", "toxic"])
)
add(
    "totals_by_platform",
    """SELECT platform, n AS count, CASE WHEN n < 1000 THEN printf('%d', n) WHEN n < 10000 THEN printf('%.2fK', n / 1e3) WHEN n < 100000 THEN printf('%.1fK', n / 1e3) ELSE printf('%.0fK', n / 1e3) END AS label
FROM (SELECT platform, count(*) AS n FROM H GROUP BY platform) WHERE n >= 550""",
    views.H,
)(lambda s, d: rp.platform_totals(ship(s, d, Rows()), 550))
add("usage_by_large_platform", "SELECT * FROM (SELECT *, count * 100e0 / sum(count) OVER (PARTITION BY platform) AS pct FROM (SELECT CAST(platform AS VARCHAR) AS platform, category AS variant, count(*) AS count FROM E WHERE platform IN (SELECT platform FROM E GROUP BY platform HAVING count(*) > 60) GROUP BY ALL)) WHERE pct >= 15", views.E)(
    lambda s, d: rp.usage_by_large_platform(log(s, d), "category", 60, 15.0)
)
add("top_platforms", "SELECT platform, CAST(row_number() OVER (ORDER BY n DESC, platform) AS INT) AS place FROM (SELECT platform, count(*) AS n FROM H WHERE platform NOT IN ('Supplier#000000007', 'Supplier#000000009') GROUP BY platform ORDER BY n DESC, platform LIMIT 5) UNION ALL VALUES ('Supplier#000000007', 6), ('Supplier#000000009', 7)", views.H)(
    lambda s, d: rp.top_platforms(ship(s, d, Rows()), 5, ["Supplier#000000007", "Supplier#000000009"])
)


# Durations, distinct counts, outages


add("mean_delay_overall", f"SELECT mean / 86400e0 AS days FROM ({oracle.merged('ST', '', where=chr(34) + 'column' + chr(34) + ' = ' + repr('delay') + ' AND entity IS NULL')})", views.H, ship_sql(DELAY))(lambda s, d: rp.mean_delay(ship(s, d, DELAY), "delay"))
add("delay_monthly", f"SELECT period, count, min / 86400e0 AS min_days, mean / 86400e0 AS mean_days, max / 86400e0 AS max_days FROM ({oracle.merged('ST', _M, where=chr(34) + 'column' + chr(34) + ' = ' + repr('delay') + ' AND entity IS NULL')})", views.H, ship_sql(DELAY))(
    lambda s, d: rp.delay_by_month(ship(s, d, DELAY), "delay")
)
add("distinct_platforms", "SELECT count(DISTINCT platform) AS platforms, CAST(max(CASE WHEN platform IS NULL THEN 1 ELSE 0 END) AS INT) AS with_null FROM E", views.E)(lambda s, d: rp.distinct_platforms(log(s, d)))
add("coverage", "SELECT min(day) AS first_day, max(day) AS last_day, CAST(max(day) - min(day) + 1 AS BIGINT) AS days FROM E", views.E)(lambda s, d: rp.coverage(log(s, d, Rows())))
add("first_seen", "SELECT CAST(platform AS VARCHAR) AS platform, count(*) AS rows, min(day) AS first_day FROM E GROUP BY platform", views.E)(lambda s, d: rp.first_seen(log(s, d, Rows())))
add("cumulative_distinct", "SELECT m.period, coalesce(n, 0) AS new, CAST(sum(coalesce(n, 0)) OVER (ORDER BY m.period) AS BIGINT) AS seen FROM (SELECT DISTINCT date_trunc('month', day)::DATE AS period FROM H) m LEFT JOIN (SELECT period, count(*) AS n FROM (SELECT part, min(date_trunc('month', day)::DATE) AS period FROM H GROUP BY part) GROUP BY period) f USING (period)", views.H)(
    lambda s, d: rp.cumulative_distinct(views.shipments(s, d).select(rp.month("day").alias("period"), "part"), "period", "part")
)
_GAPS = """G AS (SELECT platform, day AS before, "after", CAST("after" - day - 1 AS BIGINT) AS duration FROM (SELECT platform, day, lead(day) OVER (PARTITION BY platform ORDER BY day) AS "after" FROM (SELECT DISTINCT platform, day FROM E)) WHERE "after" - day > 1),
S AS (SELECT platform, count(*) AS outages, CAST(sum(duration) AS BIGINT) AS days_without, any_value(n) AS days_with, sum(duration) / any_value(n) < 0.2 AS has_real_outages FROM G JOIN (SELECT platform, count(DISTINCT day) AS n FROM E GROUP BY platform) USING (platform) GROUP BY platform)"""
add("outage_gaps", "SELECT * FROM G", views.E, _GAPS)(lambda s, d: rp.gaps(views.events(s, d), "platform", "day"))
add("outage_summary", "SELECT * FROM S", views.E, _GAPS)(lambda s, d: rp.outage_summary(views.events(s, d), "platform", "day"))
add("outage_list", "SELECT G.* FROM G JOIN S USING (platform) WHERE has_real_outages AND duration > 1", views.E, _GAPS)(lambda s, d: rp.outages(views.events(s, d), "platform", "day"))
add(
    "outlier_clamp",
    """SELECT t.*, c.cutoff, coalesce(t.count > c.cutoff, false) AS warning FROM N t LEFT JOIN (
  SELECT category, CASE WHEN v1 >= v3 * 1.02 AND v2 >= v3 * 1.02 THEN u3 WHEN v3 IS NOT NULL AND v1 >= v2 * 1.02 THEN u2 END AS cutoff FROM (
    SELECT *, CAST(CASE WHEN greatest(v3, 100) < 1000 THEN ceil(greatest(v3, 100) / 10e0) * 10 ELSE ceil(v3 / 100e0) * 100 END AS BIGINT) AS u3, CAST(CASE WHEN greatest(v2, 100) < 1000 THEN ceil(greatest(v2, 100) / 10e0) * 10 ELSE ceil(v2 / 100e0) * 100 END AS BIGINT) AS u2 FROM (
      SELECT category, max(count) FILTER (p = 1) AS v1, max(count) FILTER (p = 2) AS v2, max(count) FILTER (p = 3) AS v3 FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC) AS p FROM N) GROUP BY category))) c USING (category)""",
    views.E, _COUNTS,
)(lambda s, d: rp.outlier_clamp(_counts(s, d), ["category"], factor=1.02))


# Tags, domains, manifests, calendars, summary


def _tagged(s: SparkSession, d: str) -> DataFrame:
    e = views.events(s, d)
    tag = F.when(F.col("category") == "view", F.lit(None)).when(F.col("category") == "click", "KEYWORD_CLICK").when(F.col("category") == "error", "STATEMENT_CATEGORY_ERROR").otherwise(F.col("category"))
    return log(s, d, Rows()).drop("tag").crossJoin(F.broadcast(e.select(tag.alias("tag")).distinct()))  # five rows


add("tag_order", "SELECT tag, kind, CAST(row_number() OVER (ORDER BY kind, tag NULLS FIRST) AS INT) AS place FROM (SELECT DISTINCT tag, CASE WHEN tag IS NULL THEN 0 WHEN tag LIKE 'STATEMENT\\_CATEGORY\\_%' ESCAPE '\\' THEN 2 WHEN tag LIKE 'KEYWORD\\_%' ESCAPE '\\' THEN 3 ELSE 1 END AS kind FROM (SELECT CASE category WHEN 'view' THEN NULL WHEN 'click' THEN 'KEYWORD_CLICK' WHEN 'error' THEN 'STATEMENT_CATEGORY_ERROR' ELSE category END AS tag FROM E))", views.E)(
    lambda s, d: rp.tag_order(_tagged(s, d))
)
_DECLARED = [f"src{i}" for i in range(15)]


def _domain(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(x,) for x in _DECLARED], "value string")


_LIST = "L AS (SELECT 'src' || i AS value FROM range(15) t(i)), U AS (SELECT source AS value, count(*) AS rows FROM documents WHERE source NOT IN (SELECT value FROM L) GROUP BY source)"
add("unknown_domain", "SELECT * FROM U", _LIST)(lambda s, d: checks.unknown_values(table(s, d, "documents"), "source", _domain(s)))
add("domain_update", "SELECT value, CAST(row_number() OVER (ORDER BY lower(value), value) AS INT) AS ordinal FROM (SELECT value FROM L UNION SELECT value FROM U)", _LIST)(
    lambda s, d: checks.extended_domain(_domain(s), checks.unknown_values(table(s, d, "documents"), "source", _domain(s)))
)
_ALIASES = [("src1", "One"), ("src2", "Two"), ("src11", "One")]
add("canonical_names", "SELECT CASE source WHEN 'src1' THEN 'One' WHEN 'src2' THEN 'Two' WHEN 'src11' THEN 'One' ELSE source END AS source, count(*) AS rows FROM documents GROUP BY 1")(
    lambda s, d: checks.canonical(table(s, d, "documents").select("source"), "source", s.createDataFrame(_ALIASES, "alias string, canonical string")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
)
add("canonical_lookup", "SELECT n.name, d.n_name AS value FROM (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT n_name || 'x' FROM nation) n LEFT JOIN nation d ON lower(d.n_name) = lower(n.name)")(
    lambda s, d: checks.find_canonical(table(s, d, "nation").select(F.lower("n_name").alias("name")).union(table(s, d, "nation").select(F.concat("n_name", F.lit("x")))), table(s, d, "nation").select(F.col("n_name").alias("value")))
)
_TITLE = "list_aggregate(list_transform(regexp_extract_all(lower(replace(o_orderpriority, '_', ' ')), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"
for _old, _new in tx.FRAGMENTS.items():
    _TITLE = f"replace({_TITLE}, '{_old}', '{_new}')"
add("humanized_labels", f"SELECT o_orderpriority AS code, {_TITLE} AS label, 'CODE_' || replace(replace(o_orderpriority, '-', '_'), ' ', '_') AS tag FROM (SELECT DISTINCT o_orderpriority FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("code"), tx.humanize(F.col("o_orderpriority")).alias("label"), tx.normalize_code(F.col("o_orderpriority"), "CODE_").alias("tag"))
)
add("manifest_from_stats", "SELECT day AS release, CAST(NULL AS BIGINT) AS batch_count, count(*) AS total_rows, count(*) FILTER (category = 'purchase') AS total_rows_with_keywords, count(*) AS extract_rows, count(*) FILTER (category = 'purchase') AS extract_rows_with_keywords FROM E GROUP BY day", views.E)(
    lambda s, d: checks.manifest_from_stats(header(_with_keyword(s, d), "day", "keyword"))
)


def _manifests(s: SparkSession, d: str) -> DataFrame:
    e = views.events(s, d)
    a = distill.counters(_with_keyword(s, d).where("day < date'2024-01-20'"), "day", "keyword")
    b = distill.counters(e.where("day > date'2024-01-10'").withColumn("keyword", F.when(F.col("category").isin("purchase", "view") & (F.col("day") > date(2024, 1, 15)), F.lit(1)).when(F.col("category") == "purchase", F.lit(1))), "day", "keyword")
    return checks.merge_manifests(a, b, ["extract_rows", "extract_rows_with_keywords"])


add(
    "manifest_merge",
    """SELECT coalesce(a.day, b.day) AS release, coalesce(a.n, b.n) AS extract_rows, coalesce(a.k, b.k) AS extract_rows_with_keywords, coalesce(a.n <> b.n, false) OR coalesce(a.k <> b.k, false) AS conflict
FROM (SELECT day, count(*) AS n, count(*) FILTER (category = 'purchase') AS k FROM E WHERE day < DATE '2024-01-20' GROUP BY day) a
FULL OUTER JOIN (SELECT day, count(*) AS n, count(*) FILTER (category = 'purchase' OR category = 'view' AND day > DATE '2024-01-15') AS k FROM E WHERE day > DATE '2024-01-10' GROUP BY day) b ON a.day = b.day""",
    views.E,
)(_manifests)
add("missing_days", "SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM E EXCEPT SELECT day FROM E WHERE platform = 7", views.E)(
    lambda s, d: checks.missing_days(checks.calendar(views.events(s, d), "day"), views.events(s, d).where("platform = 7").select("day").distinct())
)
add("broken_sequence", "SELECT platform, event_id, previous FROM (SELECT platform, event_id, lag(event_id) OVER (PARTITION BY platform ORDER BY event_id) AS previous FROM E) WHERE event_id <> previous + 1", views.E)(
    lambda s, d: checks.broken_sequence(views.events(s, d), ["platform"], "event_id")
)
add("bad_list_items", "SELECT * FROM (SELECT day, platform, part, len(list_filter(list_distinct(words), lambda x: x NOT IN ('small', 'ring', 'red'))) AS n_bad FROM H) WHERE n_bad > 0", views.H)(
    lambda s, d: checks.bad_list_items(views.shipments(s, d), "words", ["small", "ring", "red"]).select("day", "platform", "part", F.size("bad_items").cast("long").alias("n_bad"))
)
_SUMMARY = """,
M AS (SELECT tag, "column", entity, variant, text, CAST(coalesce(sum(count), 0) AS BIGINT) AS count, min(min) AS min, CAST(sum(CAST(mean AS HUGEINT) * count) // nullif(sum(count) FILTER (mean IS NOT NULL), 0) AS BIGINT) AS mean, max(max) AS max FROM ST GROUP BY ALL),
K AS (SELECT tag, "column", entity, bool_or(variant IS NOT NULL OR text IS NOT NULL) AS v FROM M GROUP BY ALL),
N AS (SELECT M.*, v, replace(regexp_replace(text, '[\\x09-\\x0D\\x20]+', ' ', 'g'), '|', '') AS t FROM M JOIN K ON M.tag IS NOT DISTINCT FROM K.tag AND M."column" = K."column" AND M.entity IS NOT DISTINCT FROM K.entity),
V AS (SELECT *, concat_ws('.', "column", entity, coalesce(CASE WHEN length(t) > 70 THEN t[1:70] || '…' ELSE t END, variant, CASE WHEN v THEN 'is_null' END)) AS name,
  list_position(['batch_count', 'extract_rows', 'extract_rows_with_keywords', 'total_rows', 'total_rows_with_keywords'], "column") AS place FROM N),
Q AS (SELECT *, 0 AS i, CASE WHEN min IS NOT NULL THEN name || '.count' ELSE name END AS variable, count AS value FROM V WHERE count > 0 OR max IS NULL
  UNION ALL SELECT *, 1, name || '.min', min FROM V WHERE min IS NOT NULL UNION ALL SELECT *, 2, name || '.mean', mean FROM V WHERE mean IS NOT NULL UNION ALL SELECT *, 3, name || '.max', max FROM V WHERE max IS NOT NULL),
P AS (SELECT tag, platform, sum(count) AS n, min(start_date) AS d FROM ST WHERE "column" = 'rows' AND platform IS NOT NULL GROUP BY ALL),
A AS (SELECT tag, CASE WHEN place > 0 THEN 0 ELSE 1 END AS section, CASE WHEN place > 0 THEN CAST(place AS VARCHAR) ELSE "column" END AS a, entity AS b, count AS n, variant AS c, i, text, variable, CAST(value AS VARCHAR) AS value FROM Q
  UNION ALL SELECT tag, 2, NULL, NULL, n, platform, 0, NULL, 'platform.' || platform || '.rows', CAST(n AS VARCHAR) FROM P
  UNION ALL SELECT tag, 3, NULL, NULL, -(d - DATE '1970-01-01'), platform, 0, NULL, 'platform.' || platform || '.start_date', CAST(d AS VARCHAR) FROM P)
SELECT tag, section, CAST(row_number() OVER (PARTITION BY tag ORDER BY section, a, b NULLS FIRST, n DESC, coalesce(text, c) DESC NULLS LAST, i, variable) AS INT) AS ordinal, variable, text, value FROM A"""
_TEXTS = (Rows(), ValueCounts("quality"), TextRows("text"), TextCounts("text"))


def _summary(name: str, view: str, sql: str):
    """Registers a summary; its SQL goes on with the list of views."""

    def put(f):
        QUERIES[name], ORACLES[name] = f, f"WITH {view}, {sql}{_SUMMARY}"
        return f

    return put


_summary("summary_table", views.D, docs_sql(*_TEXTS))(lambda s, d: rp.summary(docs(s, d, *_TEXTS)))
_summary("summary_durations", views.H, ship_sql(Rows(), DELAY, WORDS, PATTERN))(lambda s, d: rp.summary(ship(s, d, Rows(), DELAY, WORDS, PATTERN)))


def _opened(s: SparkSession, d: str) -> DataFrame:
    """Statistics of documents with their header, under a tag."""
    return docs(s, d, Rows(), TextCounts("text"), tag="t").unionByName(header(views.documents(s, d).withColumn("day", F.lit(date(2024, 1, 31))), "day", "quality")).unionByName(
        header(views.documents(s, d).where("toxic = 'TOXIC'").withColumn("day", F.lit(date(2024, 1, 31))), "day", "quality", "t").where("column not like 'total%'")
    )


add(
    "report_intro",
    """SELECT nullif(count(*) FILTER (toxic = 'TOXIC'), 0) AS extract_rows, count(*) AS total_rows, count(DISTINCT platform) + 1 AS platforms, CAST(31 AS BIGINT) AS days, DATE '2024-01-01' AS first_day, DATE '2024-01-31' AS last_day,
  (SELECT count(*) FROM (SELECT DISTINCT platform, text FROM D WHERE text IS NOT NULL)) AS text_entries, count(DISTINCT text) + 1 AS texts FROM D""",
    views.D,
)(lambda s, d: rp.intro(_opened(s, d), "t"))
add("value_counts", "SELECT brand AS variant, CAST(NULL AS VARCHAR) AS text, count(*) AS count FROM H GROUP BY brand", views.H)(lambda s, d: rp.value_counts(ship(s, d, BRAND), "brand"))
_SEEN = """P AS (SELECT date_trunc('month', day)::DATE AS period, platform, flag FROM H WHERE flag <> 'A' OR platform NOT LIKE '%1'),
F AS (SELECT platform, min(period) AS a, min(period) FILTER (flag <> 'N') AS b, min(period) FILTER (flag = 'R') AS c FROM P GROUP BY platform),
K AS (SELECT 'all' AS kind, a AS period FROM F UNION ALL SELECT 'with keywords', b FROM F UNION ALL SELECT 'R', c FROM F),
G AS (SELECT period, kind, (SELECT count(*) FROM K one WHERE one.kind = any_.kind AND one.period = span.period) AS new FROM (SELECT DISTINCT period FROM P) span, (SELECT DISTINCT kind FROM K) any_)"""
add("cumulative_platforms", "SELECT *, CAST(sum(new) OVER (PARTITION BY kind ORDER BY period) AS BIGINT) AS seen FROM G", views.H, _SEEN)(
    lambda s, d: rp.cumulative_platforms(by_month(views.shipments(s, d).where("flag <> 'A' or platform not like '%1'").withColumn("flag", F.when(F.col("flag") != "N", F.col("flag"))), FLAG), "flag", "R")
)
add("stratification", "SELECT coalesce(bool_or(category IS NOT NULL), false) AS by_category, NOT coalesce(bool_or(entity = 'rows_of_text'), false) AS all_text FROM ST", views.D, docs_sql(*_TEXTS))(lambda s, d: checks.stratification(docs(s, d, *_TEXTS)))


# Audit of an extract: users of a day stand for its batch files


def _files(s: SparkSession, d: str) -> DataFrame:
    users = views.events(s, d).select("day", "platform").distinct()
    numbered = users.withColumn("batch", F.row_number().over(Window.partitionBy("day").orderBy("platform")) - 1).where("platform % 13 <> 0 or dayofmonth(day) % 2 = 0")
    own = (F.col("platform") % 5).cast("string")
    return numbered.select(F.col("day").alias("release"), "batch", own.alias("digest"), F.when(F.col("platform") % 50 == 1, F.lit("x")).otherwise(own).alias("expected"))


def _audited(s: SparkSession, d: str) -> DataFrame:
    return views.events(s, d).groupBy(F.col("day").alias("release")).agg(F.count_distinct("platform").alias("batch_count")).where(F.dayofmonth("release") % 7 != 0)


_FILES = """F AS (SELECT day AS release, batch, CAST(platform % 5 AS VARCHAR) AS digest, CASE WHEN platform % 50 = 1 THEN 'x' ELSE CAST(platform % 5 AS VARCHAR) END AS expected
  FROM (SELECT day, platform, row_number() OVER (PARTITION BY day ORDER BY platform) - 1 AS batch FROM (SELECT DISTINCT day, platform FROM E)) WHERE platform % 13 <> 0 OR day(day) % 2 = 0),
M AS (SELECT day AS release, count(DISTINCT platform) AS batch_count FROM E WHERE day(day) % 7 <> 0 GROUP BY day),
S AS (SELECT release, count(*) AS n FROM F GROUP BY release)"""
add(
    "manifest_audit",
    """SELECT release, 'missing day' AS problem, CAST(NULL AS VARCHAR) AS detail FROM (SELECT CAST(unnest(generate_series(min(release), max(release), INTERVAL 1 DAY)) AS DATE) AS release FROM M EXCEPT SELECT release FROM M)
UNION ALL SELECT release, 'batch count', CAST(coalesce(n, 0) AS VARCHAR) FROM M LEFT JOIN S USING (release) WHERE coalesce(n, 0) <> batch_count
UNION ALL SELECT release, 'unknown day', NULL FROM S WHERE release NOT IN (SELECT release FROM M)
UNION ALL SELECT release, 'missing batch', CAST(p + 1 AS VARCHAR) FROM (SELECT release, batch, lag(batch) OVER (PARTITION BY release ORDER BY batch) AS p FROM F) WHERE batch <> p + 1
UNION ALL SELECT release, 'digest', CAST(batch AS VARCHAR) FROM F WHERE digest <> expected""",
    views.E, _FILES,
)(lambda s, d: checks.audit(_audited(s, d), _files(s, d)))
add("complete_days", "SELECT release FROM M JOIN S USING (release) WHERE n = batch_count", views.E, _FILES)(lambda s, d: checks.complete_days(_audited(s, d), _files(s, d)))
add("canonical_order", "SELECT * FROM ST", views.H, ship_sql(Rows()))(
    lambda s, d: st.canonical_order(ship(s, d, Rows()), table(s, d, "supplier").select(F.col("s_name").alias("platform"), F.col("s_suppkey").alias("ordinal")))
)
