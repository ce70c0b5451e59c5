"""Queries that write on their way: ingest, incremental refresh, streams, logs. Their files go to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.functions.stats import SCHEMA
from dayledger.operators import checks
from dayledger.operators.profile import profile
from dayledger.operators.spec import Dataset, Rows, Slot, ValueCounts
from dayledger.plans import oracle, views
from dayledger.plans.queries import ORACLES, add
from dayledger.sources import logs, records, tables
from dayledger.streaming import daily, incremental, sightings

_DATA = Dataset((Rows(), ValueCounts("category")))
_STATS = f"ST AS ({oracle.statistics('E', _DATA.specs)})"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments in the text form of statement records, with a bad time in every 97th part."""
    h, none = views.shipments(spark, sf_dir), F.lit(None).cast("string")
    time = lambda c: F.date_format(F.col(c).cast("timestamp"), records.TIME_FORMAT)
    text = {
        "uuid": F.col("part").cast("string"), "platform_name": F.col("platform"), "category": F.col("category"),
        "decision_visibility": F.when(F.col("d_vis").isNotNull(), F.concat(F.lit('["'), F.col("d_vis"), F.lit('"]'))).otherwise("[]"),
        "decision_monetary": F.col("d_mon"), "decision_provision": F.col("d_pro"), "decision_account": F.col("d_acc"),
        "category_specification": F.concat(F.lit('["'), F.array_join("words", '","'), F.lit('"]')),
        "territorial_scope": F.lit("[" + ",".join(f'"{c}"' for c in records.EU) + "]"),
        "decision_facts": F.concat(F.lit('He said "'), F.col("brand"), F.lit('",\nthen left')),
        "application_date": F.when(F.col("part") % 97 == 0, "yesterday").otherwise(time("started_at")), "created_at": time("ended_at"),
    }
    return h.select(*[text.get(c, none).alias(c) for c in records.FIELDS], F.col("day"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = tables.shared_path(spark)
    rows = _statements(spark, sf_dir).drop("day")
    records.write_csv(rows, path)
    aliases = spark.createDataFrame([("Supplier#000000001", "First")], "alias string, canonical string")
    return records.ingest(records.read_csv(spark, path), F.to_date(F.substring("created_at", 1, 10)), aliases)


@add(
    "csv_ingest",
    """SELECT CASE platform WHEN 'Supplier#000000001' THEN 'First' ELSE platform END AS platform_name, d_vis AS visibility, array_to_string(words, '|') AS keywords, 'EU' AS territory,
  'He said "' || brand || '",' || chr(10) || 'then left' AS facts, day AS released_on, CAST(count(*) AS BIGINT) AS rows, min(started_at) AS first
FROM H WHERE part % 97 <> 0 GROUP BY ALL""",
    views.H,
)
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _ingested(spark, sf_dir)
    return good.groupBy(
        "platform_name", F.array_join("decision_visibility", "|").alias("visibility"), F.array_join("category_specification", "|").alias("keywords"), F.array_join("territorial_scope", "|").alias("territory"), F.col("decision_facts").alias("facts"), "released_on"
    ).agg(F.count(F.lit(1)).alias("rows"), F.min("application_date").cast("timestamp_ntz").alias("first"))


@add("csv_quarantine", "SELECT CAST(part AS VARCHAR) AS uuid, 'application_date: not a time' AS reason, count(*) AS rows FROM H WHERE part % 97 = 0 GROUP BY part", views.H)
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = _ingested(spark, sf_dir)
    return bad.groupBy("uuid", F.array_join("reasons", "; ").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@add("csv_line_counts", "SELECT CAST(sum(2 ) AS BIGINT) AS rows, CAST(sum(CASE WHEN list_contains(words, 'ring') THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_keywords FROM H", views.H)
def csv_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the statements' files: each record's text holds a newline, so it is two of them."""
    path = tables.shared_path(spark)
    records.write_csv(_statements(spark, sf_dir).drop("day"), path)
    return tables.text_row_counts(spark, path, '""ring""').agg(F.sum("rows").alias("rows"), F.sum("rows_with_keywords").alias("rows_with_keywords"))


@add("incremental_refresh", "SELECT * FROM ST", views.E, _STATS)
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day first, then the holes, then a run with nothing to do, which reads no data."""
    path, e = tables.shared_path(spark), views.events(spark, sf_dir)
    incremental.refresh(e.where(F.dayofmonth("day") % 3 == 0), _DATA, path)
    incremental.refresh(e, _DATA, path)
    if incremental.refresh(e, _DATA, path):
        raise AssertionError("a second run found days to add")
    return incremental.combined(spark, path)


@add("extract_metadata", "SELECT day, CAST(1 AS BIGINT) AS batch_count, count(*) AS extract_rows, count(*) FILTER (category = 'purchase') AS extract_rows_with_keywords FROM E WHERE category IN ('purchase', 'error') GROUP BY day", views.E)
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a distilled extract, from its files."""
    from dayledger.operators.distill import extract_metadata as recount

    path = tables.shared_path(spark)
    e = views.events(spark, sf_dir).withColumn("keyword", F.when(F.col("category") == "purchase", 1))
    incremental.refresh_extract(e, F.col("category").isin("purchase", "error"), path, "day")
    return recount(tables.read_extract(spark, path, e.schema), "day", "keyword").withColumnRenamed("release", "day")


@add("stream_statistics", "SELECT * FROM ST", views.E, _STATS)
def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' statistics by way of a file stream that ends when it has read what there is."""
    out, checkpoint = tables.shared_path(spark), tables.shared_path(spark)
    schema = tables.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    e = events.select(F.col("ts").cast("date").alias("day"), F.col("user_id").alias("platform"), F.col("event_type").alias("category"))
    daily.stream_statistics(e, _DATA, out, checkpoint).awaitTermination()
    return daily.streamed(spark, out)


@add("stream_daily", "SELECT day, category, count(*) AS count FROM E WHERE day < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM E) GROUP BY ALL", views.E)
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days of the event stream; the days that the watermark has passed."""
    out, checkpoint = tables.shared_path(spark), tables.shared_path(spark)
    schema = tables.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("event_type", "category")
    q = daily.daily_windows(events, "ts", "category").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("day date, category string, count long").parquet(out)


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """Logs in the shape of the engine's own, one file a day, made from events."""
    path, e = tables.shared_path(spark), views.events(spark, sf_dir)
    head = F.concat_ws(logs.SEPARATOR, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("platform").cast("string"), F.lit("processor"), F.lit("INFO"))
    batch = F.format_string('summarized batch file="sor-%s-full-00001", latency=%s, unit="min"', F.col("day").cast("string"), F.col("value").cast("string"))
    memory = F.format_string('maximum resident-set-size=%s, unit="MB", release="%s"', F.col("value").cast("string"), F.col("day").cast("string"))
    line = F.concat(head, F.lit(logs.SEPARATOR), F.when(F.col("category") == "error", memory).otherwise(batch), F.when(F.col("event_id") % 5 == 0, "\nTraceback:\n  at line 1").otherwise(""))
    e.select("day", "event_id", line.alias("value")).repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(path)
    return path


@add("oplog_metrics", "SELECT CAST(day AS VARCHAR) AS release, metric, count(*) AS n, max(value) AS most FROM (SELECT day, CASE WHEN category = 'error' THEN 'max-rss' ELSE 'latency' END AS metric, CASE WHEN category = 'error' THEN value / 1024.0e0 ELSE value * 60.0e0 END AS value FROM E) GROUP BY ALL", views.E)
def oplog_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the logs measure."""
    series = logs.metrics(logs.entries(logs.read_lines(spark, _logs(spark, sf_dir))))
    return series.groupBy("release", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@add("metrics_csv", ORACLES["oplog_metrics"])
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a file of metrics."""
    path = tables.shared_path(spark)
    logs.write_metrics(logs.metrics(logs.entries(logs.read_lines(spark, _logs(spark, sf_dir)))), path)
    return logs.read_metrics(spark, path).groupBy("release", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@add(
    "log_workers",
    """SELECT CAST(day AS VARCHAR) AS release, platform AS pid, CAST(nullif(row_number() OVER (PARTITION BY day ORDER BY first) - 1, 0) AS INT) AS worker FROM (SELECT day, platform, min(event_id) AS first FROM E GROUP BY ALL)""",
    views.E,
)
def log_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each process in its file, by first appearance; the first one coordinates."""
    series = logs.metrics(logs.entries(logs.read_lines(spark, _logs(spark, sf_dir))))
    return series.groupBy("release", "pid").agg(F.max("worker").alias("worker"))


@add(
    "log_properties",
    """SELECT event_id, category AS kind, event_id AS n, value AS x, event_id % 2 = 0 AS even, event_id % 3 = 0 AS last FROM E""",
    views.E,
)
def log_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values out of messages: text, whole numbers with underscores, numbers, flags, empty text, a repeated key."""
    e = views.events(spark, sf_dir)
    n = F.regexp_replace(F.col("event_id").cast("string"), r"(\d)(\d{3})$", "$1_$2")
    message = F.concat(F.lit("seen kind="), F.lit('"'), "category", F.lit('", n='), n, F.lit(", x="), F.col("value").cast("string"), F.lit(', none="", even="'), (F.col("event_id") % 2 == 0).cast("string"), F.lit('", last="TRUE", last="'), (F.col("event_id") % 3 == 0).cast("string"), F.lit('"'))
    p = e.select("event_id", logs.typed(message).alias("p")).where("p['none']['text'] is null and p['none']['flag'] is null and map_contains_key(p, 'none')")
    return p.select("event_id", F.expr("p['kind']['text']").alias("kind"), F.expr("p['n']['whole']").alias("n"), F.expr("coalesce(p['x']['number'], p['x']['whole'])").alias("x"), F.expr("p['even']['flag']").alias("even"), F.expr("p['last']['flag']").alias("last"))


@add("manifest_json", "SELECT day AS release, CAST(NULL AS BIGINT) AS batch_count, count(*) AS total_rows, count(*) FILTER (category = 'purchase') AS total_rows_with_keywords FROM E GROUP BY day", views.E)
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the events' days, one JSON document, written and read."""
    path = tables.shared_path(spark)
    e = views.events(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("category") == "purchase").alias("total_rows_with_keywords"))
    entry = F.struct(F.col("day").cast("string"), F.struct("total_rows", "total_rows_with_keywords"))
    e.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("releases"))).alias("value")).write.text(path)  # a row per day of the calendar
    return tables.read_manifest(spark, path).select("release", "batch_count", "total_rows", "total_rows_with_keywords")


@add("statistics_copy", "SELECT * FROM ST", views.E, _STATS)
def statistics_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written once, not written again as they are, and read with their schema and domain checked."""
    path, stats = tables.shared_path(spark), profile(views.events(spark, sf_dir), _DATA)
    if not tables.copy_statistics(stats, path) or tables.copy_statistics(stats, path):
        raise AssertionError("the first copy is to be written, the second is not")
    users = views.events(spark, sf_dir).select(F.col("platform").cast("string").alias("value")).distinct()
    return tables.check_schema(tables.read_statistics(spark, path, domain=users), SCHEMA)


@add("statistics_reschema", "SELECT * REPLACE ('all' AS tag) FROM ST", views.E, _STATS)
def statistics_reschema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored statistics rewritten with a tag."""
    old, new = tables.shared_path(spark), tables.shared_path(spark)
    incremental.refresh(views.events(spark, sf_dir), _DATA, old)
    incremental.reschema(spark, old, new, lambda stats: stats.withColumn("tag", F.lit("all")))
    return tables.read_statistics(spark, new)


@add(
    "extract_summary",
    "SELECT * FROM ST", "E0 AS (SELECT CAST(ts AS DATE) AS day, CASE user_id WHEN 1 THEN 'one' WHEN 2 THEN 'one' ELSE CAST(user_id AS VARCHAR) END AS platform, event_type AS category FROM events WHERE event_type IN ('purchase', 'error'))",
    f"ST AS ({oracle.statistics('E0', _DATA.specs, tag='some')})",
)
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts distilled on demand, then summarised under canonical names; a second run has nothing to do."""
    extract, path = tables.shared_path(spark), tables.shared_path(spark)
    e = views.events(spark, sf_dir).select("day", F.col("platform").cast("string").alias("platform"), "category")
    aliases = spark.createDataFrame([("1", "one"), ("2", "one")], "alias string, canonical string")
    run = lambda rows: incremental.summarize_extract(rows, F.col("category").isin("purchase", "error"), extract, _DATA, path, "some", aliases)
    run(e.where(F.dayofmonth("day") % 2 == 0))
    run(e)
    if run(e) != ([], []):
        raise AssertionError("a third run found days to add")
    return incremental.combined(spark, path)


@add("csv_versions", "SELECT day % 2 = 0 AS newer, count(*) AS rows, count(*) FILTER (day % 2 = 0) AS with_ean FROM (SELECT part AS day FROM H) GROUP BY ALL", views.H)
def csv_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two versions, without and with a product code, as one table."""
    rows = _statements(spark, sf_dir).drop("day").withColumn("content_id_ean", F.lit("4006381333931"))
    old, new = tables.shared_path(spark), tables.shared_path(spark)
    even = F.col("uuid").cast("long") % 2 == 0
    records.write_csv(rows.where(~even).drop("content_id_ean"), old)
    records.write_csv(rows.where(even), new)
    read = records.read_all_versions(spark, [old], [new])
    return read.groupBy(even.alias("newer")).agg(F.count(F.lit(1)).alias("rows"), F.count("content_id_ean").alias("with_ean"))


@add("file_digests", None)
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the given tables' files, and how they differ from a list that lacks the empty ones."""
    found = tables.written(tables.file_digests(spark, f"{sf_dir}/*.parquet"))  # used three times; each file is read once
    differing = checks.digest_differences(found, found.where("bytes > 4096")).select("path", F.lit(True).alias("unlisted"))
    return found.join(differing, "path", "left").select(F.element_at(F.split("path", "/"), -1).alias("file"), "digest", "bytes", F.coalesce("unlisted", F.lit(False)).alias("unlisted"))


@add(
    "written_digests",
    """SELECT day, sha256(string_agg(event_id || ',' || category || chr(10), '' ORDER BY event_id)) AS digest, CAST(sum(strlen(event_id || ',' || category) + 1) AS BIGINT) AS bytes FROM E GROUP BY day""",
    views.E,
)
def written_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files written from the events, a file a day: every second one (by size) as a value, the others piece by piece."""
    path = tables.shared_path(spark)
    lines = views.events(spark, sf_dir).select("day", "event_id", F.concat_ws(",", F.col("event_id").cast("string"), "category").alias("value"))
    lines.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(path)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.median("length").cast("long")).first()[0] or 0
    found = tables.file_digests(spark, path, large=sizes)
    return found.select(F.regexp_extract("path", r"day=(\d{4}-\d{2}-\d{2})", 1).cast("date").alias("day"), "digest", "bytes")


@add(
    "sightings_cumulative",
    "SELECT 'platform' AS kind, period, new, CAST(sum(new) OVER (ORDER BY period) AS BIGINT) AS seen FROM (SELECT period, count(*) AS new FROM (SELECT platform, min(day) AS period FROM E GROUP BY platform) GROUP BY period)",
    views.E,
)
def sightings_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by day, from first sightings that each refresh of the statistics adds to: late days, holes, and a compaction between."""
    path, seen, e = tables.shared_path(spark), tables.shared_path(spark), views.events(spark, sf_dir)
    for part in (F.dayofmonth("day") % 3 == 0, F.dayofmonth("day") % 3 != 1, F.lit(True)):
        days = incremental.refresh(e.where(part), _DATA, path)
        if sightings.refresh_sightings(spark, path, seen) != [str(d) for d in days]:
            raise AssertionError("sightings read other days than those that came")
        if len(days) % 2:
            sightings.compact_sightings(spark, seen)
    return sightings.cumulative(sightings.read_sightings(spark, seen).where("kind = 'platform'"))


@add("sightings_distinct", "SELECT 'platform' AS kind, count(DISTINCT platform) AS n, true AS near FROM E", views.E)
def sightings_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users exactly, and whether sketches of days that were merged come within 5 % of it."""
    path, seen, e = tables.shared_path(spark), tables.shared_path(spark), views.events(spark, sf_dir)
    incremental.refresh(e, _DATA, path)
    sightings.refresh_sightings(spark, path, seen)
    near = sightings.approximate_counts(sightings.sketches(e, "day", {"platform": "platform"})).select(F.col("kind").alias("of"), F.col("n").alias("about"))
    counts = sightings.distinct_values(sightings.read_sightings(spark, seen).where("kind = 'platform'"))
    return counts.join(near, counts["kind"] == near["of"]).select("kind", "n", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near"))


@add(
    "batch_files",
    "SELECT '2024-01-01' AS release, CAST(NULL AS INT) AS batch, count(*) AS rows, count(DISTINCT part) AS parts FROM H WHERE month(day) % 2 = 0 UNION ALL SELECT '2024-01-02', 1, count(*), count(DISTINCT part) FROM H WHERE month(day) % 2 = 1 AND part % 2 = 1",
    views.H,
)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches of one release, and one batch of another, by the names of their files."""
    path = tables.shared_path(spark)
    rows = tables.written(_statements(spark, sf_dir).withColumns({"month": F.month("day") % 2, "batch": F.col("uuid").cast("long") % 2}).drop("day"))
    for month, release in ((0, "2024-01-01"), (1, "2024-01-02")):
        for batch in (0, 1):
            own = rows.where(f"month = {month} and batch = {batch}").drop("month", "batch")
            records.write_csv(own, f"{path}/sor-global-{release}-full-{batch:05d}-00000.csv")
    read = lambda release, batch: records.read_batch(spark, path, release, batch).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("uuid").alias("parts")).select(F.lit(release).alias("release"), F.lit(batch).cast("int").alias("batch"), "rows", "parts")
    return read("2024-01-01", None).unionByName(read("2024-01-02", 1))


@dataclass(frozen=True)
class _Large:
    """A declaration of one's own: rows above a bound, and the measure of the whole numbers below the values."""

    column: str
    bound: float

    def slots(self) -> list[Slot]:
        return [Slot((("large", "count"),), when=F.col(self.column) > self.bound), Slot(((None, "measure"),), x=F.floor(self.column))]


_KEYS = """SELECT day AS start_date, day AS end_date, CAST(NULL AS VARCHAR) AS tag, CAST(platform AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS category, 'value' AS "column" """


@add(
    "profile_own_spec",
    f"""{_KEYS}, 'large' AS entity, CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS text, count(*) FILTER (value > 50) AS count, CAST(NULL AS BIGINT) AS min, CAST(NULL AS BIGINT) AS mean, CAST(NULL AS BIGINT) AS max FROM E GROUP BY ALL
UNION ALL {_KEYS}, NULL, NULL, NULL, count(*), CAST(min(floor(value)) AS BIGINT), CAST(trunc(avg(floor(value))) AS BIGINT), CAST(max(floor(value)) AS BIGINT) FROM E GROUP BY ALL""",
    views.E,
)
def profile_own_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile by a declaration that isn't the library's."""
    return profile(views.events(spark, sf_dir), Dataset((_Large("value", 50.0),)))
