"""Operational logs as a text job: entries with their continuation lines, and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayledger.operators.ordered import last_known, running_sums
from dayledger.sources.tables import written

SEPARATOR = "︙"
#: Fixed pattern: key=number or key="text" in a message.
_PAIR = r'([-_a-zA-Z0-9]+)=([_0-9]+(?:\.[0-9]+)?|"[^"]*")'


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, block, at, value): the lines of log files and their places; a large file is as many blocks as Spark reads it in.

    Rows with a larger at come later in the same block. Lines may be empty.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _last(pairs: Column) -> Column:
    """Of a key's pairs the last. The array of one binds pairs to a variable, else each element would parse the message again."""
    last = lambda ps: F.filter(ps, lambda x, i: ~F.array_contains(F.transform(F.slice(ps, i + 2, F.size(ps)), lambda y: y["k"]), x["k"]))
    return F.get(F.transform(F.array(pairs), last), F.lit(0))


def properties(message: Column) -> Column:
    """Map of a message's key=value pairs; quotes off, underscores out of numbers."""
    keys, values = F.regexp_extract_all(message, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(message, F.lit(_PAIR), F.lit(2))
    plain = F.transform(values, lambda v: F.when(v.startswith('"'), F.btrim(v, F.lit('"'))).otherwise(F.replace(v, F.lit("_"), F.lit(""))))
    return F.map_from_entries(_last(F.arrays_zip(keys.alias("k"), plain.alias("v"))))


def typed(message: Column) -> Column:
    """Map of a message's key=value pairs with typed values: (text, whole, number, flag), one of them set.

    Quoted true and false in any case are flags, other quoted text is text, and an empty
    one is null throughout; numbers are whole without a point.
    """
    keys, values = F.regexp_extract_all(message, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(message, F.lit(_PAIR), F.lit(2))

    def value(v: Column) -> Column:
        quoted, text, digits = v.startswith('"'), F.nullif(F.btrim(v, F.lit('"')), F.lit("")), F.replace(v, F.lit("_"), F.lit(""))
        flag = F.lower(text).isin("true", "false")
        return F.struct(
            F.when(quoted & ~flag, text).alias("text"), F.when(~quoted & ~F.contains(v, F.lit(".")), digits.try_cast("long")).alias("whole"),
            F.when(~quoted & F.contains(v, F.lit(".")), digits.try_cast("double")).alias("number"), F.when(quoted & flag, F.lower(text) == "true").alias("flag"),
        )

    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(F.transform(_last(pairs), lambda x: F.struct(x["k"], value(x["v"]))))


def entries(lines: DataFrame) -> DataFrame:
    """(file, block, line, timestamp, pid, module, level, prefix, props, trace): lines without the separator belong to the entry before.

    line is the number of an entry's first line in its file, block where it is. An entry
    that a block leaves open goes on in the next, so a file is read by as many tasks as it has blocks.
    """
    start = F.contains("value", F.lit(SEPARATOR))
    counted = running_sums(lines, ["file"], "block", ["at"], {"line": F.lit(1), "entry": start.cast("int")})
    marked = counted.where("entry > 0 and value <> ''").withColumn("start", start)
    grouped = marked.groupBy("file", "entry").agg(
        F.min("line").alias("line"), F.min("block").alias("block"), F.max(F.when(F.col("start"), F.col("value"))).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("start"), F.struct("line", "value")))), lambda x: x["value"]), "\n").alias("trace"),
    )
    parts = F.split("head", SEPARATOR)
    message = F.get(parts, F.lit(4))
    return grouped.select(
        "file", "block", "line", F.try_to_timestamp(F.get(parts, F.lit(0))).alias("timestamp"), F.get(parts, F.lit(1)).try_cast("long").alias("pid"), F.get(parts, F.lit(2)).alias("module"),
        F.get(parts, F.lit(3)).alias("level"), F.btrim(F.regexp_replace(message, _PAIR + r"(,\s*)?", "")).alias("prefix"), properties(message).alias("props"), F.nullif("trace", F.lit("")).alias("trace"),
    )


def kind(entry: DataFrame) -> Column:
    """What an entry tells: task start, job start, job done, batch, combined, memory, or null. Prefixes and keys are fixed values of the format."""
    p, has = F.col("prefix"), lambda *keys: F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key("props", k))
    return (
        F.when(p.isin("running processor with", "running multiprocessor with") & has("pid", "task"), "task start")
        .when((p == "running") & has("task", "release", "filter", "worker"), "job start")
        .when((p == "returning result for") & has("task", "release", "filter", "worker"), "job done")
        .when((p == "summarized batch") & has("file", "latency", "unit"), "batch")
        .when((p == "combining") & (has("file-count", "glob", "release") | has("entity", "count")), "combined")
        .when((p == "maximum") & has("resident-set-size"), "memory")
    )


def seconds(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "sec", 1.0).when(unit == "min", 60.0).when(unit == "hour", 3600.0).otherwise(86400.0)


def gigabytes(value: Column, unit: Column) -> Column:
    """Sizes in GB; bytes are written as B or byte."""
    return value / F.when(unit.isNull() | unit.isin("B", "byte"), 1024.0**3).when(unit == "KB", 1024.0**2).when(unit == "MB", 1024.0).otherwise(1.0)


def metrics(log: DataFrame) -> DataFrame:
    """(file, timestamp, pid, worker, release, batch, metric, value) of each file's last run.

    A run begins with a task start. The first process of a run coordinates and is no
    worker; the others are numbered as they appear. A process works on the release that
    it named last.
    """
    e = log.withColumn("kind", kind(log))
    p = F.col("props")
    named = F.coalesce(p["release"], F.nullif(F.regexp_extract(F.coalesce(p["file"], F.lit("")), r"\d{4}-\d{2}-\d{2}", 0), F.lit("")))
    batch = F.coalesce(p["count"], p["file-count"], F.nullif(F.regexp_extract(F.coalesce(p["file"], F.lit("")), r"-full-(\d{5})", 1), F.lit(""))).try_cast("long")
    value = (
        F.when(F.col("kind") == "batch", seconds(p["latency"].try_cast("double"), p["unit"]))
        .when(F.col("kind") == "memory", gigabytes(p["resident-set-size"].try_cast("double"), p["unit"]))
        .when(F.col("kind") == "combined", batch.cast("double"))
    )
    metric = F.when(F.col("kind") == "batch", "latency").when(F.col("kind") == "memory", "max-rss").when(F.col("kind") == "combined", "batches")
    # Messages are parsed here and once: filters below would take the whole parse along, and each table its own.
    e = written(e.select("file", "block", "line", "timestamp", "pid", "kind", named.alias("named"), F.when(F.col("kind") != "memory", batch).alias("batch"), metric.alias("metric"), value.alias("value")))
    began = e.where("kind = 'task start'").groupBy(F.col("file").alias("of")).agg(F.max("line").alias("began"))
    e = e.join(began, e["file"] == began["of"], "left").where("began is null or line >= began").drop("of", "began")
    workers = e.groupBy("file", "pid").agg(F.min("line").alias("seen"))
    workers = workers.withColumn("worker", F.dense_rank().over(Window.partitionBy("file").orderBy("seen")) - 1)
    e = last_known(e, ["file", "pid"], "block", ["line"], "release", F.col("named"))
    e = e.join(workers, ["file", "pid"]).withColumn("worker", F.when(F.col("worker") > 0, F.col("worker")))
    return e.where("metric is not null").select("file", "timestamp", "pid", "worker", "release", "batch", "metric", "value")


def write_metrics(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric series from CSV; underscores in numbers are ignored."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn("value", F.regexp_replace("value", "_", "").try_cast("double"))
