"""Reading and writing the tables of the engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column

from dayledger.functions.stats import COLUMNS, SCHEMA
from dayledger.operators.checks import canonical, same_rows, unknown_values
from dayledger.sources.commits import read_days, replace_days

_own_dirs: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; in one of our own only in local mode without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="dayledger-")
        root = _own_dirs[sc.applicationId]
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """df by way of Parquet files in the shared folder, so it is computed once and its lineage ends; with free, its shuffle files too."""
    path = shared_path(df.sparkSession)
    with freed(df.sparkSession) if free else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A source of fewer files than the cluster has cores, dealt over all of them by a key; a file may be one row group, and so one task.

    A source of more files is left as it is read, without a shuffle. Tasks are as many as the
    size asks for, and a join by the key needs no further shuffle.
    """
    return df.repartition(key) if len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism else df


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its columns and types are exactly those of schema in any order; nullability doesn't count."""
    want, got = ({f.name: f.dataType.simpleString() for f in s} for s in (schema, df.schema))
    if want != got or len(df.columns) != len(schema):
        odd = sorted({k for k in want.keys() | got.keys() if want.get(k) != got.get(k)})
        raise TypeError(f"columns differ from the schema: {', '.join(odd)}")
    return df


def read_statistics(spark: SparkSession, *paths: str, aliases: DataFrame | None = None, domain: DataFrame | None = None) -> DataFrame:
    """Statistics tables of one schema, as one table, with platforms under their canonical names.

    Paths are tables of write_statistics() or plain Parquet files. With a domain (a column ``value``), platforms that it lacks are an error.
    """
    df = reduce(lambda a, b: a.unionByName(b), [read_days(spark, path, SCHEMA, "day") for path in paths])
    df = (canonical(df, "platform", aliases) if aliases is not None else df).select(*COLUMNS)
    if domain is not None and (odd := unknown_values(df, "platform", domain).orderBy("value").limit(10).collect()):
        raise ValueError(f"unknown platforms: {', '.join(r.value for r in odd)}")
    return df


def read_extract(spark: SparkSession, path: str, schema: T.StructType, platform: str | None = None, aliases: DataFrame | None = None, day: str = "day") -> DataFrame:
    """A stored extract in the columns of schema, with platforms under their canonical names; columns that its files lack are null."""
    df = read_days(spark, path, schema, day)
    return canonical(df, platform, aliases).select(*schema.names) if aliases is not None and platform else df


def by_day(stats: DataFrame) -> DataFrame:
    """Statistics with the column that their tables are partitioned by."""
    return stats.select(*COLUMNS, F.col("start_date").alias("day"))


def write_statistics(stats: DataFrame, path: str, done: list[str] = (), source: str | None = None) -> list[str]:
    """Replaces the days that stats holds and leaves the others; readers see all of it or none (see commits). Returns the days.

    A day is as many files as its size asks for. done are days to be marked even if they have no row.
    """
    return replace_days(by_day(stats), path, "day", done, source)


def write_extract(df: DataFrame, path: str, day: str, done: list[str] = (), source: str | None = None) -> list[str]:
    """A filtered extract, by day: days are replaced, not the table, in one step; a large day is dealt over many tasks."""
    return replace_days(df, path, day, done, source)


def copy_statistics(stats: DataFrame, path: str) -> bool:
    """Writes stats to path; False if the same rows are there already. Other rows there are an error."""
    spark = stats.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        if same_rows(spark.read.schema(SCHEMA).parquet(path), stats.select(*COLUMNS)):
            return False
        raise ValueError(f"{path} holds other statistics")
    stats.select(*COLUMNS).write.mode("errorifexists").parquet(path)
    return True


def _streamed_digest(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the file at path, hashed in the JVM while it is read, so no task holds more than a buffer of it.

    No SQL function hashes a stream, so this calls Hadoop's file system (with the session's settings: any
    store that Spark opens) and commons-codec from expressions. The stream closes where it ends.
    """
    jvm = spark.sparkContext._jvm
    catalyst, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types
    load = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    seq = lambda *x: jvm.PythonUtils.toSeq(list(x))
    kind, none = lambda c: types.ObjectType(load(c)), jvm.scala.Option.empty()
    new = lambda c, *x: catalyst.objects.NewInstance(load(c), seq(*x), seq(), True, kind(c), none)
    call = lambda of, name, c, *x: catalyst.objects.Invoke(of, name, kind(c), seq(*x), seq(), True, True, True)
    static = lambda c, name, out, *x: catalyst.objects.StaticInvoke(load(c), out, name, seq(*x), seq(), True, True, True, none)
    holder = "org.apache.spark.util.SerializableConfiguration"
    settings = catalyst.Literal(jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf()), kind(holder))
    file = new("org.apache.hadoop.fs.Path", call(jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(path._jc), "toString", "java.lang.String"))
    store = call(file, "getFileSystem", "org.apache.hadoop.fs.FileSystem", call(settings, "value", "org.apache.hadoop.conf.Configuration"))
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", call(store, "open", "org.apache.hadoop.fs.FSDataInputStream", file))
    digest = static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", kind("java.lang.String"), stream)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(static("org.apache.spark.unsafe.types.UTF8String", "fromString", types.DataType.fromDDL("string"), digest)))


def file_digests(spark: SparkSession, pattern: str, large: int = 1 << 25) -> DataFrame:
    """(path, digest, bytes): SHA-256 of each file, computed where it is read.

    A file below ``large`` bytes is one value, which Spark copies into a row that it doubles until it is
    large enough. Others are hashed as they are read, by one task each, in memory that doesn't grow with them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    small = files.where(F.col("length") < large).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))
    # Files are whole in a scan and packed by size, so each large one is a task of its own.
    streamed = files.where(F.col("length") >= large).select("path", _streamed_digest(spark, F.col("path")).alias("digest"), F.col("length").alias("bytes"))
    return small.unionByName(streamed)


def text_row_counts(spark: SparkSession, pattern: str, keyword: str = "KEYWORD_") -> DataFrame:
    """Lines after the first of each file, and those with the keyword anywhere. Newlines inside fields count."""
    lines = spark.read.text(pattern).select(F.col("_metadata.file_name").alias("file"), "value")
    counts = lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("rows"), F.count_if(F.contains("value", F.lit(keyword))).alias("rows_with_keywords"))
    return counts


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(release, batch_count, total_rows, ..., sha256) from a JSON manifest with a map of releases."""
    entry = T.StructType([T.StructField(c, T.LongType()) for c in ("batch_count", "total_rows", "total_rows_with_keywords", "extract_rows", "extract_rows_with_keywords")] + [T.StructField("sha256", T.StringType())])
    df = spark.read.option("multiLine", True).schema(T.StructType([T.StructField("releases", T.MapType(T.StringType(), entry))])).json(path)
    return df.select(F.explode("releases").alias("release", "e")).select(F.to_date("release").alias("release"), "e.*")
