"""Day tables whose changes show all at once.

A write goes to a new folder of the table, and shows when a commit that lists the folder of
each day is there. A commit is one small file, written beside and renamed, so readers
see the state before or after it, whatever fails in between. The newest commit counts:

    table/data=<id>/day=2024-01-01/part-*.parquet
    table/_commits/000000000007.json      {"days": {"2024-01-01": "data=<id>", "2024-01-02": null}, ...}

A day without a folder was done and left no row. A table without commits is read as plain Parquet.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = "_commits"


@dataclass
class State:
    """What a table holds: the folder of each day, those of micro-batches by their number, the
    last batch that a compaction has taken in, and the source as it was when it was last read."""

    version: int = 0
    days: dict[str, str | None] = field(default_factory=dict)
    batches: dict[int, str] = field(default_factory=dict)
    through: int = -1
    source: str | None = None

    def folders(self) -> dict[str, list[str]]:
        """The days of each folder."""
        out: dict[str, list[str]] = {}
        for day, folder in self.days.items():
            if folder:
                out.setdefault(folder, []).append(day)
        return out


class _Files:
    """The table's folder in whatever store it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root, self.gateway = path.rstrip("/"), spark.sparkContext._gateway
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that appears whole; an error if it is there."""
        beside = self.at(f"{_LOG}/.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(beside).toUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(self.at(name)), none)


def _commits(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(_LOG) if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, path: str) -> State:
    """The table's newest state; an empty one if there is no commit."""
    files = _Files(spark, path)
    if not (versions := _commits(files)):
        return State()
    told = json.loads(files.read(f"{_LOG}/{versions[-1]:012d}.json"))
    return State(versions[-1], told["days"], {int(k): v for k, v in told["batches"].items()}, told["through"], told.get("source"))


def commit(spark: SparkSession, path: str, new: State) -> None:
    """Makes new, changed from the state of new.version, the table's state. If another writer was faster, it is an error and changes nothing."""
    text = json.dumps({"days": new.days, "batches": new.batches, "through": new.through, "source": new.source})
    _Files(spark, path).create(f"{_LOG}/{new.version + 1:012d}.json", text)


def balanced(df: DataFrame, day: str) -> DataFrame:
    """df dealt for writing by day: small days share a task, a large one is split over as many as its size asks for.

    Spark does so with the shuffle's own block sizes (spark.sql.adaptive.advisoryPartitionSizeInBytes), so no scan counts rows first.
    """
    return df.hint("rebalance", day)


def write_days(df: DataFrame, path: str, day: str, rows_per_file: int = 5_000_000) -> str:
    """Writes df by day to a new folder of the table, which no reader sees yet; returns its name."""
    folder = f"data={uuid.uuid4().hex}"
    balanced(df, day).write.option("maxRecordsPerFile", rows_per_file).partitionBy(day).parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def write_folder(df: DataFrame, path: str) -> str:
    """Writes df as it is dealt to a new folder of the table; returns its name."""
    folder = f"data={uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def written_days(spark: SparkSession, path: str, folder: str, day: str) -> list[str]:
    """The days that a folder has, from its listing."""
    return sorted(n.split("=", 1)[1] for n in _Files(spark, path).names(folder) if n.startswith(f"{day}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def replace_days(df: DataFrame, path: str, day: str, done: list[str] = (), source: str | None = None) -> list[str]:
    """Replaces the days that df holds, and marks those of done as well, in one step; other days stay. Rows without a day are left out. Returns the days with rows."""
    spark = df.sparkSession
    old = state(spark, path)
    folder = write_days(df.where(F.col(day).isNotNull()), path, day)
    days = written_days(spark, path, folder, day)
    old.days |= {d: None for d in done} | {d: folder for d in days}
    old.source = source or old.source
    commit(spark, path, old)
    return days


def read_days(spark: SparkSession, path: str, schema: T.StructType, day: str, batches: bool = False, only: list[str] | None = None) -> DataFrame:
    """All days of the table (or only some) in the columns of schema, with those of its micro-batches if asked for; Parquet files without commits as they are."""
    now = state(spark, path)
    if not now.version:
        return spark.read.schema(schema).parquet(path)
    root = path.rstrip("/")
    paths = [f"{root}/{folder}/{day}={d}" for folder, days in now.folders().items() for d in days if only is None or d in only]
    if batches:
        paths += [f"{root}/{folder}/{day}={d}" for folder in now.batches.values() for d in written_days(spark, path, folder, day)]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*schema.names) if paths else spark.createDataFrame([], schema)


def tidy(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes folders that none of the last ``keep`` commits lists; returns them. Not for tables that someone writes meanwhile."""
    files = _Files(spark, path)
    versions = _commits(files)
    if not versions:
        return []
    held = set()
    for v in versions[-max(1, keep) :]:
        told = json.loads(files.read(f"{_LOG}/{v:012d}.json"))
        held |= {f for f in told["days"].values() if f} | set(told["batches"].values())
    gone = [n for n in files.names("") if n.startswith("data=") and n not in held]
    for n in gone:
        files.fs.delete(files.at(n), True)
    return sorted(gone)


def source_state(records: DataFrame) -> str:
    """What records would read, as a digest: its plan, and its files with their sizes and times; empty if it reads no files. Only names are read."""
    spark = records.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    plan = records._jdf.queryExecution().analyzed().canonicalized().toString()
    told = hashlib.sha256(f"{records.semanticHash()} {plan}".encode())
    files = sorted(records.inputFiles())
    folders: dict[str, dict] = {}
    for name in files:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        parent = p.getParent().toString()
        if parent not in folders:
            folders[parent] = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in p.getFileSystem(conf).listStatus(p.getParent())}
        told.update(f"{name} {folders[parent].get(p.getName())}".encode())
    return told.hexdigest() if files else ""
