"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A null id takes part as the largest one.
NULL_ID = 2**63 - 1

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="dayledger-")
    return _own_dirs[sc.applicationId]


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_dayledger_path"] = path
    return out


class Scratch:
    """Written tables that go at the end of a with block, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        out = materialise(df)
        self.paths.append(out.__dict__["_dayledger_path"])
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def clear(self) -> None:
        """Deletes the tables. A collection of the driver's garbage then lets Spark drop the shuffle files that made them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        if self.paths:
            gc.collect()
            jvm.System.gc()
        self.paths.clear()


def spread_hot(left: DataFrame, keys: DataFrame, key: str, count: str, by: list[str], each: int = 2_000, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (key, salt) in which no key is hot.

    keys has the number of a key's rows on the left in count. Of keys with
    over ``each`` rows, the ``most`` most frequent (a fixed bound, so they are broadcast)
    get a salt for every ``each`` of their rows; all other keys have the salt 0. A left row's
    salt is a hash of its columns ``by``. keys should be written, as they are read twice.
    """
    hot = keys.where(F.col(count) > each).select(key, count).distinct().orderBy(F.desc(count), key).limit(most).select(key, F.ceil(F.col(count) / each).cast("int").alias("__salts"))
    sent = F.broadcast(hot)
    salted = lambda df: df.join(sent, key, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    left = salted(left).withColumn("salt", F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int")).drop("__salts")
    right = salted(keys.drop(count)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return left, right


def bloom(keys: DataFrame, each: int = 64, most: int = 27) -> np.ndarray:
    """A Bloom filter of the 64-bit numbers ``k`` of keys, packed in bytes: one bit for each, of ``each`` bits a key and 2**most (16 MB) in all, so that is what reaches the driver at most."""
    bits = min(most, max(16, (each * keys.count()).bit_length()))
    low = keys.select(F.col("k").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = low.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint8)


def in_bloom(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Flags: which of the numbers x (uint64) the filter may hold; it holds all that it was made of."""
    bit = (x & np.uint64(8 * len(known) - 1)).view(np.int64)
    return known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. In a text of ASCII alone that is what lower() does, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(n))
