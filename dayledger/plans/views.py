"""The views that queries start from, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.sources.tables import spread, table, written


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: a daily log; users stand for platforms, event types for categories."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("date").alias("day"), "ts", F.col("user_id").alias("platform"), F.col("event_type").alias("category"), "value", "props")


def lines(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """Line items with order, supplier and part, in the columns that H is made of.

    With only, in these columns; each join but the last is written then, so its shuffle files
    are gone before the next. The joins' strategies are Spark's choice by size; nothing is
    hinted.
    """
    step = (lambda df: df) if only is None else (lambda df: written(df, free=True))
    has = lambda *columns: [c for c in columns if only is None or c in only]
    l, o, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "part"))
    l = l.select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.05).alias("discounted"), (F.col("l_tax") == 0).alias("untaxed"))
    own = has("l_shipdate", "o_orderpriority", "l_returnflag", "l_linestatus", "discounted", "untaxed", "o_orderdate")
    lo = step(spread(l, "l_orderkey").join(o, F.col("l_orderkey") == o.o_orderkey).select("l_suppkey", "l_partkey", *own))
    lop = step(lo.join(p, lo.l_partkey == p.p_partkey).select("l_suppkey", *own, *has("p_brand", "p_partkey", "p_name")))
    j = lop.join(s, lop.l_suppkey == s.s_suppkey)
    return j.select(*has("l_shipdate", "s_name", "o_orderpriority", "s_nationkey", "l_returnflag", "l_linestatus", "p_brand", "p_partkey", "discounted", "untaxed", "p_name", "o_orderdate"))


def shipped() -> dict[str, Column]:
    """The columns of H, over lines(); suppliers stand for platforms."""
    return {
        "day": F.col("l_shipdate").cast("date"), "platform": F.col("s_name"), "category": F.col("o_orderpriority"), "nation": F.col("s_nationkey"),
        "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "brand": F.col("p_brand"), "part": F.col("p_partkey"),
        "d_vis": F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")), "d_mon": F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")),
        "d_pro": F.when(F.col("discounted"), F.lit("DISCOUNT")), "d_acc": F.when(F.col("untaxed"), F.lit("UNTAXED")),
        "words": F.split("p_name", " "), "started_at": F.col("o_orderdate"), "ended_at": F.col("l_shipdate"),
        "end_date": F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate")),
    }


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: line items with order, supplier and part."""
    return lines(spark, sf_dir).select(*[c.alias(k) for k, c in shipped().items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: documents with labels where they have one; sources stand for platforms, languages for categories."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    j = d.join(l, d.doc_id == l.id, "left")
    return j.select(
        "doc_id", F.col("source").alias("platform"), F.col("lang").alias("category"), "text", "n_chars",
        F.when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "BAD").alias("quality"), F.when(F.col("toxic") == 1, "TOXIC").when(F.col("toxic") == 0, "CLEAN").alias("toxic"),
    )


E = """E AS (SELECT event_id, CAST(ts AS DATE) AS day, ts, user_id AS platform, event_type AS category, value, props FROM events)"""
H = """H AS (SELECT CAST(l.l_shipdate AS DATE) AS day, s.s_name AS platform, o.o_orderpriority AS category, s.s_nationkey AS nation,
       l.l_returnflag AS flag, l.l_linestatus AS status, p.p_brand AS brand, p.p_partkey AS part,
       CASE WHEN l.l_returnflag = 'R' THEN l.l_returnflag END AS d_vis, CASE WHEN l.l_linestatus = 'F' THEN l.l_linestatus END AS d_mon,
       CASE WHEN l.l_discount >= 0.05 THEN 'DISCOUNT' END AS d_pro, CASE WHEN l.l_tax = 0 THEN 'UNTAXED' END AS d_acc,
       string_split(p.p_name, ' ') AS words, o.o_orderdate AS started_at, l.l_shipdate AS ended_at,
       CASE WHEN l.l_shipdate >= o.o_orderdate THEN l.l_shipdate END AS end_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey)"""
D = """D AS (SELECT d.doc_id, d.source AS platform, d.lang AS category, d.text, d.n_chars,
       CASE WHEN l.quality = 1 THEN 'GOOD' WHEN l.quality = 0 THEN 'BAD' END AS quality, CASE WHEN l.toxic = 1 THEN 'TOXIC' WHEN l.toxic = 0 THEN 'CLEAN' END AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
