"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source is a stream of words, dealt over shards by a seeded hash of doc_id, and
each shard is cut into blocks of nearly equal word counts. Blocks (repeats counted)
are apportioned to sources, then to each source's shards, by highest quotients
``weight / (2 s + 1)``. Within a shard the quota is spread evenly over its blocks from
a seeded start, so what one document gives follows from its place in closed form and
no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.llm.common import WORD, materialise


def count_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share_num: int = 3, share_den: int = 2, max_repeat: int = 2) -> DataFrame:
    """Adds weight and target to (src, source_size).

    Sources in order of src get the weights in turn. The total, share_num/share_den of
    all words, is shared by weight; a source stops at max_repeat times its size and its
    excess is shared again. One row per source; the windows without keys see no more.
    """
    everything = Window.partitionBy()
    by_key = Window.orderBy("src")
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    upto, before = by_fill.rowsBetween(Window.unboundedPreceding, 0), by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    s = s.withColumn("rest", F.sum("source_size").over(everything) * F.lit(float(share_num)) / F.lit(float(share_den)) - (F.sum("cap").over(upto) - F.col("cap")))
    s = s.withColumn("open", F.sum("weight").over(before))
    s = s.withColumn("full", F.col("cap") * F.col("open") <= F.col("rest") * F.col("weight"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("rest") / F.col("open"))).over(everything))
    return s.select("src", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each row by Sainte-Laguë within its group.

    Seats that a row surely wins are counted, not listed: for m rows of total weight W
    and N seats a row's quota is within (w / W) m / 2 + 1 of N w / W, so each group
    lists about four quotients a row. Ties go to the smaller key.
    """
    over = Window.partitionBy(*group)
    r = rows.withColumn("__total", F.sum(weight).over(over)).withColumn("__rows", F.count(F.lit(1)).over(over))
    r = r.withColumn("__part", F.when(F.col("__total") > 0, F.col(weight) / F.col("__total")).otherwise(0.0))
    r = r.withColumn("__slack", F.col("__part") * F.col("__rows") / 2 + 1)
    r = r.withColumn("__low", F.greatest(F.lit(0), F.floor(F.col("__part") * F.col(seats) - F.col("__slack"))).cast("long"))
    r = r.withColumn("__high", F.ceil(F.col("__part") * F.col(seats) + F.col("__slack")).cast("long"))
    r = r.withColumn("__left", F.col(seats) - F.sum("__low").over(over))
    q = r.select(*group, key, "__left", F.explode(F.sequence("__low", "__high")).alias("__s"), F.col(weight).alias("__w"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col("__w") / (2 * F.col("__s") + 1)), key, "__s")
    q = q.where("__w > 0").withColumn("__place", F.row_number().over(best))
    won = q.where("__place <= __left").groupBy(*group, key).agg(F.count(F.lit(1)).alias("__won"))
    out = r.join(won, [*group, key], "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
    return out.drop("__total", "__rows", "__part", "__slack", "__low", "__high", "__left", "__won")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share_num: int = 3, share_den: int = 2, max_repeat: int = 2, block_words: int = 16, shards: int = 1024, seed: str = "mix-1") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    size counts words (null or empty text: 0, and then taken is 0). Sources follow each
    other by code point, a null source last as a source of its own. Repeated rows and
    repeated or null ids are rows of their own; rows alike in id and size get their
    takes in either order. No document gives more than max_repeat times its size.
    """
    rows = docs.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~")).alias("src"),
        count_words("text").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
    )
    rows = materialise(rows.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(shards))))
    cells = rows.groupBy("src", "shard").agg(F.sum("size").alias("z"))
    targets = source_targets(cells.groupBy("src").agg(F.sum("z").alias("source_size")), weights, share_num, share_den, max_repeat)
    every = materialise(cells.join(targets, "src"))
    block = F.ceil(F.col("z") / F.greatest(F.lit(1.0), F.round(F.col("z") / F.lit(block_words)))).cast("long")
    cells = every.where("z > 0").withColumn("block", block).withColumn("n", F.ceil(F.col("z") / F.col("block")).cast("long"))
    cells = cells.withColumn("v", F.col("n") * F.col("target") / F.col("source_size"))
    by_source = cells.groupBy("src").agg(F.round(F.sum(F.col("v").cast("decimal(38,9)")).cast("double"), 6).alias("v")).withColumn("all", F.lit(0))
    total = Window.partitionBy("all")
    by_source = by_source.withColumn("seats", F.round(F.sum(F.col("v").cast("decimal(38,6)")).over(total).cast("double")).cast("long"))
    by_source = apportion(by_source, ["all"], "src", "v", "seats").select("src", F.col("quota").alias("seats"))
    cells = apportion(cells.join(by_source, "src"), ["src"], "shard", "v", "seats")
    cells = cells.withColumn("quota", F.least(F.col("quota"), F.col("n") * max_repeat))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("src"), F.lit("/"), F.col("shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.col("n"))
    cells = cells.select("src", "shard", "block", "n", F.expr("quota div n").alias("each"), F.expr("quota % n").alias("more"), start.alias("o"))
    place = Window.partitionBy("src", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("b", F.sum("size").over(place)).withColumn("a", F.col("b") - F.col("size"))
    cells = every.select("src", "shard", "source_size", "target").join(cells, ["src", "shard"], "left")
    rows = rows.join(cells, ["src", "shard"])
    for p in ("a", "b"):
        rows = rows.withColumn("k" + p, F.expr(f"{p} div block"))
        got = f"block * (k{p} * each + (k{p} * more + o) div n) + ({p} - k{p} * block) * (each + ((k{p} + 1) * more + o) div n - (k{p} * more + o) div n)"
        rows = rows.withColumn("f" + p, F.expr(got))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("fb") - F.col("fa"), F.lit(0).cast("long")).alias("taken"))


#: The same mix in DuckDB's SQL, from nothing but the tables.
ORACLE = r"""
WITH rows0 AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
rows1 AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % 1024 AS shard FROM rows0),
cells0 AS (SELECT src, shard, CAST(sum(size) AS BIGINT) AS z FROM rows1 GROUP BY ALL),
s0 AS (SELECT src, CAST(sum(z) AS BIGINT) AS source_size FROM cells0 GROUP BY ALL),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2 AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 3.0e0 / 2.0e0 - CAST(sum(cap) OVER (ORDER BY cap / weight, src ROWS UNBOUNDED PRECEDING) - cap AS DOUBLE) AS rest,
         CAST(sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM s1),
s3 AS (SELECT *, cap * open <= rest * weight AS "full" FROM s2),
s4 AS (SELECT *, max(CASE WHEN NOT "full" THEN rest / open END) OVER () AS level FROM s3),
targets AS (SELECT src, source_size, CASE WHEN "full" THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM s4),
cells1 AS (SELECT *, CAST(ceil(z / greatest(1.0e0, round(z / 16))) AS BIGINT) AS block FROM cells0 WHERE z > 0),
cells2 AS (SELECT c.*, CAST(ceil(z / block) AS BIGINT) * target / source_size AS v FROM cells1 c JOIN targets USING (src)),
p0 AS (SELECT src, round(CAST(sum(CAST(v AS DECIMAL(38, 9))) AS DOUBLE), 6) AS w FROM cells2 GROUP BY src),
p1 AS (SELECT *, CAST(round(CAST(sum(CAST(w AS DECIMAL(38, 6))) OVER () AS DOUBLE)) AS BIGINT) AS seats, sum(w) OVER () AS ww, count(*) OVER () AS m FROM p0),
p2 AS (SELECT *, greatest(0, CAST(floor(w / ww * seats - (w / ww * m / 2 + 1)) AS BIGINT)) AS low, CAST(ceil(w / ww * seats + (w / ww * m / 2 + 1)) AS BIGINT) AS high FROM p1),
p3 AS (SELECT *, seats - sum(low) OVER () AS "left" FROM p2),
p4 AS (SELECT src, low, "left", row_number() OVER (ORDER BY w / (2 * s + 1) DESC, src, s) AS place FROM (SELECT *, unnest(range(low, high + 1)) AS s FROM p3 WHERE w > 0)),
p5 AS (SELECT src, any_value(low) + count(*) FILTER (place <= "left") AS seats FROM p4 GROUP BY src),
q1 AS (SELECT c.*, p5.seats, sum(v) OVER (PARTITION BY src) AS ww, count(*) OVER (PARTITION BY src) AS m FROM cells2 c JOIN p5 USING (src)),
q2 AS (SELECT *, greatest(0, CAST(floor(v / ww * seats - (v / ww * m / 2 + 1)) AS BIGINT)) AS low, CAST(ceil(v / ww * seats + (v / ww * m / 2 + 1)) AS BIGINT) AS high FROM q1),
q3 AS (SELECT *, seats - sum(low) OVER (PARTITION BY src) AS "left" FROM q2),
q4 AS (SELECT src, shard, low, "left", row_number() OVER (PARTITION BY src ORDER BY v / (2 * s + 1) DESC, shard, s) AS place FROM (SELECT *, unnest(range(low, high + 1)) AS s FROM q3)),
q5 AS (SELECT src, shard, any_value(low) + count(*) FILTER (place <= "left") AS quota FROM q4 GROUP BY src, shard),
q6 AS (SELECT c.src, c.shard, block, CAST(ceil(z / block) AS BIGINT) AS n, least(quota, 2 * CAST(ceil(z / block) AS BIGINT)) AS quota FROM cells1 c JOIN q5 USING (src, shard)),
q7 AS (SELECT *, quota // n AS each, quota % n AS more, CAST('0x' || md5('mix-1/' || src || '/' || shard)[1:8] AS BIGINT) % n AS o FROM q6),
r0 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM rows1),
r1 AS (SELECT r0.*, b - size AS a, block, n, each, more, o FROM r0 LEFT JOIN q7 USING (src, shard)),
r2 AS (SELECT *, a // block AS ka, b // block AS kb FROM r1),
r3 AS (SELECT *, block * (ka * each + (ka * more + o) // n) + (a - ka * block) * (each + ((ka + 1) * more + o) // n - (ka * more + o) // n) AS fa,
         block * (kb * each + (kb * more + o) // n) + (b - kb * block) * (each + ((kb + 1) * more + o) // n - (kb * more + o) // n) AS fb FROM r2)
SELECT doc_id, size, source_size, target, CAST(coalesce(fb - fa, 0) AS BIGINT) AS taken
FROM r3 JOIN targets USING (src)
"""
