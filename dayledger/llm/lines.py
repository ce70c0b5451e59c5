"""Line dedup: lines whose key is in several documents stay in the smallest of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import ascii_lower, materialise, order_id, spread_hot

_SPACES = " \t\n\x0b\x0c\r"


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, refresh_n_chars: bool = False) -> DataFrame:
    """docs with text replaced by what stays of it, plus n_lines and n_dropped.

    A text is split at newlines; a null or empty text is one empty line and stays as it
    is. A line's key has white space stripped and A-Z lower-cased. Keys of min_chars or
    more code points in min_docs or more documents lose all their lines but those in the
    smallest doc_id; repeats within that document stay. Rows of one id are one document;
    a null id counts as the largest. All columns of docs are kept, whatever their names;
    with refresh_n_chars a column n_chars is the length of what stays of a text.
    """
    names = docs.columns
    body = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), order_id(docs["doc_id"]).alias("id"), F.xxhash64(body).alias("th"))
    lines = docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(body).alias("th"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(_SPACES)))
    lines = lines.withColumn("key", key).where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "th", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))
    if min_docs == 2:
        shared = lines.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).where("first < last").drop("last")
    else:
        shared = lines.groupBy("h", "id").agg(F.count(F.lit(1)).alias("rows")).groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).where(F.col("n") >= min_docs).drop("n")
    found, shared = spread_hot(lines, materialise(shared), "h", "rows", ["id", "th"])
    gone = found.join(shared, ["h", "salt"]).where("id <> first").groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    whole = base.join(gone.hint("shuffle_hash"), ["id", "th"], "left")
    whole = whole.withColumn("parts", F.split(F.coalesce(F.col("row")["text"], F.lit("")), "\n", -1)).withColumn("n_lines", F.size("parts").cast("long"))
    # What lies between dropped lines is sliced out, so a text costs time in proportion to its lines.
    stays = F.expr(
        """array_join(flatten(transform(sequence(0, size(gone)), j ->
        slice(parts, if(j = 0, 0, gone[j - 1] + 1) + 1,
              if(j = size(gone), size(parts), gone[j]) - if(j = 0, 0, gone[j - 1] + 1)))), '\n')"""
    )
    out = whole.withColumn("stays", F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(stays))
    length = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("stays")) if refresh_n_chars and "n_chars" in names else None

    def column(c: str):
        return F.col("stays") if c == "text" else length.cast(docs.schema[c].dataType) if c == "n_chars" and length is not None else F.col("row")[c]

    text = [column(c).alias(c) for c in names]
    return out.select(*text, "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


#: The digest of op3 in DuckDB's SQL.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
