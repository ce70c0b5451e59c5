"""Secret scans with corpus-wide ownership frequency.

Three base patterns mark spans in every text. The method adds spans: opaque tokens
and the values of base spans are gathered over the corpus by hash, and their distinct
repositories and owners are counted. What one owner alone holds, in few repositories,
counts as a live credential of theirs; what many owners hold, or one owner spreads over
many repositories, is a copied example. Base spans stay either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.llm.common import materialise, order_id, spread_hot

#: The base patterns; letters after (?i: match in either case (ASCII).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the method looks at: opaque tokens with letters and digits.
OPAQUE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
_SPAN = "struct<start:int,kind:int,end:int,token:string>"
_PORTION = 128
_NONE = f"cast(array() as array<{_SPAN}>)"


def spans(text: Column, kind: int, pattern: str, value_group: int = 0, min_value: int = 1) -> Column:
    """The matches of pattern as an array of (start, kind, end, token), in code points.

    split() gives what lies between matches, so a match begins after all gaps and
    matches before it. Matches whose value group is shorter than min_value are dropped.
    A maximal run that is long enough is the same match as a run of any length that is
    then measured, which is why the run lengths stand in ACCESS and HEX.
    """
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("token"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["value"]) >= min_value, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    # Matches are walked in portions, so that no step copies a long array.
    empty = F.expr(_NONE)
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # f of x, with x computed once
    portions = once(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _PORTION).cast("int")), lambda i: F.slice(s, i * _PORTION + 1, _PORTION)))
    inner = lambda at, portion: F.aggregate(portion, F.struct(at.alias("at"), empty.alias("out")), step)
    add = lambda acc, portion: once(inner(acc["at"], portion), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))
    walked = F.aggregate(portions, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("out")), add, lambda acc: F.flatten(acc["out"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(empty)


def _digest(found: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: str, repository: str, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_owned, n_copied, n_base_live, base, spans.

    base and spans are texts ``kind:start:end,...``; a null or empty text has none. A
    candidate is live if at most max_owners owners and max_repositories repositories hold
    it. Live opaque tokens outside base spans are spans of kind owned; n_copied counts the
    other opaque tokens there, n_base_live the base spans whose values are live. A null
    owner or repository is one of its own. Texts are read whole; one with many matches takes
    time in proportion to them and a sort. Rows alike in doc_id and text get the same result
    each; other columns, whatever their names, play no part.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"], order_id(docs["doc_id"]).alias("id"), F.xxhash64(text).alias("th"),
        F.coalesce(docs[owner].cast("string"), F.lit("")).alias("owner"), F.coalesce(docs[repository].cast("string"), F.lit("")).alias("repository"),
        F.concat(spans(text, 0, ASSIGN, 2, 6), spans(text, 1, ACCESS), spans(text, 2, HEX)).alias("base"),
        F.filter(spans(text, 3, OPAQUE), lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]")).alias("opaque"),
    )
    rows = materialise(rows)
    marked = lambda spans, base: F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(base).alias("base")))
    cand = rows.select("id", "th", "owner", "repository", F.explode(F.concat(marked(F.col("base"), True), marked(F.col("opaque"), False))).alias("c")).select("id", "th", "owner", "repository", "c.x", "c.base")
    # A token overlaps a base span that begins before it and ends after its start, or one that begins inside it.
    by_start = Window.partitionBy("id", "th").orderBy("x.start")
    before, later = by_start.rangeBetween(Window.unboundedPreceding, 0), by_start.rangeBetween(0, Window.unboundedFollowing)
    ended, begins = F.max(F.when(F.col("base"), F.col("x.end"))).over(before), F.min(F.when(F.col("base"), F.col("x.start"))).over(later)
    clear = ~F.coalesce(ended > F.col("x.start"), F.lit(False)) & ~F.coalesce(begins < F.col("x.end"), F.lit(False))
    cand = cand.withColumn("told", F.col("base") | clear).withColumn("h", F.unhex(F.md5(F.col("x.token").cast("binary"))))
    held = materialise(cand.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")))
    judged, held = spread_hot(cand.where("told").select("id", "th", "h", "x"), held, "h", "n", ["id", "th"])
    judged = judged.join(held, ["h", "salt"]).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    per_row = judged.groupBy("id", "th").agg(F.collect_set(F.struct("x", "live")).alias("more"))
    out = rows.select("doc_id", "id", "th", "base").join(per_row, ["id", "th"], "left")
    none = F.expr(_NONE)
    which = lambda f: F.coalesce(F.transform(F.filter("more", f), lambda m: m["x"]), none)
    owned, copied = which(lambda m: (m["x"]["kind"] == 3) & m["live"]), which(lambda m: (m["x"]["kind"] == 3) & ~m["live"])
    count = lambda c: F.size(c).cast("long")
    n = lambda k: count(F.filter("base", lambda x: x["kind"] == k))
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), count(owned).alias("n_owned"), count(copied).alias("n_copied"),
        count(which(lambda m: (m["x"]["kind"] < 3) & m["live"])).alias("n_base_live"), _digest(F.col("base")).alias("base"), _digest(F.concat("base", owned)).alias("spans"),
    )


_SQL_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_kind(kind: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, source, {kind} AS kind, value,
      CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s, length(hits[i]) AS n
    FROM (SELECT *, unnest(vals) AS value, unnest(range(1, len(vals) + 1)) AS i
          FROM (SELECT doc_id, source, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM documents))
    WHERE length(value) >= {least}"""


#: The digest of op6 in DuckDB's SQL.
ORACLE = f"""
WITH base AS (
    {_sql_kind(0, _SQL_ASSIGN, 2, 6)}
    UNION ALL {_sql_kind(1, r"AKIA[A-Z0-9]+", 0, 20)}
    UNION ALL {_sql_kind(2, r"[0-9a-f]+", 0, 24)}),
cand AS (SELECT * FROM ({_sql_kind(3, r"[A-Za-z0-9_-]+", 0, 20)}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
held AS (SELECT value, count(DISTINCT coalesce(source, '')) <= 1 AND count(DISTINCT coalesce(doc_id::VARCHAR, '')) <= 3 AS live FROM (FROM base UNION ALL FROM cand) GROUP BY value),
outside AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.n AND c.s < b.s + b.n)),
every AS (SELECT e.*, live FROM (FROM base UNION ALL FROM outside) e JOIN held USING (value)),
named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || (s + n) AS span FROM every)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       count(*) FILTER (kind = 3 AND live) AS n_owned, count(*) FILTER (kind = 3 AND NOT live) AS n_copied, count(*) FILTER (kind < 3 AND live) AS n_base_live,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans
FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""
