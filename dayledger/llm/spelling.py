"""Spelling variants: words that differ by one code point, grouped under the far more frequent form.

Pairs come from asymmetric q-chunks. The shorter word of a pair (of equals the smaller)
contributes its two halves, the other its grams of a half's length at every place that a
half can reach, which is within a shift of one. One edit leaves one half whole, so the pair meets on
(length, half, gram), and is verified.

Where more than ``SMALL`` words meet on both sides of a key, they aren't paired: what is left
of them without the gram is within one edit too, so the rests are halved in turn, and the key
grows by a half of the rest, until few meet or the rest is one code point. So common
chunks cost rows in proportion to the words that have them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import Scratch, materialise, spread_hot

#: A run of letters in UTF-8: a-z, or U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Words of a key on its smaller side that are paired at once.
SMALL = 16
#: Words that a task counts before it sends them on.
_HELD = 1 << 18


def _runs(damage: int | None, min_chars: int):
    """(word, n): runs of texts, counted in parts. With damage a run loses a code point where damage divides the hash of its document and itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                begin = zlib.crc32(name.encode() + b":")
                for word, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower())).items() if text else ():
                    if len(word) < min_chars:  # in bytes, so in code points too
                        continue
                    if damage and (h := zlib.crc32(word, begin)) % damage == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] += n
                if len(held) >= _HELD:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    return run


def count_words(docs: DataFrame, min_chars: int = 6, min_n: int = 5, damage: int | None = None) -> DataFrame:
    """(word, n) of the runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, of so many code points and occurrences at least."""
    texts = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("name"), docs["text"].alias("text"))
    counted = texts.mapInPandas(_runs(damage, min_chars), "word string, n long").where(F.char_length("word") >= min_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def _halves(rest: str, piece: int) -> tuple[str, str]:
    """SQL of a half of a text, and of what is left of it then."""
    left, right = f"substring({rest}, 1, char_length({rest}) div 2)", f"substring({rest}, char_length({rest}) div 2 + 1)"
    return (left, right) if piece == 0 else (right, left)


def _grams(rest: str, short: str, piece: int) -> tuple[str, str]:
    """SQL of the gram of a longer text (or an equal one) where a half of one of length ``short`` is, if the edit is in the other, and of what is left then."""
    half = f"{short} div 2"
    left, right = f"substring({rest}, 1, {half})", f"substring({rest}, {half} + 1)"
    if piece == 0:
        return left, right
    cut = f"char_length({rest}) - ({short} - {half})"
    return f"substring({rest}, {cut} + 1)", f"substring({rest}, 1, {cut})"


def _first_keys(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (key, s, rest) and grams (key, t, rest, more) of all words.

    more is by how much t is longer. A gram at a place which a pair that meets there alone doesn't need has a null rest.
    """
    chunk = lambda piece: "struct(xxhash64(char_length(word), {0}, {1}) as key, {2} as rest)".format(piece, *_halves("word", piece))
    chunks = words.select("word", F.explode(F.expr(f"array({chunk(0)}, {chunk(1)})")).alias("x")).select("x.key", F.col("word").alias("s"), "x.rest")
    grams = []
    for more in (0, 1):
        short = f"(char_length(word) - {more})"
        for piece, size, place in ((0, f"{short} div 2", "0"), (1, f"({short} - {short} div 2)", f"{short} div 2")):
            own = more if piece else 0
            for shift in (-1, 0, 1):
                at = f"{place} + {shift}"
                rest = _grams("word", short, piece)[1] if shift == own else "cast(null as string)"
                inside = f"{at} >= 0 and {at} + {size} <= char_length(word)"
                grams.append(f"if({inside}, struct(xxhash64({short}, {piece}, substring(word, {at} + 1, {size})) as key, {rest} as rest, {more} as more), null)")
    every = words.select("word", F.explode(F.expr(f"array({', '.join(grams)})")).alias("x")).where("x is not null")
    # A gram that is at two places is one; the place with a rest counts.
    grams = every.groupBy(F.col("x.key").alias("key"), F.col("word").alias("t"), F.col("x.more").alias("more")).agg(F.max("x.rest").alias("rest"))
    return chunks, grams.select("key", "t", "rest", "more")


def _next_keys(chunks: DataFrame, grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of the rests, for keys on which too many meet."""
    chunk = lambda piece: "struct(xxhash64(key, {0}, {1}) as key, {2} as rest)".format(piece, *_halves("rest", piece))
    chunks = chunks.select("s", F.explode(F.expr(f"array({chunk(0)}, {chunk(1)})")).alias("x")).select("x.key", "s", "x.rest")
    gram = lambda piece: "struct(xxhash64(key, {0}, {1}) as key, {2} as rest)".format(piece, *_grams("rest", "(char_length(rest) - more)", piece))
    grams = grams.where("rest is not null").select("t", "more", F.explode(F.expr(f"array({gram(0)}, {gram(1)})")).alias("x")).select("x.key", "t", "x.rest", "more")
    return chunks, grams


def near_words(words: DataFrame) -> DataFrame:
    """The pairs (a, b), a before b, of words (column ``word``, distinct, of six code points or more) that differ by exactly one inserted, deleted or replaced code point; exact."""
    with Scratch(words.sparkSession) as scratch:
        chunks, grams, found = *_first_keys(words.select("word")), []
        while True:
            chunks, grams = scratch(chunks), scratch(grams)
            left = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.char_length("rest")).alias("length"))
            met = scratch(left.join(grams.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "key").withColumn("ready", F.expr(f"least(c, g) <= {SMALL} or length <= 1")))
            ready, open_ = met.where("ready"), met.where("not ready")
            # The side with more words is salted, the other is small or all but true pairs.
            own, keys = spread_hot(chunks.select("key", "s"), ready.select("key", "c"), "key", "c", ["s"])
            own = own.join(keys, ["key", "salt"]).select("key", "s")
            other, keys = spread_hot(grams.select("key", "t"), ready.select("key", "g"), "key", "g", ["t"])
            other = other.join(keys, ["key", "salt"]).select("key", "t")
            pairs = own.join(other, "key").where("s <> t and (char_length(s) < char_length(t) or s < t) and levenshtein(s, t, 1) = 1")
            found.append(scratch(pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()))
            if open_.isEmpty():
                return materialise(reduce(lambda x, y: x.unionByName(y), found).distinct())
            still = lambda df, n: spread_hot(df, open_.select("key", n), "key", n, [df.columns[1]])
            own, keys = still(chunks, "c")
            other, keys2 = still(grams, "g")
            chunks, grams = _next_keys(own.join(keys, ["key", "salt"]).drop("salt"), other.join(keys2, ["key", "salt"]).drop("salt"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead to in the end; forms never lead in a circle. Each round follows twice as many."""
    with Scratch(forms.sparkSession) as scratch:
        found = scratch(forms.select("word", F.col("form").alias("root")))
        while True:
            far = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
            step = scratch(found.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
            found = step.select("word", "root")
            if step.where("moved").isEmpty():
                return materialise(found)


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_n: int = 5, times: int = 5, damage: int | None = None) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are those of count_words(). A word's form is the word of largest n near it (ties:
    the smallest in code-point order), if its n is at least ``times`` the word's own; else null.
    root is where forms lead to, the word itself if it has none. Null and empty texts
    have no words, texts are read whole, repeated rows count as often as they are there,
    a null doc_id counts as empty text, other columns, whatever their names, play no part, and an empty table gives no
    row. damage=k deletes a code point of a run where k divides the crc32 of ``<doc_id>:<run>``.
    """
    words = materialise(count_words(docs, min_chars, min_n, damage))
    near = near_words(words)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    of = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(of, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("k"))
    known = words.join(best, "word", "left").withColumn("strong", -F.col("k.less") >= times * F.col("n"))
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("strong"), F.col("k.other")).alias("form"), F.when(F.col("strong"), -F.col("k.less")).alias("form_n")))
    far = roots(known.where("form is not null").select("word", "form"))
    return known.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: op13 in DuckDB's SQL: crc32 from its rule, near words by what is left without a code point.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT r, k, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gone AS MATERIALIZED (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT x.word, y.word AS other FROM gone x JOIN gone y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
         UNION SELECT x.word, w.word FROM gone x JOIN words w ON x.d = w.word UNION SELECT w.word, x.word FROM gone x JOIN words w ON x.d = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, min_by(other, {'n': -n, 'w': other}) AS form FROM (SELECT near.word, other, w.n FROM near JOIN words w ON w.word = near.other) GROUP BY word),
known AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, form FROM known UNION ALL SELECT p.word, k.word, k.form FROM path p JOIN known k ON k.word = p.form)
SELECT k.word, k.form, p.root, k.n, k.n_near, k.form_n FROM known k JOIN path p ON p.word = k.word AND p.form IS NULL
"""
