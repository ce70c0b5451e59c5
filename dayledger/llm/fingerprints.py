"""Document fingerprints by consistent weighted sampling.

A text is the bag of its words. For sample k each word has r and c from Gamma(2, 1) and
b uniform, all derived from a hash of (word, k). A word of weight w is quantised to
``t = floor(ln w / r + b)`` and bids ``ln c - r (t - b + 1)``; the lowest bid wins. Two
bags share the winner (word, t) with the probability of their generalised Jaccard
similarity. The bid is a function of (word, t, k), so it stands for the winner.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.llm.common import NULL_ID, SPACE, materialise, order_id

_UNIT = 2.0**-31


def bids(h: Column, k: int) -> tuple[Column, Column, Column]:
    """r, ln c and b of sample k for word hash h, from three more hashes of it."""
    x, y, z = (F.xxhash64(h, F.lit(3 * k + j)) for j in range(3))
    low = lambda v: (v.bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0.5)) * F.lit(_UNIT)
    high = lambda v: (F.shiftrightunsigned(v, 33) + F.lit(0.5)) * F.lit(_UNIT)
    return -F.log(low(x) * high(x)), F.log(-F.log(low(y) * high(y))), low(z)


def bid(h: Column, k: int, log_weight: Column) -> Column:
    r, log_c, b = bids(h, k)
    t = F.floor(log_weight / r + b)
    return log_c - r * (t - b + F.lit(1.0))


#: Ranges of ids of about equal rows, at most.
_RANGES = 1 << 12


def _ranges(ids: DataFrame, run: int) -> list[tuple[int, int, int]]:
    """(lowest id, bits, first bucket) of ranges of the ids, in order.

    Ranges are cut at quantiles of the ids, so each has about as many rows however
    unevenly ids lie. A range of several ids has a bucket for each stretch of
    2**bits ids, about ``run`` rows; an id with many rows, as null may be, is a range by itself,
    whose buckets are told by the -bits highest bits of the texts' hashes.
    """
    known = F.when(F.col("id") != NULL_ID, F.col("id"))
    n, nulls, low, high = ids.agg(F.count(known), F.count_if(F.col("id") == NULL_ID), F.min(known), F.max(known)).first()
    pieces = []  # (lowest, highest, rows)
    if n:
        count = min(_RANGES, max(1, n // (4 * run)))
        cuts = ids.agg(F.percentile_approx(known, [k / count for k in range(1, count)], 1 << 14)).first()[0] if count > 1 else []
        repeats = Counter([low, *cuts])
        starts = sorted(repeats)
        for start, end in zip(starts, [*(s - 1 for s in starts[1:]), high]):
            rows = n // count + 1
            if repeats[start] > 1:
                pieces.append((start, start, (repeats[start] - 1) * rows))
                start += 1
            if start <= end:
                pieces.append((start, end, rows))
    if nulls:
        pieces.append((NULL_ID, NULL_ID, nulls))
    out, first = [], 0
    for low, high, rows in pieces:
        if low == high:
            bits = -max(0, (rows // run).bit_length() - 1)
            out.append((low, bits, first))
            first += 1 << -bits
        else:
            bits = max(0, ((high - low + 1) * run // rows).bit_length() - 1)
            out.append((low, bits, first))
            first += (high >> bits) - (low >> bits) + 1
    return out or [(0, 0, 0)]


def _bucket(ranges: list[tuple[int, int, int]]) -> Column:
    """The bucket of (id, th); buckets follow each other as ids and hashes do."""
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    lows, step = [low for low, _, _ in ranges], 64
    last = lambda cuts: F.size(F.filter(cuts, lambda x: x <= F.col("id"))) - 1
    block = F.greatest(last(numbers(lows[::step])), F.lit(0))
    at = block * step + F.greatest(last(F.slice(numbers(lows), block * step + 1, F.lit(step))), F.lit(0))
    x = F.struct(*[F.get(numbers(v), at).alias(c) for c, v in zip(("low", "bits", "first"), zip(*ranges))])
    right = lambda v, n: F.call_function("shiftright", v, n.cast("int"))
    many = right(F.col("id"), F.greatest(x["bits"], F.lit(0))) - right(x["low"], F.greatest(x["bits"], F.lit(0)))
    one = right(F.col("th"), x["bits"] + 64) + F.call_function("shiftleft", F.lit(1).cast("long"), (-x["bits"] - 1).cast("int"))
    return x["first"] + F.when(x["bits"] >= 0, many).otherwise(one)


def _heads(base: DataFrame) -> DataFrame:
    """The first row of each bucket, dealt to the bucket before it (the first: to the last).

    Buckets are found in rounds of 16 bits of their number, so no window without keys
    sees more than 2**16 rows.
    """
    first = materialise(base.groupBy("bucket").agg(F.min(F.struct("id", "th")).alias("k")).select("bucket", "k.id", "k.th"))

    def follow(keys: DataFrame, level: int) -> DataFrame:
        """(key, next): next is null for the largest."""
        if level == 0:
            return keys.withColumn("next", F.lead("key").over(Window.orderBy("key")))
        keys = keys.withColumn("g", F.shiftright("key", 16)).withColumn("next", F.lead("key").over(Window.partitionBy("g").orderBy("key")))
        groups = keys.groupBy("g").agg(F.min("key").alias("low"))
        later = follow(groups.select(F.col("g").alias("key")), level - 1).select(F.col("key").alias("g"), F.col("next").alias("g2")).where("g2 is not null")
        later = later.join(groups.select(F.col("g").alias("g2"), "low"), "g2").select("g", "low")
        return keys.join(later, "g", "left").select("key", F.coalesce("next", "low").alias("next"))

    pairs = follow(first.select(F.col("bucket").alias("key")), 3)
    smallest = first.agg(F.min("bucket").alias("low"))
    pairs = pairs.crossJoin(F.broadcast(smallest)).select(F.col("key").alias("before"), F.coalesce("next", "low").alias("bucket"))  # one row
    heads = first.join(pairs, "bucket").select("before", "id", "th")
    return base.join(materialise(heads), ["id", "th"]).dropDuplicates(["before"]).select(F.col("before").alias("bucket"), "id", "th", "body")


def fingerprint(docs: DataFrame, samples: int = 48, run: int = 64) -> DataFrame:
    """Fingerprints of every text and of its edited form; one row per row of docs.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last floor(n_chars / 4) code points replaced by
    the first as many of the next document by doc_id, the last document followed by the
    first. A null text is empty; a text without words has an empty fingerprint, like
    another such text (1.0) and unlike all others (0.0). Texts of any length are read
    whole. Repeated ids follow each other by a hash of the text, a null id comes last.
    Other columns of docs, whatever their names, play no part; an empty table gives none.

    The texts are shuffled once, by ranges of ids that hold about ``run`` rows, however
    unevenly ids lie (rows alike in id and text stay together); words
    are counted and bids taken within those partitions. A word that weighs the same in
    both texts bids once for both.
    """
    body = F.coalesce(docs["text"], F.lit(""))
    ranges = _ranges(docs.select(order_id(docs["doc_id"]).alias("id")), run)
    base = docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(body).alias("th"), body.alias("body"))
    base = base.withColumn("bucket", _bucket(ranges))
    cols = ["bucket", "id", "th", "body"]
    rows = base.select(*cols, F.lit(0).alias("ghost")).unionByName(_heads(base).select(*cols, F.lit(1).alias("ghost")))
    by_id = Window.partitionBy("bucket").orderBy("ghost", "id", "th")
    rows = rows.withColumn("rn", F.row_number().over(by_id)).withColumn("next", F.lead("body").over(by_id))
    rows = rows.withColumn("n_chars", F.char_length("body").cast("long")).withColumn("q", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(body, 1, cast(n_chars as int) - q)"), F.expr("substring(coalesce(next, ''), 1, q)"))
    rows = rows.withColumn("edited", edited)
    sha = F.sha2(F.col("edited"), 256)
    # What else is known of a text goes with its words, as numbers in hex, so that nothing is joined back.
    facts = [F.substring(sha, 16 * i + 1, 16) for i in range(4)] + [F.hex("n_chars"), F.hex("id")]
    sent = F.array(*[F.struct(F.lit(e).alias("e"), s.alias("s")) for e, s in enumerate([F.col("body"), F.col("edited"), *facts])])
    words = rows.select("bucket", "rn", "ghost", F.explode(sent).alias("x"))
    words = words.select("bucket", "rn", "ghost", F.col("x.e").alias("e"), F.explode(F.split(F.concat(F.lit(" "), F.col("x.s")), SPACE + "+", -1)).alias("w"))
    one = lambda e: F.sum(((F.col("e") == e) & (F.col("w") != "")).cast("int"))
    h = F.when(F.col("e") < 2, F.xxhash64("w")).otherwise(F.conv(F.nullif("w", F.lit("")), 16, -10).cast("long"))
    counts = words.groupBy("bucket", "rn", F.greatest(F.col("e") - 1, F.lit(0)).alias("kind"), h.alias("h")).agg(one(0).alias("o"), one(1).alias("c"), F.max("ghost").alias("ghost"))
    # Which texts a weight is of: 0 the text, 1 the edited text, 2 both.
    weight = lambda of, n: F.struct(F.lit(of).alias("of"), F.log(F.nullif(n, F.lit(0))).alias("weight"))
    weights = F.when(F.col("o") == F.col("c"), F.array(weight(2, F.col("o")))).when(F.col("c") == 0, F.array(weight(0, F.col("o")))).when(F.col("o") == 0, F.array(weight(1, F.col("c")))).otherwise(F.array(weight(0, F.col("o")), weight(1, F.col("c"))))
    bidding = counts.select("bucket", "rn", "kind", "h", "ghost", F.explode(weights).alias("x")).select("bucket", "rn", "kind", "h", "ghost", "x.of", "x.weight")
    fact = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("h"))).alias(name)
    mins = [F.min(bid(F.col("h"), k, F.col("weight"))).alias(f"m{k}") for k in range(samples)]
    known = ["ghost", *[f"sha{i}" for i in range(4)], "n_chars", "id"]
    # Keys, samples and facts are under 100 columns, up to which an aggregation runs in generated code.
    least = bidding.groupBy("bucket", "rn", "of").agg(*mins, F.max("ghost").alias("ghost"), *[fact(i + 1, name) for i, name in enumerate(known[1:])])
    least = least.select("bucket", "rn", "of", *known, F.array(*[F.coalesce(f"m{k}", F.lit(float("inf"))) for k in range(samples)]).alias("m"))
    of = lambda x: F.max(F.when(F.col("of") == x, F.col("m"))).alias(f"m{x}")
    signed = least.groupBy("bucket", "rn").agg(*[F.max(c).alias(c) for c in known], of(0), of(1), of(2))
    lower = lambda x: F.coalesce(F.zip_with(f"m{x}", "m2", lambda a, b: F.least(a, b)), F.col(f"m{x}"), F.col("m2"))
    signed = signed.select("bucket", "rn", "ghost", "id", "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"), lower(0).alias("wo"), lower(1).alias("we"))
    signed = signed.withColumn("wn", F.lead("wo").over(Window.partitionBy("bucket").orderBy("rn")))
    near = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))
    # Each winner is written as 8 hex digits of a hash of its bid.
    text = lambda c: F.when(F.get(c, F.lit(0)) == float("inf"), F.lit("")).otherwise(F.array_join(F.transform(c, lambda v: F.lower(F.lpad(F.hex(F.xxhash64(v).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""))
    return signed.where("ghost = 0").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        text(F.col("wo")).alias("fingerprint"), text(F.col("we")).alias("edited_fingerprint"), near(F.col("wo"), F.col("we")).alias("near_edited"), near(F.col("wo"), F.col("wn")).alias("near_next"),
    )


def likeness(a: Column, b: Column, samples: int = 48) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))
