"""N-gram Jaccard join by universe partition and the pigeonhole principle; exact.

1. Sizes fall into bands. In a band's join all shingles are hashed to the same number of
   segments, a few more than the shingles by which two sets of the band may differ and
   still link. A set takes part in the join of its own band, and in that of the band below
   with the smaller sets there.
2. A set's subset of a segment is one key. Two sets that link differ in at most ``most``
   shingles, so of ``most + 1`` of a set's segments one is the same in both.
3. Segments are allocated by cost. A key that more than ``SMALL`` sets have is dear, and left
   out where a set's other segments are ``most + 1``. A set with too few segments gives
   those with the fewest shingles a neighbourhood of one deletion, which counts twice, and
   the others send their own deletions where a Bloom filter says that such a set asks for them.
4. Keys meet in buckets, as blocks of numbers. Up to ``SMALL`` sets of a key are paired; a pair
   goes on if it shares as many keys as its sizes ask for. Sets that can't do without their
   dear keys meet around centres and are joined by their differences (as in ``neardup``),
   so that no step makes a row for each pair of a large group.
5. All pairs are verified on the full sets; components come from label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import NULL_ID, Scratch, materialise, order_id
from dayledger.llm.neardup import NearDuplicates, components, shingle_set
from dayledger.llm.words import WordHashes, mixed, split_words

#: Sets of a key that are paired at once.
SMALL = 16
#: Sets with fewer shingles have a segment for each of them.
SINGLE = 32
#: Sets of one key in one part of one task from which a key is dear before it is counted.
LOCAL = 64
#: Keys that a task holds, and that a bucket gets on average.
HELD, BUCKET = 1 << 21, 1 << 20
#: Classes whose copies are told from their first text by a broadcast.
COPIED = 1 << 15


class Bands:
    """The bands of sizes, and what sets of a size need."""

    def __init__(self, percent: int, slack: int = 8):
        self.percent, self.slack = percent, slack
        growth, edges = max(150, -(-10_000 // percent)), [0, SINGLE]
        while edges[-1] < 1 << 40:
            edges.append(-(-edges[-1] * growth // 100))
        self.edges = np.array(edges)

    def segments(self, band: int) -> int:
        """Segments in a band's join: one in ``slack`` more than the largest sets need, and 4."""
        if band == 0:
            return 1 << 20
        need = self.most(int(self.edges[band + 1]) - 1) + 1
        return need + (4 + need // self.slack if self.slack else 0)

    def most(self, n: int) -> int:
        """By how many shingles a set of n may differ from one that is as large or larger."""
        return n * (100 - self.percent) // self.percent

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def joins(self, n: int) -> list[tuple[int, int, int]]:
        """(band, role, most) of the joins that a set of n takes part in; role 1: with smaller sets of the band below."""
        if self.most(n) == 0:  # only an equal set links
            return []
        band = self.of(n)
        below = int(self.edges[band]) - 1
        low = [(band - 1, 1, (n + below) * (100 - self.percent) // (100 + self.percent))] if band and 100 * below >= self.percent * n else []
        return [(band, 0, self.most(n)), *low]


def _places(shingles: np.ndarray, count: int) -> np.ndarray:
    """The segment of each shingle; in order, as sorted hashes are cut into stretches of one width."""
    return ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _held(shingles: np.ndarray, count: int) -> int:
    """In how many segments a set has shingles."""
    at = _places(shingles, count)
    return 1 + int(np.count_nonzero(at[1:] != at[:-1]))


class Segments:
    """A set's segments in the join of a band."""

    def __init__(self, shingles: np.ndarray, band: int, count: int):
        at = _places(shingles, count)
        self.starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.sizes = np.diff(np.r_[self.starts, len(at)])
        self.tokens = mixed(shingles + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.add.reduceat(self.tokens, self.starts)
        self.place = mixed(at[self.starts] * np.uint64(1024) + np.uint64(band))

    def keys(self) -> np.ndarray:
        return mixed(self.sums ^ self.place)

    def deletions(self, which: np.ndarray) -> np.ndarray:
        """Keys of the segments ``which`` (flags) without one of their shingles; of those with two or more."""
        each = np.repeat(which & (self.sizes > 1), self.sizes)
        return mixed((np.repeat(self.sums, self.sizes)[each] - self.tokens[each]) ^ np.repeat(self.place, self.sizes)[each])

    def widened(self, most: int) -> np.ndarray | None:
        """Which segments get a neighbourhood: as many as lack for most + 1, those with the fewest deletions first."""
        lacking = most + 1 - len(self.starts)
        if lacking <= 0:
            return None
        able = np.flatnonzero(self.sizes > 1)
        which = np.zeros(len(self.starts), bool)
        which[able[np.argsort(self.sizes[able], kind="stable")[:lacking]]] = True
        return which


def _class_of(shingles: np.ndarray) -> tuple[bytes, int]:
    """A set's digest, and its number: 63 bits of it above a bit for the role. Sets that share a number are told apart when pairs are verified."""
    digest = xxhash.xxh128_digest(shingles.tobytes())
    return digest, int.from_bytes(digest[:8], "little", signed=True) & ~1


def _describe(width: int, bands: Bands):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                s = shingle_set(words.of(split_words(text)), width)
                if not len(s):
                    out.append((0, None, 0, 0, 0, 0, 0, None))
                    continue
                held, asked = [0, 0], []
                for band, role, most in bands.joins(len(s)):
                    held[role] = _held(s, bands.segments(band))
                    if held[role] <= most:
                        parts = Segments(s, band, bands.segments(band))
                        asked += [(band, k) for k in parts.keys()[parts.widened(most)].view(np.int64).tolist()]
                band = bands.of(len(s))
                out.append((len(s), *_class_of(s), band, int(bands.edges[band]) - 1, *held, asked or None))
            yield pd.concat([pdf[["doc_id", "id", "th"]], pd.DataFrame(out, columns=["n", "cls", "c", "band", "below", "own", "low", "asked"])], axis=1)

    return run


def _blocks(width: int, bands: Bands, buckets: int, copied, asked):
    """The keys of all sets, dealt to buckets: (bucket, kind, keys, classes).

    kind 0: keys (their low 32 bits) and classes, arrays of one length. kind 1: members of
    a key that is dear, dealt to buckets from ``buckets`` on by their classes, so no bucket
    gets them all. kind 2: the names of such keys, for their own bucket.
    """

    def dealt(k: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        bucket = ((k >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        low = k.astype(np.uint32)
        order = np.lexsort((low, bucket))
        bucket, low, c = bucket[order], low[order], c[order]
        # A key that many sets of this part have.
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])
        sizes = np.diff(np.r_[starts, len(low)])
        dear = np.repeat(sizes > LOCAL, sizes)
        for at in starts[sizes > LOCAL].tolist():
            yield int(bucket[at]), 2, low[at : at + 1].tobytes(), b""
        for at, size in zip(starts[sizes > LOCAL].tolist(), sizes[sizes > LOCAL].tolist()):
            own, name = c[at : at + size], (int(bucket[at]) << 32) + int(low[at])
            spread = own.view(np.uint64) // np.uint64(2) % np.uint64(buckets)
            for b in np.unique(spread).tolist():
                yield buckets + b, 1, np.int64(name).tobytes(), own[spread == b].tobytes()
        bucket, low, c = bucket[~dear], low[~dear], c[~dear]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)].tolist()
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            yield int(bucket[a]), 0, low[a:b].tobytes(), c[a:b].tobytes()

    def frame(k: list, c: list) -> pd.DataFrame:
        return pd.DataFrame(list(dealt(np.concatenate(k), np.repeat(np.array([x for x, _ in c]), [n for _, n in c]))), columns=["bucket", "kind", "keys", "classes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, first, held, k, c = WordHashes(), copied.value, 0, [], []
        table, asking = asked.value if asked is not None else (None, ())
        for pdf in batches:
            for id_, th, text in zip(pdf["id"].tolist(), pdf["th"].tolist(), pdf["text"]):
                s = shingle_set(words.of(split_words(text)), width)
                if not len(s) or not (joins := bands.joins(len(s))):
                    continue
                digest, number = _class_of(s)
                if first.get(digest, (id_, th)) != (id_, th):
                    continue
                for band, role, most in joins:
                    parts = Segments(s, band, bands.segments(band))
                    keys, which = [parts.keys()], parts.widened(most)
                    if which is not None:
                        keys.append(parts.deletions(which))
                    if band in asking:
                        near = parts.deletions(np.ones(len(parts.sizes), bool))
                        bit = (near & np.uint64(8 * len(table) - 1)).view(np.int64)
                        keys.append(near[table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1])
                    keys = np.concatenate(keys) if len(keys) > 1 else keys[0]
                    k.append(keys)
                    c.append((number | role, len(keys)))
                    held += len(keys)
                if held >= HELD:
                    yield frame(k, c)
                    held, k, c = 0, [], []
        if k:
            yield frame(k, c)

    return run


def _met(bucket: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """What meets in a bucket: pairs (a, b) and how many keys they share in it, and members a of dear keys (b is null)."""
    joined = lambda kind, column, dtype: np.frombuffer(b"".join(pdf[column][pdf["kind"] == kind]), dtype)
    passing = pdf[pdf["kind"] == 1]
    names = [np.repeat(np.frombuffer(k, np.int64), len(c) // 8) for k, c in zip(passing["keys"], passing["classes"])]
    k, c, dear = joined(0, "keys", np.uint32), joined(0, "classes", np.int64), np.unique(joined(2, "keys", np.uint32))
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    once = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(k)]
    k, c = k[once], c[once]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[: len(k)]
    sizes = np.diff(np.r_[starts, len(k)])
    is_dear = np.isin(k[starts], dear) | (sizes > SMALL)
    each = np.repeat(is_dear, sizes)
    hot_keys, hot = np.concatenate([*names, k[each].astype(np.int64) + (bucket[0] << 32)]), np.concatenate([joined(1, "classes", np.int64), c[each]])
    a, b = [], []
    for size in range(2, SMALL + 1):
        at = starts[(sizes == size) & ~is_dear]
        members = c[at[:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        a.append(members[:, i].ravel())
        b.append(members[:, j].ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    able = (a & b & 1 == 0) & (a >> 1 != b >> 1)  # two of the larger band meet in their own
    a, b = a[able] & ~1, b[able] & ~1
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    shared = np.diff(np.r_[first, len(a)])
    column = lambda hots, pairs: pd.array(np.concatenate([hots, pairs]), "Int64")
    out = pd.DataFrame({"key": column(hot_keys, shared * 0), "a": column(hot, a[first]), "b": column(hot * 0, b[first]), "shared": column(hot * 0, shared)})
    out.iloc[: len(hot), 2:] = pd.NA
    return out


class JaccardJoin(NearDuplicates):
    """The join of one table; ``rows`` and ``labels`` are its outcome, as in NearDuplicates."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80, slack: int = 8):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.bands = Bands(percent, slack)
        self.texts = docs.select(docs["doc_id"], order_id(docs["doc_id"]).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))
        with Scratch(self.spark) as scratch:
            every = self.texts.mapInPandas(_describe(width, self.bands), "doc_id long, id long, th long, n long, cls binary, c long, band int, below long, own long, low long, asked array<struct<band:int,k:long>>")
            every = scratch(every)
            self.rows = materialise(every.select("doc_id", "id", "th", "n", "cls"))
            facts = [F.min(x).alias(x) for x in ("c", "n", "band", "below", "own", "low", "asked")]
            some = every.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "th")).alias("k"), F.count(F.lit(1)).alias("copies"), *facts)
            self.classes = materialise(some.select("cls", "k.*", *[x for x in some.columns if x not in ("cls", "k")]))
            self.labels = self._labels(scratch)

    def _asked(self) -> tuple[np.ndarray, set[int]] | None:
        """A Bloom filter of the keys whose neighbourhoods are asked for, of 16 MB at most, and their bands; None if there are none."""
        keys = self.classes.where("asked is not null").select(F.explode("asked").alias("x")).select("x.band", "x.k")
        told = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each band
        n = sum(r.n for r in told)
        if not n:
            return None
        bits = min(27, max(16, (64 * n).bit_length()))
        low = keys.select(F.col("k").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
        words = low.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["w"].to_numpy()] = words["v"].to_numpy()
        return table.view(np.uint8), {r.band for r in told}

    def _meetings(self, scratch: Scratch) -> DataFrame:
        sc = self.spark.sparkContext
        keys = self.classes.agg(F.sum(F.col("own") + F.col("low"))).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET))
        copies = self.classes.where("copies > 2").orderBy(F.desc("copies"), "cls").limit(COPIED).select("cls", "id", "th").collect()
        copied = sc.broadcast({bytes(r.cls): (r.id, r.th) for r in copies})
        table = self._asked()
        blocks = _blocks(self.width, self.bands, buckets, copied, None if table is None else sc.broadcast(table))
        dealt = self.texts.select("id", "th", "text").mapInPandas(blocks, "bucket long, kind int, keys binary, classes binary")
        return scratch(dealt.groupBy("bucket").applyInPandas(_met, "key long, a long, b long, shared long"))

    def _candidates(self, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, shared) that share enough keys, and (a, b) of centres with the sets that can't do without dear keys."""
        met, p = self._meetings(scratch), self.percent
        hot = met.where("b is null").select("key", F.col("a").bitwiseAND(F.lit(-2)).alias("c"), F.col("a").bitwiseAND(F.lit(1)).alias("role")).distinct()
        hot = scratch(hot)
        lost = hot.groupBy("c").agg(F.count_if(F.col("role") == 0).alias("lost_own"), F.count_if(F.col("role") == 1).alias("lost_low"))
        rest = lambda x: (F.col(x) - F.coalesce("lost_" + x, F.lit(0))).alias(x)
        facts = scratch(self.classes.join(lost, "c", "left").select("c", "cls", "n", "band", "below", rest("own"), rest("low")))
        side = lambda v: facts.select(F.col("c").alias(v), F.col("cls").alias("cls_" + v), *[F.col(x).alias(f"{x}_{v}") for x in ("n", "band", "own", "low")])
        pairs = met.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(side("a"), "a").join(side("b"), "b")
        most = f"(n_a + n_b) * {100 - p} div {100 + p}"
        least = f"greatest(1, if(band_a > band_b, low_a, own_a) - {most}, if(band_b > band_a, low_b, own_b) - {most})"
        good = pairs.where(f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b) and shared >= {least}")
        pairs = good.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), "shared")
        # Sets whose other segments are too few; a pair of which one can do without dear keys shares another.
        bound = hot.join(facts, "c").where(f"if(role = 0, own <= n * {100 - p} div {p}, low <= (n + below) * {100 - p} div {100 + p})").select("key", "role", "cls")
        bound = scratch(bound)
        often = bound.groupBy("cls").agg(F.count(F.lit(1)).alias("keys"))
        heads = bound.join(often, "cls").groupBy("key").agg(F.max(F.struct("keys", "cls")).alias("m"), F.min("role").alias("role")).where("role = 0").select("key", F.col("m.cls").alias("a"))
        chains = bound.select("key", F.col("cls").alias("b")).join(heads, "key").where("a <> b").select("a", "b").distinct()
        # Sets that dear keys connect have one centre, so no set is compared around two.
        groups = scratch(components(scratch(chains)).join(often, F.col("v") == F.col("cls")).select("cls", "label", "keys"))
        centre = groups.groupBy("label").agg(F.max(F.struct("keys", "cls")).alias("m")).select("label", F.col("m.cls").alias("a"))
        spokes = groups.select("label", F.col("cls").alias("b")).join(centre, "label").where("a <> b").select("a", "b")
        return scratch(pairs), scratch(spokes)

    def _labels(self, scratch: Scratch) -> DataFrame:
        pairs, spokes = self._candidates(scratch)
        # First each set's best partner and the pairs with centres, then what these leave apart.
        best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("k")).select("k.a", "b").join(spokes, ["a", "b"], "left_anti")
        tried = scratch(spokes.withColumn("around", F.lit(True)).unionByName(best.withColumn("around", F.lit(False))))
        compared = scratch(self._compared(tried, scratch))
        links, around = compared.where("good").select("a", "b"), compared.where("around")
        labels = components(links)
        more = scratch(self._within(around, labels, scratch))
        rest = scratch(self._apart(pairs.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"), labels))
        if not rest.isEmpty():
            found = self._compared(rest.withColumn("around", F.lit(False)), scratch).where("good").select("a", "b")
            more = scratch(more.unionByName(found))
        return labels if more.isEmpty() else components(links.unionByName(more))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, slack: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Texts link if 100 * intersection >= percent * union of their sets of distinct
    ``width``-word shingles, A-Z lower-cased. A text with fewer words is one shingle; a
    null text or one without words has an empty set and links with nothing. component_id is
    the smallest doc_id that links reach. A null doc_id counts as the largest, and rows of one
    id with different texts are told apart; repeated rows fare alike. Texts are read
    whole, other columns, whatever their names, play no part, and an empty table gives none.

    No link is left to chance but in two ways: two shingles may share a hash of 64 bits,
    and a set's shingles may fall into so few segments that even neighbourhoods of all of them don't
    make ``most + 1``, which is rarer still (under 1e-16 a set). slack is how many segments there
    are to spare: one for each ``slack``, none for 0, which leaves more to neighbourhoods.
    """
    m = JaccardJoin(docs, width, percent, slack).membership()
    return m.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


#: op11 in DuckDB's SQL: every pair that shares a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
         JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
         WHERE 100 * nx.n >= 80 * ny.n AND 100 * ny.n >= 80 * nx.n
         GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM link) UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
