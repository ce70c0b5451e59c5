"""Benchmark decontamination with spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others, so a hash over the
picked words survives substitutions at the ignored places. Seeds of benchmark items and
of documents are joined by hash; each hit fixes an alignment (a diagonal), and along it
the words around the hit are compared. A document overlaps an item where a window of
``window`` aligned words (the whole item, if shorter) agrees in min_share of them.

The masks leave out no pattern of substitutions that the rule allows: those of whole
windows were searched for that, and a shorter item has masks of its own length, built
from groups of its places of which as many are ignored as there may be substitutions.

A Bloom filter of the benchmark's seeds, sized by their number up to a bound, lets a
document's other seeds go before the shuffle. It loses no hit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import materialise, order_id, spread_hot
from dayledger.llm.words import WordHashes, mixed, odd_numbers, split_words

WINDOW = 13
MIN_SHARE = 0.8
#: Whatever two of 13 words are substituted, one of these fits the other eleven somewhere.
MASKS = ("11101011", "1111001111", "1101101111")
#: Bits of the Bloom filter for each seed of the benchmark, and its largest size (2**27 bits are 16 MB).
_BITS_EACH, _MOST_BITS = 256, 27


def masks(length: int, window: int = WINDOW, min_share: float = MIN_SHARE) -> tuple[str, ...]:
    """The masks for items of ``length`` words: MASKS for the window that they were searched for,
    else those that ignore any ``wrong`` of ``wrong + 2`` groups of places, where ``wrong`` words may differ."""
    if length >= window == WINDOW and min_share == MIN_SHARE:
        return MASKS
    size = min(window, length)
    wrong = size - math.ceil(min_share * size - 1e-9)
    groups = min(wrong + 2, size)
    return tuple("".join("0" if i % groups in gone else "1" for i in range(size)) for gone in combinations(range(groups), min(wrong, groups - 1))) if size else ()


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each place of the word hashes h; empty if h is shorter than mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    picked = [i for i, c in enumerate(mask) if c == "1"]
    out = np.zeros(n, np.uint64)
    for i, odd in zip(picked, odd_numbers(len(picked), zlib.crc32(mask.encode()))):
        out += h[i : i + n] * odd
    return mixed(out)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, min_share: float) -> tuple[int, int]:
    """First and last + 1 place in doc that windows on the diagonal cover; (0, 0) if none.

    shift is the place in doc less that in item.
    """
    a, b = max(0, shift), min(len(doc), shift + len(item))
    size = min(window, len(item))
    if b - a < size:
        return 0, 0
    same = np.concatenate(([0], np.cumsum(doc[a:b] == item[a - shift : b - shift])))
    good = np.nonzero(same[size:] - same[:-size] >= min_share * size)[0]
    return (a + int(good[0]), a + int(good[-1]) + size) if len(good) else (0, 0)


def _item_seeds(window: int, min_share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            for item_id, text in zip(pdf["item_id"], pdf["text"]):
                h = words.of(split_words(text))
                for mask in masks(len(h), window, min_share):
                    s = seeds(h, mask)
                    yield pd.DataFrame({"item_id": item_id, "length": min(len(h), window), "seed": s.view(np.int64), "at": np.arange(len(s), dtype=np.int32)})

    return run


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for pdf in batches:
        yield pd.DataFrame({"item_id": pdf["item_id"], "item": [words.of(split_words(t)).tobytes() for t in pdf["text"]]})


def _bloom(seeds_df: DataFrame) -> np.ndarray:
    """One bit for each value of the seeds' low bits, packed in bytes; 16 MB at most reach the driver."""
    bits = min(_MOST_BITS, max(16, (_BITS_EACH * seeds_df.count()).bit_length()))
    low = seeds_df.select(F.col("seed").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = low.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    return table.view(np.uint8)


def _doc_hits(bloom, own_masks: list[str], window: int):
    """(key, th, segment, start, words, places, seeds): what a text has that may hit.

    A segment is a stretch of hits with window words of context on both sides;
    stretches that touch are one segment.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = WordHashes(), bloom.value
        low, longest = np.uint64(8 * len(known) - 1), max(map(len, own_masks), default=0)
        for pdf in batches:
            rows = []
            for key, th, text in zip(pdf["id"], pdf["th"], pdf["text"]):
                h = words.of(split_words(text))
                at, found = [], []
                for mask in own_masks:
                    s = seeds(h, mask)
                    bit = (s & low).view(np.int64)
                    i = np.nonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)[0]
                    if len(i):
                        at.append(i)
                        found.append(s[i])
                if not at:
                    continue
                at, found = np.concatenate(at), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                cuts = np.nonzero(np.diff(at) > longest + 2 * window)[0] + 1
                for n, (a, s) in enumerate(zip(np.split(at, cuts), np.split(found, cuts))):
                    first = max(0, int(a[0]) - window)
                    rows.append((key, th, n, first, h[first : int(a[-1]) + longest + window].tobytes(), a.astype(np.int32), s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "th", "segment", "first", "words", "at", "seeds"])

    return run


def _verify(window: int, min_share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, item_id, first, words, item, shifts in zip(pdf["id"], pdf["item_id"], pdf["first"], pdf["words"], pdf["item"], pdf["shifts"]):
                doc, it = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                for shift in shifts:
                    a, b = overlap(doc, it, int(shift) - first, window, min_share)
                    if b > a:
                        out.append((id_, item_id, a + first, b + first))
            yield pd.DataFrame(out, columns=["id", "item_id", "start", "stop"])

    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, item_id, start, stop): word stretches of documents that overlap benchmark items.

    One row for each document, item and alignment that holds a window of agreement; id is
    doc_id with null as the largest. Texts and items that are null or without words
    overlap nothing; an item of any other length is found, a text of any length is read
    whole. Repeated rows give one result; rows that share an id are read as texts of one
    document. A null item_id is an item like others. Other columns play no part.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    item_seeds = materialise(items.mapInPandas(_item_seeds(window, min_share), "item_id long, length int, seed long, at int").distinct())
    item_words = materialise(items.mapInPandas(_item_words, "item_id long, item binary").distinct())
    lengths = sorted(r.length for r in item_seeds.select("length").distinct().collect())  # window numbers at most
    own_masks = list(dict.fromkeys(m for n in lengths for m in masks(n, window, min_share)))
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(item_seeds))
    texts = docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))
    hits = texts.mapInPandas(_doc_hits(bloom, own_masks, window), "id long, th long, segment int, first int, words binary, at array<int>, seeds array<long>")
    hits = materialise(hits)
    places = hits.select("id", "th", "segment", F.explode(F.arrays_zip("at", "seeds")).alias("x")).select("id", "th", "segment", F.col("x.at").alias("place"), F.col("x.seeds").alias("seed"))
    # A passage that many documents share has hot seeds.
    often = materialise(places.groupBy("seed").agg(F.count(F.lit(1)).alias("rows")).join(item_seeds.select("seed", "item_id", "at"), "seed"))
    places, seeded = spread_hot(places, often, "seed", "rows", ["id", "th"])
    lines = places.join(seeded, ["seed", "salt"]).groupBy("id", "th", "segment", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.lit(1).alias("one"))
    lines = lines.groupBy("id", "th", "segment", "item_id").agg(F.collect_list("shift").alias("shifts"))
    pairs = lines.join(hits.select("id", "th", "segment", "first", "words"), ["id", "th", "segment"])
    # An item that many documents hold is a hot key as well: its seeds' rows bound the documents that meet it.
    met = often.groupBy(F.col("item_id").alias("own")).agg(F.sum("rows").alias("rows"))
    item_words = item_words.join(met, F.col("item_id").eqNullSafe(F.col("own"))).drop("own")
    pairs, item_words = spread_hot(pairs, materialise(item_words), "item_id", "rows", ["id", "th", "segment"])
    item_words = item_words.withColumnsRenamed({"item_id": "own", "salt": "own_salt"})
    pairs = pairs.join(item_words, F.col("item_id").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("own_salt")))
    checked = pairs.select("id", "item_id", "first", "words", "item", "shifts").mapInPandas(_verify(window, min_share), "id long, item_id long, start long, stop long")
    return checked.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per overlapping document: doc_id, n_items, items, n_spans.

    Documents that overlap nothing, as those with null or empty texts, have no row. Rows
    that share a doc_id, a null one included, are one document; repeats change nothing.
    Items that share an item_id are one item, a null item_id counts in n_spans alone.
    """
    found = benchmark_overlaps(docs, benchmark, **options)
    out = found.groupBy("id").agg(F.countDistinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_spans"))
    return out.select(F.when(F.col("id") != 2**63 - 1, F.col("id")).alias("doc_id"), "n_items", "items", "n_spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that overlap the benchmark; columns as they are.

    All rows of an id go if one of them overlaps; a null id is an id of its own. Rows
    with null or empty texts stay, and all rows stay if the benchmark is empty.
    """
    gone = materialise(benchmark_overlaps(docs, benchmark, **options).select(F.col("id").alias("__gone")).distinct())
    return docs.join(gone, order_id(docs["doc_id"]) == gone["__gone"], "left_anti")
