"""Vector code compression: product codes whose codebooks come from member-resident Lloyd rounds.

A vector is cut into parts, each with a codebook of its own. The parts are dealt once to
partitions by (position, entry, salt), as blocks of numbers, and stay there. In a round the
partitions sum their resident members, the sums by (position, entry) give the new
codebooks, which are a few numbers, and each partition assigns its residents anew. Only
parts whose entry has changed move, in the next shuffle; the union with those that stay
keeps the partitioning. The salt is a hash of the row, so a common entry is spread.

All numbers are whole, so results don't depend on the order of sums. A partition that is
lost with its executor is computed again from the shuffles before it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import NULL_ID, materialise, order_id, spread_hot

SCALE = 4096
#: Parts of a block, and parts that a partition holds on average.
BLOCK, RESIDENT = 1 << 14, 1 << 17
#: Whole numbers of this size and above are reckoned with as Python's, of any size.
_WIDE = 2.0**25
_MOST = 2**63 - 1


def _scaled(vectors: list, length: int) -> np.ndarray:
    """floor(SCALE * x) of vectors as rows, filled up with 0 to length; whole numbers in doubles."""
    out = np.zeros((len(vectors), length))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * SCALE)


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers to reckon with: of 64 bits where no sum of squares can overflow."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() < _WIDE else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first of those equally near, and its squared distance."""
    parts, entries = _whole(parts), _whole(entries)
    apart = np.stack([((parts - e) ** 2).sum(axis=1) for e in entries], axis=1)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(parts)), best]


def _parted(position: int, entry: np.ndarray, salt: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Blocks of parts by their new key: (key, columns)."""
    order = np.lexsort((salt, entry))
    entry, salt, columns = entry[order], salt[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (salt[1:] != salt[:-1])])[: len(order)].tolist()
    for a, b in zip(starts, [*starts[1:], len(order)]):
        for at in range(a, b, BLOCK):
            end = min(b, at + BLOCK)
            yield (position, int(entry[a]), int(salt[a])), [c[at:end] for c in columns]


def _salt(id_: np.ndarray, th: np.ndarray, salts: int) -> np.ndarray:
    mixed = (id_.view(np.uint64) ^ (th.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(salts)).astype(np.int64)


def _first_deal(books: list[np.ndarray], length: int, salts: int):
    """Blocks (key, [id, th, weight, part]) of a table's vectors; a vector that repeats in a batch is one part of that weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            one = pdf.drop_duplicates(["id", "th"]).merge(pdf.groupby(["id", "th"]).size().rename("weight").reset_index(), on=["id", "th"])
            id_, th, weight = (one[c].to_numpy(np.int64) for c in ("id", "th", "weight"))
            x, salt = _scaled(one["v"].tolist(), length), _salt(id_, th, salts)
            for position, part in enumerate(np.split(x, len(books), axis=1)):
                yield pd.DataFrame({"block": [pickle.dumps(b) for b in _parted(position, nearest(part, books[position])[0], salt, [id_, th, weight, part])]})

    return run


def _sums(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """((position, entry), (sum, count)) of a partition's residents: a row for each of its entries at most."""
    held: dict = {}
    for (position, entry, _), (_, _, weight, part) in blocks:
        part, weight = _whole(part), weight.astype(object) if weight.sum() > 1 << 36 else weight
        total = (part * weight[:, None]).sum(axis=0, initial=0).tolist()
        old = held.get((position, entry), ([0] * len(total), 0))
        held[position, entry] = [int(a) + int(b) for a, b in zip(old[0], total)], old[1] + int(weight.sum())
    yield from held.items()


def _added(a: tuple, b: tuple) -> tuple:
    return [x + y for x, y in zip(a[0], b[0])], a[1] + b[1]


def _reassigned(books: list[np.ndarray], salts: int):
    """Blocks under the key where they are, with the key of their new entry."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for key, (id_, th, weight, part) in blocks:
            entry = nearest(part, books[key[0]])[0]
            for new, columns in _parted(key[0], entry, _salt(id_, th, salts), [id_, th, weight, part]):
                yield key, (new, columns)

    return run


def _coded(books: list[np.ndarray]):
    """From blocks: (id, th, position, entry, apart) of their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["block"]:
                (position, _, _), (id_, th, _, part) = pickle.loads(block)
                entry, apart = nearest(part, books[position])
                yield pd.DataFrame({"id": id_, "th": th, "position": position, "entry": entry, "apart": [min(int(d), _MOST) for d in apart]})

    return run


def _books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def _rounds(blocks: RDD, books: list[np.ndarray], rounds: int, salts: int, partitions: int) -> tuple[RDD, list[np.ndarray]]:
    """The blocks at their last owners, and the codebooks after all rounds."""

    def deal(key: tuple) -> int:
        return xxhash.xxh64_intdigest(b"%d %d %d" % key) % partitions

    kept: list[RDD] = []
    resident = blocks.partitionBy(partitions, deal)
    for k in range(rounds):
        sums = dict(resident.mapPartitions(_sums).reduceByKey(_added, len(books)).collect())  # a row for each entry
        books = [np.array([[x // sums[p, e][1] for x in sums[p, e][0]] if (p, e) in sums else list(old) for e, old in enumerate(book)], object).reshape(book.shape) for p, book in enumerate(books)]
        if len(kept) > 1:
            kept[-2].unpersist()
        if k + 1 < rounds:
            marked = resident.mapPartitions(_reassigned(books, salts), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(marked)
            stay = marked.mapPartitions(lambda rows: ((key, columns) for key, (new, columns) in rows if new == key), preservesPartitioning=True)
            moving = marked.mapPartitions(lambda rows: ((new, columns) for key, (new, columns) in rows if new != key))
            resident = stay.union(moving.partitionBy(partitions, deal))
    return resident, books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, salts: int = 64, vector: str = "embedding") -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null, a component that isn't finite, or one that
    SCALE takes beyond the doubles, go. Components become floor(SCALE * x). Codebooks begin
    with the parts of the ``entries`` smallest vec_ids (a null one is the largest, ties by
    a hash of the vector; fewer rows give fewer entries). Each round assigns every part to
    the nearest entry, ties to the lower one, and replaces entries by the floor of their
    parts' mean. error sums the final squared distances, label_error the errors of equal
    labels, nulls together; both end at 2**63 - 1.

    All vectors should have one length that ``parts`` divides; others, empty ones too, are
    filled up with 0 to the longest and to a multiple. Rows alike in id, vector and label
    are coded alike, each a row; other columns, whatever their names, play no part, and an
    empty table gives none. A common entry is dealt over ``salts`` keys or more.
    """
    spark, v = vectors.sparkSession, vectors[vector]
    most = float(np.finfo(np.float64).max) / SCALE
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= most))
    label = F.coalesce(F.concat(F.lit("="), vectors["label"].cast("string")), F.lit(""))
    kept = vectors.where(v.isNotNull() & whole).select(order_id(vectors["vec_id"]).alias("id"), F.xxhash64(v).alias("th"), label.alias("lab"), v.cast("array<double>").alias("v"))
    n, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    first = kept.orderBy("id", "th").select("v").limit(entries).collect()
    length = max(parts, -(-(longest or 0) // parts) * parts)
    begin = np.array([[int(x) for x in row] for row in _scaled([r.v for r in first], length)], object).reshape(len(first), length)
    books = np.split(begin, parts, axis=1)
    coded = spark.createDataFrame([], "block binary")
    if n:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // RESIDENT))
        salts = max(salts, partitions)
        blocks = kept.select("id", "th", "v").mapInPandas(_first_deal(books, length, salts), "block binary")
        resident, books = _rounds(blocks.rdd.map(lambda r: pickle.loads(r[0])), books, rounds, salts, partitions)
        coded = spark.createDataFrame(resident.map(lambda b: (pickle.dumps(b),)), "block binary")
    coded = coded.mapInPandas(_coded(books), "id long, th long, position int, entry int, apart long")
    at = lambda p, c: F.max(F.when(F.col("position") == p, F.col(c)))
    sum_ = lambda cols: F.least(sum(cols[1:], cols[0]), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    digits = F.lower(F.concat(*[F.lpad(F.hex(at(p, "entry")), 2, "0") for p in range(parts)]))
    codes = coded.groupBy("id", "th").agg(digits.alias("code"), sum_([at(p, "apart").cast("decimal(38,0)") for p in range(parts)]).alias("error"))
    rows = materialise(kept.select("id", "th", "lab").join(codes, ["id", "th"]))
    labels = rows.groupBy("lab").agg(sum_([F.sum(F.col("error").cast("decimal(38,0)"))]).alias("label_error"), F.count(F.lit(1)).alias("rows"))
    rows, labels = spread_hot(rows, materialise(labels), "lab", "rows", ["id", "th"])
    out = rows.join(labels, ["lab", "salt"])
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("vec_id"), "code", "error", "label_error", F.lit(_books_sha256(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """op12 in DuckDB's SQL: the rounds one after another, all in whole numbers."""
    apart = lambda p, e: f"CAST(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({p}[i] - {e}[i]) * ({p}[i] - {e}[i]))) AS BIGINT)"
    out = [f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    part AS (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p)),
    smallest AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
    book0 AS (SELECT p, e, x AS c FROM part JOIN smallest USING (vec_id))"""]
    for k in range(rounds + 1):
        out.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, x, m.e AS e, m.d AS d FROM (SELECT vec_id, p, any_value(x) AS x, min({{'d': {apart('x', 'c')}, 'e': e}}) AS m FROM part JOIN book{k} USING (p) GROUP BY vec_id, p))")
        if k < rounds:
            out.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM
              (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM part) + 1)) AS i) GROUP BY ALL)) GROUP BY p, e)""")
            out.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)")
    out.append(f"""sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
    coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
    SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN coded USING (vec_id), sha""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


ORACLE = _oracle()
