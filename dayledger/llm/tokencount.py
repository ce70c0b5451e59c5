"""Token counts without token ids.

The pre-token here is a stretch between ASCII white space. The pre-tokenizers of the
vocabularies that this serves drop white space and never join what it parts, so the
pieces of a text are the pieces of its pre-tokens. Pieces are counted once per distinct
pre-token of the corpus, by the library itself, and joined to each document's pre-token
frequencies. The most frequent pre-tokens (``head`` of them, a fixed bound) reach the
documents by broadcast, the others by a shuffled join, in which no key is frequent.

A tokenizer that joins what white space parts is refused (see ``check_tokenizer``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import NULL_ID, materialise, order_id

_SIZE = 200_000
_PROBES = ("a b", "  two  words ", "don't\tstop\r\n10 20", "x\x0by\x0cz", "É ç 日本 👍 ", "\n\n", "a.b, c-d (e)\n  f", "The the THE")


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(unit, n): pre-tokens and their counts, in portions of bounded size."""
    held: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if text:
                held.update(text.encode("utf-8", "surrogatepass").split())
            if len(held) > _SIZE:
                yield pd.DataFrame({"unit": list(held), "n": list(held.values())})
                held.clear()
    yield pd.DataFrame({"unit": list(held), "n": list(held.values())})


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_tokenizer(path: str) -> None:
    """Raises ValueError if the pieces of a few texts aren't those of their stretches between white space."""
    tokenizer = _tokenizer(path)
    count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    for text in _PROBES:
        if count(text) != sum(count(w.decode()) for w in text.encode().split()):
            raise ValueError(f"{path} doesn't part text at white space: {text!r}")


def _pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for pdf in batches:
            pieces = []
            for a in range(0, len(pdf), 2000):
                texts = [bytes(u).decode("utf-8", "replace") for u in pdf["unit"][a : a + 2000]]
                pieces += [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pdf.assign(pieces=pieces)

    return run


def _frequencies(head):
    """A row (id, th, n_bytes, known) for each document, with tokens of frequent pre-tokens
    summed, and a row (id, th, unit, n) for each other pre-token of it.

    A document's own row has a unit that is no pre-token, so it joins nothing and such
    rows spread over all partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = head.value.get
        for pdf in batches:
            ids, ths, sizes, known, units, ns = [], [], [], [], [], []
            for id_, th, text in zip(pdf["id"].tolist(), pdf["th"].tolist(), pdf["text"].tolist()):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                words = raw.split()
                counts = list(map(get, words))
                rest = Counter(w for w, c in zip(words, counts) if c is None) if None in counts else {}
                m = len(rest)
                ids += [id_] * (m + 1)
                ths += [th] * (m + 1)
                sizes += [len(raw)] + [None] * m
                known += [sum(filter(None, counts))] + [None] * m
                units.append(b" %d %d" % (id_, th))
                units += rest.keys()
                ns.append(0)
                ns += rest.values() if rest else []
            yield pd.DataFrame({"id": ids, "th": ths, "n_bytes": pd.array(sizes, "Int64"), "known": pd.array(known, "Int64"), "unit": units, "n": ns})

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, head: int = 1 << 18, head_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library on the whole text without begin, end or added special
    tokens; special strings inside texts count as its default has them. A null or empty
    text has 0, a text of any length is read whole. Repeated rows are counted once and
    given as often as they are there; rows that share an id, a null one too, are told
    apart by a hash of the text. Other columns, whatever their names, play no part.
    tokenizer_path must be readable on the driver and every executor.
    """
    check_tokenizer(tokenizer_path)
    texts = docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))
    units = texts.select("text").mapInPandas(_units, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = materialise(units.mapInPandas(_pieces(tokenizer_path), "unit binary, n long, pieces int"))
    # Units by powers of two of their count: the highest powers that hold head units and head_bytes of them at most.
    sizes = units.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("units"), F.sum(F.octet_length("unit")).alias("bytes")).collect()  # 64 rows at most
    held, held_bytes, least = 0, 0, 64
    for power, count, size in sorted(sizes, reverse=True):
        held, held_bytes = held + count, held_bytes + size
        if held > head or held_bytes > head_bytes:
            break
        least = power
    frequent = units.where(F.col("n") >= F.lit(float(2**least))).select("unit", "pieces").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["unit"].to_pylist(), frequent["pieces"].to_pylist())))
    rows = texts.mapInPandas(_frequencies(sent), "id long, th long, n_bytes long, known long, unit binary, n long")
    joined = rows.join(units.select("unit", "pieces"), "unit", "left")
    # Rows alike in id and text are as many as their own rows; all their sums are as many times too large.
    out = joined.groupBy("id", "th").agg(F.count("known").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("known").alias("known"), F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0)).alias("rest"))
    out = out.withColumn("n_tokens", F.expr("known + rest div copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
