"""The exact Jaccard join, vector codes and spelling variants, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayledger.llm import codes, jaccard, neardup, spelling
from tests.llm.conftest import ROWS
from tests.llm.test_pairs import grown, plain_components


def joined(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **options).collect()}


@pytest.mark.parametrize("slack", [8, 0])
def test_join_of_mixed_sizes(spark, slack):
    """Chains of texts that grow or change word by word, in all bands; without slack many sets need neighbourhoods of one deletion."""
    rng, texts = random.Random(3), {}
    word = lambda: "".join(rng.choices("abcdef", k=5))
    for size in (1, 3, 4, 5, 8, 12, 20, 34, 36, 40, 52, 60, 75, 110, 130, 300):
        for _ in range(6):
            w = [word() for _ in range(size)]
            for step in range(4):
                texts[len(texts)] = " ".join(w)
                for _ in range(rng.randint(0, 1 + size // 40)):
                    k = rng.randrange(len(w) + 1)
                    w = [w[:k] + [word()] + w[k:], w[:k] + w[k + 1 :] or [word()], w[: k - 1] + [word()] + w[k:], w + [word()] * 2][rng.randrange(4)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = plain_components(texts, 5, 80)
    assert joined(df, slack=slack) == want and len({c for _, c in want.values()}) < 0.7 * len(texts)


def test_neighbourhoods_meet():
    """Of two sets that differ in one shingle, the keys of one and the deletions of the other meet, whichever is widened."""
    bands = jaccard.Bands(80, slack=0)
    x = jaccard.np.unique(jaccard.mixed(jaccard.np.arange(40, dtype=jaccard.np.uint64)))
    y = jaccard.np.delete(x, 17)
    band, count = bands.of(40), bands.segments(bands.of(40))
    a, b = jaccard.Segments(x, band, count), jaccard.Segments(y, band, count)
    apart = set(b.keys().tolist()) - set(a.keys().tolist())
    assert len(apart) <= 1 and apart <= set(a.deletions(jaccard.np.ones(len(a.sizes), bool)).tolist())
    which = a.widened(len(a.starts) + 2)
    assert which.sum() == min(3, (a.sizes > 1).sum()) and a.widened(len(a.starts) - 1) is None


def test_join_of_a_large_group(spark):
    """Hundreds of near copies on both sides of the threshold, and texts that share a passage with all of them."""
    texts = grown(11, 500, 150, 6)
    rng, passage = random.Random(5), " ".join(texts[0].split()[:40])
    texts |= {1000 + i: passage + " " + " ".join("".join(rng.choices("klmno", k=6)) for _ in range(90)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = plain_components(texts, 5, 80)
    assert joined(df) == want and 100 < len({c for _, c in want.values()}) < 500


def test_rows_of_differences(spark, monkeypatch):
    """Shingles of a group's differences are counted before they become rows, and those that meet nothing become none; rows a text don't grow with the group."""
    within, seen, share = neardup.NearDuplicates._within, {}, {}
    held, flat = neardup.NearDuplicates._held, neardup.NearDuplicates._flat

    def told(self, around, labels, scratch):
        seen["all"] = around.agg(F.sum(F.size("diff"))).first()[0]
        return within(self, around, labels, scratch)

    def kept(rows, met):
        out = flat(rows, met)
        counts = rows.select("c", "label", "diff").mapInPandas(neardup._counted, "c binary, t long, f long, low binary, high binary")
        ones = rows.select("c", "label", F.explode("diff").alias("t")).groupBy("c", "t").agg(F.count("t").alias("f"), F.countDistinct("label").alias("labels")).where("labels > 1")
        assert {(bytes(r.c), r.t, r.f) for r in held(rows).collect()} == {(bytes(r.c), r.t, r.f) for r in ones.collect()}
        seen["counts"], seen["rows"] = counts.count(), out.count()
        return out

    monkeypatch.setattr(neardup.NearDuplicates, "_within", told)
    monkeypatch.setattr(neardup.NearDuplicates, "_flat", staticmethod(kept))
    for size in (300, 1200):
        texts = grown(11, size, 150, 12)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
        assert joined(df) == plain_components(texts, 5, 80)
        assert seen["counts"] < 0.8 * seen["all"] and seen["rows"] < 0.8 * seen["all"], (size, seen)
        share[size] = {k: n / size for k, n in seen.items()}
    print(share)
    assert all(share[1200][k] < 1.5 * share[300][k] for k in seen), share


def test_join_odd(odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(ROWS) and all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (3, 4, 5))
    assert sorted(r.component_id for r in got if r.doc_id == 2) == [2, 2, 2]
    assert jaccard.jaccard_components(none).count() == 0


def plain_codes(rows, parts, entries, rounds):
    rows = [(i, [math.floor(x * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: r[0])
    size = len(rows[0][1]) // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, book: min((apart(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in rows:
                own[best(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(own, book)]
    found = [(i, [best(part(v, p), books[p]) for p in range(parts)], label) for i, v, label in rows]
    errors = Counter()
    for _, b, label in found:
        errors[label] += sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), errors[label], sha) for i, b, label in found)


def test_codes(spark):
    """Many copies of one vector, nulls, parts that are not finite, null labels, numbers beyond 64 bits."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8, 3) for i in range(150)]
    rows += [(2000, None, 1), (2001, [1.0, None, *[0.0] * 6], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf"), *[0.0] * 7], 1), (-5, [-0.00001] * 8, 1)]
    for more, rounds in (([], 6), ([(3000, [1e9, -3e7, *[1.5] * 6], 2), (3001, [5e8, *[0.0] * 7], 2)], 3)):
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>, label int").repartition(5).withColumn("th", F.lit("clash"))
        got = sorted(tuple(r) for r in codes.compress(df, parts=4, entries=6, rounds=rounds, salts=5).collect())
        assert got == [(*r[:2], *(min(x, 2**63 - 1) for x in r[2:4]), r[4]) for r in plain_codes(rows + more, 4, 6, rounds)]


def test_codes_stay_with_their_owners(spark):
    """Parts that keep their entry are not shuffled again."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 4, 0.05) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("th", F.xxhash64("v"))
    books = codes.np.split(codes.np.array([[int(x) for x in r] for r in codes._scaled([v for _, v in rows[:4]], 8)], object), 2, axis=1)
    blocks = df.select("id", "th", "v").mapInPandas(codes._first_deal(books, 8, 3), "block binary").rdd.map(lambda r: codes.pickle.loads(r[0]))
    resident, _ = codes._rounds(blocks, books, 4, 3, 7)
    assert resident.getNumPartitions() == 7 and resident.map(lambda b: len(b[1][0])).sum() == 800
    places = resident.mapPartitionsWithIndex(lambda k, bs: [(b[0], k) for b in bs]).collect()
    assert len({key for key, _ in places}) == len(set(places))  # a key is in one partition


def test_codes_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = [(None, [1.0] * 16, None), (2, [1.0] * 16, None), (2, [1.0] * 16, None), (2, [2.0] * 16, 1), (3, [], 1), (4, [0.5] * 3, 1)]
    got = codes.compress(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["2", "2", "2", "3", "4", "None"] and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}


def plain_variants(rows, damage):
    n = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run and damage and (h := zlib.crc32(f"{'' if i is None else i}:{run}".encode())) % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
            run = ""
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    known = {}
    for w in words:
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        known[w] = (best if best and words[best] >= 5 * words[w] else None, len(others))

    def root(w):
        return root(known[w][0]) if known[w][0] else w

    return sorted((w, f, root(w), words[w], k, words[f] if f else None) for w, (f, k) in known.items())


@pytest.mark.parametrize("small", [16, 1])
def test_variants(spark, monkeypatch, small):
    """Words with common halves, edits at every place, chains of forms, letters beyond ASCII; keys that are refined to the end."""
    monkeypatch.setattr(spelling, "SMALL", small)
    rng, words = random.Random(6), set()
    for stem in ("abcdef", "abcdeg", "strasse", "unbelievable", "éàüßÿ×÷", "aaaaaa", "abcabcabcabc"):
        words |= {stem, stem[1:] + "x", stem + "s", stem + "ss", "z" + stem}
        for k in range(len(stem)):
            words |= {stem[:k] + c + stem[k + 1 :] for c in "aqé"} | {stem[:k] + "w" + stem[k:], stem[:k] + stem[k + 1 :]}
    words |= {"common" + "".join(rng.choices("abc", k=3)) for _ in range(40)} | {"".join(rng.choices("abc", k=3)) + "common" for _ in range(40)}
    rows = [(i, " ".join(rng.choices(sorted(words), k=40)).title() if i % 2 else " ".join(rng.choices(sorted(words), k=40))) for i in range(150)]
    rows += [(900 + i, f"{w} " * 5 ** rng.randint(1, 4)) for i, w in enumerate(sorted(words)[::5])]
    rows += [(2000, "letters " * 500), (2001, "lettars " * 60), (2002, "lettarz " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for damage in (None, 7):
        got = sorted(map(tuple, spelling.spelling_variants(df, damage=damage).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        want = plain_variants(rows, damage)
        assert got == want and sum(r[1] is not None for r in want) > 20
        assert damage or ("lettarz", "lettars", "letters", 6, 1, 60) in want


def test_variants_odd(spark, odd, none):
    assert spelling.spelling_variants(none).count() == 0
    assert spelling.spelling_variants(odd.where("text is null or doc_id in (4, 5)")).count() == 0
    df = spark.createDataFrame([(None, "straße-straße straße"), (1, "Straße/straße"), (1, "Straße/straße")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.spelling_variants(df).collect()] == [("straße", None, "straße", 7, 0, None)]
