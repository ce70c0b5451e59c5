"""Near-duplicates, decontamination, token counts and the pipeline."""

import math
import random
import re
from collections import defaultdict
from functools import partial
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from dayledger.llm import decontaminate, mixing, neardup, tokencount
from dayledger.llm.common import spread_hot, table
from dayledger.llm.words import WordHashes, split_words
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(texts, width, percent):
    sets, parent = {i: shingles(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in held[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def grown(seed, n, size, edits):
    """Texts in groups around a centre, each with some words of it changed, and lone texts with a common line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    centre, common = [word() for _ in range(size)], " ".join(word() for _ in range(12))
    out = {0: " ".join(centre)}
    for i in range(1, n):
        w = list(centre)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(size)] = word()
        out[i] = " ".join(w)
    for i in range(n, n + 60):
        out[i] = common + " " + " ".join(word() for _ in range(rng.randint(0, 9)))
    return out


@pytest.mark.parametrize("edits", [2, 5])
def test_large_groups(spark, edits):
    """Groups far above a small node, with pairs on both sides of the threshold."""
    texts = grown(edits, 150, 120, edits)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == plain_components(texts, 3, 85)


def test_group_around_the_threshold(spark):
    """A thousand near copies of one text, many of them just above or below the threshold with each other."""
    texts = grown(11, 1000, 150, 12)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    want = plain_components(texts, 3, 85)
    assert got == want and 20 < len({c for i, (_, c) in want.items() if i < 1000}) < 980


def test_hot_nodes_are_salted(spark, monkeypatch):
    """With salts from ten rows on, every large node is hot; the outcome is that of brute force."""
    monkeypatch.setattr(neardup, "spread_hot", partial(spread_hot, each=10))
    texts = grown(5, 150, 120, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == plain_components(texts, 3, 85)


def test_rows_grow_with_a_group(spark, monkeypatch):
    """Rows of small nodes, pairs with centres and pairs of differences for each class don't grow with the size of the group."""
    made = {}
    walk, met = neardup.NearDuplicates._walk, neardup.NearDuplicates._met

    def walked(self, scratch):
        few, spokes = walk(self, scratch)
        made["walk"] = few.count() + spokes.count()
        return few, spokes

    def paired(tokens):
        out = met(tokens)
        made["met"] = out.count()
        return out

    monkeypatch.setattr(neardup.NearDuplicates, "_walk", walked)
    monkeypatch.setattr(neardup.NearDuplicates, "_met", staticmethod(paired))
    share = {}
    for size in (500, 2000):
        texts = grown(11, size, 150, 12)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
        neardup.near_duplicates(df, 3, 85).count()
        share[size] = {k: n / size for k, n in made.items()}
    print(share)
    assert all(share[2000][k] < 1.5 * share[500][k] + 1 for k in share[500]), share


def test_children_only_where_a_loose_class_is(spark, monkeypatch):
    """A few texts that share a third of a large group's text send few of the group on to children, at either size; links among them are found."""
    levels = []
    sized = neardup.NearDuplicates._sized

    def counted(nodes, scratch):
        levels.append(nodes.count())
        return sized(nodes, scratch)

    monkeypatch.setattr(neardup.NearDuplicates, "_sized", staticmethod(counted))
    for size in (200, 800):
        texts, rng = grown(4, size, 150, 12), random.Random(9)
        word = lambda: "".join(rng.choices("abcdefghij", k=5))
        for i in range(1000, 1040, 2):  # pairs of loose texts, some of which link
            w = texts[0].split()[:60] + [word() for _ in range(90)]
            texts[i], w[100], w[i % 7 + 120] = " ".join(w), word(), word()
            texts[i + 1] = " ".join(w)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
        levels.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
        want = plain_components(texts, 3, 85)
        assert got == want and sum(want[i + 1][1] == i for i in range(1000, 1040, 2)) > 10
        assert 0 < sum(levels[1:]) < 4 * len(texts), (size, levels)


def test_pairs_in_a_large_group(spark):
    """Texts of a large group, below the threshold with the others and above it with one whose signature agrees less than most."""
    rng, words = random.Random(8), WordHashes()
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    sign = lambda t: neardup.signature(neardup.shingle_set(words.of(split_words(t)), 3))
    centre, pairs = [word() for _ in range(400)], []
    for _ in range(800):
        places = rng.sample(range(400), 13)
        new = {at: word() for at in places}
        pair = [" ".join(new[at] if at in own else w for at, w in enumerate(centre)) for own in (places[:8], places[5:])]  # three edits in common
        pairs.append(((sign(pair[0]) == sign(pair[1])).sum(), pair))
    pairs.sort(key=lambda x: x[0])
    texts = dict(enumerate(t for same, pair in [x for x in pairs if x[0] >= 44][:30] for t in pair))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    want = plain_components(texts, 3, 85)
    assert len({c for _, c in want.values()}) > 10
    assert got == want


def test_near_dedup_data(spark, data):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    want = plain_components(texts, 5, 80)
    assert got == want
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (n, c) in want.items() if i == c}


def test_near_dedup_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (3, 4, 5))
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id == 2) == [(2, True)] * 3
    stay = neardup.drop_near_duplicates(odd).collect()
    assert sorted(str(r.doc_id) for r in stay) == sorted(["1", "2", "2", "3", "4", "5", "6", "None", "None", "-7"])
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_stages_odd(spark, odd, none, data):
    """Every stage on nulls, empty and long texts, repeats, clashing columns and an empty table."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none):
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == len(ROWS) and corpus_pipeline.STAGES[-1][1](spark, none, data).count() == 0


def test_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f G"), (None, "a b c d e f g"), (7, "x y"), (7, "x y"), (8, "y x")]
    stay = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in stay) == [1, 7, 8]


def test_paths_reach_far(spark):
    """Labels reach the end of a long chain."""
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    assert {bytes(r.v): bytes(r.label) for r in neardup.components(edges).collect()} == {bytes([i]): b"\x00" for i in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def rows_of_joins(spark, job):
    """What job returns, and how many rows Spark's joins made in it."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before, out, rows = store.executionsCount(), job(), 0
    bus.waitUntilEmpty()
    runs = store.executionsList(before, store.executionsCount() - before)
    for i in range(runs.size()):
        known, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and known.contains(m.accumulatorId()):
                    rows += int(known.apply(m.accumulatorId()).replace(",", ""))
    return out, rows


def test_edges_are_joined_while_apart(spark):
    """Labels of groups in a chain: joins make a few rows an edge, not two in every round."""
    rng, edges = random.Random(2), []
    for g in range(60):
        own = list(range(15 * g, 15 * g + 15))
        edges += list(combinations(own, 2)) + ([(own[0], own[0] - rng.randint(1, 15))] if g % 30 else [])
    name = rng.sample(range(1 << 16), 900)
    rows = [tuple(name[v].to_bytes(2, "big") for v in (e if rng.random() < 0.5 else e[::-1])) for e in edges]
    df = spark.createDataFrame(rows + rows[:100] + [(b"\xff\xff\xff",) * 2], "a binary, b binary").repartition(4)
    got, made = rows_of_joins(spark, lambda: {bytes(r.v): bytes(r.label) for r in neardup.components(df).collect()})
    half = [[name[v].to_bytes(2, "big") for v in range(k, k + 450)] for k in (0, 450)]
    assert got == {v: min(vs) for vs in half for v in vs} | {b"\xff\xff\xff": b"\xff\xff\xff"}
    print(made / len(edges))
    assert made < 4 * len(edges)


def plain_overlaps(text, items, window=13, share=0.8):
    """Every alignment of every item: those with a window that agrees enough."""
    d, out = np.array(WORD.findall(lower(text)), object), set()
    for item, t in items.items():
        w = WORD.findall(lower(t))
        size = min(window, len(w))
        if not size or len(d) < size:
            continue
        # same[i, j]: whether word i of the item stands at place j + i of the text, for each alignment j.
        padded = np.concatenate([np.full(len(w), None), d, np.full(len(w), None)])
        same = np.array([padded[i : i + len(d) + len(w)] == x for i, x in enumerate(w)])
        run = np.concatenate([np.zeros((1, same.shape[1]), int), np.cumsum(same, axis=0)])
        if (run[size:] - run[:-size]).max() >= share * size:
            out.add(item)
    return out


def test_decontaminate_data(spark, data):
    docs, bench = table(spark, data, "documents"), table(spark, data, "benchmark")
    got = {r.doc_id: set(r["items"]) for r in decontaminate.contaminated(docs, bench).collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    want = {r.doc_id: found for r in docs.collect() if (found := plain_overlaps(r.text, items))}
    assert got == want and want
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - got.keys()


def test_decontaminate_hot_item(spark, monkeypatch):
    """Items in every document, one of them without an id: they are salted from ten rows on, and all are found."""
    monkeypatch.setattr(decontaminate, "spread_hot", partial(spread_hot, each=10))
    item, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(16))
    docs = [(i, f"own{i} words {item} more{i} {other if i % 2 else ''} end{i}") for i in range(300)] + [(300 + i, f"clean{i} text of its own") for i in range(20)]
    bench = spark.createDataFrame([(1, item), (None, other), (2, "never seen in any of these documents at all but long enough to count")], "item_id long, text string")
    got = {r.doc_id: (set(r["items"]), r.n_spans) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert got == {i: ({1}, 1 + i % 2) for i in range(300)}


def test_decontaminate_substitutions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = [word() for _ in range(30)]
    docs = []
    for i in range(40):
        w = list(item)
        for p in range(i % 5, 30, 10):  # one word in ten
            w[p] = word()
        docs.append((i, " ".join([word() for _ in range(i)] + w + [word() for _ in range(7)])))
    docs += [(100 + i, " ".join(word() for _ in range(60))) for i in range(20)] + [(200, " ".join(item[:8])), (201, None), (None, " ".join(item)), (202, "it is too short")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, seed int")
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "too short", 0), (None, "", 0), (1, " ".join(item), 0)], "item_id long, text string, at int")
    got = {r.doc_id for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {*range(40), None, 202}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_masks_leave_out_no_pattern():
    """For items of 1 to 30 words: whatever words of a window the rule lets differ, a mask fits beside them."""
    for n in range(1, 31):
        size = min(n, 13)
        wrong = size - math.ceil(0.8 * size)
        for gone in (set(g) for k in range(wrong + 1) for g in combinations(range(size), k)):
            assert any(all(c == "0" or i + at not in gone for i, c in enumerate(m)) for m in decontaminate.masks(n) for at in range(size - len(m) + 1)), (n, gone)


def test_short_items(spark):
    """Items of 1 to 14 words in texts with as many substitutions as the rule allows, and with one more."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = {n: [word() for _ in range(n)] for n in range(1, 15)}
    docs, want = [], {}
    for n, words in items.items():
        wrong = min(n, 13) - math.ceil(0.8 * min(n, 13))
        for k in range(12):
            w = list(words)
            for p in rng.sample(range(min(n, 13)), min(n, wrong + k % 2)):
                w[p] = word()
            text = " ".join([word() for _ in range(k)] + w + [word() for _ in range(3)])
            docs.append((len(docs), text))
            if found := plain_overlaps(text, {i: " ".join(x) for i, x in items.items()}):
                want[docs[-1][0]] = found
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want and len(want) > 60


def test_decontaminate_odd(odd, none, spark):
    bench = spark.createDataFrame([(1, "shared line of text here other words stand in this one")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(odd, bench).collect()] == [2]
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ROWS) - 3


def test_token_counts(spark, data, odd, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = "word_bpe_49k.json"
    tok = Tokenizer.from_file(P.path(name))
    strange = "a<|endoftext|>b <|startoftext|> É x y\x85z \x1c q İstanbul ΣΑΣ’s don't ́e"
    docs = table(spark, data, "documents").select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(9, strange)], "doc_id long, text string"))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for head in (1 << 18, 20):
        got = tokencount.count_tokens(docs, P.path(name), head=head).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokencount.count_tokens(none, P.path(name)).count() == 0
    want = sorted((str(r.doc_id), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokencount.count_tokens(odd, P.path(name), head=5).collect()) == want


def test_tokenizers_that_join_words_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "t.json")
    Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, unk_token="?")).save(path)
    with pytest.raises(ValueError, match="white space"):
        tokencount.check_tokenizer(path)


def test_pipeline(spark, data):
    """Each stage on what the one before kept, against plain Python where that is possible."""
    docs = table(spark, data, "documents")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = stage(spark, kept, data)
        if k < 4:
            assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
            kept = kept.persist()
        rows = {r.doc_id: r.text for r in before.collect()} if k < 4 else {}
        after = {r.doc_id: r.text for r in kept.collect()} if k < 4 else {}
        assert k == 4 or after.keys() <= rows.keys()
        if k == 0:
            bad = {r.doc_id for r in table(spark, data, "labels").where("quality = 0").collect()}
            good = {r.doc_id for r in table(spark, data, "labels").where("quality = 1").collect()}
            assert len(bad & after.keys()) < len(bad) and len(good - after.keys()) <= 0.05 * len(good)  # 60 labels or so
        if k == 1:
            from tests.llm.test_native import plain_dedup

            assert sorted(after.items()) == sorted((i, t) for i, t, _, _ in plain_dedup(list(rows.items())))
        if k == 2:
            assert set(after) == {i for i, (_, c) in plain_components(rows, 5, 80).items() if i == c}
        if k == 3:
            items = {r.item_id: r.text for r in table(spark, data, "benchmark").collect()}
            assert rows.keys() - after.keys() == {i for i, t in rows.items() if plain_overlaps(t, items)}
    sizes = {r.doc_id: r["size"] for r in before.select("doc_id", mixing.count_words("text").alias("size")).collect()}
    assert {r.doc_id: r["size"] for r in kept.collect()} == sizes
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect()) == sorted(tuple(r) for r in kept.collect())
