"""MinHash near-dedup: a chosen-path set similarity join, exact checks, components.

1. Each text becomes the set of its distinct word shingles, a digest of that set and a
   signature of minwise tokens. Texts with equal sets are one class from here on.
2. In each of several independent trees a class walks from the root: some of its tokens
   are chosen, by a hash of the node and the tokens' places, and each (node, place,
   token) is a child that it goes to. Similar sets share nodes.
3. Nodes of at most ``SMALL`` classes are compared exhaustively. They first send the links
   of a spanning forest, and the other pairs only where confirmed links don't join them.
4. In a larger node all classes are compared with its centre, a class that agrees most with
   the commonest tokens of a few of them. Those that agree with it in ``AROUND`` of the
   tokens are joined exactly among each other: two sets differ by what their differences
   to the centre differ, so a prefix-filter join over these differences, rarest shingle
   first, finds every link, and what the whole group has in common meets nobody. The
   others walk on to children of the node, and of those around the centre the ones that
   meet them in a child, which a Bloom filter of these children tells.
5. What signatures let pass is confirmed on the full sets. Components come from label
   propagation with pointer jumping, all as DataFrames.

No step makes a row for each pair of a group: a forest has fewer links than classes, and a
large group is compared by its differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayledger.llm.common import NULL_ID, Scratch, bloom, in_bloom, materialise, order_id, spread_hot
from dayledger.llm.words import WordHashes, mixed, odd_numbers, split_words

TOKENS = 64
TREES = 8
SMALL = 24
#: Mean number of children at a root, before it is raised until each root has one, which makes 24 in
#: all trees. A child is one token, so a pair at the threshold of 0.8 shares about 19.
CHOSEN = 1.5
#: Children of a class in a large node below the root, and steps of the walk to each. What
#: many classes share in half of their tokens leaves a 16th of a node together.
BRANCHES, STEPS = 4, 4
#: Share of its tokens that a class has in common with the centre around which it is joined.
AROUND = 0.25
#: Pairs that read one copy of their first text.
PORTION = 64


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the word hashes h.

    Fewer words than width make one shingle of all; no words make none.
    """
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i, odd in enumerate(odd_numbers(width, 77)):
        out += h[i : i + n] * odd
    return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    odd = odd_numbers(2 * TOKENS, 5).astype(np.uint32) | np.uint32(1)
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        part = x[None, a : a + 2048] ^ odd[:TOKENS, None]
        np.minimum(best, (part * odd[TOKENS:, None]).min(axis=1), out=best)
    return best


def _describe(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            n, cls, sig, low = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(words.of(split_words(text)), width)
                n.append(len(s))
                cls.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                tokens = signature(s) if len(s) else None
                sig.append(None if tokens is None else tokens.tobytes())
                low.append(None if tokens is None else tokens.astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "id": pdf["id"], "th": pdf["th"], "n": n, "cls": cls, "sig": sig, "low": low})

    return run


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, cls) for each child of the trees' roots that a class goes to."""
    limit, places = np.uint64(int(CHOSEN / TOKENS * 2**64)), odd_numbers(TOKENS, 901)
    roots = mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    tree, place = np.nonzero(mixed(roots[:, None] ^ places[None, :]) < limit)
    while len(set(tree)) < TREES:  # each root has a child at least
        limit = np.uint64(int(limit) + 2**56)
        tree, place = np.nonzero(mixed(roots[:, None] ^ places[None, :]) < limit)
    for pdf in batches:
        if len(pdf):
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, TOKENS)
            node = mixed(mixed(roots[tree] + places[place])[None, :] ^ sigs[:, place].astype(np.uint64))
            yield pd.DataFrame({"node": node.ravel().view(np.int64), "cls": np.repeat(pdf["cls"].to_numpy(), len(tree))})


def _children(known=None):
    """(node, cls) for BRANCHES children of each class's node; a child is STEPS of the tokens, whose places a hash of the node chooses.

    With known, a Bloom filter's broadcast, only for the children that it may hold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = odd_numbers(TOKENS, 901)
        for pdf in batches:
            if len(pdf):
                sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
                node = pdf["node"].to_numpy().view(np.uint64)
                place = np.argsort(mixed(node[:, None] ^ places[None, :]), axis=1, kind="stable")[:, : BRANCHES * STEPS]
                token = np.take_along_axis(sigs, place, axis=1)
                child = np.repeat(node[:, None], BRANCHES, axis=1)
                for k in range(STEPS):
                    child = mixed(mixed(child + places[place[:, k::STEPS]]) ^ token[:, k::STEPS])
                out = pd.DataFrame({"node": child.ravel().view(np.int64), "cls": np.repeat(pdf["cls"].to_numpy(), BRANCHES)})
                yield out if known is None else out[in_bloom(known.value, child.ravel())]

    return run


def _lows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, TOKENS)


def _forest(least: float):
    """From the classes of a small node: (node, a, b, same), a spanning forest of the pairs whose signatures agree enough, those that agree most first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for node, members in zip(pdf["node"], pdf["members"]):
                members = sorted((bytes(m["cls"]), bytes(m["low"])) for m in members)
                lows = _lows(m[1] for m in members)
                i, j = np.triu_indices(len(members), 1)
                same = (lows[i] == lows[j]).sum(axis=1)
                near = np.nonzero(same >= least * TOKENS)[0]
                tree = list(range(len(members)))
                for k in near[np.argsort(-same[near], kind="stable")].tolist():
                    x, y = int(i[k]), int(j[k])
                    if tree[x] != tree[y]:
                        old, new = tree[y], tree[x]
                        tree = [new if t == old else t for t in tree]
                        out.append((node, members[x][0], members[y][0], int(same[k])))
            yield pd.DataFrame(out, columns=["node", "a", "b", "same"])

    return run


def _apart_pairs(least: float):
    """From the classes of a small node, with labels and centres: the pairs that agree enough, aren't joined and have no centre in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for members in pdf["members"]:
                members = sorted((bytes(m["cls"]), bytes(m["low"]), bytes(m["label"]), set(() if m["centres"] is None else m["centres"])) for m in members)
                lows = _lows(m[1] for m in members)
                i, j = np.triu_indices(len(members), 1)
                for x, y in np.column_stack([i, j])[(lows[i] == lows[j]).mean(axis=1) >= least].tolist():
                    if members[x][2] != members[y][2] and not members[x][3] & members[y][3]:
                        out.append((members[x][0], members[y][0]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _centre_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The commonest token at each place among a node's few sampled classes."""
    for pdf in batches:
        out = []
        for some in pdf["some"]:
            lows = _lows(bytes(x) for x in some)
            votes = (lows[:, None, :] == lows[None, :, :]).sum(axis=1)
            out.append(lows[votes.argmax(axis=0), np.arange(TOKENS)].tobytes())
        yield pdf[["node", "size"]].assign(usual=out)


def _agreement(keep: list[str]):
    """The columns to keep, and in how many tokens low and usual are the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[keep].assign(same=(_lows(pdf["low"]) == _lows(pdf["usual"])).sum(axis=1))

    return run


def _compare(width: int, percent: int):
    """From rows (a, b, around, text) where the row of a itself, with b null, comes first:
    (a, b, around, good, na, nb, diff); diff has the shingles that only one of them has, for pairs around a centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, first = WordHashes(), None
        for pdf in batches:
            out = []
            for a, b, around, text in zip(pdf["a"], pdf["b"], pdf["around"], pdf["text"]):
                s = shingle_set(words.of(split_words(text)), width)
                if b is None:
                    first = s
                    continue
                both = len(np.intersect1d(first, s, assume_unique=True))
                good = 100 * both >= percent * (len(first) + len(s) - both)
                out.append((a, b, around, good, len(first), len(s), np.setxor1d(first, s, assume_unique=True).view(np.int64) if around else None))
            yield pd.DataFrame(out, columns=["a", "b", "around", "good", "na", "nb", "diff"])

    return run


def _close(percent: int):
    """From (a, na, da, b, nb, db), sizes and differences to one centre: the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for na, da, nb, db in zip(pdf["na"], pdf["da"], pdf["nb"], pdf["db"]):
                apart = len(np.setxor1d(da, db, assume_unique=True))
                both = (na + nb - apart) // 2
                good.append(100 * both >= percent * (na + nb - both))
            yield pdf.loc[good, ["a", "b"]]

    return run


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (c, label, diff): (c, t, f, low, high), a row for each distinct shingle of a batch's differences to c: how many have it, and the first and last of their labels."""
    for pdf in batches:
        if len(pdf):
            (centres, c), (labels, label) = (np.unique(pdf[x].to_numpy(), return_inverse=True) for x in ("c", "label"))
            sizes, t = [len(d) for d in pdf["diff"]], np.concatenate(pdf["diff"].to_list())
            c, label = np.repeat(c, sizes), np.repeat(label, sizes)
            order = np.lexsort((t, c))
            c, t, label = c[order], t[order], label[order]
            at = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])])[: len(t)]
            low, high = (labels[least.reduceat(label, at)] for least in (np.minimum, np.maximum))
            yield pd.DataFrame({"c": centres[c[at]], "t": t[at], "f": np.diff(np.r_[at, len(t)]), "low": low, "high": high})


def _told(known):
    """A row for each shingle t of diff that the Bloom filter known may hold around the centre, whose hash is in hc; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes, t = [len(d) for d in pdf["diff"]], np.concatenate(pdf["diff"].to_list())
                may = in_bloom(known.value, (t ^ np.repeat(pdf["hc"].to_numpy(), sizes)).view(np.uint64))
                row = np.repeat(np.arange(len(pdf)), sizes)[may]
                yield pdf.drop(columns=["hc", "diff"]).iloc[row].assign(t=t[may])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's component; edges are (a, b).

    In each round every vertex points to its smallest neighbour, if that is smaller; pointers
    are followed to the roots by doubling, and edges go on between different roots. So an
    edge is joined only as long as it connects what is apart, not in every round. Rounds are
    written to the shared folder, and all go at the end.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges, labels = scratch(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
        while True:
            roots = _roots_of(edges, scratch)
            if labels is None:
                labels = roots
            else:
                far = roots.select(F.col("v").alias("label"), F.col("label").alias("far"))
                labels = scratch(labels.join(far, "label", "left").select("v", F.coalesce("far", "label").alias("label")))
            root = lambda x: roots.select(F.col("v").alias(x), F.col("label").alias("root_" + x))
            apart = edges.where("a <> b").join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
            edges = scratch(apart.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
            if edges.isEmpty():
                return materialise(labels)


def _roots_of(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): where each vertex of the edges (a, b), a <= b, gets by pointers to the smallest neighbours."""
    both = edges.select(F.col("b").alias("v"), F.col("a").alias("m")).unionByName(edges.select(F.col("a").alias("v"), F.col("b").alias("m")))
    to = scratch(both.groupBy("v").agg(F.min("m").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        # Two steps a written table; where the second moves nothing, all are at roots.
        far = to.where("label <> v").select(F.col("v").alias("label"), F.col("label").alias("far"))
        one = to.join(far, "label", "left").select("v", F.coalesce("far", "label").alias("label"))
        new = scratch(one.join(far, "label", "left").select("v", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")))
        to = new.select("v", "label")
        if new.where("moved").isEmpty():
            return to


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


class NearDuplicates:
    """The join of one table; ``rows`` and ``labels`` are its outcome.

    rows: doc_id, id (null: the largest), th (hash of the text), n (size of the set), cls.
    labels: (v, label) for classes that link to another; label is a class of the component.
    """

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        # Signatures miss a pair at the threshold with a chance of about 3e-6.
        p = percent / 100
        self.least = p - 4.5 * (p * (1 - p) / TOKENS) ** 0.5
        self.texts = docs.select(docs["doc_id"], order_id(docs["doc_id"]).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))
        every = materialise(self.texts.mapInPandas(_describe(width), "doc_id long, id long, th long, n long, cls binary, sig binary, low binary"))
        self.rows = every.drop("sig", "low")
        some = every.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "th", "sig", "low")).alias("k"))
        self.classes = materialise(some.select("cls", "k.*"))
        with Scratch(self.spark) as scratch:
            self.labels = self._labels(scratch)

    def _labels(self, scratch: Scratch) -> DataFrame:
        few, spokes = self._walk(scratch)
        # First what joins most: each class's best partner in small nodes, and the pairs with centres.
        members = F.collect_list(F.struct("cls", "low")).alias("members")
        forest = scratch(few.groupBy("node").agg(members).mapInPandas(_forest(self.least), "node long, a binary, b binary, same int"))
        best = forest.groupBy("b").agg(F.max(F.struct("same", "a")).alias("k")).select("k.a", "b").join(spokes, ["a", "b"], "left_anti")
        tried = scratch(spokes.withColumn("around", F.lit(True)).unionByName(best.withColumn("around", F.lit(False))))
        compared = scratch(self._compared(tried, scratch))
        links, around = compared.where("good").select("a", "b"), compared.where("around")
        labels = components(links)
        # Then what these links leave apart.
        more = scratch(self._within(around, labels, scratch))
        open_nodes = self._apart(forest, labels).select("node").distinct()
        centres = around.groupBy(F.col("b").alias("cls")).agg(F.collect_set(F.xxhash64("a")).alias("centres"))
        rest = few.join(open_nodes, "node", "left_semi").join(labels.withColumnRenamed("v", "cls"), "cls", "left").join(centres, "cls", "left")
        rest = rest.withColumn("label", F.coalesce("label", "cls")).groupBy("node").agg(F.collect_list(F.struct("cls", "low", "label", "centres")).alias("members"))
        pairs = rest.select("members").mapInPandas(_apart_pairs(self.least), "a binary, b binary").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch(pairs)
        if not pairs.isEmpty():
            found = self._compared(pairs.withColumn("around", F.lit(False)), scratch).where("good").select("a", "b")
            more = scratch(more.unionByName(found))
        return labels if more.isEmpty() else components(links.unionByName(more))

    def _walk(self, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(node, cls, low) of the small nodes, and the pairs (a, b) of centres with the classes around them.

        A class that agrees less than AROUND with the centre goes on to its children, and those
        that agree with the centre little enough to be near such a class go on to the children
        where one is. The centre stays, so nodes shrink from level to level; few levels have
        any large node.
        """
        lows, few, spokes = self.classes.select("cls", "low"), [], []
        nodes = self.classes.select("cls", "sig").mapInPandas(_roots, "node long, cls binary")
        while True:
            held = scratch(self._sized(scratch(nodes), scratch).join(lows, "cls").select("node", "cls", "low", "size"))
            few.append(held.where(F.col("size") <= SMALL).drop("size"))
            large = held.where(F.col("size") > SMALL)
            if large.isEmpty():
                return _union(few), _union([*spokes, self.classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)]).distinct()
            with Scratch(self.spark) as level:
                met = scratch(self._around(large, level))
            spokes.append(met.where((F.col("same") >= AROUND * TOKENS) & (F.col("a") != F.col("cls"))).select("a", F.col("cls").alias("b")))
            # Classes around the centre are joined there, so a child without a loose class finds nothing new.
            loose = met.where(F.col("same") < AROUND * TOKENS).select("node", "cls")
            reach = (F.col("same") >= AROUND * TOKENS) & (F.col("same") < (AROUND + 1 - self.least) * TOKENS)
            others = met.where(reach).join(loose.select("node").distinct(), "node", "left_semi").select("node", "cls")
            signed = lambda rows: rows.join(self.classes.select("cls", "sig"), "cls").select("node", "cls", "sig")
            own = scratch(signed(loose).mapInPandas(_children(), "node long, cls binary"))
            known = self.spark.sparkContext.broadcast(bloom(own.select(F.col("node").alias("k"))))
            nodes = own.unionByName(signed(others).mapInPandas(_children(known), "node long, cls binary")).distinct()

    @staticmethod
    def _sized(nodes: DataFrame, scratch: Scratch) -> DataFrame:
        """The written nodes (node, cls) that hold several classes, with their size; the rows of a hot node are salted."""
        sizes = scratch(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("size", F.col("rows")))
        rows, sizes = spread_hot(nodes, sizes, "node", "rows", ["cls"])
        return rows.join(sizes, ["node", "salt"]).drop("salt")

    @staticmethod
    def _around(large: DataFrame, scratch: Scratch) -> DataFrame:
        """(node, a, cls, same): the classes of large nodes (node, cls, low, size), the node's centre a and their agreement with it.

        Of the classes that agree with a node's commonest tokens nearly as well as any,
        nodes take the one that most nodes could take: a group then has few centres.
        What a node's rows are compared with goes to each of the salts of a hot node.
        """
        # A dozen classes of each node, by a hash that spreads them, stand for it.
        some = large.groupBy("node", "size", F.pmod(F.xxhash64("cls", "node"), F.lit(12)).alias("b")).agg(F.min(F.struct("cls", "low")).alias("m")).groupBy("node", "size").agg(F.collect_list("m.low").alias("some"))
        usual = scratch(some.mapInPandas(_centre_tokens, "node long, size long, usual binary"))
        large = large.drop("size")
        rows, usual = spread_hot(large, usual, "node", "size", ["cls"])
        agreeing = rows.join(usual, ["node", "salt"]).select("node", "cls", "low", "usual").mapInPandas(_agreement(["node", "cls", "low"]), "node long, cls binary, low binary, same long")
        agreeing = scratch(agreeing)
        best = scratch(agreeing.groupBy("node").agg(F.max(F.struct("same", "cls")).alias("c"), F.count(F.lit(1)).alias("size")).select("node", "size", F.col("c.same").alias("most"), F.col("c.cls").alias("own")))
        able = agreeing.join(best.select(F.col("own").alias("cls")).distinct(), "cls").join(best, "node").where("same >= most - 4")
        able = able.withColumn("nodes", F.count(F.lit(1)).over(Window.partitionBy("cls")))
        centre = scratch(able.groupBy("node", "size").agg(F.max(F.struct("nodes", "cls", "low")).alias("c")).select("node", "size", F.col("c.cls").alias("a"), F.col("c.low").alias("usual")))
        rows, centre = spread_hot(large, centre, "node", "size", ["cls"])
        return rows.join(centre, ["node", "salt"]).select("node", "a", "cls", "low", "usual").mapInPandas(_agreement(["node", "a", "cls"]), "node long, a binary, cls binary, same long")

    def _within(self, around: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
        """The links (a, b) between classes around one centre that labels don't join; exact.

        x and y link if they differ in at most k (nx + ny) shingles. One of them, y, doesn't
        link with the centre c, so it differs from c in more than k (ny + nc), and their
        differences to c have over (dx + k (nc - nx)) / 2 shingles in common. With the
        shingles in one order, rarest first, the first common one is therefore among the
        first dx - need + 1 of x (its head), and the same holds for y if x doesn't link with c.
        From there on, both must have at least as many left as the pair needs in common.
        """
        k = (100 - self.percent) / (100 + self.percent)
        rows = around.select(F.col("a").alias("c"), F.col("b").alias("x"), F.col("good").alias("inner"), F.col("na").alias("nc"), F.col("nb").alias("n"), "diff")
        rows = rows.join(labels.select(F.col("v").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))
        open_groups = rows.groupBy("c").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("c")
        rows = scratch(rows.join(open_groups, "c", "left_semi"))
        need = F.greatest(F.lit(1), F.floor((F.size("diff") + F.lit(k) * (F.col("nc") - F.col("n"))) / 2 - F.lit(1e-9)) + 1).cast("int")
        # What a class brings to the number that a pair needs in common: half of dx - k nx.
        owed = (F.size("diff") - F.lit(k) * F.col("n")) / 2
        # A shingle that no other label's difference has meets none, so it makes no row.
        held = scratch(self._held(rows))
        flat = self._flat(rows.withColumn("need", need).withColumn("owed", owed), held)
        shared = flat.join(held, ["c", "t"]).groupBy("c", "x").agg(F.first("label").alias("label"), F.first("inner").alias("inner"), F.first("need").alias("need"), F.first("owed").alias("owed"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
        shared = shared.select("c", "x", "label", "inner", "owed", F.size("s").alias("all"), (F.size("s") - F.col("need")).alias("last"), F.posexplode("s").alias("at", "s"))
        tokens = shared.select("c", F.col("s.t").alias("t"), "x", "label", "inner", "owed", (F.col("all") - F.col("at")).alias("left"), (F.col("at") <= F.col("last")).alias("head"))
        tokens = scratch(tokens.where("head or not inner"))
        met = self._met(tokens)
        own = lambda v: rows.select("c", F.col("x").alias(v), F.col("n").alias("n" + v), F.col("diff").alias("d" + v))
        both = met.join(own("a"), ["c", "a"]).join(own("b"), ["c", "b"])
        return both.select("a", "na", "da", "b", "nb", "db").mapInPandas(_close(self.percent), "a binary, b binary").distinct()

    @staticmethod
    def _met(tokens: DataFrame) -> DataFrame:
        """(c, a, b): the classes around one centre that share a shingle as _within has it, and have enough left from there on."""
        one = lambda v: tokens.select("c", "t", F.col("x").alias(v), *[F.col(n).alias(n + v) for n in ("label", "inner", "owed", "left", "head")])
        met = one("a").join(one("b"), ["c", "t"]).where("a < b and labela <> labelb and (heada and (headb or innera) or headb and innerb) and least(lefta, leftb) + 1e-9 >= oweda + owedb")
        return met.select("c", "a", "b").distinct()

    @staticmethod
    def _held(rows: DataFrame) -> DataFrame:
        """(c, t, f): shingles in differences of classes that links don't join, and how many have them."""
        counts = rows.select("c", "label", "diff").mapInPandas(_counted, "c binary, t long, f long, low binary, high binary")
        return counts.groupBy("c", "t").agg(F.sum("f").alias("f"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("c", "t", "f")

    @staticmethod
    def _flat(rows: DataFrame, held: DataFrame) -> DataFrame:
        """(c, x, label, inner, need, owed, t) for the shingles of differences that are held, and a few others that a Bloom filter lets pass."""
        known = rows.sparkSession.sparkContext.broadcast(bloom(held.select(F.col("t").bitwiseXOR(F.xxhash64("c")).alias("k"))))
        some = rows.select("c", F.xxhash64("c").alias("hc"), "x", "label", "inner", "need", "owed", "diff")
        return some.mapInPandas(_told(known), "c binary, x binary, label binary, inner boolean, need int, owed double, t long")

    @staticmethod
    def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that no links join."""
        known = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias("label_" + x))
        return pairs.join(known("a"), "a", "left").join(known("b"), "b", "left").where("label_a is null or label_b is null or label_a <> label_b").drop("label_a", "label_b")

    def _compared(self, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """The written pairs (a, b, around), compared on their full sets as _compare has it.

        The text of a travels once for PORTION pairs, so a centre's pairs are dealt over many tasks.
        """
        used = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        keys = scratch(self.classes.select("cls", "id", "th").join(used, "cls"))
        # A shuffle on both sides at any size: the plan that holds when the keys are many.
        texts = scratch(self.texts.select("id", "th", "text").join(keys.hint("merge"), ["id", "th"]).dropDuplicates(["cls"]).select("cls", "text"))
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("long").alias("parts"))
        dealt = scratch(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b", "around"))
        second = dealt.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "around", "text")
        first = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), F.lit(False).alias("around"), "text")
        rows = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", "b")
        kept = rows.select("a", "b", "around", "text").mapInPandas(_compare(self.width, self.percent), "a binary, b binary, around boolean, good boolean, na long, nb long, diff array<long>")
        return kept

    def membership(self) -> DataFrame:
        """One row per row: doc_id, id, th, n, cls, label (a class of the component), component (its smallest id)."""
        first = self.rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"))
        comp = first.join(self.labels, first["cls"] == self.labels["v"], "left").select("cls", F.coalesce("label", "cls").alias("label"), "first")
        comp = materialise(comp)
        lowest = comp.groupBy("label").agg(F.min("first").alias("component"))
        known = comp.join(lowest, "label").select("cls", "label", "component")
        return self.rows.join(known, "cls", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts link if 100 * intersection >= percent * union of their sets of distinct
    ``width``-word shingles, A-Z lower-cased. A text with fewer words is one shingle; a
    null text or one without words has an empty set and links with nothing. component_id
    is the smallest doc_id that links reach; a null doc_id counts as the largest, and
    kept is whether that is the row's own id, so rows that share the id are all kept.
    """
    m = NearDuplicates(docs, width, percent).membership()
    return m.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; rows without words all stay; columns as they are."""
    m = materialise(NearDuplicates(docs, width, percent).membership())
    stay = m.where("cls is not null and component = id").groupBy("label").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th")
    gone = m.where("cls is not null").select("id", "th").distinct().join(stay, ["id", "th"], "left_anti")
    gone = materialise(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    same = lambda keys: (order_id(docs["doc_id"]) == keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__th"])
    left = docs.join(gone, same(gone), "left_anti")
    again = m.where("cls is not null and component = id").groupBy("id", "th").count().where("count > 1")
    again = materialise(again.select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    if again.isEmpty():
        return left
    once = left.join(again, same(again)).dropDuplicates(["__id", "__th"]).drop("__id", "__th")
    return left.join(again, same(again), "left_anti").unionByName(once)


#: op9 in DuckDB's SQL: every pair that shares a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [hash(array_to_string(ws, ' '))]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
         JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
         WHERE 100 * nx.n >= 85 * ny.n AND 100 * ny.n >= 85 * nx.n
         GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM link) UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id, coalesce(min(r.c), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
