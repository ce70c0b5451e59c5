"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A step of the network is a word. Its input is the sum of a word vector (hashed word) and
the mean of vectors of its character n-grams with word ends (hashed). A text is scored
over all windows of ``WINDOW`` words that begin every ``STRIDE`` words, the last ending
with the text, so every passage of ``WINDOW - STRIDE + 1`` words stands whole in one; its
score is its most toxic window's. Training knows labels of whole
texts only: a toxic text teaches through its most toxic window, any other through its
most toxic window and a random one; windows that repeat one word of a clean text are
shown as clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import crc_mod, materialise
from dayledger.llm.words import mixed, split_words

WINDOW, STRIDE = 20, 10
_WORDS, _GRAMS, _DIM, _HIDDEN = 1 << 14, 1 << 16, 16, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner): hashed n-grams of 3, 5 and 7 bytes of each word with its ends.

    Every word has one at least; ids are in order of their owner's place in words.
    """
    lengths = np.array([len(w) + 2 for w in words])
    chars = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(chars))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), lengths)
    ids, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, 8):
        h = h * np.uint64(257)
        h[: max(0, len(chars) - n + 1)] += chars[n - 1 :] + np.uint64(1)
        if n in (3, 5, 7):
            at = np.nonzero(left >= n)[0]
            ids.append((mixed(h[at] + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int64))
            owners.append(owner[at])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % _WORDS


def windows(n: int) -> np.ndarray:
    """Begins of the windows of a text of n words: one for each STRIDE, the last ending with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Vocabulary(dict):
    """Numbers for words in order of appearance; number 0 stands for padding."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class ToxicityNet:
    """Parameters: word and n-gram vectors; for each direction input weights wx and bx and
    recurrent weights u, by gate (update, reset, candidate); attention, output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = _DIM, _HIDDEN
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": f(_WORDS, d, scale=0.05), "gram": f(_GRAMS, d, scale=0.05), "wx": f(d, 2, 3 * h, scale=0.35), "bx": np.zeros((2, 3 * h), np.float32), "u": f(2, h, 3 * h, scale=0.3), "att": f(2, h, scale=0.3), "w": f(2, h, scale=0.5), "b": np.zeros(1, np.float32)}

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        wid, (gid, owner) = word_ids(words), char_grams(words)
        count = np.bincount(owner, minlength=len(words)).astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(count).astype(np.int64)[:-1]))
        grams = np.add.reduceat(self.p["gram"][gid], starts, axis=0) / count[:, None]
        return self.p["word"][wid] + grams, (wid, gid, owner, count)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Gate inputs of each word by direction, (words + 1, 2, 3 H); row 0 is for padding."""
        h3, w = 3 * _HIDDEN, self.p["wx"].reshape(_DIM, -1)
        out = np.zeros((len(words) + 1, 2, h3), np.float32)
        for a in range(0, len(words), 5_000):
            part = words[a : a + 5_000]
            out[a + 1 : a + 1 + len(part)] = (self.vectors(part)[0] @ w).reshape(-1, 2, h3) + self.p["bx"]
        return out

    def forward(self, table: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; ids (B, T) are rows of table, 0 for padding.

        The two directions are two stacks of rows: the second reads each window backwards.
        """
        (n, t), hid, u = ids.shape, _HIDDEN, self.p["u"]
        flat = table.reshape(-1, 3 * hid)
        rows = np.concatenate([2 * ids, 2 * ids[:, ::-1] + 1]).T.copy()  # (T, 2 B)
        real = ids > 0
        full = bool(real.all())
        mask = np.concatenate([real, real[:, ::-1]]).T[:, :, None]
        h, hs, saved = np.zeros((2 * n, hid), np.float32), np.empty((t, 2 * n, hid), np.float32), []
        hu = np.empty((2 * n, 3 * hid), np.float32)
        for s in range(t):
            x = flat[rows[s]]
            np.matmul(h[:n], u[0], out=hu[:n])
            np.matmul(h[n:], u[1], out=hu[n:])
            zr = x[:, : 2 * hid] + hu[:, : 2 * hid]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr += np.float32(1)
            zr *= np.float32(0.5)
            z, r, q = zr[:, :hid], zr[:, hid:], hu[:, 2 * hid :]
            cand = r * q
            cand += x[:, 2 * hid :]
            np.tanh(cand, out=cand)
            new = h - cand
            new *= z
            new += cand
            if not full:
                new = np.where(mask[s], new, h)
            if keep:
                saved.append((h, zr, q.copy(), cand))
            hs[s] = h = new
        states = hs.reshape(t, 2, n, hid)
        states = np.stack([states[:, 0], states[::-1, 1]], axis=2)  # (T, B, 2, H), by place
        e = np.where(real.T, states.reshape(t, n, -1) @ self.p["att"].ravel(), np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", alpha, states.reshape(t, n, -1))
        logit = pooled @ self.p["w"].ravel() + self.p["b"][0]
        return (logit, (mask, states, alpha, pooled, saved)) if keep else logit

    def backward(self, d: np.ndarray, kept) -> tuple[np.ndarray, dict]:
        """From the loss's slope by logit: its slope by the gate inputs (B, T, 2, 3 H), and by the rest."""
        mask, states, alpha, pooled, saved = kept
        t, n, _, hid = states.shape
        u, flat = self.p["u"], states.reshape(t, n, -1)
        grad = {"w": (pooled.T @ d).reshape(2, hid), "b": d.sum(keepdims=True), "u": np.zeros_like(u)}
        dc = d[:, None] * self.p["w"].ravel()
        da = np.einsum("tbk,bk->tb", flat, dc)
        de = alpha * (da - (alpha * da).sum(axis=0))
        grad["att"] = np.einsum("tb,tbk->k", de, flat).reshape(2, hid)
        out = (alpha[:, :, None] * dc + de[:, :, None] * self.p["att"].ravel()).reshape(t, n, 2, hid)
        out = np.concatenate([out[:, :, 0], out[::-1, :, 1]], axis=1)  # (T, 2 B, H), by step
        dh, dx = np.zeros((2 * n, hid), np.float32), np.empty((t, 2 * n, 3 * hid), np.float32)
        for s in range(t - 1, -1, -1):
            h, zr, q, cand = saved[s]
            z, r = zr[:, :hid], zr[:, hid:]
            dh = dh + out[s]
            new = dh * mask[s]
            dcand = new * (1 - z) * (1 - cand * cand)
            dz, dr = new * (h - cand) * z * (1 - z), dcand * q * r * (1 - r)
            dx[s] = np.concatenate([dz, dr, dcand], axis=1)
            dhu = np.concatenate([dz, dr, dcand * r], axis=1)
            back = np.empty_like(dh)
            for k, part in enumerate((slice(0, n), slice(n, None))):
                grad["u"][k] += h[part].T @ dhu[part]
                back[part] = dhu[part] @ u[k].T
            dh = dh - new + new * z + back
        dx = dx.reshape(t, 2, n, 3 * hid)
        return np.stack([dx[:, 0], dx[::-1, 1]], axis=2).swapaxes(0, 1), grad


def score_texts(net: ToxicityNet, texts, flush: int = 250_000) -> np.ndarray:
    """The largest window's logit of each text, in batches of about flush words."""
    out, table, vocabulary = [], None, Vocabulary()
    pending: list[np.ndarray] = []

    def run() -> None:
        nonlocal table, pending
        words = list(vocabulary)
        had = 1 if table is None else len(table)
        new = net.inputs(words[had - 1 :])
        table = new if table is None else np.concatenate([table, new[1:]])
        begins = [windows(len(p)) for p in pending]
        padded = np.concatenate([np.concatenate([p, np.zeros(max(0, WINDOW - len(p)), np.int64)]) for p in pending])
        lengths = np.array([max(len(p), WINDOW) for p in pending])
        offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        at = np.concatenate([o + b for o, b in zip(offsets, begins)])
        logits = np.empty(len(at), np.float32)
        for a in range(0, len(at), 512):
            logits[a : a + 512] = net.forward(table, padded[at[a : a + 512, None] + np.arange(WINDOW)])
        firsts = np.concatenate(([0], np.cumsum([len(b) for b in begins])[:-1]))
        out.append(np.maximum.reduceat(logits, firsts))
        pending = []
        if len(vocabulary) > 150_000:
            vocabulary.clear()
            table = None

    held = 0
    for text in texts:
        words = split_words(text)
        pending.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        held += len(words) + WINDOW
        if held >= flush:
            run()
            held = 0
    if pending:
        run()
    return np.concatenate(out) if out else np.empty(0, np.float32)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ToxicityNet:
    """Trains on whole texts with labels 0 and 1; with one class only the bias is set."""
    net, rng = ToxicityNet(), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        p = (labels.sum() + 1) / (len(labels) + 2)
        net.p["w"][:] = 0
        net.p["b"][:] = np.log(p / (1 - p))
        return net
    vocabulary = Vocabulary()
    docs = [np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in map(split_words, texts)]
    words = list(vocabulary)
    wid, (gid, owner) = word_ids(words), char_grams(words)
    count = np.bincount(owner, minlength=len(words)).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(count).astype(np.int64)[:-1]))
    # Vectors start from log-odds of texts that hold the word or n-gram.
    for name, size, of in (("word", _WORDS, [np.unique(wid[np.unique(d) - 1]) for d in docs]), ("gram", _GRAMS, None)):
        seen = np.ones((2, size))
        for k, d in enumerate(docs):
            if of is not None:
                ids = of[k]
            else:
                u = np.unique(d) - 1
                ids = np.unique(np.concatenate([gid[int(starts[i]) : int(starts[i] + count[i])] for i in u])) if len(u) else np.empty(0, np.int64)
            seen[labels[k], ids] += 1
        n1, n0 = labels.sum() + 2, (labels == 0).sum() + 2
        odds = np.clip(np.log(seen[1] / n1) - np.log(seen[0] / n0), -3, 3)
        net.p[name][:, 0] += 0.3 * odds
    begins = [windows(len(d)) for d in docs]
    padded = [np.concatenate([d, np.zeros(max(0, WINDOW - len(d)), np.int64)]) for d in docs]
    offset = np.concatenate(([0], np.cumsum([len(p) for p in padded])[:-1]))
    flat = np.concatenate(padded)
    at = np.concatenate([o + b for o, b in zip(offset, begins)])
    firsts = np.concatenate(([0], np.cumsum([len(b) for b in begins])[:-1]))
    counts = np.array([len(b) for b in begins])
    mean, square, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    pos_weight = (labels == 0).sum() / max(1, labels.sum())
    clean = np.nonzero(labels == 0)[0]
    harmless = np.unique(np.concatenate([np.zeros(1, np.int64), *[docs[i] for i in clean]]))  # padding and words of clean texts
    for epoch in range(epochs):
        if epoch == 0:
            v = np.concatenate([[-9], net.vectors(words)[0][:, 0]])
            heat = np.sort(v[flat[at[:, None] + np.arange(WINDOW)]], axis=1)[:, -2:].sum(axis=1)
        elif epoch % 2 or epoch < 4:
            table = net.inputs(words)
            heat = np.concatenate([net.forward(table, flat[at[a : a + 512, None] + np.arange(WINDOW)]) for a in range(0, len(at), 512)])
        best = np.array([f + int(np.argmax(heat[f : f + c])) for f, c in zip(firsts, counts)])
        chosen = np.concatenate([best, firsts[clean] + rng.integers(0, counts[clean])])
        shown = np.concatenate([flat[at[chosen, None] + np.arange(WINDOW)], np.repeat(rng.choice(harmless, (len(labels) // 12, 1)), WINDOW, axis=1)])
        target = np.concatenate([labels, np.zeros(len(shown) - len(labels), int)]).astype(np.float32)
        weight = np.where(target > 0, pos_weight, 1.0).astype(np.float32)
        order = rng.permutation(len(shown))
        lr = rate * (1 - 0.8 * epoch / epochs)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            used, ids = np.unique(np.append(0, shown[pick]), return_inverse=True)
            ids = ids[1:].reshape(-1, WINDOW)
            vec, own = np.zeros((len(used), _DIM), np.float32), None
            if len(used) > 1:
                vec[1:], own = net.vectors([words[i - 1] for i in used[1:]])
            table = (vec @ net.p["wx"].reshape(_DIM, -1)).reshape(-1, 2, 3 * _HIDDEN) + net.p["bx"]
            logit, kept = net.forward(table, ids, keep=True)
            d = (sigmoid(logit) - target[pick]) * weight[pick] / len(pick)
            dx, grad = net.backward(d.astype(np.float32), kept)
            flat_dx = dx.reshape(-1, 6 * _HIDDEN)
            grad["wx"], grad["bx"] = (vec[ids].reshape(-1, _DIM).T @ flat_dx).reshape(net.p["wx"].shape), flat_dx.sum(axis=0).reshape(2, -1)
            dvec = np.zeros_like(vec)
            np.add.at(dvec, ids.ravel(), flat_dx @ net.p["wx"].reshape(_DIM, -1).T)
            touched = {}
            if own is not None:
                for name, rows, part in (("word", own[0], dvec[1:]), ("gram", own[1], (dvec[1:] / own[3][:, None])[own[2]])):
                    touched[name], inverse = np.unique(rows, return_inverse=True)
                    grad[name] = np.zeros((len(touched[name]), _DIM), np.float32)
                    np.add.at(grad[name], inverse, part)
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            for k, gk in grad.items():
                at_k = touched.get(k, slice(None))  # vectors that the batch doesn't hold rest
                gk = gk * np.float32(min(1.0, 5.0 / max(size, 1e-9)))
                m = mean[k][at_k] = mean[k][at_k] * np.float32(0.9) + gk * np.float32(0.1)
                q = square[k][at_k] = square[k][at_k] * np.float32(0.99) + gk * gk * np.float32(0.01)
                net.p[k][at_k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + np.float32(1e-8))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep_out=(3, 1), max_rows: int = 3000, max_chars: int = 40_000, **options) -> ToxicityNet:
    """Fits on max_rows labelled rows at most (a documented bound), half of them toxic if there are as many.

    Rows are chosen by the smallest hashes of doc_id; keep_out, null ids and labels, and
    documents that share an id as for the quality classifier. Texts come to the driver, so
    of the chosen rows, toxic or not, only those of up to max_chars characters (a documented
    bound, too) are learned from; a null text is an empty one.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), keep_out[0]) != keep_out[1]))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample"))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), h.alias("h")).distinct()
    part = lambda y: known.where(F.col("label") == y).orderBy("h").limit(max_rows // 2)
    chosen = materialise(part(0).unionByName(part(1)))
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")).join(chosen, F.col("id") == F.col("doc_id"))
    rows = rows.where(F.coalesce(F.char_length("text"), F.lit(0)) <= max_chars).groupBy("doc_id", "label", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.select("label", "h", "text").collect()  # at most max_rows texts of max_chars
    found.sort(key=lambda r: (r.h, r.label, r.text or ""))
    return fit([r.text for r in found], np.array([r.label for r in found], int), **options)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep_out=(3, 1), **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts and texts without words are one window of padding and score as the bias;
    texts are read whole. Without labels of both classes every text has the same score.
    Rows with a null id count as held out by the crc of an empty text; repeated rows score
    alike, an empty table gives no rows, other columns play no part.
    """
    net = train(docs, labels, keep_out=keep_out, **options)
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ToxicityNet()
        own.p = sent.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": sigmoid(score_texts(own, pdf["text"]).astype(np.float64))})

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), keep_out[0]) == keep_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
