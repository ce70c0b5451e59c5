"""HTML extraction: a linear-chain conditional random field over leaf blocks of the page.

A page is a sequence of leaf blocks, the texts between block-level tags. A block's
features are the tags, class and id words of its ancestors and properties of its text;
an edge knows whether two blocks share their parent. The field is trained on labelled
pages, which a seeded generator makes in many layouts, and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_BITS = 14
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: The attribute of labelled pages; no page to extract has it.
_LABEL = re.compile(r'\bdata-dayledger-label="([01])"')
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed sets of HTML: elements whose content is raw text, whose content isn't shown, without end tag, and block-level.
RAW = frozenset("script style iframe noembed noframes textarea title".split())
HIDDEN = frozenset("template svg object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html label legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUES = frozenset("cookie cookies subscribe newsletter comment comments reply share login log sign privacy terms related advertisement sponsored posted copyright rights reserved menu search".split())
#: Elements that a start tag closes, up to the nearest element of _STOPS.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = ("ul", "ol", "table", "div", "article", "section", "body", "dl")
#: Block-level elements can't stand in svg, so one of these shows that it wasn't closed.
_BREAKS = re.compile(r"<(?:p|div|h[1-6]|ul|ol|li|dl|table|article|section|main|body|footer|header|nav|aside)[\s>]", re.I)


def _id(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << _BITS) - 1)


class Path:
    """An element with all that is open around it. Paths that look the same have the same key.

    fresh has the feature ids that no outer element has, own those of the innermost
    element, so the features of a path are told without a list for each of its elements.
    """

    __slots__ = ("parent", "key", "tag", "names", "label", "fresh", "own", "score")

    def __init__(self, parent: Path | None, key: int, tag: str, names: tuple, label: int | None, fresh: list, own: list):
        self.parent, self.key, self.tag, self.names, self.label, self.fresh, self.own, self.score = parent, key, tag, names, label, fresh, own, None


class _Open:
    """The open elements of a page; each step costs in proportion to what is opened or closed."""

    def __init__(self):
        self.stack = [Path(None, 0, "", (), None, [_id("bias")], [])]
        self.places: dict[str, list[int]] = {}
        self.held: dict[str, int] = {}
        self.keys: dict = {}

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that tag, or 0."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def push(self, tag: str, names: tuple, label: int | None) -> None:
        top = self.stack[-1]
        features = ["in " + tag, *sorted({"named " + w for w in names})]
        fresh = [_id(f) for f in features if not self.held.get(f)]
        for f in features:
            self.held[f] = self.held.get(f, 0) + 1
        key = self.keys.setdefault((top.key, tag, names), len(self.keys) + 1)
        self.places.setdefault(tag, []).append(len(self.stack))
        own = [_id(f) for f in ("leaf " + tag, *sorted({"own " + w for w in names}))]
        self.stack.append(Path(top, key, tag, names, top.label if label is None else label, fresh, own))

    def close(self, place: int) -> None:
        """Closes the element at place and all inside it."""
        for _ in range(len(self.stack) - place if place else 0):
            x = self.stack.pop()
            self.places[x.tag].pop()
            for f in ("in " + x.tag, *{"named " + w for w in x.names}):
                self.held[f] -= 1


def leaf_blocks(page: str, labelled: bool = False):
    """(text, path, link share, label) of each leaf block with text.

    label is the nearest label of a labelled page, if any. Tags that are cut off at the end
    of the page, comments and the content of elements of RAW and HIDDEN are no text; unclosed
    elements end with their parent or the page. An element of HIDDEN that is closed by its
    own tag or never closed hides nothing. Time is in proportion to the page.
    """
    out, parts, opened = [], [], _Open()
    linked = total = in_link = 0
    ends: dict[str, tuple[int, int]] = {}  # of the next end tag by name: where it begins, and where what follows begins

    def flush() -> None:
        nonlocal linked, total
        if total:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = opened.stack[-1]
                out.append((text, path, linked / total, path.label))
        parts.clear()
        linked = total = 0

    def add(text: str) -> None:
        nonlocal linked, total
        parts.append(text)
        n = len(text) - text.count(" ")
        total += n
        if in_link:
            linked += n

    def end_of(tag: str, at: int) -> tuple[int, int]:
        """The next end tag from at on; (size, size) if there is none."""
        if ends.get(tag, (-1, -1))[0] < at:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", m.end()) if m else -1
            ends[tag] = (m.start() if m else size, close + 1 if close >= 0 else size)
        return ends[tag]

    def break_after(at: int) -> int:
        """Where the next tag of _BREAKS from at on begins; size if there is none."""
        nonlocal broken
        if broken < at:
            m = _BREAKS.search(page, at)
            broken = m.start() if m else size
        return broken

    at, size, broken = 0, len(page), -1
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
                opened.close(opened.last(tag))
            elif tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag in RAW or tag in HIDDEN and not m[0].endswith("/>"):
            start, after = end_of(tag, at)
            if tag in RAW or start < size and not (tag == "svg" and break_after(at) < start):
                at = after
            add(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES:
                place = max(opened.last(t) for t in _CLOSES[tag])
                if place > max(opened.last(t) for t in _STOPS):
                    opened.close(place)
            names, attributes = [], m[3] or m[6] or ""
            for a in _ATTR.finditer(attributes):
                names += [w.lower() for w in _NAME_WORD.findall(a[2])]
            label = _LABEL.search(attributes) if labelled else None
            opened.push(tag, tuple(names), int(label[1]) if label else None)
        elif tag == "a":
            in_link += 1
    flush()
    return out


class Features:
    """Feature ids of blocks, and their weights' sums."""

    def path(self, path: Path) -> list[int]:
        out, at = list(path.own), path
        while at is not None:
            out += at.fresh
            at = at.parent
        return out

    def text(self, block, place: int, count: int) -> list[int]:
        text, _, links, _ = block
        words = text.split(None, 25)
        few = len(words) <= 25
        n = len(words) if few else text.count(" ") + 1
        names = ["words %d" % min(7, n.bit_length()), "links %d" % math.ceil(links * 4), "place %d" % (4 * place // count)]
        if text[-1] in ".!?…":
            names.append("sentence")
        if "©" in text or "|" in text and n < 12:
            names.append("mark")
        if few:
            names += ["cue " + w for w in {w.strip(".,:;!?").lower() for w in words} & CUES]
        return [_id(x) for x in names]

    def __call__(self, block, place: int, count: int) -> list[int]:
        return self.path(block[1]) + self.text(block, place, count)

    def score(self, w: np.ndarray, block, place: int, count: int) -> float:
        """The sum of w over the block's features; what outer elements add is remembered with them."""
        path, inner = block[1], []
        while path is not None and path.score is None:
            inner.append(path)
            path = path.parent
        total = 0.0 if path is None else path.score
        for x in reversed(inner):
            total = x.score = total + float(w[x.fresh].sum())
        return total + float(w[block[1].own + self.text(block, place, count)].sum())


class Field:
    """Weights of the label 1 (main text) by feature, and of label pairs by edge kind (same parent or not)."""

    def __init__(self):
        self.w, self.edge = np.zeros(1 << _BITS), np.zeros((2, 2, 2))

    @staticmethod
    def edges(blocks) -> list[int]:
        outer = [b[1].parent.key if b[1].parent else -1 for b in blocks]
        return [int(a == b) for a, b in zip(outer, outer[1:])]

    def decode(self, rows: list[list[int]], kinds: list[int]) -> list[int]:
        """The likeliest labels of blocks with these features."""
        return self.best([float(self.w[row].sum()) for row in rows], kinds)

    def best(self, scores: list[float], kinds: list[int]) -> list[int]:
        """The likeliest labels of blocks with these scores of label 1, by Viterbi."""
        edge = self.edge.tolist()
        a = b = 0.0
        back = []
        for i, s in enumerate(scores):
            if i:
                e = edge[kinds[i - 1]]
                a0, a1 = a + e[0][0], b + e[1][0]
                b0, b1 = a + e[0][1], b + e[1][1]
                back.append((int(a1 > a0), int(b1 > b0)))
                a, b = max(a0, a1), max(b0, b1)
            b += s
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def slopes(self, rows, kinds, labels):
        """Expected less observed label-1 per block, and label pairs per edge, by forward-backward."""
        n = len(rows)
        s = np.array([[0.0, self.w[r].sum()] for r in rows])
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = s[0]
        for i in range(1, n):
            f[i] = s[i] + np.logaddexp(*(f[i - 1][:, None] + self.edge[kinds[i - 1]]))
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp(*(self.edge[kinds[i]] + s[i + 1] + b[i + 1]).T)
        z = np.logaddexp(*f[-1])
        node = np.exp(f + b - z)[:, 1] - np.array(labels)
        pair = np.zeros((2, 2, 2))
        for i in range(1, n):
            pair[kinds[i - 1]] += np.exp(f[i - 1][:, None] + self.edge[kinds[i - 1]] + s[i] + b[i] - z)
            pair[kinds[i - 1], labels[i - 1], labels[i]] -= 1
        return node, pair


_SYLLABLES = "ba con der en fi gor há in ja ke lo men nó or pre qui ra so té un ver wi xe yo zu tion ing al est".split()


def labelled_page(rng: random.Random) -> str:
    """One page in a random layout; data-dayledger-label says 1 for blocks of the article and 0 for the others."""
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    sentences = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))

    def box(tags: str, names: str, inner: str, label: int) -> str:
        tag = rng.choice(tags.split())
        attr = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names.split("|"))}"' if names and (tag in ("div", "section", "p", "ul") or rng.random() < 0.4) else ""
        return f'<{tag}{attr} data-dayledger-label="{label}">{inner}</{tag}>'

    nav = lambda: box("nav nav div ul", "nav|menu|main-menu|navbar|topnav|site-nav", f"<ul>{links(3, 9)}</ul>", 0)
    ad = lambda: box("div div aside section ins p", "ad|ads|advert|advertisement|banner-ad|sponsored|promo|ad-slot", rng.choice([sentences(1, 3), words(3, 8)]), 0)
    notice = lambda: box("div section aside p", "cookie|cookie-notice|consent|notice|alert|gdpr-banner|announcement", rng.choice([sentences(1, 2), "We use cookies. " + sentence()]) + rng.choice(["", f"<button>{words(1, 2)}</button>"]), 0)
    form = lambda: box("form form div section", "newsletter|subscribe|search-form|login|signup|contact-form", f"<form><label>{words(1, 3)}</label><input type=text><p>{sentence()}</p><button>{words(1, 2)}</button></form>", 0)
    side = lambda: box("aside aside div section", "sidebar|widget|related|related-posts|recommended|popular|side-column|trending", f"<h3>{words(1, 4)}</h3>" + rng.choice([f"<ul>{links(2, 8)}</ul>", f"<p>{sentences(1, 3)}</p>"]), 0)
    comment = lambda: box("div li article section", "comment|comment-body|reply|user-comment", f"<span>{word()}</span><p>{sentences(1, 4)}</p>", 0)
    comments = lambda: box("section div ol aside", "comments|comment-list|discussion|responses|disqus|reader-comments", f"<h3>{rng.choice(['Comments', words(1, 2)])}</h3>" + "".join(comment() for _ in range(rng.randint(1, 5))), 0)
    header = lambda: box("header header div", "header|site-header|masthead|topbar|branding", rng.choice([f"<h1>{words(1, 3)}</h1>", f"<a href=/>{words(1, 3)}</a>", f"<p>{sentence()}</p>"]) + rng.choice(["", nav()]), 0)
    footer = lambda: box("footer footer footer div", "footer|site-footer|colophon|bottom|copyright", rng.choice([f"&copy; {word()}.example &middot; {sentences(1, 2)}", f"<p>{sentences(1, 2)}</p>", f"<ul>{links(2, 6)}</ul>", "Copyright. All rights reserved."]), 0)

    def passage() -> str:
        kind = rng.random()
        text = rng.choice([sentences(1, 7), sentences(1, 7), words(1, 3) + ".", words(1, 30)])
        if kind < 0.6:
            return f"<p>{text}</p>"
        if kind < 0.7:
            return f"<p><b>{text}<br><p>{sentences(1, 4)}</p>"
        if kind < 0.78:
            return f"<h2>{words(1, 6)}</h2>"
        if kind < 0.84:
            return f"<ul><li>{words(2, 9)}</li><li>{sentence()}</li></ul>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.91:
            return f"<pre>{words(2, 20)}</pre>"
        if kind < 0.94:
            return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        if kind < 0.97:
            return f'<div>{text} <a href="/x">{words(1, 3)}</a> {sentence()}</div>'
        return text + "<br>"

    body = "".join(passage() if rng.random() < 0.85 else rng.choice([ad, ad, form, side, notice])() for _ in range(rng.randint(1, 14)))
    title = f"<h1>{words(1, 12)}</h1>"
    if rng.random() < 0.25:
        title = f"<header>{title}" + rng.choice(["", f'<p class="{rng.choice(["byline", "meta", "post-meta", "date"])}" data-dayledger-label="0">{words(2, 5)}</p>']) + "</header>"
    article = rng.choice([title, title, title, ""]) + body
    tail = "".join(x() for x in (comments, side, form) if rng.random() < 0.15)
    names = "content|post|entry|entry-content|article|article-body|story|main-content|post-body|text"
    main = box("article article article div section main", names, article + tail, 1)
    if "<article" not in main and "class=" not in main[:60] and "id=" not in main[:60] and not main.startswith("<main"):
        main = f'<div class="content" data-dayledger-label="1">{article}</div>'
    if rng.random() < 0.3:
        main = box("main div", "main|content|page|wrapper|container", main, 0)
    before = "".join(x() for x in (header, nav, ad, notice, form, side) if rng.random() < 0.4)
    after = "".join(x() for x in (comments, side, ad, form, notice) if rng.random() < 0.3)
    page = f"<html><head><title>{words(1, 6)}</title></head><body>{before}{main}{after}" + (footer() if rng.random() < 0.85 else "") + "</body></html>"
    return page


def train(pages: int = 900, rounds: int = 5, seed: int = 17) -> Field:
    """Adaptive gradient steps on the labelled pages' likelihood."""
    rng, field, features = random.Random(seed), Field(), Features()
    data = []
    for _ in range(pages):
        blocks = leaf_blocks(labelled_page(rng), labelled=True)
        if blocks:
            data.append(([features(b, i, len(blocks)) for i, b in enumerate(blocks)], Field.edges(blocks), [int(b[3] or 0) for b in blocks]))
    gw, ge = np.full(1 << _BITS, 1e-3), np.full((2, 2, 2), 1e-3)
    for _ in range(rounds):
        rng.shuffle(data)
        for rows, kinds, labels in data:
            node, pair = field.slopes(rows, kinds, labels)
            flat = np.concatenate([np.array(r) for r in rows])
            slope = np.bincount(flat, np.repeat(node, [len(r) for r in rows]), 1 << _BITS)
            at = np.unique(flat)
            slope = slope[at] + 1e-4 * field.w[at]
            gw[at] += slope**2
            field.w[at] -= 0.3 * slope / np.sqrt(gw[at])
            ge += pair**2
            field.edge -= 0.3 * pair / np.sqrt(ge)
    return field


def extract(field: Field, features: Features, page: str | None) -> str:
    blocks = leaf_blocks(page) if page else []
    if not blocks:
        return ""
    labels = field.best([features.score(field.w, b, i, len(blocks)) for i, b in enumerate(blocks)], Field.edges(blocks))
    return " ".join(b[0] for b, y in zip(blocks, labels) if y)


def extract_main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    The whole page is parsed, whatever its length and the depth of its elements; a null or
    empty page, or one without main text, gives an empty text. White space inside a block
    becomes one space, blocks join by one space. Repeated rows and repeated or null ids are
    rows of their own; other columns of pages, whatever their names, play no part.
    """
    field = field or train()
    sent = pages.sparkSession.sparkContext.broadcast((field.w, field.edge))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, features = Field(), Features()
        own.w, own.edge = sent.value
        for pdf in batches:
            texts = [extract(own, features, p) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
