"""Main text of web pages by a bidirectional LSTM over their blocks.

A page is the sequence of its text blocks. Each is a vector of its tag path (tags and
class words of the elements above it, and pairs of neighbours among these, hashed), of its words (hashed) and of a few
numbers; two LSTMs read the sequence, one from each end, so every block is judged by what comes before and after it on the
whole page. Blocks at 0.5 or more are the main text.

No page comes with labels, so a bounded sample of pages teaches: blocks within an article or main element, outside of parts whose names
say otherwise, are main text. Such pages look alike, so each is shown again in other layouts, made of its own texts:
containers under other tags and names, some without article elements, with menus, notices, adverts, forms, sidebars and
comments around and inside the article. A sample without any article teaches by those layouts alone.

Cases: a null or empty html, and one without main text, give an empty text; repeated rows are read alike; an empty table gives an
empty result; very long pages are read whole, in one sequence, alone in their run; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.html_blocks import Block, blocks
from quarry.llm.labelled import give_back
from quarry.session import small_batches

#: Names of parts that are not main text, by kind; with tags that go with them.
OTHER = {
    "menu": (("nav", "ul", "div", "menu"), ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topnav", "tabs", "toc", "pagination", "pager")),
    "header": (("header", "div"), ("masthead", "topbar", "banner", "branding", "logo", "siteheader", "toolbar")),
    "footer": (("footer", "div"), ("footer", "colophon", "copyright", "legal", "bottom", "imprint", "credits")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "teaser", "promoted", "archive", "tags", "more")),
    "notice": (("div", "section", "aside", "dialog"), ("cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "alert", "paywall", "disclaimer", "toast", "hidden")),
    "advert": (("div", "aside", "ins", "section"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adslot", "dfp", "commercial", "affiliate")),
    "form": (("form", "fieldset", "div"), ("form", "search", "login", "signup", "subscribe", "newsletter", "register", "contact", "signin")),
    "comments": (("div", "section", "ol", "ul"), ("comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "thread", "responses", "reviews")),
    "share": (("div", "ul"), ("share", "sharing", "social", "follow", "tools", "buttons")),
}
MAIN_NAMES = ("article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "page", "single", "hentry", "copy", "prose", "markdown", "wiki", "document")
PLAIN_NAMES = ("container", "wrapper", "wrap", "row", "col", "inner", "outer", "site", "layout", "grid", "column", "center", "left", "right", "box", "group", "clearfix", "block", "item", "1", "2", "12")
#: What such parts often say.
SAYINGS = {
    "menu": ("Home", "About us", "Contact", "News", "Products", "Startseite", "Accueil", "Inicio", "Log in", "Next page", "Sitemap"),
    "header": ("Skip to content", "The daily site", "Welcome", "Edition", "Sign in"),
    "footer": ("© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "Mentions légales", "Aviso legal", "Powered by"),
    "sidebar": ("Related articles", "Most read", "Recent posts", "Categories", "You may also like", "Trending now", "Tags"),
    "notice": ("We use cookies to improve your experience.", "Accept all", "This site uses cookies", "Wir verwenden Cookies", "Nous utilisons des cookies", "Utilizamos cookies", "Please enable JavaScript."),
    "advert": ("Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now", "Special offer", "Shop the sale"),
    "form": ("Email address", "Subscribe to our newsletter", "Search", "Password", "Submit", "Your name", "Sign up"),
    "comments": ("Leave a reply", "3 comments", "Reply", "Posted by anonymous", "Thanks for this article!", "says:", "Kommentare", "Commentaires"),
    "share": ("Share on Facebook", "Tweet", "Share this", "Print", "Email this", "Follow us"),
}
#: What the blocks of such parts are.
INNER = {
    "menu": (("li",), ("ul", "li"), ("a",)),
    "share": (("li",), ("a",)),
    "form": (("label",), ("p",), ("button",), ()),
    "comments": (("p",), ("li", "p"), ("div",), ("article", "p"), ("h3",), ("h2",)),
    "header": (("h1",), ("p",), (), ("div",), ("h2",)),
    "any": (("p",), ("p",), (), (), ("h2",), ("h3",), ("ul", "li"), ("div",)),
}
_SAID = [w for says in SAYINGS.values() for say in says for w in say.strip(".!:").split()]
_NOT_MAIN = frozenset(n for _, names in OTHER.values() for n in names) | {"nav", "aside", "footer", "form", "dialog", "button", "menu"}
_IN_BOTH = frozenset(("banner", "more", "text", "tags", "thread", "tools"))  # too common inside articles to tell


@dataclass(frozen=True)
class Settings:
    """``pages`` and ``page_bytes`` bound the sample and its longest page; ``layouts`` pages of other layouts are made of their texts, each page's in turn."""

    pages: int = 300
    page_bytes: int = 100_000
    layouts: int = 1800
    path_slots: int = 512
    word_slots: int = 32
    hidden: int = 28
    epochs: int = 9
    rate: float = 0.01
    seed: int = 11


class Features:
    """Vectors of blocks; those of paths are kept, for the pages of a site share them."""

    NUMBERS = 8

    def __init__(self, path_slots: int, word_slots: int):
        self.path_slots, self.word_slots = path_slots, word_slots
        self.size = path_slots + word_slots + self.NUMBERS
        self.known: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    @staticmethod
    def _add(v: np.ndarray, name: str, weight: float) -> None:
        h = zlib.crc32(name.encode("utf-8", "replace"))
        v[h % len(v)] += weight if h & 0x80000000 else -weight

    def path(self, path: tuple) -> np.ndarray:
        v = self.known.get(path)
        if v is None:
            v = np.zeros(self.path_slots, dtype=np.float32)
            named = [f for f in path if f[0] not in ("html", "body")]
            for k, f in enumerate(named):
                for w in f[1:]:
                    self._add(v, "." + w, 1.5)
                self._add(v, f[0], 0.6)
                if k:
                    self._add(v, named[k - 1][0] + ">" + f[0], 0.4)
            for w in path[-1] if path else ():
                self._add(v, "last " + w, 1.0)
            v /= max(1.0, float(np.sqrt((v * v).sum())) / 2)
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[path] = v
        return v

    def word(self, word: str) -> int:
        """A word's slot; those that count negatively come after the others."""
        at = self.words.get(word)
        if at is None:
            h = zlib.crc32(word.lower().encode("utf-8", "replace"))
            at = h % self.word_slots + (0 if h & 0x80000000 else self.word_slots)
            if len(self.words) >= 50_000:
                self.words.clear()
            self.words[word] = at
        return at

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), self.size), dtype=np.float32)
        a, b = self.path_slots, self.path_slots + self.word_slots
        n, slots = max(1, len(found) - 1), []
        for i, block in enumerate(found):
            out[i, :a] = self.path(block.path)
            text = block.text
            words = text.split(" ")
            slots += [2 * self.word_slots * i + self.word(w) for w in words]
            size = len(text)
            stops = text.count(".") + text.count(",") + text.count("?") + text.count("!")
            out[i, b:] = (math.log1p(size) / 8, math.log1p(text.count(" ")) / 6, min(1.0, block.linked / size), min(1.0, 10 * stops / size), i / n, len(block.path) / 16, float(text[-1] in ".!?"), 1.0)
        held = np.bincount(slots, minlength=2 * self.word_slots * len(found)).reshape(len(found), 2, self.word_slots)
        v = (held[:, 0] - held[:, 1]).astype(np.float32)
        out[:, a:b] = v / np.maximum(1.0, np.sqrt((v * v).sum(axis=1)))[:, None]
        return out


# the network


def _steps(x: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool):
    """One LSTM over ``x(time, page, slot)``; all its outputs, and what the way back needs."""
    u = w[f"u{side}"]
    n, m, h = x.shape[0], x.shape[1], u.shape[0]
    z_all = x @ w[f"w{side}"] + w[f"b{side}"]
    out = np.zeros((n + 1, m, h), dtype=np.float32)
    cell = np.zeros((n + 1, m, h), dtype=np.float32) if keep else None
    gates = np.zeros((n, m, 4 * h), dtype=np.float32) if keep else None
    c = np.zeros((m, h), dtype=np.float32)
    for t in range(n):
        z = z_all[t] + out[t] @ u
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
        g = np.tanh(z[:, 3 * h :])
        c = s[:, h : 2 * h] * c + s[:, :h] * g
        out[t + 1] = s[:, 2 * h :] * np.tanh(c)
        if keep:
            cell[t + 1], gates[t, :, : 3 * h], gates[t, :, 3 * h :] = c, s, g
    return out, cell, gates


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's part of ``x(time, page, ...)`` in reverse; the padding stays at the end."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)
    return x[at, np.arange(x.shape[1])[None, :]]


def _back(x, w, side, out, cell, gates, d_out, grads) -> None:
    """Add one LSTM's slopes, given those of its outputs, from the last step to the first."""
    u = w[f"u{side}"]
    h = u.shape[0]
    dz_all = np.zeros_like(gates)
    dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g = gates[t, :, :h], gates[t, :, h : 2 * h], gates[t, :, 2 * h : 3 * h], gates[t, :, 3 * h :]
        dh = dh + d_out[t]
        tc = np.tanh(cell[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cell[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * h)
    grads[f"w{side}"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[f"u{side}"] += out[:-1].reshape(-1, h).T @ flat
    grads[f"b{side}"] += flat.sum(axis=0)


def logits(x: np.ndarray, sizes: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Log-odds ``(time, page)`` that blocks are main text."""
    ahead, _, _ = _steps(x, w, "f", False)
    behind, _, _ = _steps(_turned(x, sizes), w, "r", False)
    return ahead[1:] @ w["of"] + _turned(behind[1:], sizes) @ w["or"] + w["c"]


def slopes(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """The loss a block, and its slope by every weight, for padded pages ``x`` with labels ``y(time, page)``."""
    mask = (np.arange(x.shape[0])[:, None] < sizes[None, :]).astype(np.float32)
    back = _turned(x, sizes)
    a, ca, ga = _steps(x, w, "f", True)
    b, cb, gb = _steps(back, w, "r", True)
    b_out = _turned(b[1:], sizes)
    z = a[1:] @ w["of"] + b_out @ w["or"] + w["c"]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n = max(1.0, float(mask.sum()))
    loss = float((mask * (np.logaddexp(0, z) - y * z)).sum()) / n
    dz = (mask * (p - y) / n).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["c"] += dz.sum()
    grads["of"] += np.einsum("tm,tmh->h", dz, a[1:])
    grads["or"] += np.einsum("tm,tmh->h", dz, b_out)
    _back(x, w, "f", a, ca, ga, dz[:, :, None] * w["of"], grads)
    _back(back, w, "r", b, cb, gb, _turned(dz[:, :, None] * w["or"], sizes), grads)
    return loss, grads


def new_weights(size: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for side in "fr":
        w[f"w{side}"] = rng.normal(0, size**-0.5, (size, 4 * hidden)).astype(np.float32)
        w[f"u{side}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
        w[f"b{side}"] = np.zeros(4 * hidden, dtype=np.float32)
        w[f"b{side}"][hidden : 2 * hidden] = 1  # remember at first
        w[f"o{side}"] = rng.normal(0, hidden**-0.5, hidden).astype(np.float32)
    return w | {"c": np.zeros(1, dtype=np.float32)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), *pages[0].shape[1:]), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, sizes


def train(pages: list[tuple[list[Block], list[int]]], own: Settings) -> dict[str, np.ndarray]:
    """Weights fitted by Adam to labelled sequences; long ones in pieces of 128 blocks."""
    make, rng = Features(own.path_slots, own.word_slots), np.random.default_rng(own.seed)
    w = new_weights(make.size, own.hidden, rng)
    rows = []
    for found, labels in pages:
        x, y = make.page(found), np.array(labels, dtype=np.float32)
        rows += [(x[k : k + 128], y[k : k + 128]) for k in range(0, len(y), 128)]
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(own.epochs):
        order = rng.permutation(len(rows))
        order = order[np.argsort([len(rows[i][1]) // 8 for i in order], kind="stable")]
        runs = [order[k : k + 24] for k in range(0, len(order), 24)]
        for k in rng.permutation(len(runs)):
            x, sizes = padded([rows[i][0] for i in runs[k]])
            y, _ = padded([rows[i][1] for i in runs[k]])
            _, grads = slopes(x, y, sizes, w)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = own.rate * (1 - 0.8 * epoch / max(1, own.epochs))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-12))
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                w[name] = (w[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# what teaches it


def taught(found: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: 1 within article or main, unless a part below it is named otherwise; None without such marks."""
    out, marked = [], False
    for b in found:
        tags = [f[0] for f in b.path]
        top = next((k for k, f in enumerate(b.path) if f[0] in ("article", "main") or "articlebody" in f[1:]), None)
        marked |= top is not None
        below = set() if top is None else {w for f in b.path[top + 1 :] for w in f}
        out.append(int(top is not None and not (below & (_NOT_MAIN - _IN_BOTH)) and "nav" not in tags))
    return out if marked else None


def _part(kind: str, at: tuple, texts: list[str], rng: random.Random) -> list[Block]:
    """Blocks of a part that is not main text, below ``at``."""
    tags, names = OTHER[kind]
    tag = rng.choice(tags)
    own = rng.sample(names, 1) if tag in ("div", "section", "ul", "ol", "td") or rng.random() < 0.5 else []
    more = rng.sample(PLAIN_NAMES, rng.randint(0, 1)) + rng.choice(([], [], [], [], [], ["list"], ["area"], ["section"], ["posts"], ["content"]))
    path = (*at, (tag, *own, *more))
    if rng.random() < 0.3:
        path = (*path, _plain(rng))
    found = []
    for _ in range(rng.choice((1, 1, 2, 3, 5)) if kind != "menu" else rng.randint(2, 8)):
        s = rng.choice(SAYINGS[kind]) if rng.random() < 0.4 else rng.choice(texts)
        if kind in ("menu", "share", "footer") and rng.random() < 0.7:
            s = " ".join(s.split()[: rng.randint(1, 4)])
        inner = rng.choice(INNER.get(kind, INNER["any"]))
        found.append(Block((*path, *[(t,) for t in inner]), s, len(s) if kind in ("menu", "share") or rng.random() < 0.15 else 0))
    return found


def _plain(rng: random.Random) -> tuple[str, ...]:
    return (rng.choice(("div", "div", "div", "section", "td")), *rng.sample(PLAIN_NAMES, rng.randint(0, 2)))


def interrupted(found: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A marked page with other parts put between the blocks of its article, and one beside it."""
    texts, out, marks = [b.text for b in found], [], []
    for b, y in zip(found, labels):
        if y and rng.random() < 0.25:
            top = next(k for k, f in enumerate(b.path) if f[0] in ("article", "main") or "articlebody" in f[1:])
            at = b.path[: top + 1] if rng.random() < 0.85 else b.path[:top]
            part = _part(rng.choice(("advert", "advert", "notice", "share", "sidebar", "form", "comments", "header")), at, texts, rng)
            out, marks = out + part, marks + [0] * len(part)
        out.append(b)
        marks.append(y)
    return out, marks


def layout(texts: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of another layout, made of ``texts``: one's own article between and around other parts."""
    found: list[Block] = []
    labels: list[int] = []
    outer = (("html",), ("body",), *[_plain(rng) for _ in range(rng.choice((0, 0, 1, 1, 2)))])
    text = lambda: rng.choice(texts)

    def other(kind: str, at: tuple) -> None:
        part = _part(kind, at, texts, rng)
        found.extend(part)
        labels.extend([0] * len(part))

    def some(kinds: tuple[str, ...], at: tuple, chance: float) -> None:
        for kind in rng.sample(kinds, len(kinds)):
            if rng.random() < chance:
                other(kind, at)

    some(("menu", "header", "notice", "advert", "form"), outer, 0.45)
    tag = rng.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
    names = rng.sample(MAIN_NAMES, rng.randint(1, 2)) if tag not in ("article", "main") or rng.random() < 0.5 else []
    main = (*outer, (tag, *names, *rng.sample(PLAIN_NAMES, rng.choice((0, 0, 1)))))
    if rng.random() < 0.3:
        main = (*main, (rng.choice(("div", "section")), *rng.sample(MAIN_NAMES + PLAIN_NAMES, 1)))
    if rng.random() < 0.7:
        top = (*main, ("header",)) if rng.random() < 0.25 else main
        found.append(Block((*top, (rng.choice(("h1", "h1", "h2")),)), " ".join(text().split()[: rng.randint(2, 12)]), 0))
        labels.append(1)
    for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
        inner = rng.choice((("p",), ("p",), ("p",), ("p",), ("p", "b"), (), ("h2",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("dl", "dd"), ("div",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("section", "p")))
        s = text() if rng.random() < 0.8 else " ".join(rng.choices(_SAID, k=rng.randint(5, 40))) + "."  # such words alone tell nothing
        if inner in (("h2",), ("ul", "li"), ("ol", "li"), ("table", "tr", "td")):
            s = " ".join(s.split()[: rng.randint(1, 14)])
        found.append(Block((*main, *[(t,) for t in inner]), s, len(s) // 4 if rng.random() < 0.2 else 0))
        labels.append(1)
        if rng.random() < 0.2:
            other(rng.choice(("advert", "notice", "share", "sidebar", "form")), main)
    some(("share", "comments", "sidebar", "form", "advert", "notice"), main, 0.25)
    some(("comments", "sidebar", "advert", "form", "share", "notice"), outer, 0.35)
    some(("footer", "menu"), outer, 0.6)
    return found, labels


def lesson(pages: list[str], own: Settings) -> list[tuple[list[Block], list[int]]]:
    """Labelled sequences: the pages that mark their article, and other layouts of all of them."""
    out, rng, texts = [], random.Random(own.seed), []
    for page in pages:
        found = blocks(page)
        if found:
            labels = taught(found)
            out += [(found, labels), interrupted(found, labels, rng)] if labels is not None else []
            texts.append([b.text for b in found])
    return out + [layout(texts[k % len(texts)], rng) for k in range(own.layouts) if texts]


@dataclass
class Model:
    settings: Settings
    weights: bytes

    def unpacked(self) -> dict[str, np.ndarray]:
        with np.load(io.BytesIO(self.weights)) as held:
            return {k: held[k] for k in held.files}


def sample(pages: DataFrame, own: Settings) -> DataFrame:
    """At most ``pages`` of the pages, those with the smallest seeded hash of what they hold, each once and whole, in order.

    Hashes are picked first, of a share of all that holds enough, so that no page travels that is not in the sample.
    """
    sized = pages.select("html").where(F.octet_length("html").between(1, own.page_bytes))
    keyed = sized.withColumn("_order", F.xxhash64(F.lit(own.seed), "html"))
    share = min(1.0, 64 * own.pages / max(1, pages.count()))
    low = keyed.where(F.col("_order") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else keyed
    first = low.select("_order").distinct().orderBy("_order").limit(own.pages)
    rows = keyed.join(F.broadcast(first), "_order").groupBy("_order").agg(F.min("html").alias("html"))
    return rows.repartition(1).sortWithinPartitions("_order")


def fit(pages: DataFrame, settings: Settings | None = None) -> Model:
    """Train on a bounded sample of ``pages(html)``, in one task."""
    own = settings or Settings()
    small_batches(pages.sparkSession, rows=256)

    def learnt(batches):
        texts = [t for b in batches for t in b.column("html").to_pylist()]
        lessons = lesson(texts, own)
        if lessons:
            yield pa.record_batch({"w": pa.array([_saved(train(lessons, own))], pa.binary())})
        give_back()

    row = sample(pages, own).select("html").mapInArrow(learnt, "w binary").first()
    if row is not None:
        return Model(own, bytes(row.w))
    rng = random.Random(own.seed)  # no page of the sample holds text; other layouts of one sentence teach what is left
    return Model(own, _saved(train([layout(["A text of a few words."], rng) for _ in range(64)], own)))


def _saved(weights: dict[str, np.ndarray]) -> bytes:
    at = io.BytesIO()
    np.savez(at, **weights)
    return at.getvalue()


def judge(found: list[list[Block]], weights: dict[str, np.ndarray], make: Features, most: int = 8192) -> list[np.ndarray]:
    """For each page, which blocks are main text; pages of like length go together, at most ``most`` blocks with padding."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(found)
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(found[order[upto]]) <= most:
            upto += 1
        run = order[at:upto]
        x, sizes = padded([make.page(found[k]) for k in run])
        z = logits(x, sizes, weights)
        for j, k in enumerate(run):
            out[k] = z[: sizes[j], j] >= 0
        at = upto
    return out


def main_text(html: Column, model: Model, spark: SparkSession) -> Column:
    """The main text of a page: its blocks that the model keeps, in page order, with an empty line between two."""
    told = spark.sparkContext.broadcast(model)
    small_batches(spark, rows=256, bytes_="4m")
    held: dict = {}

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        if not held:
            own = told.value.settings
            held["w"], held["make"] = told.value.unpacked(), Features(own.path_slots, own.word_slots)
        found = [blocks(p) for p in pages.to_pylist()]
        kept = judge(found, held["w"], held["make"])
        return pa.array(["\n\n".join(b.text for b, good in zip(f, k) if good) for f, k in zip(found, kept)], pa.string())

    return extracted(html)


def extract(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``."""
    model = fit(pages, settings)
    read = pages.select("page_id", "url", main_text(F.col("html"), model, pages.sparkSession).alias("text"))
    return read.withColumn("n_chars", F.length("text").cast("long"))
