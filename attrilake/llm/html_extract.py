"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Every block becomes a vector
of its tag path (tags, classes and ids of all open elements, hashed), of its words (hashed) and of
a few densities. A bidirectional LSTM in numpy reads a page's blocks in both directions and
labels each from the context of the whole document. It is trained here, on pages that a generator
with a fixed seed composes from labelled parts: articles in many containers, among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

The text of a page is its main blocks in page order, joined by line breaks; in a block character
references are decoded and white space becomes one space. Defined results: null html counts as
empty; a page without main blocks has empty text; unclosed and stray tags close as browsers close
them; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm.shingles import slices, word_hashes

#: Fixed values of HTML: elements that end a block, never hold text, hold raw text that is no part of the page's, or markup that isn't shown.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "iframe")
HIDDEN = ("template",)
#: Elements that leave no mark in a tag path: what they hold is judged as if it stood there by itself.
CLEAR = ("noscript", "object", "svg", "math", "template")
#: Elements that a start tag closes when one of them is open, and what stops the search for them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table select html body article section div main aside nav".split())
TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>""", regex.S)
NAMES = regex.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", regex.I)
PART = regex.compile(r"[a-z]+|\d+")

#: Sizes of the hashed vectors and of a direction's state, and what training takes.
PATH_SIZE, LEAF_SIZE, WORD_SIZE, DENSITIES, STATE = 384, 32, 48, 4, 20
PAGES, STEPS, BATCH, RATE, SEED = 1500, 600, 32, 0.01, 11
#: Share of a word vector's length that counts, and how slowly the averaged weights follow.
WORD_WEIGHT, FOLLOW = 0.4, 0.98
#: Pages and blocks that are labelled together; a page of more blocks goes through slice by slice.
TOGETHER, MOST_BLOCKS = 64, 16_384


def blocks_of(page: str) -> list[tuple[tuple, str, float]]:
    """(tag path, text, share of its characters in links) of a page's leaf blocks, blank ones left out."""
    out, stack, pieces, linked = [], [], [], 0
    at, link, hidden, paths = 0, 0, 0, {}

    def end_block():
        nonlocal pieces, linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join(html.unescape(raw).split())
            if text:
                path = tuple(x[1] for x in stack if x[1])
                out.append((paths.setdefault(path, path), text, min(1.0, linked / max(1, len(raw)))))
            pieces, linked = [], 0

    def pop_to(depth: int):
        nonlocal link, hidden
        while len(stack) > depth:
            name = stack.pop()[0]
            link -= name == "a"
            hidden -= name in HIDDEN

    while at <= len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not hidden:
            pieces.append(text)
            linked += len(text) if link else 0
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                end_block()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):
                close = regex.compile(rf"</{name}\b[^>]*>", regex.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in BLOCK:
            end_block()
            if any(x[0] == "p" for x in stack[-6:]):
                depth = max(i for i, x in enumerate(stack) if x[0] == "p")
                pop_to(depth)
            if name in CLOSES:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in CLOSES[name]:
                        pop_to(depth)
                        break
                    if stack[depth][0] in STOPS:
                        break
        if name not in VOID and not m.group(3).endswith("/"):
            marks = [] if name in CLEAR else [name]
            for a, b, c in NAMES.findall(m.group(3)) if marks else ():
                marks += ["." + x for x in PART.findall((a or b or c).lower())]
            stack.append((name, tuple(marks)))
            link += name == "a"
            hidden += name in HIDDEN
    end_block()
    return out


_PATHS: dict[tuple, np.ndarray] = {}


def path_vector(path: tuple) -> np.ndarray:
    """Hashed marks of all open elements, and of the innermost block-level one."""
    got = _PATHS.get(path)
    if got is None:
        got = np.zeros(PATH_SIZE + LEAF_SIZE, np.float32)
        for marks in path:
            for x in marks:
                h = zlib.crc32(x.encode())
                got[h % PATH_SIZE] = 1 if h & 0x10000 else -1
        leaf = next((m[0] for m in reversed(path) if m[0] in BLOCK), "")
        got[PATH_SIZE + zlib.crc32(leaf.encode()) % LEAF_SIZE] = 1
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = got
    return got


def vectors(blocks: list[tuple[tuple, str, float]]) -> np.ndarray:
    """(blocks, features) of a page or of several in a row."""
    texts = [t for _, t, _ in blocks]
    hashes, first = word_hashes(pa.array(texts, pa.large_string()))
    count = np.diff(first)
    where = np.repeat(np.arange(len(texts)), count)
    words = np.bincount(where * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64), minlength=len(texts) * WORD_SIZE).reshape(-1, WORD_SIZE)
    words = WORD_WEIGHT * words / np.sqrt(np.maximum(1, (words**2).sum(1, keepdims=True)))
    stops = np.array([sum(map(t.count, ".,;!?")) for t in texts])
    densities = np.stack([np.log1p(count) / 5, np.minimum(stops / np.maximum(count, 1), 1), np.array([s for _, _, s in blocks]), np.log1p([len(p) for p, _, _ in blocks]) / 3], 1)
    return np.concatenate([np.stack([path_vector(p) for p, _, _ in blocks]), words, densities], 1).astype(np.float32)


FEATURES = PATH_SIZE + LEAF_SIZE + WORD_SIZE + DENSITIES


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None, start: tuple | None = None) -> np.ndarray:
        """States (pages, blocks, STATE); beyond a page's end its state stays.

        ``start`` is the state before the first block; ``self.last`` is the one after the last.
        """
        n, steps, _ = x.shape
        drive = x @ self.w + self.b
        h, c = start or (np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32))
        out = np.zeros((n, steps, STATE), np.float32)
        for t in range(steps):
            z = drive[:, t] + h @ self.u
            g = sigmoid(z[:, : 3 * STATE])
            i, f, o = g[:, :STATE], g[:, STATE : 2 * STATE], g[:, 2 * STATE :]
            a = np.tanh(z[:, 3 * STATE :])
            m = mask[:, t : t + 1]
            new = f * c + i * a
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, a, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[:, t] = h
        self.last = h, c
        return out

    def backward(self, x: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of w, u and b from that of the states."""
        n, steps, _ = x.shape
        dw_in = np.zeros((n, steps, 4 * STATE), np.float32)
        du = np.zeros_like(self.u)
        dh, dc = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, a, tanh, m = kept[t]
            dh = dh + grad[:, t]
            inner = np.where(m, dh, 0)
            dn = np.where(m, dc, 0) + inner * o * (1 - tanh**2)
            dz = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), inner * tanh * o * (1 - o), dn * i * (1 - a**2)], 1)
            dw_in[:, t] = dz
            du += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ self.u.T
            dc = np.where(m, dn * f, dc)
        flat = dw_in.reshape(-1, 4 * STATE)
        return [x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)]


@dataclass
class Labeller:
    """Two LSTMs and a logistic output over both states and the block's own vector."""

    ahead: Lstm
    back: Lstm
    out: np.ndarray
    own: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        def lstm():
            b = np.zeros(4 * STATE, np.float32)
            b[STATE : 2 * STATE] = 1
            return Lstm(rng.normal(0, 0.1, (FEATURES, 4 * STATE)).astype(np.float32), rng.normal(0, 0.2, (STATE, 4 * STATE)).astype(np.float32), b)

        return Labeller(lstm(), lstm(), rng.normal(0, 0.2, (2 * STATE, 1)).astype(np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.own, self.bias]

    def states(self, x, mask, kept=None):
        a = self.ahead.forward(x, mask, kept[0] if kept else None)
        b = self.back.forward(x[:, ::-1], mask[:, ::-1], kept[1] if kept else None)[:, ::-1]
        return np.concatenate([a, b], 2)

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the chance that each block is main text."""
        out = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        while order:
            # as many pages as keep the padded array small, the longest first
            at = order[-max(1, min(TOGETHER, MOST_BLOCKS // max(1, len(pages[order[-1]])))) :]
            del order[-len(at) :]
            x, mask = padded([pages[i] for i in at])
            p = sigmoid(self.states(x, mask) @ self.out + x @ self.own + self.bias)[:, :, 0]
            for i, row in zip(at, p, strict=True):
                out[i] = row[: len(pages[i])]
        return out

    def streamed(self, blocks: list, size: int = MOST_BLOCKS) -> np.ndarray:
        """The chances of one long page's blocks: vectors live a slice at a time, of the rest only states stay."""
        n = len(blocks)
        logit = np.empty(n, np.float32)
        for lstm, weights, cuts, step in ((self.ahead, self.out[:STATE], range(0, n, size), 1), (self.back, self.out[STATE:], range((n - 1) // size * size, -1, -size), -1)):
            state = None
            for at in cuts:
                x = vectors(blocks[at : at + size])
                found = lstm.forward(x[None, ::step], np.ones((1, len(x)), bool), start=state)[0, ::step]
                state = lstm.last
                part = (found @ weights)[:, 0]
                logit[at : at + size] = part + (x @ self.own + self.bias)[:, 0] if step > 0 else logit[at : at + size] + part
        return sigmoid(logit)

    def gradients(self, x, mask, y):
        kept = ([], [])
        s = self.states(x, mask, kept)
        p = sigmoid(s @ self.out + x @ self.own + self.bias)[:, :, 0]
        d = (np.where(mask, p - y, 0) / mask.sum()).astype(np.float32)[:, :, None]
        ds = d @ self.out.T
        first = self.ahead.backward(x, kept[0], ds[:, :, :STATE])
        second = self.back.backward(np.ascontiguousarray(x[:, ::-1]), kept[1], ds[:, ::-1, STATE:])
        loss = -np.where(mask, np.log(np.where(y > 0, p, 1 - p) + 1e-9), 0).sum() / mask.sum()
        return [*first, *second, s.reshape(-1, 2 * STATE).T @ d.reshape(-1, 1), x.reshape(-1, FEATURES).T @ d.reshape(-1, 1), d.sum((0, 1))], loss


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(1, max(map(len, pages)))
    x, mask = np.zeros((len(pages), longest, FEATURES), np.float32), np.zeros((len(pages), longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


# The generator of labelled pages. A part is (html, whether its blocks are main text).
KINDS = {
    "menu": ("home about contact news products services blog login register help search topics archive support careers".split(), 1, 3),
    "notice": ("we use cookies to improve your experience accept all settings privacy policy by continuing you agree to our terms notice important".split(), 4, 16),
    "advert": ("sponsored advertisement buy now best offer free shipping discount click here sale deal today only limited".split(), 3, 14),
    "footer": ("copyright all rights reserved terms privacy imprint contact sitemap company powered by follow us".split(), 3, 14),
    "comment": ("reply posted by user ago thanks great post i agree disagree nice article report like comment wrote said".split(), 3, 40),
    "form": ("name email password subscribe submit newsletter sign up your message send search required enter".split(), 1, 5),
    "related": ("related posts read more you may also like popular trending next previous share tweet tags category recommended".split(), 2, 9),
}
SYLLABLES = "the an in er on re ti st en at ed nd to or ea ha ng is it al ar ou le de ment que ción lich keit heit tion été eau ch sch ung ado os as".split()
CONTAINERS = {
    "menu": ['<nav>', '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<header class="site-header">', '<div class="navbar">', '<div class="breadcrumbs">', '<div id="header">', '<header>', '<div class="topbar">'],
    "notice": ['<div class="notice">', '<div class="cookie-banner">', '<div id="cookie-notice">', '<div class="alert">', '<section class="consent">', '<aside class="notice">', '<div role="alert">', '<p class="notice">', '<div class="banner">', '<div class="gdpr">', '<div class="disclaimer">', '<div class="popup modal">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<aside class="sponsored">', '<div id="ad-1">', '<div class="promo">', '<section class="ad-slot">', '<p class="ad">', '<div class="sponsor">'],
    "footer": ['<footer>', '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="bottom">'],
    "comment": ['<div class="comments">', '<section id="comments">', '<section class="comments">', '<ol class="comment-list">', '<div class="discussion">', '<div id="respond">', '<div class="replies">', '<ul class="comments">', '<aside class="comments">', '<div class="user-comments reader">'],
    "form": ['<form>', '<form class="newsletter">', '<form action="/search">', '<form id="subscribe">', '<fieldset class="login">', '<div class="signup newsletter">'],
    "related": ['<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">', '<section class="related-posts">', '<div class="share">', '<div class="social">', '<aside class="related">'],
}
MAIN = ['<article>', '<article>', '<article>', '<article class="post">', '<main>', '<main><article>', '<div class="content">', '<div id="content">', '<div class="article-body">', '<div class="post-content">', '<section class="story">', '<div class="entry">', '<div id="main"><div class="text">', '<div role="main">', '<section class="content"><article>', '<div class="page"><div class="article">']


def closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(regex.findall(r"<(\w+)", opening)))


class Pages:
    """Composes labelled pages; the same seed composes the same ones."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def prose(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(int(self.rng.integers(low, high)))]
        junk = self.pick(["", "", "", "%%%", "###", "!!"])
        return " ".join((w + self.pick(["", "", "", "", "", "", ",", "."]) + junk) for w in words).capitalize() + "."

    def phrase(self, kind: str) -> str:
        words, low, high = KINDS[kind]
        if self.rng.random() < 0.4:  # boilerplate in words that articles have too
            return self.prose(low, high + 1)
        return " ".join(self.pick(words) for _ in range(int(self.rng.integers(low, high + 1))))

    def boilerplate(self, kind: str) -> str:
        opening = self.pick(CONTAINERS[kind])
        n = int(self.rng.integers(1, 7))
        if kind in ("menu", "related") and self.rng.random() < 0.8:
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{self.phrase(kind)}</a></li>' for i in range(n)) + "</ul>"
        elif kind == "comment":
            inner = "".join(self.pick(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="comment">{}</li>', "<div><b>{}</b><p>{}</p></div>", "<blockquote>{}</blockquote>"]).replace("{}", self.phrase(kind)) for _ in range(n))
        elif kind == "form":
            inner = "".join(self.pick(["<label>{}</label><input>", "<button>{}</button>", "<p>{}</p>", "<select><option>{}</option></select>"]).replace("{}", self.phrase(kind)) for _ in range(min(n, 3)))
        else:
            inner = self.pick(["{}", "{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h3>{}</h3><p>{}</p>", '<a href="/x">{}</a>', "<div>{}</div>"])
            while "{}" in inner:
                inner = inner.replace("{}", self.phrase(kind), 1)
        return opening + inner + closing(opening)

    def noise(self) -> str:
        """A name that says nothing, on a container of either kind."""
        return f'<div class="{self.word()}">' if self.rng.random() < 0.35 else ""

    def page(self) -> list[tuple[str, int]]:
        parts: list[tuple[str, int]] = []

        def other(kind: str, chance: float, wrap: bool = True):
            if self.rng.random() < chance:
                shell = self.noise() if wrap else ""
                parts.append((shell + self.boilerplate(kind) + closing(shell), 0))

        other("notice", 0.3)
        other("menu", 0.9)
        other("menu", 0.3)
        other("advert", 0.6)
        other("related", 0.25)
        other("form", 0.15)
        main = self.pick(MAIN)
        shell = self.noise()
        parts.append((shell + main, -1))
        if self.rng.random() < 0.8:
            parts.append((f"<h1>{self.prose(2, 10)}</h1>", 1))
        for _ in range(int(self.rng.integers(1, self.pick([12, 12, 12, 60])))):
            form = self.pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<p><a href='/x'>x</a> {}</p>", "<table><tr><td>{}</td></tr></table>"])
            parts.append((form.replace("{}", self.prose(1, int(self.pick([4, 12, 60, 160])))), 1))
            for kind, chance in (("advert", 0.04), ("notice", 0.02), ("related", 0.03), ("form", 0.02)):
                other(kind, chance, wrap=False)
        other("comment", 0.12, wrap=False)  # comments inside the article's own element
        other("related", 0.1, wrap=False)
        parts.append((closing(main) + closing(shell), -1))
        other("comment", 0.45)
        other("related", 0.4)
        other("advert", 0.3)
        other("form", 0.25)
        other("notice", 0.2)
        other("footer", 0.9)
        return parts

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and labels of one page's blocks."""
        parts = self.page()
        body = "<html><body>"
        marked = body + "".join(h.replace(">", f">\x02{label}", 1) if label < 0 else self._mark(h, label) for h, label in parts).replace("\x02-1", "")
        found = [(p, t.replace("\x031", "").replace("\x030", "").strip(), s, "\x031" in t) for p, t, s in blocks_of(marked) if t.replace("\x031", "").replace("\x030", "").strip()]
        x = vectors([(p, t, s) for p, t, s, _ in found])
        y = np.array([m for *_, m in found], np.float32)
        drop = self.rng.random() < 0.5  # some pages teach what paths alone say
        if drop:
            x[:, PATH_SIZE + LEAF_SIZE : PATH_SIZE + LEAF_SIZE + WORD_SIZE] = 0
        return x, y

    @staticmethod
    def _mark(part: str, label: int) -> str:
        """Every run of text in the part starts with a mark of its label."""
        return regex.sub(r">([^<]+)", lambda m: f">\x03{label}{m.group(1)}", part)


_TRAINED: dict = {}


def trained(seed: int = SEED, pages: int = PAGES, steps: int = STEPS) -> Labeller:
    """The labeller, trained on the driver once a process: the same for the same arguments."""
    key = seed, pages, steps
    if key not in _TRAINED:
        rng = np.random.default_rng(seed)
        source = Pages(seed)
        data = sorted((source.labelled() for _ in range(pages)), key=lambda d: len(d[1]))
        model = Labeller.fresh(rng)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
        mean = [w.copy() for w in model.weights()]
        for step in range(1, steps + 1):
            at = int(rng.integers(0, max(1, pages - 2 * BATCH))) + rng.choice(min(pages, 2 * BATCH), min(pages, BATCH), replace=False)  # of like lengths
            x, mask = padded([data[i][0] for i in at])
            y = np.zeros(mask.shape, np.float32)
            for row, i in enumerate(at):
                y[row, : len(data[i][1])] = data[i][1]
            gradients, _ = model.gradients(x, mask, y)
            size = np.sqrt(sum(float((g**2).sum()) for g in gradients))
            for w, g, (m, v) in zip(model.weights(), gradients, moments, strict=True):  # Adam
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                rate = RATE * (1 - 0.95 * step / steps)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            for w, m in zip(model.weights(), mean, strict=True):
                m += (1 - FOLLOW) * (w - m)
        for w, m in zip(model.weights(), mean, strict=True):
            w[...] = m
        _TRAINED[key] = model
    return _TRAINED[key]


def main_text(pages: list[str], model: Labeller, least: float = 0.5) -> list[str]:
    """The main text of each page."""
    out, held, size = [""] * len(pages), [], 0

    def settle():
        nonlocal held, size
        if held:
            cuts = np.cumsum([len(b) for _, b in held])[:-1]
            chances = model.chances(np.split(vectors([x for _, b in held for x in b]), cuts)) if size <= MOST_BLOCKS else [model.streamed(b) for _, b in held]
            for (i, found), chance in zip(held, chances, strict=True):
                out[i] = "\n".join(t for (_, t, _), p in zip(found, chance, strict=True) if p >= least)
        held, size = [], 0

    for i, page in enumerate(pages):
        found = blocks_of(page)
        if size + len(found) > MOST_BLOCKS or len(held) == TOGETHER:
            settle()
        if found:
            held.append((i, found))
            size += len(found)
    settle()
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def read(batches):
        labeller = shared.value
        for whole in batches:
            for batch in slices(whole, "html"):
                text = main_text([h or "" for h in batch.column("html").to_pylist()], labeller)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    columns = [pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(read, "page_id long, url string, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
