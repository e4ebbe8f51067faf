"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, with character references decoded and white
space turned into one space. Titles, scripts, styles and text areas are never blocks; they alone run on to the end where their
end tag is missing. A page is read in linear time. A block's vector is its tag path (tag names and the words of class, id and role of every open element), its hashed words, and a few
figures (length, share of linked text, position). A bidirectional LSTM in numpy reads the whole sequence, so each block is
labelled with the document around it: 1 for the article, 0 for menus, headers, footers, sidebars, notices, adverts, forms
and reader comments. Blocks labelled 1 are joined by line breaks, in page order.

Training is here too: the labeller is fitted on pages written by `made_page`, a generator of varied layouts whose blocks
are known, filled with at most `WORDS` words from at most `SAMPLE` pages of the input (those with the smallest hashes, and
of their ids), so that the vocabulary and languages are the corpus's own.

Defined results: null, empty or textless html gives an empty text; unclosed, misnested or unknown tags are read as far as
they go; repeated pages are extracted once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import few_by_hash

SAMPLE, WORDS, PATH_BITS, WORD_BITS, FIGURES, HIDDEN = 200, 20_000, 128, 64, 14, 20
WIDTH = PATH_BITS + WORD_BITS + FIGURES

#: Tokens that can be told without looking past the next `<`. A lone `<` is looked at by Blocks.slow.
_TOKEN = re.compile(r"[^<]++|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|<", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile("[>\"']")
#: Elements whose text is no markup.
RAW = {t: re.compile(f"</{t}\\s*>", re.I) for t in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SUBWORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {k: {"p"} for k in "div ul ol h1 h2 h3 h4 h5 h6 section article aside header footer nav main form table blockquote pre figure".split()}


def _names(tag: str, attributes: str) -> list[str]:
    out = ["<" + tag]
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            out += ["." + w.lower() for w in _SUBWORD.findall(m[2] or m[3] or m[4] or "")]
    return out


_path_hash: dict[str, int] = {}
_word_hash: dict[str, int] = {}


def _bucket(cache: dict[str, int], word: str, n: int, seed: int, strip: str = "") -> int:
    k = cache.get(word)
    if k is None:
        if len(cache) > 200_000:
            cache.clear()
        k = cache[word] = zlib.crc32((word.strip(strip) if strip else word).encode(), seed) % n
    return k


class Blocks:
    """Blocks of one page: (text, buckets of the tag path's names as bits, their number, linked code points, leaf tag)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, str]] = []
        self.stack: list[tuple[str, int, int]] = []  # an open element's tag, and the bits and number of the names down to it
        self.text: list[str] = []
        self.linked, self.in_link = 0, 0
        self.opened: dict[str, int] = {}  # how often a name is on the stack
        self.html, self.loose, self.unclosed = html, False, set()
        at, match = 0, _TOKEN.match
        while (m := match(html, at)) is not None:
            at = m.end()
            if m[2] is not None:
                at = self.tag(m[1], m[2].lower(), m[3], at)
            elif m[0] != "<":
                self.put(m[0])
            else:
                at = self.slow(at - 1)
        self.flush()

    def put(self, piece: str) -> None:
        self.text.append(piece)
        self.linked += len(piece) * (self.in_link > 0)

    def until(self, end: str, at: int) -> int:
        """Past the next `end` from `at`, or the page's end; what isn't found once is not looked for again."""
        k = -1 if end in self.unclosed else self.html.find(end, at)
        if k < 0:
            self.unclosed.add(end)
        return len(self.html) if k < 0 else k + len(end)

    def slow(self, at: int) -> int:
        """Reads what the `<` at `at` begins and returns where that ends: a comment, a declaration, a tag with odd quotes or
        brackets, or mere text. A tag ends with the first `>` outside quotes. Where a page has none, from there on with the
        first `>` of any kind, so that a page is read in linear time."""
        html = self.html
        if html.startswith("<!--", at):
            return self.until("-->", at + 2)
        if html.startswith("<![CDATA[", at):
            return self.until("]]>", at)
        m = _NAME.match(html, at)
        if m is not None or html[at + 1 : at + 2] in ("!", "?", "/"):
            end, k = None, at + 1 if m is None else m.end()
            while not self.loose and m is not None:
                stop = _STOP.search(html, k)
                if stop is None:
                    self.loose = True
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    k = html.find(stop[0], stop.end()) + 1
                    self.loose = not k
            if end is None:
                end = self.until(">", at) - 1 if ">" not in self.unclosed else len(html)
            if end < len(html) and html[end] == ">":
                return end + 1 if m is None else self.tag(m[1], m[2].lower(), html[m.end() : end], end + 1)
        self.put("<")
        return at + 1

    def tag(self, ends: str, tag: str, attributes: str, at: int) -> int:
        """Takes in a tag that ends at `at`; returns where to read on."""
        if tag == "br":
            self.text.append(" ")
        elif tag in INLINE:
            if tag == "a":
                self.in_link = 0 if ends else 1
        elif tag in RAW:
            self.flush()
            if not ends:
                end = RAW[tag].search(self.html, at)
                return end.end() if end else len(self.html)
        elif ends:
            self.flush()
            if self.opened.get(tag):
                while True:
                    name = self.stack.pop()[0]
                    self.opened[name] -= 1
                    if name == tag:
                        break
        else:
            self.flush()
            closes = CLOSES.get(tag)
            while closes and self.stack and self.stack[-1][0] in closes:
                self.opened[self.stack.pop()[0]] -= 1
            if tag not in VOID and tag != "head" and not attributes.endswith("/"):  # the text of a head is all in raw-text elements
                _, bits, n = self.stack[-1] if self.stack else ("", 0, 0)
                names = _names(tag, attributes)
                for name in names:
                    bits |= 1 << _bucket(_path_hash, name, PATH_BITS, 1)
                self.stack.append((tag, bits, n + len(names)))
                self.opened[tag] = self.opened.get(tag, 0) + 1
        return at

    def flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                leaf, bits, n = self.stack[-1] if self.stack else ("", 0, 0)
                self.blocks.append((text, bits, n, self.linked, leaf))
            self.text = []
        self.linked = 0


def vectors(blocks: list[tuple[str, int, int, int, str]]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), np.float32)
    at = PATH_BITS + WORD_BITS
    total = sum(len(b[0]) for b in blocks) or 1
    before = 0
    for k, (text, bits, depth, linked, leaf) in enumerate(blocks):
        row = out[k]
        row[:PATH_BITS] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_BITS // 8, "little"), np.uint8), bitorder="little")
        row[_bucket(_path_hash, "leaf " + leaf, PATH_BITS, 1)] = 1
        words = text.lower().split()
        if words:
            counts = np.bincount([_bucket(_word_hash, word, WORD_BITS, 2, ".,:;!?()[]\"'") for word in words], minlength=WORD_BITS)
            row[PATH_BITS:at] = counts / np.sqrt((counts * counts).sum())  # alike for long and short blocks
        n = len(text)
        row[at:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1, linked / n), n < 25, n > 120, text[-1] in ".!?\"»”", text.count(",") / max(1, len(words)), before / total, k / len(blocks), min(2, depth / 12),
            n / total, any(c.isdigit() for c in text), "©" in text, k == 0,
        )
        before += n
    return out


# ---- the labeller


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.w = {}
        for way in ("f", "b"):
            self.w[way + "x"], self.w[way + "h"], self.w[way + "c"] = make(WIDTH, 4 * hidden), make(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)
            self.w[way + "c"][hidden : 2 * hidden] = 1
        self.w["o"], self.w["d"] = make(2 * hidden, 1), np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """x (steps, pages, WIDTH); mask 1 where a page has a block."""
        n = self.hidden
        gates = x @ self.w[way + "x"] + self.w[way + "c"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.zeros((*x.shape[:2], n), np.float32)
        for t in range(len(x)):
            g = gates[t] + h @ self.w[way + "h"]
            s = 1 / (1 + np.exp(-g[:, : 3 * n]))
            i, f, o, a = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * a)
            tc = np.tanh(new_c)
            new_h = m * (o * tc)
            if keep is not None:
                keep.append((h, c, i, f, o, a, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        keep_f, keep_b = ([], []) if kept is not None else (None, None)
        forth = self._run("f", x, mask, keep_f)
        back = self._run("b", x[::-1], mask[::-1], keep_b)[::-1]
        both = np.concatenate([forth, back], 2)
        if kept is not None:
            kept.update(f=keep_f, b=keep_b, both=both)
        return 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["d"], -30, 30)))[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = self.forward(x, mask, kept)
        d = (p - y) * mask / mask.sum()
        grads = {"o": np.einsum("tbk,tb->k", kept["both"], d)[:, None], "d": np.array([d.sum()])}
        d_both = d[:, :, None] * self.w["o"][:, 0]
        n = self.hidden
        for way, own, xs in (("f", d_both[:, :, :n], x), ("b", d_both[::-1, :, n:], x[::-1])):
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            d_gates = np.zeros((*x.shape[:2], 4 * n), np.float32)
            wh = np.zeros_like(self.w[way + "h"])
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, a, tc, m = kept[way][t]
                dh = (dh + own[t]) * m
                dc = (dc * m) + dh * o * (1 - tc * tc)
                dc = dc * m
                g = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], 1)
                d_gates[t] = g
                wh += h.T @ g
                dh, dc = g @ self.w[way + "h"].T, dc * f
            grads[way + "h"] = wh
            flat = d_gates.reshape(-1, 4 * n)
            grads[way + "x"], grads[way + "c"] = xs.reshape(-1, WIDTH).T @ flat, flat.sum(0)
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 24, rate: float = 0.01, seed: int = 4) -> Labeller:
    model, rng = Labeller(), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    pages = sorted(pages, key=lambda p: len(p[0]))
    starts = list(range(0, len(pages), batch))
    for epoch in range(epochs):
        for at in rng.permutation(starts):
            own = pages[at : at + batch]
            x, mask = _padded([p for p, _ in own])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(own):
                y[: len(labels), k] = labels
            drop = (rng.random(WIDTH) > 0.05).astype(np.float32)  # no single name decides
            step += 1
            for k, g in model.gradients(x * drop, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - rate / (1 + epoch / 3) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[np.ndarray], batch_blocks: int = 20_000) -> list[np.ndarray]:
    """Each page's block labels; pages of like length are run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end - at + 1) <= batch_blocks:
            end += 1
        some = order[at:end]
        p = model.forward(*_padded([pages[k] for k in some]))
        for i, k in enumerate(some):
            out[k] = p[: len(pages[k]), i] >= 0.5
        at = end
    return out


# ---- training pages

_CONTENT = ["<article{}>", "<main{}>", "<div class='content'>", "<div id='main-content'>", "<div class='post'>", "<div class='entry-content'>", "<section class='article'>", "<div class='story-body'>", "<div id='article'>", "<div class='post-body text'>", "<td class='body'>", "<div role='main'>", "<div>"]
_MENU = ["<nav{}>", "<div class='menu'>", "<div id='navigation'>", "<ul class='navbar'>", "<div class='breadcrumb'>", "<div role='navigation'>", "<div class='top-links'>", "<div class='pagination'>", "<div class='tags'>", "<div class='share social'>"]
_SIDE = ["<aside{}>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<section class='related'>", "<div class='recommended'>", "<div class='right-column'>", "<div class='trending popular'>", "<div role='complementary'>"]
_AD = ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div id='ad-banner'>", "<div class='sponsored'>", "<div class='promo'>", "<aside class='advertisement'>", "<section class='sponsor'>", "<p class='ad'>", "<div class='ad-slot'>"]
_NOTICE = ["<div class='cookie-notice'>", "<div id='cookie-banner'>", "<div class='consent gdpr'>", "<div class='notice'>", "<div class='alert'>", "<div class='popup modal'>", "<section class='newsletter'>", "<div role='alert'>", "<div class='paywall'>", "<div role='dialog'>", "<div class='banner'>"]
_COMMENTS = ["<section class='comments'>", "<div id='comments'>", "<div class='comment-list'>", "<ol class='commentlist'>", "<div class='discussion'>", "<div class='reader-comments'>", "<div class='responses replies'>", "<section id='reader-comments'>"]
_FOOT = ["<footer{}>", "<div class='footer'>", "<div id='footer'>", "<div class='site-info copyright'>", "<div role='contentinfo'>", "<div class='bottom legal'>"]
_HEAD = ["<header{}>", "<div class='header'>", "<div id='masthead'>", "<div class='site-header'>", "<div class='topbar logo'>", "<div role='banner'>"]
_FORM = ["<form{}>", "<form class='search'>", "<div class='login'><form>", "<form id='subscribe'>", "<form class='contact'>"]
_WORN = "home about contact news search login subscribe share privacy terms cookies accept settings comments reply menu next previous advertisement sponsored copyright rights reserved more read popular related inicio contacto buscar accueil rechercher startseite kontakt suche impressum datenschutz".split()


def made_page(rng: np.random.Generator, words: list[str]) -> tuple[str, list[int]]:
    """A page in a random layout and the labels of its blocks in order. Every text starts with a mark of its label."""
    pick = lambda options: options[rng.integers(len(options))]
    mark = {1: "\x02", 0: "\x03"}

    def say(n: int, worn: float = 0.0) -> str:
        own = [pick(_WORN) if rng.random() < worn else pick(words) for _ in range(n)]
        return " ".join(own)

    def prose() -> str:
        text = say(int(np.exp(rng.uniform(0.7, 6 if rng.random() < 0.3 else 5))))
        if rng.random() < 0.06:
            text = text.replace(" ", " | ")
        if rng.random() < 0.2:
            text = f"<b>{text}</b>" if rng.random() < 0.5 else f"<a href='/x'>{text[:30]}</a> {text[30:]}"
        return text + (pick([".", "", "!", "?"]) if rng.random() < 0.9 else "<br>" + say(4))

    def put(label: int, tag: str, text: str) -> str:
        end = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}>{mark[label]}{text}{end}"

    def box(openings: list[str], inner: str) -> str:
        opening = pick(openings)
        if "{}" in opening:
            opening = opening.format(f" class='{pick(words).strip('.,')}'" if rng.random() < 0.3 else "")
        tags = re.findall(r"<(\w+)", opening)
        return opening + inner + "".join(f"</{t}>" for t in reversed(tags))

    def links(label: int = 0) -> str:
        return "<ul>" + "".join(f"<li><a href='/{k}'>{mark[label]}{say(int(rng.integers(1, 4)), 0.4)}</a></li>" for k in range(rng.integers(2, 9))) + "</ul>"

    def texts(label: int, low: int, high: int, worn: float = 0.0) -> str:
        return "".join(put(label, "p", prose() if rng.random() > worn else say(int(rng.integers(3, 25)), 0.3)) for _ in range(rng.integers(low, high)))

    def plain(label: int, worn: float) -> str:
        return mark[label] + say(int(rng.integers(2, 30)), worn) + pick([".", ""])

    def advert() -> str:
        return box(_AD, plain(0, 0.1) if rng.random() < 0.6 else texts(0, 1, 3))

    def body() -> str:
        out = put(1, pick(["h1", "h1", "h2"]), say(int(rng.integers(2, 12)))) if rng.random() < 0.85 else ""
        if rng.random() < 0.15:
            return out + mark[1] + "<br>".join(prose() for _ in range(rng.integers(1, 6)))
        for _ in range(rng.integers(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                out += texts(1, 1, 4)
            elif kind < 0.78:
                out += "<ul>" + "".join(put(1, "li", prose()) for _ in range(rng.integers(2, 6))) + "</ul>"
            elif kind < 0.82:
                out += f"<blockquote>{texts(1, 1, 3)}</blockquote>"
            elif kind < 0.86:
                out += put(1, pick(["h2", "h3"]), say(int(rng.integers(2, 8))))
            elif kind < 0.88:
                out += "<table>" + "".join("<tr>" + "".join(put(1, "td", say(int(rng.integers(1, 5)))) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
            elif kind < 0.96:
                out += advert() + (texts(1, 1, 3) if rng.random() < 0.7 else "")
            else:
                out += box(_NOTICE + _SIDE, plain(0, 0.3))
        return out

    comments = lambda: box(_COMMENTS, (put(0, "h3", say(2, 0.6)) if rng.random() < 0.7 else "") + "".join(put(0, pick(["p", "li", "div"]), prose()) for _ in range(rng.integers(1, 7))))
    form = lambda: box(_FORM, f"<label>{mark[0]}{say(2, 0.5)}</label><input type='text'><div>{mark[0]}{say(3, 0.4)}</div>")
    head = [box(_HEAD, plain(0, 0.3) if rng.random() < 0.5 else put(0, "h1", say(3)) + box(_MENU, links())), box(_MENU, links()), box(_MENU, links()), box(_NOTICE, plain(0, 0.3) if rng.random() < 0.5 else texts(0, 1, 3, 0.4)), advert(), box(_SIDE, links()), form()]
    tail = [box(_SIDE, put(0, "h3", say(2, 0.4)) + links()), box(_SIDE, texts(0, 1, 4)), comments(), comments(), advert(), form(), box(_NOTICE, texts(0, 1, 3, 0.4)), box(_MENU, links())]
    before = "".join(piece for piece in head if rng.random() < 0.35)
    after = "".join(piece for piece in tail if rng.random() < 0.35)
    foot = box(_FOOT, f"{mark[0]}&copy; {say(int(rng.integers(1, 14)), 0.2)}" if rng.random() < 0.6 else texts(0, 1, 3, 0.5) + links()) if rng.random() < 0.85 else ""
    inside = comments() if rng.random() < 0.08 else ""
    content = box(_CONTENT if rng.random() < 0.97 else ["<div>"], body() + inside)
    if rng.random() < 0.3:
        content = f"<div class='{pick(['container', 'wrapper', 'page', 'row'])}'>{content}{after}</div>"
        after = ""
    return f"<html><head><title>{say(4)}</title></head><body>{before}{content}{after}{foot}</body></html>", []


def training_pages(words: list[str], n: int = 500, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        html, _ = made_page(rng, words)
        blocks = Blocks(html).blocks
        labels = np.array([b[0][0] == "\x02" for b in blocks], np.float32)
        blocks = [(b[0].replace("\x02", "").replace("\x03", "").strip() or "x", *b[1:]) for b in blocks]
        if blocks:
            out.append((vectors(blocks), labels))
    return out


def corpus_words(pages: DataFrame, sample: int = SAMPLE, most: int = WORDS) -> list[str]:
    """At most `most` words, those with the smallest hashes, of at most `sample` page ids, likewise; one page for each id."""
    pages = pages.select(F.col("page_id").cast("long").alias("p"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    few = few_by_hash(pages.select("p"), "p", sample)
    one = pages.join(F.broadcast(few.withColumnRenamed("p", "few")), F.col("p") == F.col("few")).groupBy("p").agg(F.max("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted({w for b in Blocks(html).blocks for w in b[0].split()}), pa.string())], ["word"])

    words = one.select("html").mapInArrow(run, "word string").distinct().withColumn("order", F.xxhash64("word")).orderBy("order", "word").limit(most)
    return sorted(r.word for r in words.collect()) or list(_WORN)


def trained(pages: DataFrame, sample: int = SAMPLE, made: int = 800) -> Labeller:
    return fit(training_pages(corpus_words(pages, sample), made))


def extract_html(model: Labeller, pages: list[str]) -> list[str]:
    blocks = [Blocks(h or "").blocks for h in pages]
    labels = label(model, [vectors(b) for b in blocks])
    return ["\n".join(b[0] for b, keep in zip(own, kept, strict=True) if keep) for own, kept in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                texts = extract_html(sent.value, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
