"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page.

:func:`blocks` turns a page into its sequence of leaf blocks: the text between two block-level tags, with the path
of open elements. Each block becomes a vector: hashed tokens of the tag path (element names, words of class, id
and role), hashed words of the whole text, and a few measures. The LSTM reads the sequence in both directions, so
each label depends on the whole page. Everything is numpy; a batch of pages is run in step, longest first, and rows
are not padded, so memory follows the number of blocks however unequal the pages are.

The model is fitted on the driver on about ``SAMPLE_PAGES`` pages, twice as many at most (a bounded sample by a
hash of the page's key). Blocks of those with at most ``SAMPLE_BLOCKS`` blocks are labelled by the page's own semantic
elements; the texts of all of them are dealt anew into ``TRAINING_PAGES``
layouts with other elements, class names and orders, so that the model reads layout and context rather than one
template. Fitting is deterministic. All pages are labelled, each by its whole html, in one pass without a shuffle.

Defined cases: null or empty html gives empty text; text without any tag is one block; broken or unclosed markup is
read as browsers do for paragraphs and lists, and what is open at the end is closed; repeated rows and null
page_id are labelled like others; an empty table gives an empty result (the model is then fitted on invented
words); extra columns are ignored. A very long page is labelled whole, in a batch of its own. Ties: a block whose score
is exactly 0.5 does not belong to the main text.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_PAGES = 200
SAMPLE_BLOCKS = 200  # sampled pages with more blocks lend their texts to the layouts, but are not fitted on themselves
GATE_ROWS = 4096  # blocks whose gate inputs are held at a time
TRAINING_PAGES = 900
EPOCHS = 5
HIDDEN, PATH_DIM, WORD_DIM = 16, 16, 8
PATH_BUCKETS, WORD_BUCKETS = 2048, 512
MEASURES = 8

# Element kinds of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title head".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
               "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead".split())
MARKUP = frozenset("template svg math object canvas audio video select".split())  # raw elements that hold markup, hence comments
MAIN_ELEMENTS = frozenset(("article", "main"))
OTHER_ELEMENTS = frozenset("nav header footer aside form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")


def _end_of(name: str, source: str, at: int) -> re.Match | None:
    """The end tag of a raw element. What stands before it is not markup: a '<' or an open '<!--' there starts nothing."""
    end = f"</({name})(?:[\\s/][^>]*)?>"
    if name not in MARKUP:
        return re.compile(end, re.I).search(source, at)
    return next((m for m in re.compile(f"<!--(?:(?!<!--).)*?-->|{end}", re.I | re.S).finditer(source, at) if m[1]), None)


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    if "=" not in attributes:
        return ()
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        out += [x.lower() for x in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


class Page:
    """Leaf blocks of a page: texts, paths (tuples of (element, names)), share of link text."""

    __slots__ = ("texts", "paths", "links")

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.paths: list[tuple] = []
        self.links: list[float] = []


def blocks(source: str) -> Page:
    page, stack, held, path, linked, total = Page(), [], [], (), 0, 0
    at, in_link = 0, 0

    def flush() -> None:
        nonlocal held, linked, total
        if held:
            text = _SPACES.sub(" ", html.unescape("".join(held))).strip(" ")
            if text:
                page.texts.append(text)
                page.paths.append(path)
                page.links.append(linked / max(1, total))
            held, linked, total = [], 0, 0

    def add(text: str) -> None:
        nonlocal path, linked, total
        if not held:
            if not text.strip():
                return
            path = tuple(e for e in stack if e[0] not in INLINE)
        held.append(text)
        total += len(text)
        linked += len(text) if in_link else 0

    def close(name: str) -> None:
        nonlocal in_link
        while stack:
            e = stack.pop()
            in_link -= e[0] == "a"
            if e[0] == name:
                return

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if any(e[0] == name for e in stack):
                close(name)
            continue
        if name in RAW:
            # the elements of a head are raw themselves, and its end tag may be missing
            if name != "head" and not m[3].endswith("/"):
                end = _end_of(name, source, at)
                at = end.end() if end else len(source)
                if end:
                    flush()
            continue
        if name in INLINE:
            if name == "br":
                add(" ") if held else None
            elif name not in VOID and not m[3].endswith("/"):
                stack.append((name, ()))
                in_link += name == "a"
            continue
        flush()
        if name in CLOSES_P and any(e[0] == "p" for e in stack):
            close("p")
        for other in SAME_CLOSES.get(name, ()):
            for e in reversed(stack):
                if e[0] in SCOPES:
                    break
                if e[0] == other:
                    close(other)
                    break
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, _names(m[3])))
    if at < len(source):
        add(source[at:])
    flush()
    return page


# -- vectors ----------------------------------------------------------------------------------

def _path_ids(path: tuple) -> list[int]:
    tokens = []
    for element, names in path:
        tokens.append(element)
        for n in names:
            tokens += [f".{n}", f"~{n[:5]}"]
    tokens.append(f"leaf {path[-1][0]}" if path else "leaf")
    return [zlib.crc32(t.encode()) % PATH_BUCKETS for t in tokens]


def _measures(page: Page) -> np.ndarray:
    n = len(page.texts)
    out = np.zeros((n, MEASURES), np.float32)
    for i, (text, path) in enumerate(zip(page.texts, page.paths, strict=True)):
        blanks = text.count(" ")
        leaf = path[-1][0] if path else ""
        out[i] = (np.log1p(len(text)) / 6, np.log1p(blanks) / 5, page.links[i], text[-1] in ".!?\"'»”", leaf[:1] == "h" and leaf[1:].isdigit(),
                  leaf == "li", len(path) / 8, i / n)
    return out


def word_means(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean vector of each text's hashed words; the buckets and the text of every word."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    edges = np.diff((data > 32).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    buckets = (C.range_hashes(C.prefix_sums(data), starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])[starts]
    counts = np.bincount(lines, minlength=len(texts))
    sums = np.zeros((len(texts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        sums[full] = np.add.reduceat(table[buckets], np.cumsum(counts[full]) - counts[full], axis=0)
    return sums / np.maximum(1, counts)[:, None].astype(np.float32), buckets, lines


# -- the network --------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    dim = PATH_DIM + WORD_DIM + MEASURES
    model = {"path": np.zeros((PATH_BUCKETS, PATH_DIM)), "word": np.zeros((WORD_BUCKETS, WORD_DIM)), "wo": r.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1)}
    for d in "fb":
        model |= {f"x{d}": r.normal(0, dim**-0.5, (dim, 4 * HIDDEN)), f"h{d}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.zeros(4 * HIDDEN)}
        model[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    return {k: v.astype(np.float32) for k, v in model.items()}


def _gates(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s = _sigmoid(z[:, : 3 * HIDDEN])
    return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])


def _run(x: np.ndarray, wx: np.ndarray, bias: np.ndarray, wh: np.ndarray, counts: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after every step. Rows of ``x`` and of the result stand step by step, ``counts[t]`` pages in step t; a
    page that goes on keeps its place in the step. The inputs of the gates are made for some steps at a time."""
    pages = int(counts[0]) if len(counts) else 0
    out, h, c = np.zeros((len(x), HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    at, z, made = 0, None, (0, 0)
    for n in counts.tolist():
        if at + n > made[1]:
            made = (at, max(at + n, at + GATE_ROWS))
            z = x[made[0] : made[1]] @ wx + bias
        i, f, o, g = _gates(z[at - made[0] : at - made[0] + n] + h[:n] @ wh)
        before = c[:n].copy() if keep is not None else None
        c[:n] = f * c[:n] + i * g
        tanh = np.tanh(c[:n])
        if keep is not None:
            keep.append((i, f, o, g, before, tanh, h[:n].copy()))
        h[:n] = o * tanh
        out[at : at + n] = h[:n]
        at += n
    return out


def _back(keep: list, dout: np.ndarray, wh: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the recurrent weights."""
    pages, at = int(counts[0]) if len(counts) else 0, len(dout)
    dz, dwh = np.zeros((len(dout), 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(len(counts) - 1, -1, -1):
        n = int(counts[t])
        at -= n
        i, f, o, g, before, tanh, h = keep[t]
        d = dh[:n] + dout[at : at + n]
        dcell = dc[:n] + d * o * (1 - tanh * tanh)
        own = dz[at : at + n]
        own[:] = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), d * tanh * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
        dwh += h.T @ own
        dh[:n] = own @ wh.T
        dc[:n] = dcell * f
    return dz, dwh


class Batch:
    """Pages side by side, without padding: one row of features a block, whatever the lengths of the pages.

    Rows stand page by page. ``place`` says where each stands when all pages are read in step, forwards or backwards:
    pages are in descending order of length, so those that still have a block in a step are its first ``counts[t]``."""

    def __init__(self, pages: list[Page], path_table: np.ndarray, word_table: np.ndarray, cache: dict | None = None):
        self.order = sorted(range(len(pages)), key=lambda k: -len(pages[k].texts))
        pages = [pages[k] for k in self.order]
        self.lengths = np.array([len(p.texts) for p in pages])
        steps, self.total = int(self.lengths[0]) if pages else 0, int(self.lengths.sum())
        step = np.concatenate([np.arange(n) for n in self.lengths]) if self.total else np.zeros(0, np.int64)
        page = np.repeat(np.arange(len(pages)), self.lengths)
        self.counts = np.searchsorted(-self.lengths, -np.arange(steps), side="left")  # pages with more than t blocks
        begin = np.cumsum(self.counts) - self.counts
        self.place = {"f": begin[step] + page, "b": begin[self.lengths[page] - 1 - step] + page} if self.total else {"f": step, "b": step}
        self.paths = [path for p in pages for path in p.paths]
        vectors, self.buckets, self.owner = word_means([t for p in pages for t in p.texts], word_table)
        ids: dict = {} if cache is None else cache
        rows = []
        for path in self.paths:
            v = ids.get(path)
            if v is None:
                if len(ids) > 100_000:
                    ids.clear()
                k = _path_ids(path)
                v = ids[path] = path_table[k].sum(axis=0) / np.sqrt(len(k))
            rows.append(v)
        flat = np.concatenate([np.array(rows, np.float32).reshape(-1, PATH_DIM), vectors,
                               np.concatenate([_measures(p) for p in pages]) if pages else np.zeros((0, MEASURES), np.float32)], axis=1)
        self.x = flat

    def in_step(self, flat: np.ndarray, side: str) -> np.ndarray:
        """Rows of the pages in the order in which a side of the network reads them."""
        out = np.empty_like(flat)
        out[self.place[side]] = flat
        return out

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        """Per page, in the order given."""
        out: list = [None] * len(self.order)
        for k, part in zip(self.order, np.split(flat, np.cumsum(self.lengths)[:-1]), strict=True):
            out[k] = part
        return out


def scores(model: dict, batch: Batch, keep: dict | None = None) -> np.ndarray:
    """Probability of main text for every block (in the batch's order)."""
    states = []
    for side in "fb":
        x, kept = batch.in_step(batch.x, side), None if keep is None else []
        h = _run(x, model[f"x{side}"], model[f"b{side}"], model[f"h{side}"], batch.counts, kept)
        if keep is not None:
            keep[side] = (x, kept)
        states.append(h[batch.place[side]])
    h = np.concatenate(states, axis=1)
    if keep is not None:
        keep["h"] = h
    return _sigmoid(h @ model["wo"] + model["bo"])


def gradients(model: dict, batch: Batch, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    keep: dict = {}
    p = scores(model, batch, keep)
    loss = float(-np.mean(np.where(labels > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    d = ((p - labels) / max(1, len(labels))).astype(np.float32)
    out = {"wo": keep["h"].T @ d, "bo": d.sum(keepdims=True)}
    dh = (d[:, None] * model["wo"]).astype(np.float32)
    flat = np.zeros_like(batch.x)
    for k, side in enumerate("fb"):
        x, kept = keep[side]
        dz, out[f"h{side}"] = _back(kept, batch.in_step(dh[:, k * HIDDEN : (k + 1) * HIDDEN], side), model[f"h{side}"], batch.counts)
        out[f"x{side}"] = x.T @ dz
        out[f"b{side}"] = dz.sum(axis=0)
        flat += (dz @ model[f"x{side}"].T)[batch.place[side]]
    out["path"], out["word"] = np.zeros_like(model["path"]), np.zeros_like(model["word"])
    for path, g in zip(batch.paths, flat[:, :PATH_DIM], strict=True):
        ids = _path_ids(path)
        np.add.at(out["path"], ids, g / np.sqrt(len(ids)))
    counts = np.maximum(1, np.bincount(batch.owner, minlength=batch.total))
    np.add.at(out["word"], batch.buckets, flat[batch.owner, PATH_DIM : PATH_DIM + WORD_DIM] / counts[batch.owner][:, None])
    return loss, out


def fit(examples: list[tuple[Page, np.ndarray]], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam on mini-batches of pages."""
    model, r = new_model(seed), random.Random(seed)
    m, v, t = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2)), None, 0
    m, v = m
    examples = [e for e in examples if e[0].texts]
    for epoch in range(epochs):
        r.shuffle(examples)
        for first in range(0, len(examples), 16):
            chunk = examples[first : first + 16]
            batch = Batch([p for p, _ in chunk], model["path"], model["word"])
            labels = np.concatenate([chunk[k][1] for k in batch.order]).astype(np.float32)
            _, grads = gradients(model, batch, labels)
            t += 1
            step = rate * (0.4 if epoch >= epochs - 2 else 1)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model[k] = (model[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


# -- training pages -------------------------------------------------------------------------------

#: Elements and class names that layouts are dealt from, by what they hold.
MAIN = ["article", "main", "div.article", "div.article-body", "div.post-content", "div.post", "div.entry-content", "section.story", "div#content",
        "div.main-text", "div.text", "td.content", "div.body-copy", "div#main", "section.page-content", "div"]
OTHERS = {
    "header": ["header", "div.header", "div#masthead", "div.site-header", "div.top-bar", "div.logo", "header.page-header", "div.site-title"],
    "menu": ["nav", "div.menu", "ul.nav", "div.navigation", "div.breadcrumbs", "ul.menu", "div.navbar", "nav.pagination", "div.tags", "ul.social", "div.share"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div.ad-banner", "div.sponsor", "section.promotion",
               "div.adBox", "div.ad-slot", "div.commercial"],
    "notice": ["div.cookie", "div.cookie-banner", "div.notice", "div.consent", "div.alert", "div.gdpr", "div.modal", "div.popup", "div.privacy-notice",
               "div.overlay", "section.notice", "div.disclaimer", "div.warning", "div.paywall"],
    "sidebar": ["aside", "div.sidebar", "div.side", "div.widget", "div.related", "div.right-rail", "div.recommended", "section.trending", "aside.more",
                "div.popular", "div#sidebar", "section.related-posts", "div.teaser"],
    "form": ["form", "form.search", "form.newsletter", "div.subscribe", "form.login", "form.signup", "fieldset", "form.contact", "div.newsletter"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "div.responses", "div.discussion", "div.replies",
                 "div.reader-comments", "section.feedback", "div.comment-list", "div.user-comment", "article.comment", "section#comments", "ul.comments"],
    "footer": ["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.bottom", "div.legal", "footer.page-footer"],
}


def _open(kind: str, label: str) -> tuple[str, str]:
    element, mark, name = re.match(r"(\w+)([.#]?)(.*)", kind).groups()
    if mark == "#":
        return f'<{element} id="{name}" class="label-{label}">', f"</{element}>"
    return f'<{element} class="{(name + " " if mark else "")}label-{label}">', f"</{element}>"


def _invented(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("ba", "re", "ti", "on", "sa", "lu", "ner", "o")) for _ in range(r.randint(1, 4))) for _ in range(n))


def layout(r: random.Random, texts: list[str]) -> str:
    """A page with labelled parts. Texts of any part come from the same pool, so that words alone tell little."""

    def words(low: int, high: int) -> str:
        n = r.randint(low, high)
        pool = r.choice(texts).split() if texts else []
        if len(pool) < 2:
            return _invented(r, n)
        first = r.randrange(len(pool))
        return html.escape(" ".join((pool[first:] + pool[:first])[:n]), quote=r.random() < 0.5)

    def sentence(low: int, high: int) -> str:
        return f"{words(low, high)}{r.choice(('.', '.', '!', ''))}"

    def links(n: int) -> str:
        items = [f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(n)]
        return f"<ul>{''.join(items)}</ul>" if r.random() < 0.8 else " ".join(f'<a href="/x">{words(1, 4)}</a>' for _ in range(n))

    def other(kind: str) -> str:
        a, b = _open(r.choice(OTHERS[kind]), "rest")
        if kind == "menu":
            body = links(r.randint(1, 9))
        elif kind == "header":
            body = r.choice((f"<h1>{words(1, 4)}</h1><p>{sentence(2, 9)}</p>", f"<h2>{words(1, 3)}</h2>", words(1, 6), links(4)))
        elif kind == "footer":
            body = r.choice((f"&copy; {words(1, 3)} &middot; {sentence(3, 14)}", f"<p>{sentence(4, 40)}</p>", links(r.randint(1, 6)), f"<p>&copy; {words(1, 5)}</p>{links(3)}"))
        elif kind == "form":
            body = f"<label>{words(1, 5)}</label><input name=q><p>{sentence(3, 25)}</p><button>{words(1, 2)}</button>"
        elif kind == "comments":
            body = "".join(f"<{t}>{r.choice(('', f'<b>{words(1, 2)}</b> '))}{sentence(3, 70)}</{t}>" for t in [r.choice(("p", "li", "div"))] * r.randint(1, 6))
            body = (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.6 else "") + body
        elif kind == "sidebar":
            body = r.choice((f"<h3>{words(1, 3)}</h3>{links(r.randint(1, 6))}", f"<p>{sentence(4, 60)}</p>", f"<h4>{words(1, 4)}</h4><p>{sentence(5, 40)}</p>"))
        else:
            body = r.choice((sentence(3, 40), f"<p>{sentence(3, 60)}</p>", f"<p>{sentence(3, 20)}</p><a href=/x>{words(1, 3)}</a>"))
        return a + body + b

    def part() -> str:
        x = r.random()
        if x < 0.75:
            return r.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<div>{}</div>")).format(sentence(1, 120))
        if x < 0.83:
            return f"<h{r.randint(2, 4)}>{words(1, 9)}</h{2}>"
        if x < 0.9:
            return "<ul>" + "".join(f"<li>{sentence(1, 25)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if x < 0.95:
            return f"<blockquote>{sentence(5, 50)}</blockquote>"
        return f"<p>{words(1, 20)} <a href=/x>{words(1, 4)}</a> {sentence(1, 20)}</p>"

    before = [k for k in ("header", "menu", "notice", "advert", "menu", "sidebar", "form") if r.random() < 0.35]
    after = [k for k in ("sidebar", "advert", "comments", "form", "menu", "notice", "footer") if r.random() < 0.45]
    if r.random() < 0.3:
        r.shuffle(before)
    a, b = _open(r.choice(MAIN[:2] if r.random() < 0.5 else MAIN), "main")
    title = r.choice(("", f"<h1>{words(2, 12)}</h1>", f"<h1>{words(2, 12)}</h1>", f"<header><h1>{words(2, 12)}</h1></header>"))
    body = [title, *(part() for _ in range(r.choice((1, 2, 4, 8, 14, 25))))]
    for kind in ("advert", "sidebar", "menu", "form", "comments", "notice"):  # parts that stand inside the article
        if r.random() < 0.12:
            body.insert(len(body) if kind == "comments" else r.randint(1, len(body)), other(kind))
    page = "".join([*(other(k) for k in before), a, *body, b, *(other(k) for k in after)])
    if r.random() < 0.4:
        page = f'<div class="{r.choice(("wrapper", "container", "page", "layout", "row"))}">{page}</div>'
    return f"<html><body>{page}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    """Labels that a layout carries: the innermost one decides. They are taken off the paths."""
    out, bare = [], []
    for path in page.paths:
        marks = [names[-1] for _, names in path if "label" in names]
        out.append(bool(marks) and marks[-1] == "main")
        bare.append(tuple((e, names[: names.index("label")] if "label" in names else names) for e, names in path))
    page.paths = bare
    return np.array(out, np.float32)


def own_labels(page: Page) -> np.ndarray | None:
    """Labels by a page's own semantic elements; None if it has no article."""
    names = [{e for e, _ in path} for path in page.paths]
    if not any(n & MAIN_ELEMENTS for n in names):
        return None
    return np.array([bool(n & MAIN_ELEMENTS) and not n & OTHER_ELEMENTS for n in names], np.float32)


def train(sources: list[str], pages: int = TRAINING_PAGES, seed: int = 7) -> dict[str, np.ndarray]:
    """Fits the model on sampled pages and on layouts made of their texts."""
    r, own = random.Random(seed), []
    sampled = [blocks(s) for s in sources]
    texts = [t for p in sampled for t in p.texts]
    for p in sampled:
        y = own_labels(p)
        if y is not None and len(p.texts) <= SAMPLE_BLOCKS:
            own.append((p, y))
    made = []
    for _ in range(pages):
        p = blocks(layout(r, texts))
        made.append((p, labels_of(p)))
    return fit(made + own, seed=seed)


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (the main blocks, one a line), n_blocks, n_main."""
    # a share of the pages by a hash of their key: what reaches the driver does not grow with pages or tasks
    total = max(1, pages.count())
    draw = F.xxhash64("page_id", "url").bitwiseAND(F.lit((1 << 52) - 1))
    sample = pages.where("html IS NOT NULL").where(draw < int(min(1.0, sample_pages / total) * (1 << 52))).select("html", draw.alias("_draw"))
    rows = sorted(sample.limit(2 * sample_pages).collect(), key=lambda r: (r["_draw"], r["html"]))
    held = pages.sparkSession.sparkContext.broadcast(train([row["html"] for row in rows]))
    return pages.select("page_id", "url", "html").mapInArrow(_labeller(held), _schema(pages))


def _schema(pages: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return f"page_id {kind['page_id']}, url {kind['url']}, text string, n_blocks bigint, n_main bigint"


def _labeller(held):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = held.value, {}
        for batch in batches:
            for part in C.slices(batch, "html", 1 << 20):
                parsed = [blocks(s or "") for s in part.column("html").to_pylist()]
                full = [p for p in parsed if p.texts]
                b = Batch(full, model["path"], model["word"], cache)
                marks = iter(b.split(scores(model, b) > 0.5) if full else ())
                kept = [[t for t, k in zip(p.texts, next(marks).tolist(), strict=True) if k] if p.texts else [] for p in parsed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(["\n".join(k) for k in kept], pa.string()),
                     pa.array([len(p.texts) for p in parsed], pa.int64()), pa.array([len(k) for k in kept], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_main"])

    return label
