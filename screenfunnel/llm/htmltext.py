"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its text blocks. A bidirectional LSTM in numpy reads each block's hashed tag path and words, forward
and backward, so a block is judged within the whole page, and labels it main text or not. It is trained on pages that a
generator makes, with labels that follow from how they are made: article parts in many containers, and menus, headers,
footers, sidebars, notices, adverts, forms and reader comments around and inside them. Pages are read and labelled row by row
in the tasks; long pages are sequences like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.blocks import SIZE, read_blocks, vectors

#: Generated pages to train on, passes over them, and units of each direction.
TRAIN_PAGES, EPOCHS, UNITS = 900, 10, 24

Params = dict[str, np.ndarray]
CONTENT = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "section#main", "div.story", "div#content", "div.text", "td.main"]
OUTSIDE = {
    "nav": ["nav", "div.menu", "ul.nav", "div#navigation", "div.breadcrumb", "div.pagination", "ul.menu", "div.navbar", "div.toc"],
    "header": ["header", "div#header", "div.masthead", "div.site-header", "div.topbar", "div.logo", "div.banner"],
    "footer": ["footer", "div#footer", "div.footer", "div.site-footer", "div.copyright", "div.bottom", "div.legal"],
    "aside": ["aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "div.recommended", "section.more", "div.rail", "div.teaser"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.ad-banner", "section.ad", "p.ad", "div#ad-1"],
    "notice": ["div.cookie", "div.notice", "div.consent", "div#cookie-banner", "div.alert", "div.newsletter", "div.popup", "div.modal", "div.gdpr", "dialog", "p.notice", "div.disclaimer", "div.subscribe"],
    "form": ["form", "form.search", "div.login", "form#contact", "fieldset", "form.signup", "div.search"],
    "comments": ["div.comments", "section#comments", "div#comments", "ol.commentlist", "div.comment", "div.replies", "section.discussion", "div.respond", "ul.comments", "div.reader-comments", "section.comments", "article.comment"],
    "social": ["div.share", "div.social", "ul.share-buttons", "div.follow", "div.tags"],
}
NEUTRAL = ["div", "div.wrapper", "div.container", "div.row", "div.col", "section", "div.page", "div#root", "div.inner", "div.site", "div.layout", "center", "div.x1"]


class _Maker:
    """Random pages; ``parts`` are (html, labels of its blocks)."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = "aeiouaeiouäéñßlrstndmkpbcghvwyz"
        self.syllables = ["".join(self.rng.choice(list(letters), 2)) for _ in range(120)]

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(n)]
        kind = self.rng.random()
        if kind < 0.07:
            made = [w.upper() + "!!" for w in made]
        elif kind < 0.14:
            made = [w + self.pick(["###", "***", "$$$", "%%%"]) for w in made]
        elif kind < 0.2:
            made = [w for x in made for w in (x, "|")]
        elif kind < 0.24:
            made = made[:2] * (n // 2 + 1)
        else:
            made[0] = made[0].capitalize()
            made = [w + ("." if self.chance(0.1) else "," if self.chance(0.08) else "") for w in made]
            if self.chance(0.8):
                made[-1] += "."
        return " ".join(made)

    def wrap(self, spec: str, inner: str, close: bool = True) -> str:
        tag = spec.split(".")[0].split("#")[0]
        attr = f' class="{spec.split(".")[1]}"' if "." in spec else f' id="{spec.split("#")[1]}"' if "#" in spec else ""
        if self.chance(0.15) and not attr:
            attr = f' class="{self.pick(self.syllables)}{self.pick(self.syllables)}"'
        return f"<{tag}{attr}>{inner}" + (f"</{tag}>" if close else "")

    def link(self) -> str:
        return f'<a href="/x">{self.words(1, 3)}</a>'

    def content(self) -> tuple[str, list[int]]:
        kind = self.rng.random()
        size = (1, 6) if self.chance(0.2) else (5, 60) if self.chance(0.8) else (60, 200)
        if kind < 0.1:
            return f"<h{self.rng.integers(1, 4)}>{self.words(2, 10)}</h{self.rng.integers(1, 4)}>", [1]
        if kind < 0.2:
            n = int(self.rng.integers(1, 6))
            items = "".join(f"<li>{self.words(2, 15)}" + ("</li>" if self.chance(0.8) else "") for _ in range(n))
            return self.wrap(self.pick(["ul", "ol"]), items), [1] * n
        if kind < 0.25:
            return self.wrap("blockquote", f"<p>{self.words(5, 30)}</p>"), [1]
        if kind < 0.29:
            return self.wrap("pre", self.words(5, 30)), [1]
        if kind < 0.33:
            n = int(self.rng.integers(2, 6))
            return "<table><tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(n)) + "</tr></table>", [1] * n
        text = self.words(*size)
        if self.chance(0.25):
            text = f"<b>{text}" + ("</b>" if self.chance(0.5) else "<br>")
        if self.chance(0.15):
            text += f" {self.link()} {self.words(1, 8)}"
        return f"<p>{text}" + ("</p>" if self.chance(0.75) else ""), [1]

    def outside(self, kind: str) -> tuple[str, list[int]]:
        spec = self.pick(OUTSIDE[kind])
        listed = spec.split(".")[0] in ("ul", "ol")
        if listed or (kind in ("nav", "social", "footer", "aside", "header") and self.chance(0.6)):
            n = int(self.rng.integers(2, 9))
            items = "".join(f"<li>{self.link() if self.chance(0.8) or kind == 'nav' else self.words(2, 30)}</li>" for _ in range(n))
            return self.wrap(spec, items if listed else f"<ul>{items}</ul>"), [0] * n
        if kind == "form":
            return self.wrap(spec, f"<p><label>{self.words(1, 3)}</label> <input name=q></p><p><button>{self.words(1, 2)}</button></p>"), [0, 0]
        n = int(self.rng.integers(1, 5)) if kind in ("comments", "aside", "notice") else 1
        long = (1, 12) if self.chance(0.4) else (5, 40)
        texts = [self.words(*long) for _ in range(n)]
        if kind == "footer" and self.chance(0.6):
            texts[0] = f"&copy; {self.words(1, 2)} &middot; {texts[0]}"
        if n == 1 and self.chance(0.6):
            return self.wrap(spec, texts[0]), [0]
        inner = self.pick(["p", "div", "div.comment" if kind == "comments" else "div", "p"])
        return self.wrap(spec, "".join(self.wrap(inner, t) for t in texts)), [0] * n

    def page(self) -> tuple[str, list[int]]:
        title = self.words(2, 8)
        parts: list[tuple[str, list[int]]] = [(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>", [0])]
        for kind in ("header", "nav", "ad", "notice", "aside", "form"):
            if self.chance({"nav": 0.8, "ad": 0.5}.get(kind, 0.3)):
                parts.append(self.outside(kind))
        n = int(self.rng.integers(1, 14)) if self.chance(0.9) else int(self.rng.integers(14, 60))
        body = [(f"<h1>{title if self.chance(0.5) else self.words(2, 9)}</h1>", [1])] if self.chance(0.8) else []
        body += [self.content() for _ in range(n)]
        if self.chance(0.35):
            kind = self.pick(["ad", "aside", "social", "form", "notice", "comments", "nav"])
            body.insert(int(self.rng.integers(1, len(body) + 1)), self.outside(kind))
        inner, labels = "".join(h for h, _ in body), [x for _, b in body for x in b]
        spec = self.pick(CONTENT) if self.chance(0.5) else "article"
        if spec.startswith("td"):
            inner = f"<table><tr>{self.wrap(spec, inner)}</tr></table>"
        else:
            inner = self.wrap(spec, inner)
        for _ in range(int(self.rng.integers(0, 3))):
            inner = self.wrap(self.pick(NEUTRAL), inner)
        parts.append((inner, labels))
        for kind in ("social", "comments", "ad", "aside", "nav", "notice", "form", "footer"):
            if self.chance({"footer": 0.85, "comments": 0.35}.get(kind, 0.2)):
                parts.append(self.outside(kind))
        return "".join(h for h, _ in parts) + ("</body></html>" if self.chance(0.8) else ""), [x for _, b in parts for x in b]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages."""
    maker, out = _Maker(seed), []
    while len(out) < n:
        html, labels = maker.page()
        blocks = read_blocks(html)
        if len(blocks) == len(labels):
            out.append((vectors(blocks), np.array(labels, np.float32)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(units: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {"out": (rng.normal(size=2 * units) / np.sqrt(2 * units)).astype(np.float32), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p[f"wx{d}"] = (rng.normal(size=(SIZE, 4 * units)) * 0.08).astype(np.float32)
        p[f"wh{d}"] = (rng.normal(size=(units, 4 * units)) / np.sqrt(units)).astype(np.float32)
        p[f"b{d}"] = np.zeros(4 * units, np.float32)
        p[f"b{d}"][units : 2 * units] = 1
    return p


def _run(p: Params, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    """One direction over pages (page, block, value); masked blocks leave the state as it is."""
    units = p[f"wh{d}"].shape[0]
    pages, length, _ = x.shape
    z = x @ p[f"wx{d}"] + p[f"b{d}"]
    h = c = np.zeros((pages, units), np.float32)
    out, tape = np.zeros((pages, length, units), np.float32), []
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        a = z[:, t] + h @ p[f"wh{d}"]
        i, f, o = (_sigmoid(a[:, k * units : (k + 1) * units]) for k in range(3))
        g, m = np.tanh(a[:, 3 * units :]), mask[:, t, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        tape.append((t, i, f, o, g, c, tc, h, m))
        c, h = m * c2 + (1 - m) * c, m * (o * tc) + (1 - m) * h
        out[:, t] = h
    return out, tape


def predict(p: Params, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate([_run(p, x, mask, "f")[0], _run(p, x, mask, "b")[0]], axis=2)
    return _sigmoid(both @ p["out"] + p["bias"])


def _step(p: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> Params:
    """Gradients of the mean cross-entropy by backpropagation through time."""
    runs = {d: _run(p, x, mask, d) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    err = (_sigmoid(both @ p["out"] + p["bias"]) - y) * mask / mask.sum()
    grads: Params = {"out": np.einsum("pt,ptu->u", err, both), "bias": np.array([err.sum()], np.float32)}
    units = p["whf"].shape[0]
    for d, part in (("f", p["out"][:units]), ("b", p["out"][units:])):
        dz = np.zeros((*x.shape[:2], 4 * units), np.float32)
        gwh = np.zeros_like(p[f"wh{d}"])
        dh = dc = np.zeros((x.shape[0], units), np.float32)
        for t, i, f, o, g, c, tc, h, m in reversed(runs[d][1]):
            dh = dh + err[:, t, None] * part
            live = dh * m
            dct = dc * m + live * o * (1 - tc * tc)
            da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            dz[:, t] = da
            gwh += h.T @ da
            dh, dc = da @ p[f"wh{d}"].T + dh * (1 - m), dct * f + dc * (1 - m)
        flat = dz.reshape(-1, 4 * units)
        grads |= {f"wx{d}": x.reshape(-1, SIZE).T @ flat, f"wh{d}": gwh, f"b{d}": flat.sum(axis=0)}
    return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, pages))
    x, mask = np.zeros((len(pages), length, pages[0].shape[1]), np.float32), np.zeros((len(pages), length), np.float32)
    for k, v in enumerate(pages):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, units: int = UNITS, seed: int = 7) -> Params:
    """The labeller, fitted with Adam on ``pages`` generated pages; the same on every call."""
    data = sorted(labelled_pages(pages, seed), key=lambda d: len(d[1]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    batches = []
    for g in groups:
        x, mask = _padded([v for v, _ in g])
        y = np.zeros_like(mask)
        for k, (_, labels) in enumerate(g):
            y[k, : len(labels)] = labels
        batches.append((x, mask, y))
    p, rng = _start(units, seed), np.random.default_rng(seed)
    mean, square, n = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs) + 0.0005
        for k in rng.permutation(len(batches)):
            n += 1
            for name, g in _step(p, *batches[k]).items():
                g = g + 1e-5 * p[name]
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                p[name] = p[name] - rate * (mean[name] / (1 - 0.9**n)) / (np.sqrt(square[name] / (1 - 0.999**n)) + 1e-8)
    return p


def label_pages(p: Params, pages: list[list], most: int = 60_000) -> list[np.ndarray]:
    """Chance of main text for each block of each page; pages of like length run together, ``most`` blocks at a time."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < len(order) and n < 256 and (n + 1) * len(pages[order[n]]) <= most:
            n += 1
        now, order = order[:n], order[n:]
        x, mask = _padded([vectors(pages[k]) for k in now])
        for k, row in zip(now, predict(p, x, mask)):
            out[k] = row[: len(pages[k])]
    return out


def extract(p: Params, htmls: list[str]) -> list[list[tuple[str, float]]]:
    """Blocks and chances of pages."""
    pages = [read_blocks(h) for h in htmls]
    return [[(b.text, float(c)) for b, c in zip(blocks, chances)] for blocks, chances in zip(pages, label_pages(p, pages))]


def _extracted(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = extract(p, [h or "" for h in part.column(2).to_pylist()])
                texts = ["\n".join(t for t, c in page if c > 0.5) for page in pages]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def main_text(df: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text (blocks labelled main text, joined by line breaks; empty if none), n_chars in code points.

    One row per row, whatever repeats; a null or empty page has an empty text; null ids and addresses stay null; an empty
    table gives no rows; other columns play no part.
    """
    narrow = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
