"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, each with the tags and
class words on the path down to it. Every block is read as a vector of hashed path entries, hashed words and a few
measures; a bidirectional LSTM runs over the whole sequence, so that a block's label rests on the blocks before
and after it, and the blocks labelled as content are joined. The network is numpy only and is trained
on pages that ``sample_pages`` makes up (their layouts, class names and notices), the same ones each time.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices

# --- pages to blocks ----------------------------------------------------------------------

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>?", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = {"script", "style", "noscript", "template", "textarea", "select", "button", "title", "svg", "math", "iframe", "object", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag that ends an open one of these, up to the nearest border.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDER = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "td"}


class Open:
    """An open element on its parents: what a block needs of all of them is carried along, so that no block looks at the whole stack."""

    __slots__ = ("tag", "entries", "parent", "buckets", "count")

    def __init__(self, tag: str, entries: tuple[str, ...], parent: Open | None):
        self.tag, self.entries, self.parent = tag, entries, parent
        self.buckets, self.count = (parent.buckets, parent.count) if parent is not None else (0, 0)  # a bit for each bucket
        for e in entries:
            self.buckets |= 1 << PATH_AT[e]
        self.count += len(entries)


@dataclass
class Block:
    where: Open | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """All entries of the open elements, outermost first."""
        out, at = [], self.where
        while at is not None:
            out.append(at.entries)
            at = at.parent
        return tuple(e for es in reversed(out) for e in es)


class Stack:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, entries: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(Open(tag, entries, self.top))

    @property
    def top(self) -> Open | None:
        return self.open[-1] if self.open else None

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def closes(self, tag: str) -> None:
        """An end tag ends the innermost element of its name, and those in it."""
        if (k := self.last((tag,))) >= 0:
            self.cut(k)

    def makes_way(self, tag: str) -> None:
        """A block's opening tag ends a paragraph, and what ``ENDS`` names, up to the nearest border: the innermost, of table cells all."""
        ended = ENDS.get(tag, set()) | (set() if tag in VOID else {"p"})
        border = -1 if tag == "tr" else self.last(BORDER - ended)
        if tag in ("tr", "td", "th"):
            at = [places[k] for n in ended if (places := self.places.get(n)) and (k := bisect_right(places, border)) < len(places)]
            if at:
                self.cut(min(at))
        elif (k := self.last(ended)) > border:
            self.cut(k)

    @property
    def links(self) -> bool:
        return bool(self.places.get("a"))


class Closers(dict):
    """Where the end tags of a name start and end in a page, looked for once a name."""

    def __init__(self, page: str):
        super().__init__()
        self.page = page

    def __missing__(self, tag: str) -> tuple[list[int], list[int]]:
        found = [m.span() for m in re.finditer(rf"</{re.escape(tag)}\s*>?", self.page, re.I)]
        self[tag] = out = ([a for a, _ in found], [b for _, b in found])
        return out

    def after(self, tag: str, at: int) -> int | None:
        starts, ends = self[tag]
        k = bisect_left(starts, at)
        return ends[k] if k < len(starts) else None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; white space in each is one space, character references are decoded. Time and memory grow with the page's
    length alone, however deep its elements are and whether they are closed or not."""
    out: list[Block] = []
    stack = Stack()
    pieces: list[str] = []
    where: Open | None = None
    linked, blank = 0, True
    page = page or ""
    closers = Closers(page)
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked, blank
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                out.append(Block(where, text, linked))
            pieces, linked, blank = [], 0, True

    def add(text: str) -> None:
        nonlocal where, linked, blank
        if text:
            if blank:
                where, blank = stack.top, not text.strip()
            pieces.append(text)
            if stack.links:
                linked += len(text)

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag not in INLINE:
                flush()
            stack.closes(tag)
            continue
        if tag in HIDDEN:
            if not found[0].endswith("/>"):
                close = closers.after(tag, at)
                at = close if close is not None else (end if tag in ("script", "style", "textarea", "title", "template") else at)
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            stack.makes_way(tag)
        if tag in VOID or found[0].endswith("/>"):
            continue
        entries = (tag,)
        if found[3] and len(found[3]) > 4:
            for m in NAMES.finditer(found[3]):
                entries += tuple("." + w for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w)
        stack.push(tag, entries)
    flush()
    return out


# --- blocks to vectors --------------------------------------------------------------------

PATH, WORDS, EXTRA = 640, 128, 10
WIDTH = PATH + WORDS + EXTRA


class Hashed(dict):
    """Word to its bucket; short words are remembered, up to 200000."""

    def __init__(self, base: int, buckets: int):
        super().__init__()
        self.base, self.buckets = base, buckets

    def __missing__(self, key: str) -> int:
        if len(key) > 64:
            return self.base + zlib.crc32(key.encode("utf8", "surrogatepass")) % self.buckets
        if len(self) > 200_000:
            self.clear()
        self[key] = n = self.base + zlib.crc32(key.encode("utf8", "surrogatepass")) % self.buckets
        return n


PATH_AT, WORD_AT = Hashed(0, PATH), Hashed(PATH, WORDS)


def vectors(sequence: list[Block]) -> np.ndarray:
    """A row for each block: path entries and words by bucket (the words as shares), and measures."""
    n = len(sequence)
    x = np.zeros((n, WIDTH), np.float32)
    for i, b in enumerate(sequence):
        if b.where is not None:
            x[i, :PATH] = np.unpackbits(np.frombuffer(b.where.buckets.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        words = b.text.lower().split()
        at = np.fromiter(map(WORD_AT.__getitem__, words), np.int64, len(words))
        np.add.at(x[i], at, np.float32(1 / len(words) ** 0.5))
        size = len(b.text)
        x[i, -EXTRA:] = (
            min(np.log1p(size) / 6, 2), min(len(words) / 40, 2), min(b.linked / size, 1), sum(map(b.text.count, ".,;!?")) / len(words),
            b.text[-1] in ".!?…:", min((b.where.count if b.where is not None else 0) / 12, 4), i / n, (n - 1 - i) / n, size < 25, 1,
        )
    return x


# --- the network --------------------------------------------------------------------------

UNITS, INNER = 20, 32


@dataclass
class Labeller:
    """Input layer, an LSTM in each direction, output layer."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        shapes = {"in": (WIDTH, INNER), "inb": (INNER,), "out": (2 * UNITS + INNER,), "outb": ()}
        for d in "fb":
            shapes |= {d + "x": (INNER, 4 * UNITS), d + "h": (UNITS, 4 * UNITS), d + "b": (4 * UNITS,)}
        w = {k: (rng.standard_normal(s) / max(1, s[0] if len(s) > 1 else 8) ** 0.5 if k[-1] != "b" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        w["in"] = (rng.standard_normal((WIDTH, INNER)) * 0.3).astype(np.float32)
        w["outb"] = np.float32(0)
        for d in "fb":
            w[d + "b"] = np.zeros(4 * UNITS, np.float32)
            w[d + "b"][UNITS : 2 * UNITS] = 1  # remember at first
        return cls(w)

    def _run(self, z: np.ndarray, d: str, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, batch, units) of one direction over z (time, batch, 4 units)."""
        n, batch, _ = z.shape
        h, c = np.zeros((batch, UNITS), np.float32), np.zeros((batch, UNITS), np.float32)
        out = np.empty((n, batch, UNITS), np.float32)
        wh = self.w[d + "h"]
        order = range(n) if d == "f" else range(n - 1, -1, -1)
        for t in order:
            a = z[t] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * UNITS], -30, 30)))
            i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
            g = np.tanh(a[:, 3 * UNITS :])
            m = mask[t][:, None]
            before = (h, c)
            c = m * (f * c + i * g)
            tc = np.tanh(c)
            h = m * (o * tc)
            out[t] = h
            if keep is not None:
                keep.append((t, before, i, f, o, g, tc, m))
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (time, batch) of x (time, batch, WIDTH)."""
        e = np.tanh(x @ self.w["in"] + self.w["inb"])
        return self.over(e, mask, keep)

    def over(self, e: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        parts = []
        for d in "fb":
            steps: list | None = None if keep is None else []
            parts.append(self._run(e @ self.w[d + "x"] + self.w[d + "b"], d, mask, steps))
            if keep is not None:
                keep[d] = steps
        top = np.concatenate([*parts, e], axis=2)
        if keep is not None:
            keep |= {"e": e, "top": top}
        return top @ self.w["out"] + self.w["outb"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        s = self.forward(x, mask, keep)
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        ds = (mask * (p - y) / n).astype(np.float32)
        e, top = keep["e"], keep["top"]
        g = {"out": np.einsum("tbk,tb->k", top, ds), "outb": ds.sum()}
        dtop = ds[:, :, None] * self.w["out"]
        de = dtop[:, :, 2 * UNITS :].copy()
        for k, d in enumerate("fb"):
            dout = dtop[:, :, k * UNITS : (k + 1) * UNITS]
            dz = np.zeros((*ds.shape, 4 * UNITS), np.float32)
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            wh = self.w[d + "h"]
            gh = np.zeros_like(wh)
            for t, (h0, c0), i, f, o, gg, tc, m in reversed(keep[d]):
                dh = (dh + dout[t]) * m
                dcc = (dc + dh * o * (1 - tc**2)) * m
                da = np.concatenate([dcc * gg * i * (1 - i), dcc * c0 * f * (1 - f), dh * tc * o * (1 - o), dcc * i * (1 - gg**2)], axis=1)
                dz[t] = da
                gh += h0.T @ da
                dh, dc = da @ wh.T, dcc * f
            g[d + "h"], g[d + "b"] = gh, dz.sum((0, 1))
            g[d + "x"] = np.einsum("tbi,tbj->ij", e, dz)
            de += dz @ self.w[d + "x"].T
        de *= 1 - e**2
        g["inb"] = de.sum((0, 1))
        g["in"] = x.reshape(-1, WIDTH).T @ de.reshape(-1, INNER)
        return loss, g

    def content(self, pages: list[list[Block]], most: int = 12_000) -> list[np.ndarray]:
        """Which blocks of each page are content. Pages of like length run together, about ``most`` blocks at once."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            longest, group = 0, []
            while order and (not group or len(pages[order[0]]) * (len(group) + 1) <= most) and len(group) < 256:
                group.append(order.pop(0))
                longest = len(pages[group[-1]])
            e, mask = np.zeros((longest, len(group), INNER), np.float32), np.zeros((longest, len(group)), np.float32)
            for k, i in enumerate(group):
                for at in range(0, len(pages[i]), 4096):
                    part = pages[i][at : at + 4096]
                    v = vectors(part)
                    if len(part) < len(pages[i]):
                        place = np.arange(at, at + len(part), dtype=np.float32)
                        v[:, -4], v[:, -3] = place / len(pages[i]), (len(pages[i]) - 1 - place) / len(pages[i])
                    e[at : at + len(part), k] = np.tanh(v @ self.w["in"] + self.w["inb"])
                mask[: len(pages[i]), k] = 1
            s = self.over(e, mask)
            for k, i in enumerate(group):
                out[i] = s[: len(pages[i]), k] > 0
        return out


def trained(pages: int = 2200, rounds: int = 9, batch: int = 24, rate: float = 4e-3, seed: int = 11) -> Labeller:
    """A labeller trained on ``pages`` made-up pages with Adam."""
    made = [blocks_and_labels(p) for p in sample_pages(pages, seed)]
    data = [(vectors(b), np.array(y, np.float32)) for b, y in made if b]
    data.sort(key=lambda d: len(d[0]))
    groups = [data[at : at + batch] for at in range(0, len(data), batch)]
    net, rng = Labeller.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step = 0
    for r in range(rounds):
        for gi in rng.permutation(len(groups)):
            group = groups[gi]
            n = max(len(x) for x, _ in group)
            x, mask, y = np.zeros((n, len(group), WIDTH), np.float32), np.zeros((n, len(group)), np.float32), np.zeros((n, len(group)), np.float32)
            for k, (a, b) in enumerate(group):
                x[: len(a), k], mask[: len(a), k], y[: len(b), k] = a, 1, b
            hide = rng.random((n, len(group), PATH)) < 0.12  # class names are not to be relied on
            x[:, :, :PATH] *= ~hide
            _, g = net.gradients(x, mask, y)
            step += 1
            scale = min(1.0, 2.0 / max(1e-9, sum(float((q**2).sum()) for q in g.values()) ** 0.5))
            lr = rate * (0.3 if r >= rounds - 2 else 1.0)
            for k, q in g.items():
                q = q * scale
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q**2
                net.w[k] = (net.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# --- made-up pages ------------------------------------------------------------------------

MARK = "\x02"  # stands before content in made-up pages
CHROME = {
    "nav": ["home", "about", "contact", "news", "products", "shop", "archive", "login", "sign up", "search", "help", "accueil", "inicio", "startseite", "kontakt", "menu"],
    "notice": ["we use cookies to improve your experience", "accept all", "this site uses cookies", "please enable javascript", "subscribe to our newsletter", "wir verwenden cookies", "nous utilisons des cookies"],
    "footer": ["all rights reserved", "copyright", "privacy policy", "terms of use", "imprint", "impressum", "mentions légales", "powered by", "back to top", "©", "follow us"],
    "side": ["related articles", "popular posts", "categories", "tags", "recent comments", "most read", "trending", "archives", "share this", "see also", "advertisement", "sponsored"],
    "comment": ["reply", "report", "leave a comment", "great post", "i disagree", "posted by", "thanks for sharing", "comments", "likes"],
    "form": ["name", "email", "your message", "send", "password", "remember me", "required", "submit"],
}
KINDS = {
    "nav": (["nav", "ul", "div"], ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main menu", "toolbar"]),
    "notice": (["div", "section", "aside", "p"], ["cookie", "cookie banner", "notice", "alert", "consent", "banner", "popup", "message", "gdpr"]),
    "ad": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "adsense", "banner ad", "sponsored"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "rail", "share", "social", "tags", "popular"]),
    "form": (["form"], ["search", "login", "newsletter", "signup", "contact form", "subscribe"]),
    "comment": (["div", "section", "ol", "ul"], ["comments", "comment list", "responses", "discussion", "replies", "disqus", "comment thread"]),
    "footer": (["footer", "div"], ["footer", "site footer", "bottom", "legal", "copyright", "colophon"]),
    "header": (["header", "div"], ["header", "site header", "masthead", "top", "logo", "branding"]),
}


def sample_pages(count: int, seed: int) -> Iterator[str]:
    """Pages with content marked by MARK at the start of each of its blocks."""
    rng = random.Random(seed)
    syllables = "er an the in on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur un ón ß ä è é".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def prose(n: int, stop: bool = True) -> str:
        w = [word() + ("," if rng.random() < 0.06 else "." if rng.random() < 0.05 else "") for _ in range(n)]
        if rng.random() < 0.04:
            w = [x + rng.choice(("***", "%%%", "###", " |", "!!", "$$$", "&amp;&amp;")) for x in w]
        if rng.random() < 0.03:
            w = [x.upper() for x in w]
        if rng.random() < 0.04:
            w = [w[0]] * n if w else w
        if n > 4 and rng.random() < 0.05:  # an article may speak of what notices speak of
            w[: n // 2] = rng.choice([x for k in CHROME.values() for x in k] + ["this work is licensed under the license version 3", "released under the license"]).split()
        text = " ".join(w)
        return text[:1].upper() + text[1:] + ("." if stop else "")

    def attrs(names: list[str]) -> str:
        if rng.random() < 0.25:
            return ""
        n = rng.choice(names)
        n = n.replace(" ", rng.choice("-_ ")) + rng.choice(("", "", "-1", "-wrapper", "-inner", " row", "-block"))
        return f' {rng.choice(("class", "class", "id"))}="{n}"'

    def links(kind: str, n: int) -> str:
        out = []
        for _ in range(n):
            label = rng.choice(CHROME.get(kind, CHROME["nav"])) if rng.random() < 0.5 else prose(rng.randint(1, 5), False)
            out.append(f'<a href="/{word()}">{label}</a>')
        style = rng.random()
        if style < 0.55:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in out) + "</ul>"
        return rng.choice((" | ", " ", "<br>", " &middot; ")).join(out) if style < 0.8 else "".join(f"<div>{x}</div>" for x in out)

    def chrome(kind: str) -> str:
        tags, names = KINDS[kind]
        tag = rng.choice(tags)
        a = attrs(names)
        if not a and tag in ("div", "section", "p", "ul", "ol"):
            a = f' class="{rng.choice(names).replace(" ", "-")}"' if kind in ("ad", "comment", "notice") else a
        if kind == "nav":
            body = links("nav", rng.randint(3, 10))
        elif kind == "header":
            body = rng.choice(("<h1>{}</h1>", "<div>{}</div>", "<a href='/'>{}</a>", "<p>{}</p>")).format(prose(rng.randint(1, 4), False)) + (links("nav", rng.randint(2, 6)) if rng.random() < 0.5 else "")
        elif kind == "ad":
            body = rng.choice(("{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<span>{}</span>", "<h4>{}</h4>")).format(prose(rng.randint(3, 25)))
        elif kind == "notice":
            body = rng.choice(("{}", "<p>{}</p>", "<span>{}</span>")).format(rng.choice(CHROME["notice"]) + " " + prose(rng.randint(0, 20))) + (" <a href='#'>ok</a>" if rng.random() < 0.4 else "")
        elif kind == "side":
            body = f"<h{(h := rng.randint(2, 5))}>{rng.choice(CHROME['side'])}</h{h}>" * (rng.random() < 0.7) + (links("side", rng.randint(2, 8)) if rng.random() < 0.7 else f"<p>{prose(rng.randint(5, 30))}</p>")
        elif kind == "form":
            body = "".join(rng.choice(("<label>{}</label><input>", "<p>{}</p>", "<div>{}</div>")).format(rng.choice(CHROME["form"]) if rng.random() < 0.7 else prose(rng.randint(1, 8))) for _ in range(rng.randint(1, 5)))
        elif kind == "comment":
            item = rng.choice(("div", "li", "article")) if tag not in ("ol", "ul") else "li"
            body = "<h3>{}</h3>".format(rng.choice(CHROME["comment"])) * (rng.random() < 0.6) * (tag not in ("ol", "ul"))
            for _ in range(rng.randint(1, 6)):
                body += f'<{item} class="comment"><b>{word()}</b> <p>{prose(rng.randint(3, 60))}</p>' + (f"<a href='#'>{rng.choice(CHROME['comment'])}</a>" if rng.random() < 0.5 else "") + f"</{item}>"
        else:
            body = rng.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format((("&copy; " if rng.random() < 0.5 else "") + rng.choice(CHROME["footer"] + ["x.example.com &middot;"]) + " " + prose(rng.randint(0, 14)))) + (links("footer", rng.randint(2, 8)) if rng.random() < 0.5 else "")
        return f"<{tag}{a}>{body}</{tag}>"

    def marked(tag: str, text: str) -> str:
        return f"<{tag}>{MARK}{text}</{tag}>"

    def article(wild: bool) -> str:
        out = []
        title = prose(rng.randint(2, 14), False)
        if rng.random() < 0.85:
            t = marked(rng.choice(("h1", "h1", "h2")), title)
            out.append(f"<header>{t}</header>" if rng.random() < 0.12 else t)
        if rng.random() < 0.35:
            out.append(f"<p>{rng.choice(('<b>', '<strong>', '<b>', ''))}{MARK}{title} {prose(rng.choice((1, 3, 12, 40)))}" + rng.choice(("<br>", "</p>", "</b></p>")))
        n = rng.choice((0, 1, 2, 4, 8, 12, 16, 24))
        for i in range(n):
            r, size = rng.random(), rng.choice((1, 1, 2, 3, 6, 12, 25, 50, 90, 140))
            if r < 0.72:
                text = prose(size)
                if rng.random() < 0.3:
                    text = rng.choice((f"<b>{text}", f"<b>{text}", f"<strong>{text}", f"<em>{text}</em>", f"<a href='/q'>{word()}</a> {text}", f"<span>{text}</span>"))
                close = "</p>" if rng.random() < 0.8 else rng.choice(("<br>", ""))
                out.append(f"<p>{MARK}{text}{close}")
            elif r < 0.80:
                out.append(marked(rng.choice(("h2", "h3", "h4")), prose(rng.randint(1, 8), False)))
            elif r < 0.86:
                k = rng.choice(("ul", "ol"))
                out.append(f"<{k}>" + "".join(marked("li", prose(rng.randint(1, 20))) for _ in range(rng.randint(1, 6))) + f"</{k}>")
            elif r < 0.90:
                out.append(f"<blockquote>{marked('p', prose(size))}</blockquote>")
            elif r < 0.92:
                out.append(marked("pre", prose(size)))
            elif r < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(marked("td", prose(rng.randint(1, 4), False)) for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.97 and wild:
                out.append(chrome(rng.choice(("ad", "side", "form"))))
            else:
                out.append(f"<div>{MARK}{prose(size)}</div>")
        return "".join(out)

    bodies = ["content", "article", "post body", "entry content", "main", "story", "text", "post", "article body", "page"]
    for i in range(count):
        wild = rng.random() < 0.6
        tag = rng.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        a = attrs(bodies) if tag != "article" or rng.random() < 0.5 else ""
        if tag in ("div", "section") and not a and rng.random() < 0.8:
            a = f' class="{rng.choice(bodies).replace(" ", "-")}"'
        body = f"<{tag}{a}>{article(wild)}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        if rng.random() < 0.3:
            body = f"<main>{body}</main>" if tag != "main" else body
        elif rng.random() < 0.3:
            body = f'<div class="{rng.choice(("wrapper", "container", "page", "site", "row"))}">{body}</div>'
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.5), ("form", 0.15), ("side", 0.2)) if rng.random() < p]
        after = [k for k, p in (("side", 0.3), ("ad", 0.25), ("comment", 0.4), ("form", 0.25), ("nav", 0.15), ("footer", 0.8), ("notice", 0.15)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
        page = "".join(map(chrome, before)) + body + "".join(map(chrome, after))
        if rng.random() < 0.15:  # nested wrappers
            page = f'<div id="page">{page}</div>'
        yield f"<html><body>{page}</body></html>"


def blocks_and_labels(page: str) -> tuple[list[Block], list[bool]]:
    found = blocks(page)
    return [Block(b.where, b.text.replace(MARK, "") or ".", b.linked) for b in found], [MARK in b.text for b in found]


# --- the operator -------------------------------------------------------------------------

_trained: list[Labeller] = []


def default_labeller() -> Labeller:
    """The labeller of ``trained()``, trained once in a process."""
    if not _trained:
        _trained.append(trained())
    return _trained[0]


def extract(pages: DataFrame, labeller: Labeller | None = None, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text, n_chars) of every row: its content blocks joined by line ends.

    A null or empty page, and one without content, gives an empty text; repeated rows give
    repeated results; a null key is carried; an empty table gives no rows; other columns are not read. A long page is read whole, in
    time and memory in proportion to its length.
    """
    frame = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    return _extracted(frame, labeller, [T.StructField(key, pages.schema[key].dataType)])


def _extracted(frame: DataFrame, labeller: Labeller | None, keys: list[T.StructField]) -> DataFrame:
    """The last column of ``frame`` is the page, those before it are carried as ``keys``."""
    held = frame.sparkSession.sparkContext.broadcast(labeller or default_labeller())
    schema = T.StructType([*keys, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 256):
            found = [blocks(p) for p in part.column(len(keys)).to_pylist()]
            kept = held.value.content(found)
            texts = ["\n".join(b.text for b, k in zip(bs, ks) if k) for bs, ks in zip(found, kept)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [f.name for f in schema])

    return map_arrow(frame, run, schema)


def html_query(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    keys = [T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", pages.schema["url"].dataType)]
    return _extracted(pages.select("page_id", "url", "html"), None, keys)
