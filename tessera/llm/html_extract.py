"""Main-text extraction from HTML by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a
vector of its hashed tag path (tags, classes and ids of the nearest elements and of all
ancestors), of its hashed words and of a few measurements. A bidirectional LSTM (numpy)
reads the sequence of a page's blocks and labels every block with the whole page as
context. It is trained here, on pages of a generator that knows its own labels
(:func:`generated`), with fixed seeds; nothing of the data read is used.

Defined results: a null or empty page gives an empty text; white space inside a block
becomes one space, <br> counts as white space, blocks without text vanish, kept blocks are
joined by two \\n in page order. Pages of any length are read whole, in one pass; broken markup
(quotes, comments or elements left open) loses no more text than stated at :func:`tokens`. Repeated rows
are extracted alike, a null page_id or url stays null, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_root

NEAR, FAR, WORDS, MORE = 96, 160, 16, 12
INPUT, HIDDEN = NEAR + FAR + WORDS + MORE, 24

#: A tag whose quoted values hold no angle bracket: matching stops at the next bracket, so all attempts together are linear.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
#: Dropped with what they hold, up to the end of the page where unclosed; and those dropped only where closed.
_RAW, _PAIR = {"script", "style", "iframe", "noscript"}, {"template", "svg", "object"}
#: What may stand in a head, whose end tag may be left out.
_HEAD_VOID, _HEAD_PAIR = {"meta", "link", "base"}, {"title", "script", "style", "noscript", "template"}
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW | _PAIR | _HEAD_PAIR}
_ATTR = re.compile(r"(class|id|role|data-y|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_INLINE = set("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr input label".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


def tokens(page: str):
    """(kind, value, attributes) of a page in one pass: "text", "start" and "end" (value: the tag), "space" (something dropped).

    A quote that is never closed is taken for a letter from there on; a comment or raw text that is never closed reaches to the end of the page.
    """
    at, last, n = 0, page.rfind(">"), len(page)
    quotes, never, head = True, set(), False
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], ""
            return
        if lt > at:
            text = page[at:lt]
            if not head or not text.isspace():
                head = False
                yield "text", text, ""
        m = _TAG.match(page, lt)
        if m:
            end, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
        elif page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            yield "space", "", ""
            continue
        elif page.startswith("<![CDATA[", lt) and "]]>" not in never:
            stop = page.find("]]>", lt)
            if stop < 0:
                never.add("]]>")
                at = lt
                continue
            yield "text", html.escape(page[lt + 9 : stop]), ""
            at = stop + 3
            continue
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.index(">", lt) + 1
            continue
        else:
            m = _TAG_NAME.match(page, lt)
            if not m:
                yield "text", "<", ""
                at = lt + 1
                continue
            k = m.end()
            while quotes and (mark := _MARK.search(page, k)) and mark[0] != ">":
                k = page.find(mark[0], mark.end()) + 1
                quotes = k > 0
            stop = page.find(">", k) if quotes else -1
            if stop < 0:  # the end of the page within a tag
                quotes, stop = False, page.index(">", lt)
            end, tag, attrs, at = m[1], m[2].lower(), page[m.end() : stop], stop + 1
        if head:
            if tag in _HEAD_VOID or (end and tag == "head"):
                head = not end
                continue
            head = tag in _HEAD_PAIR and not end
        if not end and (tag in _RAW or head or (tag in _PAIR and tag not in never and not (tag == "svg" and attrs.endswith("/")))):
            stop = _END[tag].search(page, at)
            if stop or tag in _RAW or head:
                at = stop.end() if stop else n
                if not head:
                    yield "space", "", ""
                continue
            never.add(tag)
        if not end and tag == "head":
            head = True
            continue
        if tag == "svg" and attrs.endswith("/"):
            continue
        yield ("end" if end else "start"), tag, attrs


class Block:
    __slots__ = ("text", "path", "link")

    def __init__(self, text, path, link):
        self.text, self.path, self.link = text, path, link


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. A path is a tuple of (tag, names, data-y)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    parts: list[str] = []
    state = {"link": 0, "in_a": 0}
    depth: dict[str, list[int]] = {}  # places of each open tag in the stack

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["in_a"]:
                state["link"] += len(text.strip())

    def flush() -> None:
        if parts:
            t = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if t:
                out.append(Block(t, tuple(stack), state["link"]))
            parts.clear()
        state["link"] = 0

    for kind, tag, attrs in tokens(page):
        if kind == "text":
            add(tag)
            continue
        if kind == "space":
            parts.append(" ")
            continue
        if tag == "a":
            state["in_a"] = 0 if kind == "end" else 1
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if kind == "end":
            if stack and stack[-1][0] == tag:
                stack.pop()
                depth[tag].pop()
                if not depth[tag]:
                    del depth[tag]
            elif tag in depth:
                del stack[depth[tag][-1] :]
                for t, places in list(depth.items()):
                    while places and places[-1] >= len(stack):
                        places.pop()
                    if not places:
                        del depth[t]
            state["in_a"] = 0
        else:
            while stack and stack[-1][0] in _CLOSES.get(tag, {"p"}):
                closed = stack.pop()[0]
                depth[closed].pop()
                if not depth[closed]:
                    del depth[closed]
            if tag in _VOID or attrs.endswith("/"):
                continue
            names, y = [], None
            for a in _ATTR.finditer(attrs) if attrs else ():
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "data-y":
                    y = value
                else:
                    names += [x.lower() for x in _PARTS.findall(value)] if key in ("class", "id", "role") else [key]
            depth.setdefault(tag, []).append(len(stack))
            stack.append((tag, tuple(names), y))
    flush()
    return out


_hashed: dict[str, int] = {}


def _slot(s: str) -> int:
    v = _hashed.get(s)
    if v is None:
        if len(_hashed) > 200_000:
            _hashed.clear()
        v = _hashed[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return v


def features(seq: list[Block]) -> np.ndarray:
    x = np.zeros((len(seq), INPUT), np.float32)
    cache: dict[tuple, np.ndarray] = {}
    for k, b in enumerate(seq):
        row = cache.get(b.path)
        if row is None:
            row = np.zeros(NEAR + FAR, np.float32)
            for d, (tag, names, _) in enumerate(reversed(b.path)):
                for s in (tag, *names):
                    if d < 2:
                        row[_slot(f"n{s}") % NEAR] = 1
                    row[NEAR + _slot(f"f{s}") % FAR] = 1
            cache[b.path] = row
        x[k, : NEAR + FAR] = row
        words = _WORD.findall(b.text.lower())
        sums = [0] * WORDS
        for w in words:
            v = _hashed.get(w) or _slot(w)
            sums[v % WORDS] += 1 if v & 65536 else -1
        x[k, NEAR + FAR : -MORE] = sums
        n = len(b.text)
        x[k, NEAR + FAR : -MORE] /= max(1.0, len(words)) ** 0.5
        ends = sum(b.text.count(c) for c in ".!?")
        x[k, -MORE:] = (
            1, np.log1p(n) / 5, min(1.0, b.link / n), min(1.0, 20 * ends / n), n > 120, n < 25, len(b.path) / 8, (k + 1) / len(seq),
            b.text[-1] in ".!?\"”»", b.text.count(",") * 10 / n, b.path == seq[k - 1].path if k else 0, k == 0,
        )
    return x


# ------------------------------------------------------------------ the network


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, mask, w, u, b, keep=False):
    """x: T x B x D. Returns T x B x H and, if wanted, what the backward pass needs."""
    t, n, _ = x.shape
    hid = u.shape[0]
    z = x @ w + b
    h, c, out, tape = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32), np.zeros((t, n, hid), np.float32), []
    for k in range(t):
        a = z[k] + h @ u
        i, f, o, g = _sig(a[:, :hid]), _sig(a[:, hid : 2 * hid] + 1), _sig(a[:, 2 * hid : 3 * hid]), np.tanh(a[:, 3 * hid :])
        new = f * c + i * g
        tc = np.tanh(new)
        m = mask[k][:, None]
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * new + (1 - m) * c
        out[k] = h * m
    return out, tape


def _lstm_back(dout, x, w, u, tape):
    t, n, _ = x.shape
    dz = np.zeros((t, n, u.shape[1]), np.float32)
    du, dh, dc = np.zeros_like(u), np.zeros((n, u.shape[0]), np.float32), np.zeros((n, u.shape[0]), np.float32)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[k]
        dht = (dout[k] + dh) * m
        dct = dht * o * (1 - tc**2) + dc * m
        a = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
        dz[k] = a
        du += h.T @ a
        dh, dc = a @ u.T + (1 - m) * dh, dct * f + (1 - m) * dc
    return np.tensordot(x, dz, ([0, 1], [0, 1])), du, dz.sum((0, 1))


class Labeller:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "lr":
            self.p |= {f"w{d}": g(INPUT, 4 * HIDDEN) * 0.7, f"u{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        self.p |= {"v": g(2 * HIDDEN, 1), "s": np.zeros((INPUT, 1), np.float32), "c": np.zeros(1, np.float32)}

    def forward(self, x, mask, keep=False):
        p = self.p
        a, ta = _lstm(x, mask, p["wl"], p["ul"], p["bl"], keep)
        b, tb = _lstm(x[::-1], mask[::-1], p["wr"], p["ur"], p["br"], keep)
        h = np.concatenate([a, b[::-1]], 2)
        return _sig((h @ p["v"] + x @ p["s"] + p["c"])[..., 0]), h, ta, tb

    def gradients(self, x, mask, y):
        p = self.p
        out, h, ta, tb = self.forward(x, mask, True)
        d = ((out - y) * mask / mask.sum())[..., None].astype(np.float32)
        dh = d @ p["v"].T
        g = {"v": np.tensordot(h, d, ([0, 1], [0, 1])), "s": np.tensordot(x, d, ([0, 1], [0, 1])), "c": d.sum((0, 1))}
        g["wl"], g["ul"], g["bl"] = _lstm_back(dh[..., :HIDDEN], x, p["wl"], p["ul"], ta)
        g["wr"], g["ur"], g["br"] = _lstm_back(dh[::-1, :, HIDDEN:], x[::-1], p["wr"], p["ur"], tb)
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like length share a batch."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            size, take = len(pages[order[-1]]), []
            while order and len(take) < 128 and (not take or len(take) * size < 6000):
                take.append(order.pop())
            x, mask = _padded([features(pages[k]) for k in take])
            y = self.forward(x, mask)[0]
            for b, k in enumerate(take):
                out[k] = y[: len(pages[k]), b] >= 0.5
        return out


def _padded(xs: list[np.ndarray]):
    t = max(len(x) for x in xs)
    x, mask = np.zeros((t, len(xs), INPUT), np.float32), np.zeros((t, len(xs)), np.float32)
    for b, v in enumerate(xs):
        x[: len(v), b], mask[: len(v), b] = v, 1
    return x, mask


# ------------------------------------------------------------------ training pages

_SYL = "ba re ti on en ing er st the an is or al de lu mi na ko sa vi qu ra el ter mo ne".split()
#: Names that pages give to their parts, main and other.
_MAIN = ["content", "post", "entry", "article body", "story", "post-content", "main-text", "text", "entry-content", "articleBody", "page-content", "prose", "body copy", ""]
_OTHER = {
    "nav": ["menu", "nav", "navbar", "main-nav", "top-menu", "breadcrumbs", "breadcrumb", "links", "pagination", ""],
    "header": ["header", "site-header", "masthead", "top", "branding", "logo", ""],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", ""],
    "aside": ["sidebar", "widget", "related", "related-posts", "trending", "popular", "tags", "author-box", "side", "recommended", ""],
    "notice": ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "announcement", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "ad-slot", "adsbox", "promotion", "commercial"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form", ""],
    "comments": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "respond", "disqus", "user-comments", "reader-comments"],
    "share": ["share", "social", "share-buttons", "follow", "meta", "toolbar"],
}
_SAY = {"nav": "Home About Contact News", "footer": "Copyright Privacy Terms Imprint All rights reserved", "notice": "We use cookies Accept Subscribe to our newsletter", "ad": "Advertisement Sponsored Buy now", "form": "Name Email Submit Search Password", "comments": "Reply says Comments", "share": "Share Tweet Print", "aside": "Related Popular Read more", "header": "Log in Menu"}


def _words(r, n):
    return " ".join("".join(r.choice(_SYL) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentence(r, lo=4, hi=22):
    s = _words(r, r.randint(lo, hi))
    if r.random() < 0.3:
        s = s.replace(" ", ", ", 1)
    return s.capitalize() + r.choice("....!?")


def _para(r, most=7):
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


def _name(r, kind, always=False):
    c = r.choice(_MAIN if kind == "main" else _OTHER[kind])
    if not c or (not always and r.random() < 0.12):
        return ""
    return f' {r.choice(["class", "class", "id"])}="{c}{r.choice(["", "", "", " " + _words(r, 1), "-" + str(r.randint(1, 9)), " row", " container"])}"'


def _other(r, kind) -> str:
    """A part of a page that is not main text."""
    say = lambda: r.choice([_words(r, r.randint(1, 4)), _words(r, r.randint(1, 4)).capitalize(), " ".join(r.sample(_SAY[kind].split(), 2))])
    links = lambda n: "".join(f'<li><a href="/{_words(r, 1)}">{say()}</a></li>' for _ in range(n))
    text = lambda: r.choice([_sentence(r), _sentence(r), say(), _para(r, 3)])
    tag = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form"], "comments": ["section", "div", "div", "ol"], "notice": ["div", "section", "aside", "dialog"], "ad": ["div", "div", "aside", "section", "ins"]}.get(kind, ["div"])
    tag = r.choice(tag)
    name = _name(r, kind, always=tag in ("div", "section", "ul", "ol", "dialog", "ins"))
    if tag in ("div", "section", "ul", "ol", "dialog", "ins") and not name:
        name = f' class="{r.choice([c for c in _OTHER[kind] if c] or ["x"])}"'
    if kind == "nav":
        body = links(r.randint(3, 9)) if tag == "ul" else r.choice([f"<ul>{links(r.randint(3, 9))}</ul>", " ".join(f'<a href="#">{say()}</a>' for _ in range(r.randint(2, 7)))])
    elif kind == "footer":
        body = r.choice([f"&copy; {_words(r, 2)} &middot; {_sentence(r)}", f"<p>{text()}</p><ul>{links(3)}</ul>", f"<p>&copy; 20{r.randint(10, 26)} {say()}</p>", _sentence(r)])
    elif kind == "header":
        body = r.choice([f"<h1>{say()}</h1>", f"<a href='/'>{say()}</a>", f"<div>{say()}</div><p>{_sentence(r, 3, 8)}</p>"]) + (f"<nav><ul>{links(4)}</ul></nav>" if r.random() < 0.4 else "")
    elif kind == "form":
        body = f"<label>{say()}</label><input name=q><select><option>{say()}<option>{say()}</select><button>{say()}</button>" + (f"<p>{text()}</p>" if r.random() < 0.5 else "") + (f"<textarea>{say()}</textarea>" if r.random() < 0.3 else "")
    elif kind == "comments":
        one = lambda: r.choice([f"<div class='comment'><b>{say()}</b><p>{_para(r, 4)}</p></div>", f"<li><p>{say()}</p><p>{_para(r, 4)}</p></li>", f"<p>{_para(r, 3)}</p>", f"<article class='comment'><p>{_para(r, 3)}</p></article>"])
        body = (f"<h{(k := r.randint(2, 4))}>{say()}</h{k}>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
    elif kind in ("aside", "notice"):
        body = (f"<h3>{say()}</h3>" if r.random() < 0.6 else "") + r.choice([f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{text()}</p>", text(), f"<p>{text()}</p><button>{say()}</button>"])
    else:
        body = r.choice([text(), f"<p>{text()}</p>", f"<a href='#'>{text()}</a>", f"<span>{say()}</span>"])
    return f'<{tag}{name} data-y="0">{body}</{tag}>'


def generated(seed: int) -> str:
    """A page whose elements carry data-y: 1 main text, 0 not (the nearest ancestor counts)."""
    r = random.Random(seed)
    end = r.choice(["</p>", "</p>", "</p>", ""])

    def inline(s):
        w = s.split(" ")
        for tag in ("b", "a href='/x'", "em"):
            if len(w) > 3 and r.random() < 0.2:
                k = r.randrange(len(w))
                w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>"
        return " ".join(w)

    main = []
    if r.random() < 0.75:
        main.append(f"<h1>{inline(_words(r, r.randint(2, 12)).capitalize())}{r.choice(['', '', '.'])}</h1>")
    for _ in range(r.randint(1, 14) if r.random() < 0.9 else r.randint(14, 40)):
        k = r.random()
        if k < 0.72:
            main.append(f"<p>{inline(_para(r))}{end}")
        elif k < 0.8:
            main.append(f"<h{(n := r.randint(2, 4))}>{_words(r, r.randint(1, 6)).capitalize()}</h{n}>")
        elif k < 0.86:
            main.append(f"<p><b>{_sentence(r)}<br>{r.choice(['', _sentence(r)])}{r.choice(['', '</b></p>'])}")
        elif k < 0.9:
            main.append("<ul>" + "".join(f"<li>{r.choice([_sentence(r), _words(r, 3)])}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif k < 0.93:
            main.append(f"<blockquote><p>{_para(r, 3)}</p></blockquote>")
        elif k < 0.95:
            main.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 1)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif k < 0.97:
            main.append(f"<pre>{_words(r, 6)}</pre>")
        else:
            main.append(f"<p>{_words(r, r.randint(1, 3))}{end}")
        if r.random() < 0.05:
            main.append(_other(r, r.choice(["ad", "ad", "aside", "share", "notice", "form"])))
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    inner = "".join(main)
    if r.random() < 0.2:
        inner = f"<div{_name(r, 'main')}>{inner}</div>"
    if r.random() < 0.12:
        inner += _other(r, "comments")
    if r.random() < 0.08:
        inner = _other(r, r.choice(["share", "ad"])) + inner
    if r.random() < 0.08:
        inner += f'<footer data-y="0">{_sentence(r)}</footer>'
    body = f'<{tag}{_name(r, "main") if tag in ("div", "section") or r.random() < 0.4 else ""} data-y="1">{inner}</{tag}>'
    if r.random() < 0.15:
        body = f"<main>{body}</main>"
    some = lambda kinds, p: "".join(_other(r, k) for k in kinds if r.random() < p)
    before = some(["notice", "header", "nav", "ad", "form", "share"], 0.35)
    if r.random() < 0.35:
        before = _other(r, "nav") + before
    after = some(["share", "comments", "aside", "ad", "form", "notice"], 0.3) + (_other(r, "footer") if r.random() < 0.75 else "")
    if r.random() < 0.15:
        body = f"<div class='{r.choice(['wrap', 'container', 'page', 'row', 'layout'])}'>{body}{some(['aside', 'comments', 'ad'], 0.4)}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>{before}{body}{after}</body></html>"


def _truth(seq: list[Block]) -> np.ndarray:
    out = np.zeros(len(seq), np.float32)
    for k, b in enumerate(seq):
        y = next((y for _, _, y in reversed(b.path) if y is not None), "0")
        out[k] = y == "1"
    return out


def train(pages: int = 1400, epochs: int = 7, seed: int = 11) -> Labeller:
    """Fit the labeller to generated pages (Adam, fixed seeds)."""
    data = []
    for k in range(pages):
        seq = blocks(generated(seed * 1_000_003 + k))
        if seq:
            data.append((features(seq), _truth(seq)))
    data.sort(key=lambda d: len(d[0]))
    net, r = Labeller(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    batches, step = [data[i : i + 32] for i in range(0, len(data), 32)], 0
    for e in range(epochs):
        for b in r.permutation(len(batches)):
            x, mask = _padded([d[0] for d in batches[b]])
            # unknown names and words must not decide: some hashed inputs are dropped
            x[..., : NEAR + FAR] *= r.random((1, x.shape[1], NEAR + FAR)) > 0.06
            y = np.zeros_like(mask)
            for k, d in enumerate(batches[b]):
                y[: len(d[1]), k] = d[1]
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                rate = 0.01 * (1 - e / epochs) + 0.0005
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    return net


_net: list[Labeller] = []


def labeller(spark: SparkSession | None = None) -> Labeller:
    """The trained network, fitted once per process; with a session its weights are kept in the shared folder, under the
    hash of this code, and read from there by later applications."""
    if not _net and spark is None:
        _net.append(train())
    if not _net:
        source = inspect.getsource(inspect.getmodule(train)).encode()
        path = f"{shared_root(spark)}/tessera-html-{hashlib.sha256(source + np.__version__.encode()).hexdigest()[:16]}"
        jvm = spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            net = Labeller()
            for r in spark.read.parquet(path).collect():  # a row for each of the network's matrices
                net.p[r["name"]] = np.frombuffer(r["data"], np.float32).reshape(net.p[r["name"]].shape)
            _net.append(net)
        else:
            _net.append(train())
            rows = [(k, bytearray(v.astype(np.float32).tobytes())) for k, v in _net[0].p.items()]
            spark.createDataFrame(rows, "name string, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _net[0]


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    seqs = [blocks(p) if p else [] for p in pages]
    return ["\n\n".join([b.text for b, k in zip(s, keep) if k]) for s, keep in zip(seqs, net.label(seqs))]


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(net or labeller(pages.sparkSession))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                cols = [part.column(0), part.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
