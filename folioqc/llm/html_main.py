"""Main text of web pages by a recurrent block labeller.

A page is parsed into its sequence of leaf blocks, in linear time. Each block is a vector of its
hashed tag path (with class and id words), its hashed words and a few counts; a numpy
bidirectional LSTM reads the whole sequence and labels every block as main text or not, so that a
block's label rests on the page around it. It is trained here, on generated pages of known
structure and on a bounded sample of given pages whose own semantic tags label their blocks; of
both kinds it also sees versions without these tags and without names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import sample_rows, slices

# Element kinds of HTML that decide how markup is cut into blocks.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg head title select option datalist canvas audio video textarea".split())
MATH = frozenset(
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
PHRASE = INLINE | MATH
#: Start tags that leave an open head open; any other, or text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")

PATH_SPACE, WORD_SPACE = 2048, 2048
EMBED, COUNTS, HIDDEN = 12, 6, 16
#: Pages that run side by side, and cells (blocks by pages) that they may fill.
LANES, CELLS = 256, 1 << 18
#: Generated pages; bounds of the sample of given pages: rows and bytes; blocks of a training window
#: (a longer page gives several); steps.
TRAIN_PAGES, SAMPLE_PAGES, SAMPLE_BYTES, TRAIN_BLOCKS, STEPS = 1200, 300, 24 << 20, 256, 340


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of all tags; comments and declarations have no name.

    A quote counts after an equals sign only. If a tag does not end because its quotes do not, this
    and all later tags end at their first >, so that the rest of the page is not lost and no
    character is looked at more than a few times.
    """
    at, last, loose = 0, page.rfind(">"), False
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            at = COMMENT.match(page, i).end()
            yield i, at, False, "", ""
            continue
        if i > last:
            return
        closes = page.startswith("/", i + 1)
        name = NAME.match(page, i + 1 + closes)
        if not name:
            if not (closes or page.startswith(("!", "?"), i + 1)):
                at = i + 1
                continue
            at = page.find(">", i) + 1
            yield i, at, False, "", ""
            continue
        end = 0 if loose else _tag_end(page, name.end())
        if not end:
            loose, end = True, page.find(">", i) + 1
        yield i, end, closes, name[0].lower(), page[name.end() : end - 1]
        at = end


def _tag_end(page: str, at: int) -> int:
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if not at:
            break
    return 0


class Block:
    """A leaf: the sets (as bits) of the tags and of the names on its path, its depth, its text and
    the characters of it that are in links. Sets of one path are shared by all its blocks."""

    __slots__ = ("tags", "names", "depth", "text", "linked")

    def __init__(self, tags: int, names: int, depth: int, text: str, linked: int):
        self.tags, self.names, self.depth, self.text, self.linked = tags, names, depth, text, linked


_buckets: dict[tuple[str, int], int] = {}


def _bucket(word: str, space: int) -> int:
    key = (word, space)
    found = _buckets.get(key)
    if found is None:
        if len(_buckets) > 500_000:
            _buckets.clear()
        found = _buckets[key] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % space
    return found


def _bits(words: Iterable[str]) -> int:
    out = 0
    for w in words:
        out |= 1 << _bucket(w, PATH_SPACE)
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with white space collapsed; hidden and raw elements are none.

    Each open element has its set of path words, made from its parent's; open elements are also
    listed by tag, so that no end tag looks through the stack.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    open_at: dict[str, list[int]] = {}
    walls: list[int] = []
    run: list[tuple[str, bool]] = []
    hidden = links = at = skip_to = 0

    def flush() -> None:
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                found.append(Block(*(stack[-1][1:] if stack else (0, 0)), len(stack), text, sum(len(t) for t, link in run if link)))
            run.clear()

    def push(tag: str, attributes: str) -> None:
        nonlocal hidden, links
        names = 0
        if attributes:
            names = _bits(f".{w}" for m in ATTR.finditer(attributes) for w in NAME_PART.findall(next(g for g in m.groups() if g is not None).lower()))
        above = stack[-1] if stack else ("", 0, 0)
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in PHRASE:
            walls.append(len(stack))
        stack.append((tag, above[1] | _bits((tag,)), above[2] | names))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"

    def pop() -> None:
        nonlocal hidden, links
        tag = stack.pop()[0]
        open_at[tag].pop()
        if tag not in PHRASE:
            walls.pop()
        hidden -= tag in HIDDEN_TAGS
        links -= tag == "a"

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            pop()

    def say(a: int, b: int) -> None:
        if b > a:
            if hidden and not page[a:b].isspace():
                end_head()
            if not hidden:
                run.append((html.unescape(page[a:b]), links > 0))

    for start, end, closes, tag, attributes in tags(page):
        if start < skip_to:
            continue
        say(at, start)
        at = end
        if not tag:
            continue
        if tag not in PHRASE:
            flush()
        elif tag in MATH and not hidden:
            run.append((" ", False))
        if closes:
            if tag in ("body", "html", "br"):
                end_head()
            place = open_at.get(tag)
            if place and (tag not in PHRASE or not walls or place[-1] > walls[-1]):
                least = place[-1]
                while len(stack) > least:
                    pop()
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in VOID or attributes.endswith("/") and tag not in CLOSES_P | INLINE:
            continue
        if tag in CLOSES_P:
            while open_at.get("p") and stack[-1][0] in PHRASE | {"p"}:
                pop()
        if tag in SIBLINGS:
            while stack and stack[-1][0] in PHRASE | {"p", *SIBLINGS[tag]}:
                pop()
        push(tag, attributes)
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            after = page.find(">", close.end()) + 1 if close else 0
            at = skip_to = after or len(page)
            pop()
    say(at, len(page))
    flush()
    return found


def _positions(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(PATH_SPACE // 8, "little"), np.uint8), bitorder="little")).astype(np.uint16)


def vectors(page: list[Block]) -> tuple[list[np.ndarray], np.ndarray, list[list[int]], np.ndarray]:
    """Buckets of the distinct paths and the path of every block; word buckets and counts of every block."""
    known: dict[int, int] = {}
    path_of = np.asarray([known.setdefault(b.tags | b.names, len(known)) for b in page], np.int64)
    words, counts = [], np.zeros((len(page), COUNTS), np.float32)
    n = max(1, len(page))
    for i, b in enumerate(page):
        words.append([_bucket(w, WORD_SPACE) for w in set(b.text.lower().split())])
        size = len(b.text)
        counts[i] = (np.log1p(size) / 6, min(1.0, b.linked / size), i / n, min(b.depth, 100) / 12, sum(map(b.text.count, ".,;:!?")) / size * 10, np.log1p(n) / 6)
    return [_positions(p) for p in known], path_of, words, counts


class Lstm:
    """One direction; gates are stacked as input, forget, output, cell."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.h = hidden
        self.w = rng.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def run(self, x: np.ndarray, solid: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States for x (blocks, pages, inputs); blocks that are not solid leave none."""
        h, (steps, pages, _) = self.h, x.shape
        s = c = np.zeros((pages, h), np.float32)
        states = np.empty((steps, pages, h), np.float32)
        for t in range(steps):
            joined = np.concatenate([x[t], s], axis=1)
            a = joined @ self.w + self.b
            gates = 1 / (1 + np.exp(-a[:, : 3 * h]))
            g = np.tanh(a[:, 3 * h :])
            old = c
            c = (gates[:, h : 2 * h] * old + gates[:, :h] * g) * solid[t][:, None]
            tc = np.tanh(c)
            s = gates[:, 2 * h :] * tc * solid[t][:, None]
            states[t] = s
            if keep is not None:
                keep.append((joined, gates, g, old, tc))
        return states

    def back(self, keep: list, solid: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.h
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        ds = dc = np.zeros_like(d_states[0])
        dx = np.empty((*d_states.shape[:2], self.w.shape[0] - h), np.float32)
        for t in range(len(keep) - 1, -1, -1):
            joined, gates, g, old, tc = keep[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            ds = (ds + d_states[t]) * solid[t][:, None]
            dc = (dc + ds * o * (1 - tc * tc)) * solid[t][:, None]
            da = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dw += joined.T @ da
            db += da.sum(0)
            dj = da @ self.w.T
            dx[t], ds, dc = dj[:, :-h], dj[:, -h:], dc * f
        return dw, db, dx


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.path = rng.normal(0, 0.3, (PATH_SPACE, EMBED)).astype(np.float32)
        self.word = rng.normal(0, 0.1, (WORD_SPACE, EMBED)).astype(np.float32)
        self.a, self.b = (Lstm(rng, 2 * EMBED + COUNTS, HIDDEN) for _ in range(2))
        self.out = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple, list]:
        """x (blocks, pages, inputs), solid, the places of blocks, and each bag's members: buckets,
        the bag of each, shares, and the bag of each block."""
        longest = max(len(p[1]) for p in pages)
        x = np.zeros((longest, len(pages), 2 * EMBED + COUNTS), np.float32)
        solid = np.zeros((longest, len(pages)), np.float32)
        t = np.concatenate([np.arange(len(p[1])) for p in pages])
        lane = np.repeat(np.arange(len(pages)), [len(p[1]) for p in pages])
        first = np.cumsum([0, *(len(p[0]) for p in pages)])
        listed = (
            (self.path, [b for p in pages for b in p[0]], np.concatenate([p[1] + o for p, o in zip(pages, first)])),
            (self.word, [b for p in pages for b in p[2]], np.arange(len(t))),
        )
        bags = []
        for k, (table, rows, of_block) in enumerate(listed):
            sizes = np.asarray([len(r) for r in rows], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint16), *(np.asarray(r, np.uint16) for r in rows)])
            share = (1 / np.maximum(1, sizes)).astype(np.float32)
            sums = np.zeros((len(rows), EMBED), np.float32)
            ends = np.cumsum(sizes)
            # Members are summed in parts, so that their vectors never all stand side by side.
            a = 0
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
                full = a + np.flatnonzero(sizes[a:b])
                if len(full):
                    low = ends[a] - sizes[a]
                    sums[full] = np.add.reduceat(table[flat[low : ends[b - 1]]], ends[full] - sizes[full] - low, axis=0)
                a = b
            x[t, lane, k * EMBED : (k + 1) * EMBED] = (sums * share[:, None])[of_block]
            bags.append((flat, sizes, share, of_block))
        x[t, lane, 2 * EMBED :] = np.concatenate([p[3] for p in pages])
        solid[t, lane] = 1
        return x, solid, (t, lane), bags

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """Probability of main text of every block of each page (as vectors() gives it)."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p[1])), key=lambda i: len(pages[i][1]))
        while order:
            # Pages of like length run together; the longest page sets how many.
            n = max(1, min(LANES, len(order)))
            while n > 1 and n * len(pages[order[n - 1]][1]) > CELLS:
                n //= 2
            part, order = order[:n], order[n:]
            x, solid, _, _ = self.inputs([pages[i] for i in part])
            states = np.concatenate([self.a.run(x, solid), self.b.run(x[::-1], solid[::-1])[::-1]], axis=2)
            p = 1 / (1 + np.exp(-(states @ self.out + self.bias)))
            for lane, i in enumerate(part):
                out[i] = p[: len(pages[i][1]), lane]
        return out

    def learn(self, pages: list, labels: list[np.ndarray]) -> list[tuple[object, str, np.ndarray]]:
        x, solid, (t, lane), bags = self.inputs(pages)
        ka, kb = [], []
        states = np.concatenate([self.a.run(x, solid, ka), self.b.run(x[::-1], solid[::-1], kb)[::-1]], axis=2)
        p = 1 / (1 + np.exp(-(states @ self.out + self.bias)))
        y = np.zeros_like(p)
        y[t, lane] = np.concatenate(labels)
        d = (p - y) * solid / max(1.0, solid.sum())
        ds = d[:, :, None] * self.out
        wa, ba, xa = self.a.back(ka, solid, ds[:, :, :HIDDEN])
        wb, bb, xb = self.b.back(kb, solid[::-1], ds[::-1, :, HIDDEN:])
        dx = xa + xb[::-1]
        grads = [(self.a, "w", wa), (self.a, "b", ba), (self.b, "w", wb), (self.b, "b", bb), (self, "out", (d[:, :, None] * states).sum((0, 1))), (self, "bias", d.sum()[None])]
        for k, name in enumerate(("path", "word")):
            flat, sizes, share, of_block = bags[k]
            of_bag = np.zeros((len(sizes), EMBED), np.float32)
            np.add.at(of_bag, of_block, dx[t, lane, k * EMBED : (k + 1) * EMBED])
            g = np.zeros_like(getattr(self, name))
            np.add.at(g, flat, np.repeat(of_bag * share[:, None], sizes, axis=0))
            grads.append((self, name, g))
        return grads


# Generated pages. Word lists are fixed values that pages of many sites share.
_MENU = "home about contact news blog shop login register search help support products services archive category tags next previous more all sitemap press jobs".split()
_NOTICE = "we use cookies to improve your experience accept all cookies privacy policy settings by continuing you agree subscribe to our newsletter sign up for updates enter your email".split()
_ADVERT = "advertisement sponsored buy now offer sale discount free shipping click here limited deal promo best price".split()
_FOOTER = "© copyright all rights reserved terms privacy imprint contact powered by company inc follow us".split()
_COMMENT = "reply posted by says comment comments user ago likes report great thanks agree i think nice article permalink".split()
_MAIN_NAMES = "content main post entry article body story text post-content entry-content article-body main-content page-content".split()


def _sentence(rng: np.random.Generator, low: int, high: int, pool: list[str] | None = None) -> str:
    if pool and rng.random() < 0.7:
        return " ".join(pool[k] for k in rng.integers(0, len(pool), int(rng.integers(low, high))))
    syllables = ("ka", "ri", "en", "to", "sch", "el", "mo", "ua", "ção", "an", "de", "ist", "é", "ver", "tion", "os", "li", "ба", "по", "ing")
    words = ["".join(syllables[k] for k in rng.integers(0, len(syllables), int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high)))]
    out = " ".join(words)
    return out[:1].upper() + out[1:] + ("." if len(words) > 4 else "")


def generated_page(rng: np.random.Generator) -> tuple[str, list[str], list[str]]:
    """html, and the block texts that are and are not main; layouts vary in order and naming."""
    main: list[str] = []
    other: list[str] = []
    number = iter(range(10**6))

    def take(text: str, into: list[str]) -> str:
        # A number that no other block has lets training match blocks to labels; it is cut out later.
        text = f"{text} §{next(number)}§"
        into.append(text)
        return text

    def box(tag: str, names: list[str], inner: str) -> str:
        named = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if names and (tag == "div" or rng.random() < 0.5) else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def menu(names: list[str], tag: str) -> str:
        pool = _MENU if rng.random() < 0.5 else None
        items = "".join(f'<li><a href="#">{take(_sentence(rng, 1, 4, pool).rstrip("."), other)}</a></li>' for _ in range(int(rng.integers(2, 12))))
        return box(tag, names, f"<ul>{items}</ul>")

    def boiler(kind: str) -> str:
        if kind == "menu":
            return menu(["nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav"], rng.choice(["nav", "div", "nav"]))
        if kind == "header":
            return box(rng.choice(["header", "div"]), ["header", "site-header", "masthead", "top", "banner"], f"<{(t := rng.choice(['p', 'div', 'h2']))}>{take(_sentence(rng, 1, 6), other)}</{t}>")
        if kind == "ad":
            inner = take(_sentence(rng, 2, 14, _ADVERT if rng.random() < 0.5 else None), other)
            return box(rng.choice(["div", "aside", "div", "section"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], inner if rng.random() < 0.6 else f"<p>{inner}</p>")
        if kind == "notice":
            return box("div", ["cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "newsletter", "popup"], f"<p>{take(_sentence(rng, 4, 20, _NOTICE), other)}</p><button>{take('OK', other)}</button>")
        if kind == "aside":
            inner = "".join(f"<p>{take(_sentence(rng, 2, 16), other)}</p>" for _ in range(int(rng.integers(1, 4))))
            if rng.random() < 0.5:
                return menu(["sidebar", "related", "widget", "recent-posts"], rng.choice(["aside", "div"]))
            return box(rng.choice(["aside", "div"]), ["sidebar", "related", "widget", "side", "share", "social", "author-box"], f"<h3>{take(_sentence(rng, 1, 4), other)}</h3>{inner}")
        if kind == "form":
            return f'<form action="/">{box("p", [], take(_sentence(rng, 1, 8, _NOTICE), other))}<label>{take("Email", other)}</label><input name="q"><button>{take("Send", other)}</button></form>'
        if kind == "comments":
            rows = "".join(box(rng.choice(["div", "li", "article"]), ["comment", "comment-body", "reply"], f"<p>{take(_sentence(rng, 3, 40, _COMMENT if rng.random() < 0.4 else None), other)}</p>") for _ in range(int(rng.integers(1, 7))))
            return box(rng.choice(["section", "div"]), ["comments", "comment-list", "respond", "disqus", "discussion", "reader-comments"], f"<h3>{take(_sentence(rng, 1, 3, _COMMENT), other)}</h3>{rows}")
        return box(rng.choice(["footer", "footer", "div"]), ["footer", "site-footer", "bottom", "copyright"], take(_sentence(rng, 2, 16, _FOOTER if rng.random() < 0.5 else None), other) if rng.random() < 0.6 else f"<p>{take(_sentence(rng, 2, 16, _FOOTER), other)}</p>")

    def article() -> str:
        parts = [f"<h1>{take(_sentence(rng, 1, 10), main)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 16))):
            u = rng.random()
            text = _sentence(rng, 1, 8) if rng.random() < 0.3 else " ".join(_sentence(rng, 3, 25) for _ in range(int(rng.integers(1, 5))))
            if u < 0.72:
                parts.append(f"<p>{'<b>' if rng.random() < 0.1 else ''}{take(text, main)}{'<br>' if rng.random() < 0.1 else '</p>'}")
            elif u < 0.8:
                parts.append(f"<h2>{take(_sentence(rng, 1, 7), main)}</h2>")
            elif u < 0.86:
                parts.append("<ul>" + "".join(f"<li>{take(_sentence(rng, 2, 14), main)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif u < 0.9:
                parts.append(f"<blockquote>{take(text, main)}</blockquote>")
            elif u < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{take(_sentence(rng, 1, 5), main)}</td><td>{take(_sentence(rng, 1, 5), main)}</td></tr>" for _ in range(3)) + "</table>")
            elif u < 0.97:
                parts.append(f"<div>{take(text, main)}</div>")
            else:
                parts.append(boiler(rng.choice(["ad", "aside", "form", "notice"])))
        return "".join(parts)

    if rng.random() < 0.06:
        # Text without any container, or without any markup.
        texts = [take(" ".join(_sentence(rng, 3, 25) for _ in range(int(rng.integers(1, 4)))), main) for _ in range(int(rng.integers(1, 6)))]
        return "".join(f"<p>{t}" for t in texts) if rng.random() < 0.6 else "\n".join(texts), main, other
    before = [k for k in ("notice", "header", "menu", "ad", "aside", "form") if rng.random() < (0.7 if k == "menu" else 0.35)]
    after = [k for k in ("ad", "aside", "form", "comments", "footer", "notice", "menu") if rng.random() < (0.75 if k == "footer" else 0.5 if k == "comments" else 0.25)]
    rng.shuffle(before)
    tag = rng.choice(["article", "main", "div", "section", "article"])
    core = box(tag, list(_MAIN_NAMES), article())
    if rng.random() < 0.3:
        core = box(rng.choice(["main", "div"]), ["wrapper", "container", "main", "page", "content"], "".join(map(boiler, before[:1])) + core + "".join(map(boiler, after[:1])))
        before, after = before[1:], after[1:]
    return f"<html><body>{''.join(map(boiler, before))}{core}{''.join(map(boiler, after))}</body></html>", main, other


_MARK = re.compile(r" ?§\d+§")


def training_pages(n: int = TRAIN_PAGES, seed: int = 17) -> tuple[list[list[Block]], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for _ in range(n):
        page, main, _ = generated_page(rng)
        wanted = {m[0] for text in main for m in re.finditer(r"§\d+§", text)}
        found = blocks(page)
        labels.append(np.asarray([float(any(m in wanted for m in re.findall(r"§\d+§", b.text))) for b in found], np.float32))
        for b in found:
            b.text = _MARK.sub("", b.text) or "."
        pages.append(found)
    return pages, labels


# Elements whose meaning labels blocks of given pages.
_IS_MAIN = ("article", "main")
_IS_OTHER = ("nav", "header", "footer", "aside", "form", "menu", "button")
_IS_OTHER_NAME = (".ad", ".ads", ".comments", ".comment", ".cookie", ".sidebar")


def self_labelled(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages with a semantic main element, labelled by their own tags."""
    main, other, names = _bits(_IS_MAIN), _bits(_IS_OTHER), _bits(_IS_OTHER_NAME)
    found = [b for b in map(blocks, pages) if any(main & x.tags for x in b)]
    return found, [np.asarray([float(bool(main & x.tags) and not other & x.tags and not names & x.names) for x in b], np.float32) for b in found]


def _plainer(page: list[Block], rng: np.random.Generator, how: int) -> list[Block]:
    """The page as it is; with some names dropped; with semantic elements made div; with both."""
    if not how:
        return page
    semantic, div = _bits((*_IS_MAIN, *_IS_OTHER, "section")), _bits(("div",))
    bits = np.frombuffer(rng.bytes(PATH_SPACE // 8), np.uint8)
    kept = int.from_bytes(bits.tobytes(), "little") if rng.random() < 0.7 else 0
    out = []
    for b in page:
        t = b.tags & ~semantic | div if how > 1 and b.tags & semantic else b.tags
        out.append(Block(t, b.names & kept if how % 2 else b.names, b.depth, b.text, b.linked))
    return out


def train(sample: list[str], steps: int = STEPS, seed: int = 23) -> Labeller:
    """Adam over batches of windows of generated and self-labelled pages, in plainer forms as well,
    so that structure and words are learnt and not some tag."""
    rng = np.random.default_rng(seed)
    data = []
    for page, y in (x for pages, labels in (training_pages(), self_labelled(sample)) for x in zip(pages, labels)):
        for a in range(0, len(page), TRAIN_BLOCKS):
            part = _plainer(page, rng, int(rng.integers(0, 4)))
            listed, path_of, words, counts = vectors(part)
            used, of_part = np.unique(path_of[a : a + TRAIN_BLOCKS], return_inverse=True)
            data.append((([listed[k] for k in used], of_part, words[a : a + TRAIN_BLOCKS], counts[a : a + TRAIN_BLOCKS]), y[a : a + TRAIN_BLOCKS]))
    net = Labeller()
    moments: dict[tuple[int, str], list[np.ndarray]] = {}
    for step in range(1, steps + 1):
        batch = [data[k] for k in rng.integers(0, len(data), 32)]
        for owner, name, g in net.learn([b[0] for b in batch], [b[1] for b in batch]):
            m = moments.setdefault((id(owner), name), [np.zeros_like(g), np.zeros_like(g)])
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            rate = 0.015 * min(1.0, 2 * (1 - step / (steps + 1)))
            move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
            setattr(owner, name, (getattr(owner, name) - move).astype(np.float32))
    return net


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page. A page without markup around any of its text has nothing but its text."""
    parsed = [blocks(p) for p in pages]
    probabilities = net.probabilities([vectors(p) for p in parsed])
    plain = [not any(b.tags for b in page) for page in parsed]
    return [" ".join(b.text for b, p in zip(page, ps) if whole or p >= 0.5) for page, ps, whole in zip(parsed, probabilities, plain)]


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html, or one without main text, gives an empty text. Every page is parsed and
    labelled whole, on its own; repeated rows agree, null identifiers pass through and no row gives
    no row. Only page_id, url and html are read, so other columns may have any names. Memory grows
    with the blocks of the longest page, about 500 bytes each.
    """
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = sample_rows(slim.where("html is not null").select("page_id", "html"), "html", sample_pages, sample_bytes, "pages")
    net = train([r.html for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = main_texts(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
