"""Main text of web pages: a recurrent labeller over the sequence of a page's text blocks."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_each

#: At most this many pages, those with the smallest hash of their page_id, are learned from.
MAX_TRAINING_PAGES = 240
MADE_UP_PAGES = 1600
#: Widths of the hashed vectors of tag paths and words, of the other inputs, and of each direction's state.
PATH, WORD, OTHER, STATE = 64, 8, 14, 24
TABLE = 4096

#: Elements that end a block, whose content no reader sees (RAW holds characters, HIDDEN tags), and that have no content.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = "script|style|noscript|template|textarea|iframe|title"
HIDDEN = set("svg math select object canvas".split())
#: Elements in which "/>" ends an element, and those in them in which it does not.
FOREIGN, HTML_AGAIN = ("svg", "math"), ("foreignobject", "desc")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: HTML's elements for parts of a page that are not its main text.
ASIDE_TAGS = set("nav aside header footer form button menu dialog label option legend fieldset head".split())

#: Tags, comments and text. A quote opens a quoted value only behind the = of an attribute: elsewhere it is a letter like others.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<more>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text between the edges of block elements, and the tags and names of what it stands in."""

    path: list[str]
    text: str
    link_chars: int = 0
    words: list[str] = field(default_factory=list)


def _tokens(source: str) -> tuple[list[re.Match], set[int]]:
    """The tags and texts of a page without what raw-text elements hold, and which of them open a hidden element.

    A raw-text element runs to its end tag or else to the end of the page; in svg and math it may be empty, and ends
    with them. An element of HIDDEN counts only with an end tag of its own: an unclosed one hides nothing.
    """
    found: list[re.Match] = []
    opened: dict[str, list[int]] = {t: [] for t in HIDDEN}
    closed: set[int] = set()
    foreign: list[str] = []
    ends: dict[str, int] = {}

    def end(name: str) -> int:
        """Where the next end tag of a name starts, or the page's length; searches go on from the last one found."""
        if ends.get(name, -1) < at:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            ends[name] = m.start() if m else len(source)
        return ends[name]

    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m["raw"]:
            close = end(m["raw"].lower())
            if foreign and foreign[-1] in FOREIGN and (m[0].endswith("/>") or close == len(source) or end(foreign[-1]) < close):
                continue
            at = source.find(">", close) + 1 or len(source)
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                if tag in foreign:
                    del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
                if opened.get(tag):
                    closed.add(opened[tag].pop())
            elif tag in FOREIGN or (foreign and tag in HTML_AGAIN):
                if not m["more"].endswith("/"):
                    foreign.append(tag)
                    if tag in HIDDEN:
                        opened[tag].append(len(found))
            elif tag in HIDDEN:
                opened[tag].append(len(found))
            elif tag in BLOCK:
                while foreign and foreign[-1] in FOREIGN:
                    foreign.pop()
            found.append(m)
        elif m["text"]:
            found.append(m)
    return found, closed


def page_blocks(source: str | None) -> list[Block]:
    """The text blocks of a page in order, with character references decoded and white space as single spaces."""
    stack: list[tuple[str, list[str]]] = []
    found: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = 0
    hidden = None  # where the outermost hidden element is on the stack

    def flush() -> None:
        nonlocal parts, link_parts
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                found.append(Block([t for _, names in stack for t in names], " ".join(words), len("".join(link_parts)), words))
            parts, link_parts = [], []

    tokens, hides = _tokens(source or "")
    for n, m in enumerate(tokens):
        text = m["text"]
        if text is not None:
            if hidden is None:
                parts.append(text)
                if in_link:
                    link_parts.append(text)
            continue
        tag = m["tag"].lower()
        if hidden is None:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            if tag == "br":
                parts.append(" ")
        if n in hides:
            hidden = len(stack) if hidden is None else hidden
            stack.append((tag, []))
        if tag not in BLOCK and not (tag in HIDDEN and m["close"]):
            continue
        if m["close"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), len(stack))
            if hidden is not None and k <= hidden:
                del stack[hidden:]
                hidden = None
            if hidden is None and tag in BLOCK:
                flush()
            del stack[k:]
            continue
        if hidden is None:
            flush()
        if tag not in VOID and not m["more"].endswith("/"):
            while stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                stack.pop()
            names = [p for g in NAMES.findall(m["more"]) for p in NAME_PARTS.findall("".join(g).lower())]
            stack.append((tag, [tag, *("." + n for n in names)]))
            if hidden is None:
                in_link = 0
    flush()
    return found


def semantic_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that says itself what its parts are: main text is what stands in an article or main element and in
    none of HTML's elements for other parts. Names of classes are not looked at. None where a page has no such element."""
    if not any("article" in b.path or "main" in b.path for b in blocks):
        return None
    return np.array([float(("article" in b.path or "main" in b.path) and not any(t in ASIDE_TAGS for t in b.path)) for b in blocks])


MARK = "\ue000"


def marked(blocks: list[Block]) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made-up page without the marks on its main text, and their labels."""
    labels = np.array([float(MARK in b.text) for b in blocks])
    plain = [Block(b.path, " ".join(w for w in (w.replace(MARK, "") for w in b.words) if w), b.link_chars - b.text.count(MARK) * bool(b.link_chars), [w for w in (w.replace(MARK, "") for w in b.words) if w]) for b in blocks]
    keep = [k for k, b in enumerate(plain) if b.text]
    return [plain[k] for k in keep], labels[keep]


class Maker:
    """Made-up pages whose main text is known, as it is marked when written: many layouts, and containers whose names are
    telling, random or missing, so that a part must be known by what it looks like and stands next to."""

    def __init__(self, seed: int, telling: float = 0.5):
        self.rng, self.telling = np.random.default_rng(seed), telling
        letters = np.array(list("abcdefghijklmnoprstuvwy"))
        self.words = ["".join(letters[self.rng.integers(0, len(letters), k)]) for k in self.rng.integers(2, 9, 6000)]

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return self.words[self.rng.integers(len(self.words))]

    def say(self, low: int, high: int, stop: str = ".") -> str:
        words = [self.words[k] for k in self.rng.integers(0, len(self.words), self.rng.integers(low, high + 1))]
        for k in range(6, len(words) - 2, int(self.rng.integers(6, 15))):
            words[k] += self.pick(",", ".", ".")
            if words[k][-1] == ".":
                words[k + 1] = words[k + 1].capitalize()
        return " ".join(words).capitalize() + stop

    def box(self, inner: str, names: str, tags: tuple = ("div",)) -> str:
        tag = self.pick(*tags)
        if tag in ASIDE_TAGS and self.chance(0.6):
            return f"<{tag}>{inner}</{tag}>"
        if tag in ASIDE_TAGS:
            tag = self.pick("div", "section", "ul" if inner.startswith("<li") else "div")
        if self.chance(self.telling):
            name = f' {self.pick("class", "id", "class")}="{self.pick(*names.split())}{self.pick("", "", "-wrap", " box", "-list", "__inner")}"'
        else:
            name = self.pick("", f' class="{self.word()}"', f' class="{self.word()}-{self.word()}"', f' id="{self.word()}"')
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, low: int, high: int, words: int = 2) -> str:
        items = [f'<a href="/{self.word()}">{self.say(1, words, "")}</a>' for _ in range(self.rng.integers(low, high + 1))]
        return self.pick("<ul>" + "".join(f"<li>{i}" + self.pick("", "</li>") for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items), " ".join(items))

    def menu(self) -> str:
        return self.box(self.links(3, 9), "nav menu navbar topbar navigation toolbar tabs crumbs breadcrumb", ("nav", "div", "header", "section"))

    def banner(self) -> str:
        inner = f"<{(t := self.pick('h1', 'div', 'p', 'a'))}>{self.say(1, 3, '')}</{t}>" + self.pick("", f"<p>{self.say(2, 6, '')}</p>", self.links(2, 5))
        return self.box(inner, "header masthead top brand topbar site-head logo", ("header", "div"))

    def side(self) -> str:
        return self.box(f"<h3>{self.say(1, 3, '')}</h3>" + self.pick(self.links(2, 7, 7), f"<p>{self.say(6, 25)}</p>", f"<ul>{''.join(f'<li>{self.say(2, 7, chr(8230))}' for _ in range(4))}</ul>"), "sidebar aside widget related recommended popular rail", ("aside", "div", "section"))

    def advert(self) -> str:
        return self.box(self.pick(self.say(4, 18), f"<p>{self.say(4, 18)}</p>", f"<a href='/x'>{self.say(3, 9, '!')}</a> {self.say(2, 6, '!')}"), "ad ads advert banner sponsor promo sponsored", ("div", "section", "aside"))

    def notice(self) -> str:
        words = self.pick("We use cookies", "This site uses cookies to", "Accept our terms and", "Subscribe to our newsletter", "Sign up for", "Wir verwenden Cookies", "Nous utilisons des cookies", "Usamos cookies")
        return self.box(f"<p>{words} {self.say(3, 14)}</p>" + self.pick("<button>OK</button>", "<a href='#'>Accept</a>", ""), "cookie consent notice gdpr newsletter modal popup subscribe", ("div", "section"))

    def form(self) -> str:
        return f"<form>{self.pick(f'<label>{self.say(1, 2, chr(58))}</label>', f'<p>{self.say(2, 6)}</p>', '')}<input><button>{self.say(1, 2, '')}</button></form>"

    def share(self) -> str:
        return self.box(self.pick("Share", "Tweet", "Print", "Teilen", "Partager") + " " + self.links(2, 4, 1), "share social tags meta byline tools", ("div", "p", "ul"))

    def comments(self) -> str:
        who = lambda: self.word().capitalize() + self.pick("", " " + self.word().capitalize())
        when = lambda: self.pick(f"{self.rng.integers(1, 28)} {self.pick('Jan', 'May', 'Juli', 'mars')} 20{self.rng.integers(10, 27)}", f"{self.rng.integers(2, 50)} {self.pick('hours', 'days', 'minutes')} ago", f"20{self.rng.integers(10, 27)}-0{self.rng.integers(1, 9)}-1{self.rng.integers(0, 9)}", f"vor {self.rng.integers(2, 9)} Tagen", "")
        tag, style = self.pick("div", "li", "div", "article", "section"), self.rng.integers(4)
        text = lambda: "".join(f"<p>{self.say(3, 40, self.pick('.', '!', '?', ''))}</p>" for _ in range(self.pick(1, 1, 2)))
        reply = self.pick("Reply", "Antworten", "Répondre", "Responder", "Like", "")
        one = [
            lambda: f"<b>{who()}</b> {when()}{text()}", lambda: f"<p>{who()} {self.pick('says', 'wrote', 'schrieb', 'dit')}:</p>{text()}",
            lambda: f"<div>{who()}</div><div>{when()}</div>{text()}<a href='#'>{reply}</a>", lambda: f"<p>{who()}: {self.say(4, 30)}</p>",
        ][style]
        head = self.pick("", f"<h3>{self.rng.integers(1, 90)} {self.pick('Comments', 'Responses', 'Kommentare', 'commentaires', 'Comentarios', 'Opinions')}</h3>", f"<h2>{self.pick('Comments', 'Discussion', 'Kommentare', 'Leave a reply', 'What readers say')}</h2>")
        items = [f'<{tag}{self.pick("", f" class={chr(34)}{self.word()}{chr(34)}")}>{one()}</{tag}>' for _ in range(self.rng.integers(1, 6))]
        name = "comments comment responses disqus respond replies discussion feedback talk opinions thread reader-comments"
        return self.box(head + "".join(items) + self.pick("", "", self.form()), name, ("div", "section"))

    def footer(self) -> str:
        own = f"&copy; {self.pick('', '2021 ', '2024 ')}{self.say(1, 6)}" + self.pick("", f" &middot; {self.say(3, 12)}")
        inner = self.pick(own, f"<p>{own}</p>", f"<p>{own}</p>{self.links(2, 5)}", f"{self.links(3, 6)}<div>{own}</div>", f"{own}<address>{self.say(3, 7)}</address>")
        return self.box(inner, "footer foot bottom copyright legal imprint", ("footer", "div"))

    def main(self) -> str:
        m, text = MARK, lambda *a: MARK + self.say(*a)
        parts = [self.pick(f"<h1>{text(3, 9, '')}</h1>", f"<h2>{text(3, 9, '')}</h2>", f"<div>{text(3, 9, '')}</div>", "")]
        par = self.pick("p", "p", "p", "div")
        for _ in range(self.rng.integers(1, 11)):
            parts.append(
                self.pick(
                    *[f"<{par}>{text(8, 80)}</{par}>"] * 6, f"<{par}>{text(2, 9)}</{par}>", f"<p><b>{text(6, 20)}<br>{self.say(3, 9)}", f"<h2>{text(1, 5, '')}</h2><{par}>{text(9, 50)}</{par}>",
                    f"<ul><li>{text(2, 9)}</li><li>{text(2, 9)}</li></ul>", f"<blockquote>{text(6, 30)}</blockquote>", f"<pre>{text(3, 9, '')}</pre>",
                    f"<{par}>{text(2, 9, '')} <a href='/x'>{self.say(1, 3, '')}</a> {self.say(4, 30)}</{par}>", f"<table><tr><td>{text(1, 3, '')}<td>{m}{self.rng.integers(1, 99)}</tr></table>", f"<figure><figcaption>{text(3, 9)}</figcaption></figure>",
                )
            )
            if self.chance(0.08):
                parts.append(self.pick(self.advert, self.share, self.side, self.menu, self.notice)())
        if self.chance(0.25):
            parts.append(self.pick(self.comments, self.comments, self.share)())
        inner = "".join(parts)
        frame = self.pick("article", "main", "box", "box", "box", "bare")
        if frame == "bare":
            return inner
        if frame == "box":
            return self.box(inner, "content entry post story text body article page main single-post entry-content post-body", ("div", "section", "div"))
        return f"<{frame}{self.pick('', f' class={chr(34)}{self.word()}{chr(34)}')}>{inner}</{frame}>"

    def page(self) -> str:
        top = [self.pick(self.menu, self.menu, self.banner, self.advert, self.notice, self.side, self.form)() for _ in range(self.rng.integers(0, 4))]
        after = [self.pick(self.side, self.advert, self.menu, self.notice, self.form, self.share)() for _ in range(self.rng.integers(0, 3))]
        if self.chance(0.35):
            after.insert(0, self.comments())
        end = [self.footer()] if self.chance(0.85) else []
        inner = "".join([*top, self.main(), *after, *end])
        if self.chance(0.3):
            inner = f'<div{self.pick("", f" class={chr(34)}{self.word()}{chr(34)}", " id=wrapper")}>{inner}</div>'
        return f"<html><head><title>{self.say(2, 6, '')}</title></head><body>{inner}</body></html>"


def practice(count: int, seed: int = 5, telling: float = 0.5) -> list[tuple[list[Block], np.ndarray]]:
    """The blocks and labels of made-up pages."""
    maker = Maker(seed, telling)
    pages = [marked(page_blocks(maker.page())) for _ in range(count)]
    return [p for p in pages if p[0]]


def _vectors(width: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).standard_normal((TABLE, width)) / np.sqrt(width) * 2).astype(np.float32)


def _means(lists: list[list[str]], table: np.ndarray, total: bool) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) & (TABLE - 1) for x in lists for t in x), np.int64, int(sizes.sum()))
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(table[ids], (np.cumsum(sizes) - sizes)[some], axis=0)
        out[some] = sums if total else sums / sizes[some, None]
    return out


def inputs(blocks: list[Block], paths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The input vectors of blocks: hashed tag path, hashed words (all of them), and a few measures."""
    chars, n = np.array([len(b.text) for b in blocks], np.float32), len(blocks)
    share = lambda f: np.array([f(b) / max(1, len(b.text)) for b in blocks], np.float32)
    seen = Counter(tuple(b.path) for b in blocks)
    other = np.stack(
        [
            np.log1p(chars) / 5,
            np.minimum(1, share(lambda b: b.link_chars)),
            np.array([b.text[-1] in ".!?:;\"'" for b in blocks], np.float32),
            np.array([len(b.path) / 10 for b in blocks], np.float32),
            np.array([b.path[-1][0] == "." if b.path else 0 for b in blocks], np.float32),
            np.ones(n, np.float32),
            np.log1p(np.array([seen[tuple(b.path)] for b in blocks], np.float32)) / 3,
            np.arange(n, dtype=np.float32) / max(1, n - 1),
            np.minimum(1, 5 * share(lambda b: sum(map(b.text.count, "0123456789")))),
            np.minimum(1, 20 * share(lambda b: b.text.count(",") + b.text.count("."))),
            np.array([any(t in ("h1", "h2", "h3", "h4") for t in b.path[-2:]) for b in blocks], np.float32),
            np.array(["\u00a9" in b.text for b in blocks], np.float32),
            np.array([":" in b.text[-2:] or "|" in b.text for b in blocks], np.float32),
            np.minimum(1, np.array([len(b.words) for b in blocks], np.float32) / 12),
        ],
        axis=1,
    )
    return np.concatenate([_means([sorted(set(b.path)) for b in blocks], paths, True), _means([b.words for b in blocks], words, False), other], axis=1)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pages])
    out = np.zeros((size.max(), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        out[: len(p), k] = p
    return out, (np.arange(size.max())[:, None] < size[None, :]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output at every block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng, width = np.random.default_rng(seed), PATH + WORD + OTHER
        self.w = weights or {
            **{f"{d}{n}": (rng.standard_normal(s) * 0.15).astype(np.float32) for d in "fb" for n, s in (("x", (width, 4 * STATE)), ("h", (STATE, 4 * STATE)), ("c", (4 * STATE,)))},
            "o": (rng.standard_normal((2 * STATE, 1)) * 0.2).astype(np.float32),
            "p": np.zeros(1, np.float32),
        }

    def _run(self, x: np.ndarray, there: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        steps, batch, _ = x.shape
        h, c = np.zeros((batch, STATE), np.float32), np.zeros((batch, STATE), np.float32)
        pre, hs, kept = x @ self.w[way + "x"] + self.w[way + "c"], np.zeros((steps, batch, STATE), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.w[way + "h"]
            gates = _sigmoid(a[:, : 3 * STATE])
            i, f, o, g = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :], np.tanh(a[:, 3 * STATE :])
            m = there[t][:, None]
            c_new = m * (f * c + i * g)
            tc = np.tanh(c_new)
            kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc), c_new
            hs[t] = h
        return hs, kept

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of every block of every page to be main text."""
        out: list = [np.empty(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            most = max(1, 20_000 // max(1, len(pages[order[min(len(order), 128) - 1]])))
            part, order = order[: min(128, most)], order[min(128, most) :]
            x, there = _padded([pages[k] for k in part])
            both = np.concatenate([self._run(x, there, "f")[0], self._run(x, there, "b")[0]], axis=2)
            p = _sigmoid(both @ self.w["o"] + self.w["p"])[:, :, 0]
            for j, k in enumerate(part):
                out[k] = p[: len(pages[k]), j]
        return out

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(x, there, way) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        d = (_sigmoid(both @ self.w["o"] + self.w["p"])[:, :, 0] - y) * there / max(1.0, there.sum())
        grads = {"o": np.einsum("tbh,tb->h", both, d)[:, None], "p": np.array([d.sum()], np.float32)}
        for way, cut in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            dh_out = d[:, :, None] * self.w["o"][cut, 0]
            gh, da_all = np.zeros_like(self.w[way + "h"]), np.zeros((*x.shape[:2], 4 * STATE), np.float32)
            dh, dc = np.zeros((x.shape[1], STATE), np.float32), np.zeros((x.shape[1], STATE), np.float32)
            for t, h0, c0, i, f, o, g, tc, m in reversed(runs[way][1]):
                dh = (dh + dh_out[t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                da = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                da_all[t], gh, dc, dh = da, gh + h0.T @ da, dc * f, da @ self.w[way + "h"].T
            grads |= {way + "h": gh, way + "x": np.einsum("tbd,tba->da", x, da_all, optimize=True), way + "c": da_all.sum(axis=(0, 1))}
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, rate: float = 0.01, seed: int = 1) -> "Labeller":
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        groups = [order[a : a + 24] for a in range(0, len(order), 24)]
        m, v, n = {k: 0 for k in self.w}, {k: 0 for k in self.w}, 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, there = _padded([pages[k] for k in groups[g]])
                y = _padded([labels[k][:, None] for k in groups[g]])[0][:, :, 0]
                n += 1
                step = rate * (0.3 if epoch > epochs * 0.7 else 1)
                for k, d in self.gradients(x, there, y).items():
                    d = np.clip(d, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.w[k] = (self.w[k] - step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self


def train(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> dict[str, np.ndarray]:
    """Weights of a labeller learned by one task from a bounded sample of the pages, as far as they label themselves, and
    from made-up ones."""
    names = sorted(Labeller().w)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(b, y) for b in (page_blocks(h) for h in pdf.sort_values("page_id")["html"]) if b and (y := semantic_labels(b)) is not None]
        model = fitted(own + practice(MADE_UP_PAGES))
        return pd.DataFrame({n: [model.w[n].tobytes()] for n in names})

    sample = pages.where("page_id is not null").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    ids = sample.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    chosen = one_each(sample.join(F.broadcast(ids), "page_id", "left_semi"), "page_id", "html").withColumn("one", F.lit(0))
    row = chosen.groupBy("one").applyInPandas(learn, ", ".join(f"{n} binary" for n in names)).head()
    plain = Labeller().w
    return {n: np.frombuffer(row[n], np.float32).reshape(plain[n].shape).copy() for n in names} if row else plain


def fitted(pages: list[tuple[list[Block], np.ndarray]]) -> Labeller:
    """A labeller that has learned from blocks and their labels."""
    tables = _vectors(PATH, 11), _vectors(WORD, 12)
    return Labeller().fit([inputs(b, *tables) for b, _ in pages], [y for _, y in pages])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (main blocks in page order, one newline between), n_chars.

    A page's blocks are labelled together, so each is judged with all the others in view. Null and empty pages, and
    pages without main text, give the empty text; repeated rows get a row each; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train(pages))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tables = Labeller(sent.value), (_vectors(PATH, 11), _vectors(WORD, 12))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                blocks = [page_blocks(h) for h in part["html"]]
                scores = model.scores([inputs(b, *tables) if b else np.empty((0, PATH + WORD + OTHER), np.float32) for b in blocks])
                texts = ["\n".join(b.text for b, p in zip(page, s) if p >= 0.5) for page, s in zip(blocks, scores)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]}).astype({"page_id": "Int64"})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
