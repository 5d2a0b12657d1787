"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import ship_package
from fieldloom.llm.html_training import labelled_pages

#: Elements open at a time, at most; deeper ones are text of the deepest, as browsers do it.
DEEPEST = 512
#: Labelled pages that the model is fitted on.
TRAINING_PAGES = 600
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
#: Tags of a page whose quotes may turn out not to be closed; after them quotes no longer hide a tag's end.
UNCLOSED = 16
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page: it ends with their closing tag, or, where there is none, with the page.
RAW = frozenset("script style template textarea title iframe".split())
#: Their content goes too, but without a closing tag they are as good as not there.
DRAWN = frozenset("svg select".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)


class _Open:
    """An open element: its tag and the features of it and all its ancestors."""

    __slots__ = ("tag", "features")

    def __init__(self, tag: str, attributes: str, parent: _Open | None):
        own = {f"in:{tag}"}
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                own.update(f"of:{t}" for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower()))
        self.tag = tag
        self.features = own if parent is None else parent.features if own <= parent.features else parent.features | own


class Scanner:
    """The tags of a page, found in time that grows with its length however broken it is.

    What was looked for in vain is not looked for again further on: no closing tag, no closing quote and no end of a tag
    turns up later in the page if there is none from here on.
    """

    def __init__(self, page: str):
        self.page, self.last, self.unclosed = page, page.rfind(">"), 0
        self.gone: set[str] = set()

    def tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the first tag, comment or declaration from here on; the last two have no name."""
        page = self.page
        while True:
            i = page.find("<", at)
            if i < 0:
                return None
            if page.startswith("<!--", i):
                e = page.find("-->", i + 4)
                return i, len(page) if e < 0 else e + 3, False, "", ""
            if i >= self.last:
                # no tag ends, but a comment may still begin
                at = page.find("<!--", i)
                if at < 0:
                    return None
                continue
            c = page[i + 1]
            if c in "!?":
                return i, page.index(">", i) + 1, False, "", ""
            closing = c == "/"
            m = _NAME.match(page, i + 1 + closing)
            if m:
                e = self._end(m.end())
                if e >= 0:
                    return i, e + 1, closing, m[0].lower(), page[m.end() : e]
            at = i + 1

    def _end(self, at: int) -> int:
        page, i = self.page, at
        while self.unclosed < UNCLOSED:
            m = _STOP.search(page, i)
            if m is None or (m[0] != ">" and (m[0] in self.gone or page.find(m[0], m.end()) < 0)):
                if m is not None:
                    self.gone.add(m[0])
                self.unclosed += 1
                break
            if m[0] == ">":
                return m.start()
            i = page.find(m[0], m.end()) + 1
        return page.find(">", at)

    def after_closing(self, tag: str, at: int) -> int:
        """Where the closing tag's end is, or -1."""
        if f"/{tag}" in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if m is None:
            self.gone.add(f"/{tag}")
            return -1
        return m.end()


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks: runs of text between the borders of block elements, white space made one space."""
    out: list[Block] = []
    stack = [_Open("html", "", None)]
    parts: list[str] = []
    linked = 0  # characters inside links

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(_block(text, stack, linked))
            parts.clear()
        linked = 0

    at, scanner, depth = 0, Scanner(page), Counter(["html"])
    while at < len(page):
        found = scanner.tag(at)
        if found is None:
            parts.append(page[at:])
            break
        start, end, closing, tag, attributes = found
        if start > at:
            parts.append(page[at:start])
            if any(o.tag == "a" for o in stack[-3:]):
                linked += start - at
        at = end
        if not tag:
            continue
        if closing:
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            if depth[tag] and tag != "html":
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if any(o.tag not in INLINE for o in stack[k:]):
                    flush()
                depth.subtract(o.tag for o in stack[k:])
                del stack[k:]
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW or tag in DRAWN:
            flush()
            closed = -1 if attributes.endswith("/") else scanner.after_closing(tag, at)
            if closed >= 0:
                at = closed
            elif tag in RAW and not attributes.endswith("/"):
                break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            before = len(stack)
            ended = _close_implied(stack, tag)
            if len(stack) < before:
                depth.subtract(ended)
        if tag not in VOID and (tag not in INLINE or not attributes.endswith("/")):
            if len(stack) < DEEPEST:
                stack.append(_Open(tag, attributes, stack[-1]))
                depth[tag] += 1
    flush()
    return out


def _close_implied(stack: list[_Open], tag: str) -> list[str]:
    """A block begins: it ends an open paragraph, and an item ends the one before it. Returns the tags that end."""
    gone: list[str] = []
    k = len(stack) - 1
    while k > 0 and stack[k].tag in INLINE:
        k -= 1
    if k > 0 and stack[k].tag == "p":
        gone += [o.tag for o in stack[k:]]
        del stack[k:]
    if tag in _CLOSES:
        ended, within = _CLOSES[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                break
            if stack[k].tag in ended.split():
                gone += [o.tag for o in stack[k:]]
                del stack[k:]
                break
    return gone


def _block(text: str, stack: list[_Open], linked: int) -> Block:
    k = len(stack) - 1
    while k > 0 and stack[k].tag in INLINE:
        k -= 1
    words = text.count(" ") + 1
    share = min(3, 4 * linked // (len(text) + 1))
    f = [f"tag:{stack[k].tag}", f"words:{min(7, words.bit_length())}", f"links:{share}", "ends" if text[-1] in ".!?:;" else "open"]
    if text[0] == "©" or "©" in text[:80]:
        f.append("copyright")
    if "|" in text and words < 20:
        f.append("bars")
    return Block(text, [*stack[-1].features, *f])


@dataclass
class Field:
    """weights: of the article state, by feature; change[i][j]: from state i to j; begin: of a page that begins in the article."""

    weights: dict[str, float]
    change: tuple[tuple[float, float], tuple[float, float]]
    begin: float

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest states, by Viterbi; ties are no article."""
        if not blocks:
            return []
        get, cache = self.weights.get, {}
        (c00, c01), (c10, c11) = self.change
        s0, s1, back = 0.0, self.begin, []
        for n, b in enumerate(blocks):
            e = 0.0
            for x in b.features:
                if x not in cache:
                    cache[x] = get(x, 0.0)
                e += cache[x]
            if n:
                f0, f1 = s1 + c10 > s0 + c00, s1 + c11 > s0 + c01
                back.append((f0, f1))
                s0, s1 = (s1 + c10 if f0 else s0 + c00), (s1 + c11 if f1 else s0 + c01) + e
            else:
                s1 += e
        state = s1 > s0
        out = [state]
        for f0, f1 in reversed(back):
            state = f1 if state else f0
            out.append(state)
        return out[::-1]


def fit_field(pages: list[tuple[list[Block], list[bool]]], epochs: int = 120, shrink: float = 0.02, least: int = 3) -> Field:
    """Maximise the conditional likelihood of the labels, less a quadratic penalty, by forward-backward sums and Adam."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for blocks, _ in pages:
        for b in blocks:
            for f in b.features:
                seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= least)
    place = {f: k for k, f in enumerate(names)}
    n, t = len(pages), max(len(b) for b, _ in pages)
    x, y, on = np.zeros((n, t, len(names)), np.float32), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (blocks, labels) in enumerate(pages):
        on[i, : len(blocks)] = True
        y[i, : len(blocks)] = labels
        for j, b in enumerate(blocks):
            x[i, j, [place[f] for f in b.features if f in place]] = 1
    total = int(on.sum())
    p = np.zeros(len(names) + 5)
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, epochs + 1):
        w, c, begin = p[:-5], p[-5:-1].reshape(2, 2), p[-1]
        e = np.stack([np.zeros((n, t)), x @ w.astype(np.float32)], 2)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = e[:, 0] + [0, begin]
        for k in range(1, t):
            a[:, k] = np.where(on[:, k, None], np.logaddexp(a[:, k - 1, :1] + c[0], a[:, k - 1, 1:] + c[1]) + e[:, k], a[:, k - 1])
        for k in range(t - 2, -1, -1):
            z = e[:, k + 1] + b[:, k + 1]
            b[:, k] = np.where(on[:, k + 1, None], np.stack([np.logaddexp(z[:, 0] + c[i, 0], z[:, 1] + c[i, 1]) for i in (0, 1)], 1), 0)
        whole = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        one = np.exp(a[:, :, 1] + b[:, :, 1] - whole[:, None]) * on
        miss = (y - one) * on
        g = np.zeros_like(p)
        g[:-5] = np.tensordot(miss.astype(np.float32), x, 2)
        pair = on[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                q = np.exp(a[:, :-1, i] + c[i, j] + e[:, 1:, j] + b[:, 1:, j] - whole[:, None]) * pair
                g[-5 + 2 * i + j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() - q.sum()
        g[-1] = miss[:, 0].sum()
        g = g / total - shrink * p / total
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(v) for f, v in zip(names, p[:-5])}, ((float(p[-5]), float(p[-4])), (float(p[-3]), float(p[-2]))), float(p[-1]))


def aligned(page: str, truth: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """The page's blocks with the labels of a labelled page, whose blocks they must equal."""
    blocks = blocks_of(page)
    if [b.text for b in blocks] != [t for t, _ in truth]:
        raise ValueError("blocks and labels differ")
    return blocks, [main for _, main in truth]


_fitted: dict[int, Field] = {}


def fitted(pages: int = TRAINING_PAGES) -> Field:
    if pages not in _fitted:
        _fitted[pages] = fit_field([aligned(*p) for p in labelled_pages(pages)])
    return _fitted[pages]


def extract(page: str, model: Field) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, main in zip(blocks, model.decode(blocks)) if main)


def main_text(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html): the article, whole.

    Null and empty pages, and pages without an article, have an empty text; null ids and urls stay null; repeated
    rows are rows of their own; an empty table gives none.
    """
    ship_package(pages.sparkSession)
    model = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            text = [extract(h.as_py() or "", model) for h in rb.column(2)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
