"""The main text of web pages, by a recurrent labeller of leaf blocks.

A page is read as the sequence of its leaf blocks: runs of text between block-level tags, with the
path of open elements above them. Each block enters as the mean of hashed path vectors (element
names, words of class, id and role), the mean of hashed word vectors, and a few numbers. A
bidirectional long short-term memory reads all blocks of the page and labels every one, so each
label knows the whole page. Blocks labelled as text are joined in page order.

The network is trained in numpy on the driver on a bounded sample of pages (``SAMPLE``; of a page of
more than ``LONGEST`` characters it learns from the first and the last half as many). Nothing
marks the truth there, so pages teach by their plain cases: blocks under ``article`` or ``main``
are text unless a part of the page with a name like those in ``ASIDE`` holds them. Besides, their
paragraphs are set anew into generated pages with other containers and parts around and between.

Defined results: null or empty html gives an empty text; a page without text blocks too; unclosed
elements end where HTML ends them, an unclosed script, style, comment or tag at the end of the page; a
quote that does not follow an equals sign, or that no other follows, is a character like any; of
paths deeper than ``OUTER + INNER`` elements the labeller reads both ends;
repeated rows are treated alike; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.nets import Adam, lstm, lstm_back, sigmoid
from paperloom.llm.tables import sampled
from paperloom.llm.words import hash_words, pieces

SAMPLE, LONGEST = 300, 60_000
HIDDEN, PATH, WORD, BUCKETS, NUMBERS = 12, 12, 6, 1 << 11, 4
ROUNDS, BATCH = 14, 24
# HTML's elements by how they shape text.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|math"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Names of page parts that are not the text.
ASIDE = frozenset(
    "nav header footer aside form head title button select textarea menu sidebar ad ads advert advertisement banner cookie notice consent "
    "comment comments respond reply related share social promo sponsored breadcrumb breadcrumbs pagination pager subscribe newsletter login "
    "signup copyright legal widget popup modal toolbar tags meta".split()
)
_TEXT = frozenset("article main".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_NAME, _EQUALS, _VALUE = re.compile(r"[\s/]*(=?[^\s/>=]*)"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_MARKS = frozenset(("class", "id", "role"))
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW.split("|")}
# Elements that hold no markup and end with the page if not before.
_ENDLESS = frozenset(("script", "style"))
# Open elements that a block's path names, outermost and innermost, and words of one element's marks.
OUTER, INNER, MARKS = 16, 16, 16
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    links: int


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, list[str]]:
    """Where the tag ends whose attributes begin at ``at``, and the values of its class, id and role.

    A quote opens a string right after an equals sign only, and only if another one follows in the
    page (``last`` has the place of each kind's last one); else a value ends at white space or ``>``.
    """
    marks: list[str] = []
    while at < len(page):
        m = _NAME.match(page, at)
        at, name = m.end(), m[1]
        if page.startswith(">", at):
            return at + 1, marks
        equals = _EQUALS.match(page, at) if name else None
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in last and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                value = _VALUE.match(page, at)[0]
                at += len(value)
            if name.lower() in _MARKS:
                marks.append(value)
        elif not name:
            at += 1  # an equals sign that no name precedes is part of one, so this is the page's end
    return len(page), marks


def tags(page: str) -> Iterator[tuple[int, int, str, bool, list[str]]]:
    """(start, end, name, closing, marks) of all markup in page order, without a name for what is no element.

    One pass: what an unclosed comment, quote or element looks for is looked for once.
    """
    last = {quote: page.rfind(quote) for quote in "\"'"}
    unclosed: set[str] = set()
    at = 0
    while m := _OPEN.search(page, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = page.find("-->", start + 2)
            at = len(page) if end < 0 else end + 3
        elif m[2]:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        else:
            name, closing = m[4].lower(), bool(m[3])
            at, marks = _attributes(page, at, last)
            if name not in _CLOSE:
                yield start, at, name, closing, marks
                continue
            if not closing and page[at - 2 : at] != "/>" and name not in unclosed:
                end = _CLOSE[name].search(page, at)
                if end:
                    at = end.end()
                elif name in _ENDLESS:
                    at = len(page)
                else:
                    unclosed.add(name)
        yield start, at, "", False, []


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that hold text, references decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    is_open: Counter[str] = Counter()
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            near = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            out.append(Block(text, tuple(w for _, words in near for w in words), min(linked, len(text))))
        linked = 0

    def shut(k: int) -> None:
        flush()
        for name, _ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            linked += len(text) if in_link else 0

    page, at = page or "", 0
    for start, end, name, closing, marks in tags(page):
        add(page[at:start])
        at = end
        if not name:
            continue
        if name in _INLINE:
            if name in ("br", "wbr", "img"):
                held.append(" " if name != "wbr" else "")
            elif name == "a":
                in_link = not closing
            continue
        if closing:
            if is_open[name]:
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            else:
                flush()
            continue
        flush()
        while stack and (stack[-1][0] in _CLOSES_ITSELF.get(name, ()) or stack[-1][0] == "p"):
            is_open[stack.pop()[0]] -= 1
        if name not in _VOID:
            words = islice(_PART.finditer(" ".join(marks).lower()), MARKS)
            stack.append((name, (name, *("." + w[0] for w in words))))
            is_open[name] += 1
    add(page[at:])
    flush()
    return out


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return ((total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]).astype(np.float32)


class Input(NamedTuple):
    """Blocks of several pages: path and word buckets with their counts per block, numbers, and blocks per page."""

    path: np.ndarray
    n_path: np.ndarray
    word: np.ndarray
    n_word: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray


def encode(pages: list[list[Block]]) -> Input:
    flat = [b for page in pages for b in page]
    words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in pieces(pa.array([b.text for b in flat], pa.string())):
        words.append((hash_words(p) % np.uint64(BUCKETS)).astype(np.int64))
        counts.append(p.n_words)
    known: dict[str, int] = {}
    path = [known[w] if w in known else known.setdefault(w, _bucket(w)) for b in flat for w in b.path]
    size = np.array([len(b.text) for b in flat], np.float32)
    n_word = np.concatenate(counts)
    numbers = [np.log1p(size) / 4, np.array([b.links for b in flat], np.float32) / np.maximum(size, 1), np.log1p(n_word) / 4, [b.text[-1] in ".!?…" for b in flat]]
    return Input(
        np.array(path, np.int64),
        np.array([len(b.path) for b in flat], np.int64),
        np.concatenate(words),
        n_word,
        np.stack([np.asarray(x, np.float32) for x in numbers], axis=1) if flat else np.zeros((0, NUMBERS), np.float32),
        np.array([len(p) for p in pages], np.int64),
    )


class Labeller:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        h, width = HIDDEN, PATH + WORD + NUMBERS

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {
            "path": rng.normal(0, 0.5, (BUCKETS, PATH)).astype(np.float32), "word": rng.normal(0, 0.1, (BUCKETS, WORD)).astype(np.float32),
            "ahead": draw(width, 4 * h), "behind": draw(width, 4 * h), "bias": np.zeros(8 * h, np.float32), "u": draw(2 * h, 8 * h),
            "out": draw(2 * h), "skip": draw(width), "out0": np.zeros(1, np.float32),
        }
        side = np.arange(2 * h) // h
        self.block = (side[:, None] == np.tile(side, 4)[None, :]).astype(np.float32)
        self.p["u"] *= self.block

    def vectors(self, x: Input) -> np.ndarray:
        return np.hstack([_means(self.p["path"][x.path], x.n_path), _means(self.p["word"][x.word], x.n_word), x.numbers])

    def _run(self, v: np.ndarray, at: np.ndarray, keep: bool):
        """Logits of blocks ``at`` (pages, steps), -1 for none."""
        steps, there = at.T, (at.T >= 0).astype(np.float32)[:, :, None]
        parts = [np.where(there[::k] > 0, (v @ self.p[n])[steps[::k]], 0).reshape(*steps.shape, 4, 1, HIDDEN) for n, k in (("ahead", 1), ("behind", -1))]
        x = np.concatenate(parts, axis=3).reshape(*steps.shape, 8 * HIDDEN) + self.p["bias"]
        mask = np.concatenate([np.repeat(there, HIDDEN, 2), np.repeat(there[::-1], HIDDEN, 2)], axis=2)
        states, tape = lstm(x, self.p["u"], mask, keep)
        h = np.concatenate([states[:, :, :HIDDEN], states[::-1, :, HIDDEN:]], axis=2)
        logit = h @ self.p["out"] + (v @ self.p["skip"])[steps] + self.p["out0"]
        return logit, there[:, :, 0], h, tape

    def label(self, x: Input, size: int = 20_000) -> np.ndarray:
        """Which blocks are text; pages run in batches of like length and bounded size."""
        v, first, out = self.vectors(x), np.cumsum(x.sizes) - x.sizes, np.zeros(len(x.n_path), bool)
        order = [i for i in np.argsort(x.sizes, kind="stable") if x.sizes[i]]
        while order:
            n = max(1, int(size // x.sizes[order[-1]]))
            part, order = np.array(order[-n:]), order[:-n]
            at = _places(first[part], x.sizes[part])
            logit, there, *_ = self._run(v, at, False)
            out[at.T[there > 0]] = logit[there > 0] >= 0
        return out

    def gradients(self, x: Input, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h2 = self.p, HIDDEN
        v, at = self.vectors(x), _places(np.cumsum(x.sizes) - x.sizes, x.sizes)
        logit, there, h, tape = self._run(v, at, True)
        steps, real = at.T, there > 0
        d = np.where(real, sigmoid(logit) - y[steps], 0).astype(np.float32) / real.sum()
        g = {"out": np.einsum("tb,tbh->h", d, h), "out0": np.array([d.sum()], np.float32)}
        dh = d[:, :, None] * p["out"]
        dx, g["u"] = lstm_back(np.concatenate([dh[:, :, :h2], dh[::-1, :, h2:]], axis=2), p["u"], tape)
        g["u"] = g["u"] * self.block
        g["bias"] = dx.sum(axis=(0, 1))
        dx = dx.reshape(*steps.shape, 4, 2, HIDDEN)
        per_block = np.zeros(len(v), np.float32)
        per_block[steps[real]] = d[real]
        g["skip"], dv = v.T @ per_block, per_block[:, None] * p["skip"]
        for side, name, k in ((0, "ahead", 1), (1, "behind", -1)):
            gates = np.zeros((len(v), 4 * HIDDEN), np.float32)
            gates[steps[::k][real[::k]]] = dx[:, :, :, side][real[::k]].reshape(-1, 4 * HIDDEN)
            g[name] = v.T @ gates
            dv = dv + gates @ p[name].T
        for name, rows, n, cut in (("path", x.path, x.n_path, slice(0, PATH)), ("word", x.word, x.n_word, slice(PATH, PATH + WORD))):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], rows, np.repeat(dv[:, cut] / np.maximum(n, 1)[:, None], n, axis=0))
        return g


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    step = np.arange(max(int(sizes.max()), 1))
    return np.where(step < sizes[:, None], first[:, None] + step, -1)


def _plain_case(b: Block) -> bool:
    names = {w.lstrip(".") for w in b.path}
    return bool(names & _TEXT) and not names & ASIDE


_HOLDERS = ("<article>|</article>", "<main>|</main>", '<div class="content">|</div>', '<div id="post" class="entry-content">|</div>', '<section class="story-body">|</section>', '<div role="main">|</div>')
_PARTS = (
    '<aside class="sidebar"><h3>{0}</h3><p>{1}</p></aside>', '<div class="sidebar"><p>{1}</p></div>', '<div class="cookie-notice"><p>{1}</p></div>',
    '<div class="notice">{1}</div>', '<form action="/s"><label>{0}</label><p>{1}</p><button>{2}</button></form>', '<div class="ad">{1}</div>',
    '<div class="advert sponsored"><p>{1}</p></div>', '<section id="comments"><h2>{0}</h2><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>',
    '<div class="comments"><ul><li>{1}</li><li>{2}</li></ul></div>', '<ul class="menu"><li><a href="/a">{0}</a></li><li><a href="/b">{2}</a></li></ul>',
    '<div class="related"><ul><li><a href="/c">{1}</a></li></ul></div>', '<div class="share"><a href="/d">{0}</a></div>', '<header><p>{0}</p></header>',
    '<div class="banner"><p>{1}</p></div>', '<div class="newsletter subscribe"><p>{1}</p></div>', '<nav class="breadcrumb"><a href="/e">{0}</a></nav>',
)


def generated(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page of known parts around given paragraphs, with the truth for each block."""
    marked = []

    def say(limit: int, truth: bool) -> str:
        words = texts[rng.integers(len(texts))].split()
        at = rng.integers(max(len(words) - limit, 0) + 1)
        marked.append((f"{len(marked)}⁣", truth))
        return entities.escape(marked[-1][0] + " ".join(words[at : at + limit]))

    def part() -> str:
        return _PARTS[rng.integers(len(_PARTS))].format(say(4, False), say(int(rng.integers(4, 60)), False), say(12, False))

    a, z = _HOLDERS[rng.integers(len(_HOLDERS))].split("|")
    body = [f"<h1>{say(8, True)}</h1>"]
    for _ in range(rng.integers(1, 9)):
        kind = rng.integers(10)
        limit = int(rng.integers(2, 120))
        body.append({0: "<h2>{}</h2>", 1: "<ul><li>{}</li></ul>", 2: "<blockquote>{}</blockquote>", 3: "<div>{}</div>"}.get(int(kind), "<p>{}</p>").format(say(limit, True)))
        if rng.random() < 0.15:
            body.append(part())
    before, after = ("".join(part() for _ in range(rng.integers(0, 4))) for _ in range(2))
    page = f"<html><head><title>{say(6, False)}</title></head><body>{before}{a}{''.join(body)}{z}{after}<footer>{say(10, False)}</footer></body></html>"
    truth = dict(marked)
    found = blocks(page)
    y = [truth[b.text.split("⁣")[0] + "⁣"] for b in found]
    return [b._replace(text=b.text.split("⁣", 1)[1].lstrip() or "-") for b in found], y


def fit(pages: list[str]) -> Labeller:
    """Trains on the plain cases of given pages and on generated pages of their paragraphs."""
    rng, net = np.random.default_rng(6), Labeller()
    parsed = [b for b in map(blocks, pages) if b]
    texts = [b.text for page in parsed for b in page if len(b.text) > 20] or ["words of a page that has no other text to learn from"]
    known = [(page, [_plain_case(b) for b in page]) for page in parsed]
    known = [(page, y) for page, y in known if any(y)]
    lessons = known + [generated(texts, rng) for _ in range(SAMPLE)]
    adam = Adam(net.p, 0.01)
    for turn in range(ROUNDS):
        order = rng.permutation(len(lessons))
        order = order[np.argsort([len(lessons[i][1]) // 8 for i in order], kind="stable")]
        for i in rng.permutation(np.arange(0, len(order), BATCH)):
            part = [lessons[k] for k in order[i : i + BATCH]]
            y = np.array([v for _, ys in part for v in ys], np.float32)
            adam.step(net.gradients(encode([page for page, _ in part]), y), 0.01 if turn < ROUNDS - 4 else 0.003)
    return net


def _extract(net: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [blocks(x) for x in part.column("html").to_pylist()]
                x = encode(pages)
                chosen, first, texts = net.label(x), 0, []
                for page in pages:
                    texts.append("\n\n".join(b.text for b, yes in zip(page, chosen[first : first + len(page)]) if yes))
                    first += len(page)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select("page_id", "url", "html")
    ends = F.concat(F.substring("html", 1, LONGEST // 2), F.right("html", F.lit(LONGEST // 2)))
    bounded = F.when(F.length("html") <= LONGEST, F.col("html")).otherwise(ends).alias("html")
    net = fit([r["html"] for r in sampled(rows.select("page_id", bounded), "page_id", SAMPLE).collect() if r["html"]])
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    out = rows.mapInArrow(_extract(net), f"{schema}, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
