"""Main text of web pages: maximum-scoring subsequence over words and tags.

A page is a sequence of tags and runs of words. Every word scores positive and every tag scores zero or less, with weights
learned from labelled pages: a page that marks its article (one ``article`` or ``main`` element) labels its own tokens. A tag's
weight is the log-odds of the tag inside against outside of the marked part, and never above zero; words are weighed by where
they stand: plain, inside links, or inside an element that holds no main text (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments: by element name, role, or words of class and id). One linear scan finds the contiguous
region with the greatest score. Its blocks, without the parts of the last kind, are the text.

White space inside a block becomes one space, character references are decoded once, blocks are joined by an empty line.

Edge cases: a null page is an empty one, an empty page or one without words has an empty text; broken markup never fails: a tag
that is not closed ends with the page, a closing tag closes the innermost open element of its name, a head that is not closed
ends where something else begins; pages of any length are read once, in time that grows in proportion; no labelled page: built-in
counts alone give the weights; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import read, small

#: Labelled pages that are learned from at most.
SAMPLE = 2000
#: Elements whose content is not text.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select option button audio video head".split())
#: Elements that hold no main text.
APART = frozenset("nav header footer aside form dialog menu fieldset".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Words of a class, id or role that mark an element as apart.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead "
    "footer colophon sidebar sidebars aside widget widgets related recommended recommendations popular trending comment comments commentlist disqus respond reply replies discussion reactions "
    "cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup signin login register share sharing social follow toolbar "
    "pagination pager search searchbox form complementary contentinfo".split()
)
#: A container with one of these words is the page's body even if a mark is among its words.
_BODY = frozenset("article content main body post entry story page wrapper container layout site".split())
#: What a tag begins with; its attributes are read by _tag_end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
#: Elements that may stand in a head; any other one closes it.
_HEAD = frozenset("head title meta link script style noscript base template".split())
#: Elements that end an open one of their name.
_SINGLE = frozenset("p li dt dd tr td th".split())
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLOSE = {x: re.compile(rf"</{x}", re.I) for x in ("script", "style", "textarea", "title")}
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Counts (inside, outside) that stand for labelled pages of the usual kind.
_PRIOR = {"p": (40, 4), "h1": (6, 1), "h2": (8, 2), "h3": (6, 3), "b": (6, 3), "br": (6, 3), "li": (6, 30), "ul": (2, 8), "a": (10, 40), "div": (10, 40), "other": (10, 15)}
_PRIOR_WORDS = {"plain": (900, 60), "link": (40, 60), "apart": (5, 200)}


@dataclass
class Token:
    """A run of text (tag empty) or a tag."""

    tag: str
    text: str
    apart: bool
    link: bool
    block: bool  # whether a block ends here
    marked: bool  # inside an article or main element


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag's > stands, or the page's end. A quote that nothing closes is a character like others; ``unclosed`` keeps
    such quotes, so that none is looked for twice."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = -1 if m[0] in unclosed else page.find(m[0], m.end())
        if close < 0:
            unclosed.add(m[0])
        at = max(close + 1, m.end())
    return len(page)


def _ends_block(name: str) -> bool:
    return name not in INLINE and name not in RAW


def _is_apart(name: str, attrs: str, in_marked: bool) -> bool:
    if name in APART:
        return not (name == "header" and in_marked)
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id", "role"):
            words = set(_SPLIT.split(value))
            if words & _MARKS and not words & _BODY:
                return True
    return False


class _Open:
    """The open elements, found by name and by whether they are inline, without walking through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, raw, apart, link, marked
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.raw = self.apart = self.link = self.marked = 0

    def _count(self, e: tuple[str, bool, bool, bool, bool], by: int) -> None:
        self.raw, self.apart, self.link, self.marked = (x + by * y for x, y in zip((self.raw, self.apart, self.link, self.marked), e[1:], strict=True))

    def push(self, e: tuple[str, bool, bool, bool, bool]) -> None:
        self.places.setdefault(e[0], []).append(len(self.stack))
        if e[0] not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(e)
        self._count(e, 1)

    def cut(self, k: int) -> None:
        """Closes the k-th element and those within it."""
        while len(self.stack) > k:
            e = self.stack.pop()
            self.places[e[0]].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self._count(e, -1)

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    open_, unclosed, at = _Open(), set(), 0

    def text(part: str) -> None:
        if part and not open_.raw:
            out.append(Token("", part, open_.apart > 0, open_.link > 0, False, open_.marked > 0))

    def tag(name: str) -> None:
        out.append(Token(name, "", open_.apart > 0, open_.link > 0, _ends_block(name), open_.marked > 0))

    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if not m["name"]:
            continue
        name, end = m["name"].lower(), _tag_end(page, at, unclosed)
        attrs, at = page[at:end], end + 1
        if name not in _HEAD and (k := open_.last("head")) >= 0 and not m["end"] and not any(open_.last(x) > k for x in ("script", "style", "noscript", "template", "title")):
            open_.cut(k)
        if m["end"]:
            k = open_.last(name)
            # an inline end tag doesn't close blocks around it
            if k >= 0 and not (name in INLINE and open_.last_block() > k):
                open_.cut(k)
            if not open_.raw:
                tag(name)
            continue
        is_raw, is_apart = name in RAW, _is_apart(name, attrs, open_.marked > 0)
        if name in _SINGLE and (k := open_.last_block()) >= 0 and open_.stack[k][0] == name:
            open_.cut(k)
        if name not in VOID and not attrs.endswith("/"):
            open_.push((name, is_raw, is_apart, name == "a", name in ("article", "main")))
            if name in ("script", "style", "textarea", "title"):  # their content is no markup
                close = _CLOSE[name].search(page, at)
                at = close.start() if close else len(page)
        if not open_.raw or is_raw:
            tag(name)
    text(page[at:])
    return out


def _kind(t: Token) -> str:
    return "apart" if t.apart else "link" if t.link else "plain"


@dataclass(frozen=True)
class Weights:
    tags: dict[str, float]
    words: dict[str, float]

    @staticmethod
    def of_counts(tags: dict[str, tuple[float, float]], words: dict[str, tuple[float, float]]) -> Weights:
        """Counts (inside, outside) of labelled pages, added to the built-in ones."""
        total = lambda a, b: {k: tuple(x + y for x, y in zip(a.get(k, (0, 0)), b.get(k, (0, 0)), strict=True)) for k in {**a, **b}}
        odds = lambda c: math.log((c[0] + 1) / (c[1] + 1))
        tag_odds = {k: odds(c) for k, c in total(_PRIOR, tags).items()}
        word_odds = {k: odds(c) for k, c in total(_PRIOR_WORDS, words).items()}
        # words score positive unless they stand apart; tags score at most zero
        # (a part that is left out anyway must not tear the text around it asunder, so the limits are narrow)
        fixed = {"plain": max(0.5, min(4.0, word_odds["plain"])), "link": max(-1.0, min(1.0, word_odds["link"])), "apart": max(-0.5, min(-0.1, word_odds["apart"]))}
        return Weights({k: max(-2.0, min(0.0, v)) for k, v in tag_odds.items()}, fixed)

    def score(self, t: Token) -> float:
        if t.tag:
            return 0.0 if t.tag in RAW else self.tags.get(t.tag, self.tags["other"])
        return self.words[_kind(t)] * len(t.text.split())


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part with the greatest sum; of equals the longest first one."""
    best, bounds, start, run = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if run < 0:
            start, run = i, 0.0
        run += s
        if run > best:
            best, bounds = run, (start, i + 1)
    return bounds


def main_text(page: str, weights: Weights) -> str:
    found = tokens(page)
    lo, hi = region([weights.score(t) for t in found])
    # whole blocks: the region grows to the ends of the blocks that it touches
    while lo > 0 and not found[lo - 1].block:
        lo -= 1
    while 0 < hi < len(found) and not found[hi - 1].block and not found[hi].block:
        hi += 1
    blocks, parts = [], []
    for t in found[lo:hi]:
        if t.block:
            blocks.append("".join(parts))
            parts = []
        elif t.tag == "br":
            parts.append(" ")
        elif not t.tag and not t.apart:
            parts.append(t.text)
    blocks.append("".join(parts))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Learns from about ``sample`` pages with one marked part at most: the first by hash of their ids.

    Only ids are sorted, and only those below a hash bound that leaves about twice as many as are needed.
    """
    marked = pages.where(F.regexp_count(F.lower("html"), F.lit(r"<(article|main)[\s>]")) == 1)
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    known_ids = marked.select(F.col("page_id").cast("long").alias("page_id")).where("page_id is not null")
    share = min(1.0, 2.0 * sample / max(known_ids.count(), 1))
    ids = known_ids.where(place <= int(share * (1 << 30))).orderBy(place, "page_id").limit(sample).collect()
    chosen = pages.sparkSession.createDataFrame([(i,) for i in sorted({r["page_id"] for r in ids})], "page_id long")
    labelled = marked.join(F.broadcast(chosen), "page_id", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small(batches):
            for page in batch.column(0).to_pylist():
                for t in tokens(page):
                    if t.tag not in ("article", "main"):
                        counts["tag" if t.tag else "word", t.tag or _kind(t), t.marked] += 1 if t.tag else len(t.text.split())
        rows = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([counts[r] for r in rows], pa.int64())], names=["what", "name", "inside", "n"])

    known = INLINE | APART | VOID | frozenset("p div ul ol li dl dt dd table tr td th thead tbody h1 h2 h3 h4 h5 h6 section blockquote pre figure figcaption html body".split())
    counted = labelled.mapInArrow(run, "what string, name string, inside boolean, n long")
    counted = counted.withColumn("name", F.when((F.col("what") == "word") | F.col("name").isin(sorted(known)), F.col("name")).otherwise("other"))
    tags: dict[str, list[int]] = {}
    words: dict[str, list[int]] = {}
    for r in counted.groupBy("what", "name", "inside").agg(F.sum("n").alias("n")).collect():
        (tags if r["what"] == "tag" else words).setdefault(r["name"], [0, 0])[0 if r["inside"] else 1] += r["n"]
    return Weights.of_counts({k: tuple(v) for k, v in tags.items()}, {k: tuple(v) for k, v in words.items()})


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit_weights(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(p or "", shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
