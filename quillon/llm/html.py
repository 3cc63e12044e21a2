"""HTML extraction (maximum-scoring subsequence).

A page is a sequence of words and tags, each with a score: words are worth 1, or less than 0
where they lie in an element that isn't content, and tags cost something. What isn't content is
learned from labelled pages, those whose author marked one <article>: a greedy cover picks
the names and classes of elements whose words lie outside of articles, each for words that
no other one explains, so that a menu is told by its nav and not by the list items that
articles have as well. What is usual on the web counts as a few pages' worth of words
beforehand, which labelled pages outweigh. A tag's cost is learned from the tags that are
left. A linear scan (Kadane) finds the contiguous stretch of the largest sum, the content
region; its words of negative score (an advert or notice within the article) are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_package, pick, table

#: Weights are learned from at most so many labelled pages.
TRAIN_PAGES = 2000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(script|style|noscript|template|textarea|svg|title|select|button|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[\s\x1c-\x1f]+")
#: These go without a trace, as they stand inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that end an open paragraph, and elements whose end tags may be
# left out, with the elements that end their scope.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Elements and whole class names that usually hold no content.
USUAL = frozenset("e:nav e:footer e:aside e:form e:menu e:dialog e:head e:header c:ad c:ads c:advert c:advertisement c:sidebar c:comments c:comment-list c:cookie-banner c:cookies c:newsletter c:breadcrumbs c:navigation c:menu c:footer c:masthead".split())
# A header within these is a part of the text.
HEADER_IN = frozenset(["article", "main"])
#: Words and pages outside of articles that a usual feature counts for beforehand; share of
#: a feature's words that lie outside, and pages with it, that it is picked for.
PRIOR_WORDS, PURE, LEAST_PAGES = 300, 0.9, 3
#: Cost of a tag where nothing is known, least and largest; cost of a word that isn't
#: content, which is low, as an advert may stand in the middle of an article.
TAG_COST, LEAST_COST, MOST_COST, BAD_COST = 0.5, 0.2, 20.0, 0.25


class Token:
    """A word (text, block) or a tag (text is None); path: features of the elements around
    it; inside: within an <article>."""

    __slots__ = ("name", "text", "block", "path", "inside")

    def __init__(self, name: str, text: str | None, block: int, path: tuple, inside: bool):
        self.name, self.text, self.block, self.path, self.inside = name, text, block, path, inside


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    stack: list[tuple[str, tuple]] = []  # name, features of it and of what it is in
    block, at, broken = 0, 0, True  # broken: white space or a break since the last word

    def path() -> tuple:
        return stack[-1][1] if stack else ()

    def articles() -> bool:
        return any(n == "article" for n, _ in stack)

    def words(chunk: str) -> None:
        nonlocal broken
        text, own, inside = html.unescape(chunk), path(), articles()
        parts = SPACE.split(text)
        if parts[0] and not broken and out and out[-1].text is not None and out[-1].block == block:
            out[-1].text += parts[0]
            parts[0] = ""
        out.extend(Token("", w, block, own, inside) for w in parts if w)
        broken = not parts[-1] and (len(parts) > 1 or broken)

    def close(names: tuple, stop: tuple) -> None:
        """End the outermost open element of these names within the scope."""
        k = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                k = i
            elif stack[i][0] in stop:
                break
        del stack[k:]

    for m in TAG.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if m.group(1):
                out.append(Token(m.group(1).lower(), None, block, path(), articles()))
                block, broken = block + 1, True
            continue
        if name in INLINE:
            broken = broken or name in ("br", "img")
            if m.group(2):
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] not in INLINE), -1)
                if k >= 0 and stack[k][0] == name:
                    del stack[k:]
            elif name not in VOID:
                stack.append((name, path()))
            continue
        block, broken = block + 1, True
        if m.group(2):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            out.append(Token("/" + name, None, block, path(), articles()))
            if k >= 0:
                del stack[k:]
            continue
        if name in ENDS_P:
            close(("p",), tuple({n for n, _ in stack} - INLINE - {"p"}))
        if name in IMPLIED:
            close(*IMPLIED[name])
        marks = " ".join(a or b or c for a, b, c in NAMES.findall(m.group(4) or "")).lower().split()
        own = {f"c:{c}" for c in marks} | ({f"e:{name}"} if name != "div" and (name != "header" or not any(n in HEADER_IN for n, _ in stack)) else set())
        around = tuple(dict.fromkeys((*path(), *sorted(own))))
        out.append(Token(name, None, block, around, articles() or name == "article"))
        if name not in VOID:
            stack.append((name, around))
    if at < len(page):
        words(page[at:])
    return out


@dataclass
class Weights:
    bad: frozenset  # features of elements that aren't content
    tags: dict[str, float]


def weights(pages: Iterator[str]) -> Weights:
    """From pages with just one article; without such pages, what is usual."""
    words: Counter = Counter()  # (path, inside) -> words
    tags: Counter = Counter()
    holders: dict[str, int] = Counter()
    depth: dict[str, int] = {}
    for page in pages:
        if len(re.findall(r"<article\b", page, re.I)) != 1:
            continue
        seen = set()
        for t in tokens(page):
            (words if t.text is not None else tags)[t.path, t.inside, t.name] += 1
            if not t.inside and t.text is not None:
                seen.update(t.path)
            for i, f in enumerate(t.path):
                depth[f] = min(i, depth.get(f, i))
        holders.update(seen)
    bad: set = set()
    while True:
        out, within = Counter(), Counter()
        for (path, inside, _), n in words.items():
            if bad.isdisjoint(path):
                for f in path:
                    (within if inside else out)[f] += n
        for f in USUAL - bad:
            out[f] += PRIOR_WORDS
        fit = [f for f in out if out[f] / (out[f] + within[f]) >= PURE and (holders[f] >= LEAST_PAGES or f in USUAL)]
        if not fit:
            break
        # classes before names of elements, which say less (of a div the name says nothing);
        # an element's classes that never come apart go together
        rank = {f: (f[0] == "e", -out[f], depth.get(f, 0) if f[0] == "e" else 0) for f in fit}
        bad.update(f for f in fit if rank[f] == min(rank.values()))
    within, out = Counter(), Counter()
    for (path, inside, name), n in tags.items():
        if bad.isdisjoint(path):
            (within if inside else out)[name] += n
    cost = {}
    for name in within.keys() | out.keys():
        odds = log((within[name] + 0.5) / (out[name] + 0.5))
        cost[name] = -min(MOST_COST, max(LEAST_COST, TAG_COST - odds))
    return Weights(frozenset(bad), cost)


def score(t: Token, learned: Weights) -> float:
    good = learned.bad.isdisjoint(t.path)
    if t.text is not None:
        return 1.0 if good else -BAD_COST
    return learned.tags.get(t.name, -TAG_COST) if good else -LEAST_COST


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the largest positive sum; the first of
    equal ones, and (0, 0) if no sum is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best + 1e-12:
            best, found = run, (start, i + 1)
    return found


def extract(page: str, learned: Weights) -> str:
    ts = tokens(page)
    scores = [score(t, learned) for t in ts]
    a, b = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for t, s in zip(ts[a:b], scores[a:b], strict=True):
        if t.text is not None and s > 0:
            blocks.setdefault(t.block, []).append(t.text)
    return "\n\n".join(" ".join(w) for w in blocks.values())


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """From the labelled pages with the smallest hashes of their ids, train_pages at most,
    in one task."""
    find_package(pages.sparkSession)
    p = pick(pages, id_col, html_col).toDF("page_id", "html").select(F.col("page_id").cast("long"), "html").filter(F.col("html").rlike("(?i)<article[ >]"))
    chosen = p.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    sample = p.join(F.broadcast(chosen), "page_id").select("html").limit(train_pages).repartition(1)  # ids may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(x.as_py() for b in batches for x in b.column("html"))
        yield pa.RecordBatch.from_arrays([pa.array([sorted(w.bad)]), pa.array([list(w.tags)], pa.list_(pa.string())), pa.array([list(w.tags.values())], pa.list_(pa.float64()))], ["bad", "tags", "costs"])

    r = sample.mapInArrow(run, "bad array<string>, tags array<string>, costs array<double>").first()
    return Weights(frozenset(r.bad), dict(zip(r.tags, r.costs, strict=True))) if r else weights(iter(()))


def extract_text(pages: DataFrame, learned: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row page_id, url, text, n_chars.

    A null or empty page, and one without content, has an empty text. Rows are treated one
    by one: ids may be null or repeat, pages may be cut off anywhere and of any length. An
    empty table gives no rows; further columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learned)
    p = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                text = [extract(x.as_py(), shared.value) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, learn(pages))
