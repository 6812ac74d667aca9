"""Main text of web pages by a maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

_NAME = r"[a-zA-Z][^\s/>]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)({_NAME})((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)({_NAME})([^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements by how they take part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIPPED = frozenset("script style textarea title xmp noembed noframes iframe head nav footer aside form noscript template svg canvas object audio video button select dialog menu map annotation annotation-xml applet".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager search copyright disclaimer adsbygoogle warning announcement notification aside topbar toc".split())
TITLES = frozenset("article post entry content main page title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(("article", "main"))
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom mmultiscripts semantics".split())
#: Marks of lists of articles that are none of the page's own text.
CARDS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Open:
    """The open elements; every question takes the same time however deep they are."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.blocks: list[str] = []
        self.count: Counter = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1
        if name in BLOCKS:
            self.blocks.append(name)

    def close(self, name: str) -> None:
        """Closes the last element of that name, if one is open, and all in it."""
        while self.count[name]:
            last = self.names.pop()
            self.count[last] -= 1
            if last in BLOCKS:
                self.blocks.pop()
            if last == name:
                break

    def key(self) -> str:
        """What the weight of a text here is learned for."""
        return f"{self.blocks[-1] if self.blocks else 'body'}{'>a' if 'a' in self.names[-3:] else ''}"


@dataclass
class Item:
    """A run of text or a tag. ``key`` is what its weight is learned for."""

    key: str
    words: int = 0
    text: str = ""
    breaks: bool = False
    content: bool = False
    low: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _said(text: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(text)}


def _is_left_out(name: str, attrs: dict[str, str]) -> bool:
    """Whether the element shows no text of the page's own, whatever it holds."""
    return name in SKIPPED and name != "form" or name not in ("html", "body") and ("hidden" in attrs or attrs.get("aria-hidden") == "true")


def _marks(name: str, attrs: dict[str, str], inside: bool, heading: str) -> set[str]:
    """What marks the element as boilerplate: its name, role or words of its
    class and id. Headings, article and main are not known by class and id.
    Ids inside an article that name a section, or repeat the heading that the
    element begins with, say what the text is about."""
    if name in ("html", "body"):
        return set()
    if name == "form" or name == "header" and not inside:
        return {name}
    if (role := attrs.get("role", "").lower()) in ROLES:
        return {role}
    if name in CONTENT or name in HEADINGS:
        return set()
    of_class, of_id = _said(attrs.get("class", "")), _said(attrs.get("id", ""))
    if inside and not of_id <= BOILERPLATE and (name == "section" or of_id <= _said(heading.lower())):
        of_id = set()
    words = of_class | of_id
    return words & BOILERPLATE or ({"header"} if "header" in words and not inside and not words & TITLES else set())


def items(page: str) -> list[Item]:
    """The page's visible runs and tags in order; boilerplate elements that
    their name, role, class or id tells are left out whole, but for those that
    hold an article or main element or, where none stands elsewhere, most of the
    page's words. Comments and the like that hold later articles stay as low."""
    out: list[Item] = []
    tags: list[tuple[int, int, bool, str, str]] = []  # start, end, closing, name, attributes
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        tags.append((m.start(), at, bool(m[1] or m[4]), name, m[3] or m[6] or ""))
        if name in RAW and not (m[1] or m[4]):
            end = re.compile(rf"</{name}\s*(?=[>\s/])", re.I).search(page, at)
            at = end.start() if end else len(page)
    skip_until, open_, inside = -1, Open(), 0
    ends = _closers(tags)
    landmarks = [k for k, t in enumerate(tags) if t[3] in CONTENT and not t[2]]
    mains = [0, *accumulate(tags[x][3] == "main" for x in landmarks)]
    upto: list[int] = []  # words before each tag
    low_until = -1

    def holds(k: int, end: int) -> tuple[bool, bool]:
        """Whether element k is to stay, and whether as low, for what it holds."""
        first, after = bisect_right(landmarks, k), bisect_right(landmarks, end)
        if first < after:
            return True, first > 0 and mains[after] == mains[first]
        if landmarks:
            return False, False
        if not upto:
            at = n = 0
            for i, (start, stop, closing, name, _) in enumerate(tags):
                raw = i and tags[i - 1][3] in RAW and not tags[i - 1][2]
                n += 0 if raw else len(page[at:start].split())
                upto.append(n)
                at = stop
            upto.append(n + len(page[at:].split()))
        return 2 * (upto[min(end, len(tags) - 1) + (end >= len(tags))] - upto[k]) > upto[-1], False

    at = 0
    for k, (start, end, closing, name, raw) in enumerate([*tags, (len(page), len(page), True, "", "")]):
        if k > skip_until and start > at:
            text = html.unescape(page[at:start])
            if n := len(text.split()):
                out.append(Item(open_.key(), n, text, False, inside > 0 and k > low_until, k <= low_until))
            elif text:
                out.append(Item("space", 0, text, False, inside > 0))
        at = end
        if not name or k <= skip_until:
            continue
        attrs = _attributes(raw) if raw and not closing else {}
        if not closing and name not in VOID:
            gone = _is_left_out(name, attrs)
            if not gone and (name in ("form", "header") or attrs):
                stop, heading = ends.get(k, k), ""
                if k + 2 < len(tags) and tags[k + 1][3] in HEADINGS and not page[end : tags[k + 1][0]].strip():
                    heading = re.sub("<[^>]*>", " ", page[tags[k + 1][1] : tags[ends.get(k + 1, k + 2)][0]])
                if marks := _marks(name, attrs, inside > 0, heading):
                    stays, low = holds(k, stop)
                    gone = not stays
                    if low and marks & CARDS:
                        low_until = max(low_until, stop)
            if gone:
                skip_until = ends.get(k, k)
                out.append(Item("gone", breaks=name in BLOCKS))
                continue
        if closing and name in CONTENT:
            inside = max(0, inside - 1)
        out.append(Item("/" * closing + name, 0, " " if name == "br" else "", name in BLOCKS, inside > 0))
        if closing:
            open_.close(name)
        elif name not in VOID:
            if name in BLOCKS:  # a block ends an open paragraph
                open_.close("p")
            open_.push(name)
            inside += name in CONTENT
    return out


def _closers(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """For opening tags, the index of the tag that ends the element. Elements
    that nothing closes end before the next landmark."""
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    landmark = len(tags)
    marks = [0] * len(tags)
    for k in range(len(tags) - 1, -1, -1):
        marks[k] = landmark
        if tags[k][3] in ("article", "main", "footer", "nav", "aside", "body") or tags[k][3] == "p" and not tags[k][2]:
            landmark = k
    for k, (_, _, closing, name, _) in enumerate(tags):
        stack = stacks.setdefault(name, [])
        if closing:
            if stack:
                ends[stack.pop()] = k
        elif name not in VOID:
            if name in ("p", "li", "td", "tr", "dt", "dd") and stack and name == "p":
                ends[stack.pop()] = k - 1
            stack.append(k)
    for stack in stacks.values():
        for k in stack:
            ends[k] = max(k, marks[k] - 1)
    return ends


@dataclass
class Weights:
    """Share of content among the words and tags of each kind, with a prior."""

    inside: Counter = field(default_factory=Counter)
    outside: Counter = field(default_factory=Counter)
    prior: float = 20.0

    def learn(self, page: str) -> None:
        """Count a page that marks its content by an article or main element."""
        found = items(page)
        if not any(i.content for i in found):
            return
        for i in found:
            (self.inside if i.content else self.outside)[i.key] += i.words or 1

    def share(self, key: str, prior: float) -> float:
        a, b = self.inside[key], self.outside[key]
        return (a + prior * self.prior) / (a + b + self.prior)

    def score(self, i: Item) -> float:
        """Words score their kind's share of content, tags less than nothing."""
        if i.key == "space":
            return 0.0
        if i.key == "gone":
            return -0.02
        if i.words and i.low:
            return -0.2 * i.words
        if i.words:
            return i.words * self.share(i.key, 0.1 if i.key.endswith(">a") else 0.6)
        name = i.key.lstrip("/")
        if name in CONTENT:
            return -1.0
        return -0.02 - (1 - self.share(i.key, 0.95 if name in INLINE or name in ("p", "li", "td", "tr") else 0.5))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, in one pass; (0, 0)
    where none is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += x
        if total > best:
            best, span = total, (begin, k + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    """Blocks of the best contiguous region, joined by two line ends."""
    found = items(page)
    span = best_run([weights.score(i) for i in found])
    blocks, now = [], []
    for i in found[slice(*span)]:
        if i.breaks:
            blocks.append("".join(now))
            now = []
        else:
            now.append(i.text)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def learned(pages: DataFrame, sample: int = 300, longest: int = 100_000) -> Weights:
    """Weights from at most ``sample`` pages of at most ``longest`` code points
    that mark their content by an article or main element, in a fixed order.
    They come from those about 8 * ``sample`` pages whose hashes are smallest,
    so that no more travel to the driver however large the table is."""
    weights, n = Weights(), pages.count()
    html_, draw = F.col("html").cast("string"), F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30))
    drawn = pages.where(draw <= F.lit(int((1 << 30) * min(1.0, 8 * sample / max(n, 1)))))
    marked = drawn.where((F.length(html_) <= longest) & html_.rlike("(?i)<(article|main)[ >]")).select(draw.alias("draw"), html_.alias("html"))
    for row in marked.orderBy("draw", "html").limit(sample).collect():
        weights.learn(row["html"])
    return weights


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    pages: page_id, url, html (null: empty); other columns are ignored. The text
    is empty where nothing scores. Character references are decoded and white
    space inside a block is one space. Repeated rows stay; an empty table gives
    an empty result. ``weights`` default to those learned from the table.
    """
    weights = weights or learned(pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    html_ = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html_).mapInArrow(run, from_arrow_schema(schema))
