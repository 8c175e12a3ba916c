"""Main text of web pages: boosted trees over the nodes of the DOM, decoded over the tree.

A page is parsed leniently into elements. Each element is described by the size and density of its subtree (text, links,
elements, paragraphs, punctuation), the tokens of its class, id and role, its tag, its depth, its place among its siblings
and what its ancestors are. Gradient-boosted trees, trained here on pages drawn from many layouts (`training_pages`), give
the log-odds that an element is part of the article.

Decoding chooses for every element: all of it in, all of it out, or mixed, where only the children decide. The choice with
the largest sum over the page is found from the leaves up. So an element taken whole has no descendant left out, one left
out has none taken, and an advert inside an article makes the article mixed instead of contradicting it.

Text: references decoded, white space inside a block one space, trimmed, blocks in page order joined by one line feed.

Defined results: null or empty html, or a page without article, gives the empty string. Markup that is not closed is closed
at the end. Repeated rows are extracted each. An empty table gives no rows; columns other than the three named are not read. Pages of any
length are parsed in time proportional to it.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import boosting, text
from tapewright.llm.rows import bounded_batches
from tapewright.llm.training_pages import pages

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg select object".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input button".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body td th main aside nav header footer blockquote".split())
TAG_GROUPS = (
    frozenset(["nav", "menu"]), frozenset(["header"]), frozenset(["footer"]), frozenset(["aside"]), frozenset("form button input label fieldset dialog".split()),
    frozenset(["article"]), frozenset(["main"]), frozenset(["section"]), frozenset(["div"]), frozenset(["p"]), frozenset("h1 h2 h3 h4 h5 h6".split()),
    frozenset("ul ol dl".split()), frozenset("li dt dd".split()), frozenset(["a"]), frozenset("table tbody thead tr td th".split()),
    frozenset("pre blockquote code figure figcaption".split()), frozenset("b strong em i span u small".split()), frozenset(["body", "html"]))
#: Tokens of class, id and role that hint at what an element is.
TOKENS = (
    frozenset("ad ads adv advert adverts advertisement sponsor sponsored banner promo promotion".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar links pagination pager".split()),
    frozenset("sidebar side rail widget related recommended read share social column".split()),
    frozenset("header masthead logo brand title".split()), frozenset("footer bottom colophon copyright".split()),
    frozenset("cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup banner".split()),
    frozenset("comment comments reply replies discussion responses respond author disqus".split()),
    frozenset("form login search".split()), frozenset("content article post entry story body text main copy".split()))
LEAVE_OUT = frozenset("head".split())

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-y|hidden|aria-hidden)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass
class Tree:
    """Elements in page order; `parts` are the texts with the element they stand in and their block's number."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[frozenset] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    parts: list[tuple[int, int, str]] = field(default_factory=list)


class Markup:
    """Finds a page's tags, comments and declarations one after another, in time proportional to the page.

    A tag ends at the first > outside quotes. An opening that never ends is text; the places such a search came through are
    remembered, so none is searched twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.stops = [m.start() for m in _STOP.finditer(page)]
        self.last = page.rfind(">")
        self.dead: set[int] = set()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`, -1 for none."""
        page, stops, seen = self.page, self.stops, []
        k = bisect_left(stops, at)
        while k < len(stops) and k not in self.dead:
            place = stops[k]
            if page[place] == ">":
                return place
            seen.append(k)
            shut = page.find(page[place], place + 1)
            if shut < 0:
                break
            k = bisect_left(stops, shut) + 1
        self.dead.update(seen)
        return -1

    def __iter__(self):
        """(start, end, closing slash, name, attributes); the name is empty for what is no element."""
        page, at = self.page, 0
        while m := _OPENING.search(page, at):
            at = m.end()
            if page.startswith("<!--", m.start()):
                end = page.find("-->", at)
                end = len(page) if end < 0 else end + 3
                jump = yield m.start(), end, "", "", ""
            elif not m[2]:
                if at > self.last:
                    continue
                jump = yield m.start(), (end := page.index(">", at) + 1), "", "", ""
            else:
                shut = self.tag_end(at)
                if shut < 0:
                    continue
                jump = yield m.start(), (end := shut + 1), m[1], m[2].lower(), page[at:shut]
            at = jump or end


class Open:
    """The open elements: a stack, and for each tag the places where it stands in it."""

    def __init__(self):
        self.nodes, self.tags = [0], ["html"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags) -> int:
        """The highest place of any of the tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while place and len(self.nodes) > place:
            self.places[self.tags.pop()].pop()
            self.nodes.pop()


def parse(page: str, marked: bool = True) -> Tree:
    """The page's elements; `marked` pages are drawn ones, whose data-y is read. On a real page data-y may be anything."""
    tree, stack, at, block = Tree(["html"], [-1], [frozenset()], [-1]), Open(), 0, 0

    def said(piece: str) -> None:
        if piece and not piece.isspace():
            tree.parts.append((stack.nodes[-1], block, references.unescape(piece)))
        elif piece and tree.parts:
            tree.parts.append((stack.nodes[-1], block, " "))

    found, jump = iter(Markup(page)), None
    while True:
        try:
            start, end, slash, name, attributes = found.send(jump)
        except StopIteration:
            said(page[at:])
            return tree
        said(page[at:start])
        at, jump = end, None
        if not name:
            continue
        if name == "br":
            tree.parts.append((stack.nodes[-1], block, " "))
            continue
        if name not in INLINE:
            block += 1
        if slash:
            stack.cut(stack.last([name]))
            continue
        if name in RAW or name == "title":
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = jump = close.end() if close else len(page)
            continue
        if name in CLOSES_P or name in SELF_CLOSING:
            closes = SELF_CLOSING.get(name, ("p",))
            ended = stack.last(closes)
            if ended and ended > stack.last(SCOPES.difference(closes)):
                stack.cut(ended)
        if name in VOID:
            continue
        tokens, label = set(), -1
        if attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                if key.lower() == "data-y":
                    if marked:
                        label = int(a or b or c or -1)
                else:
                    tokens.update(_SPLIT.split((a or b or c).lower()))
        tree.tags.append(name)
        tree.parents.append(stack.nodes[-1])
        tree.tokens.append(frozenset(tokens))
        tree.labels.append(label)
        stack.push(len(tree.tags) - 1, name)


N_TAGS, N_TOKENS = len(TAG_GROUPS), len(TOKENS)


@lru_cache(maxsize=4096)
def _tag_row(tag: str) -> np.ndarray:
    return np.array([tag in g for g in TAG_GROUPS], np.float32)


@lru_cache(maxsize=4096)
def _token_row(tokens: frozenset) -> np.ndarray:
    return np.array([bool(tokens & g) for g in TOKENS], np.float32)


def described(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Features of every element, and the characters that stand directly in it."""
    n = len(tree.tags)
    parent = np.array(tree.parents)
    own, marks = np.zeros(n), np.zeros(n)
    first = np.full(n, np.inf)
    total = 0
    for node, _, part in tree.parts:
        size = len(part.strip())
        if size:
            own[node] += size
            marks[node] += len(_PUNCTUATION.findall(part))
            first[node] = min(first[node], total)
            total += size
    tags = np.stack([_tag_row(t) for t in tree.tags])
    tokens = np.stack([_token_row(t) for t in tree.tokens])
    is_p = tags[:, 9]
    link = np.where(tags[:, 13] > 0, 1.0, 0.0)
    depth, inside_link = np.zeros(n), link.copy()
    above = np.zeros((n, N_TAGS + N_TOKENS), np.float32)
    whole = np.concatenate([tags, tokens], axis=1)
    place, siblings, like = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    seen_like: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = tree.parents[i]
        depth[i] = depth[p] + 1
        inside_link[i] = max(inside_link[i], inside_link[p])
        np.maximum(above[p], whole[p], out=above[i])
        place[i] = seen[p] = seen.get(p, 0) + 1
        key = (p, tree.tags[i])
        seen_like[key] = seen_like.get(key, 0) + 1
    for i in range(1, n):
        siblings[i] = seen[tree.parents[i]]
        like[i] = seen_like[tree.parents[i], tree.tags[i]]
    sums = np.stack([own, own * inside_link, marks, np.ones(n), is_p, link], axis=1)
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        sums[p] += sums[i]
        if first[i] < first[p]:
            first[p] = first[i]
    chars, linked, punctuation, count, paragraphs, links = sums.T
    around = np.maximum(parent, 0)
    numbers = np.stack([
        np.log1p(own), np.log1p(chars), chars / count, linked / (chars + 1), punctuation / (chars + 1), np.log1p(count), np.log1p(paragraphs),
        np.log1p(links), depth, place, siblings, like, place / (siblings + 1), np.where(np.isfinite(first), first / (total + 1), 0), chars / (total + 1),
        chars[around] / (total + 1), chars / (chars[around] + 1), linked[around] / (chars[around] + 1), np.log1p(paragraphs[around])], axis=1)
    return np.concatenate([numbers, whole, above], axis=1).astype(np.float32), own


@dataclass(frozen=True)
class Settings:
    pages: int = 500
    trees: int = 50
    depth: int = 4
    seed: int = 3
    #: What a mixed element costs, in log-odds.
    mixed: float = 0.5


@lru_cache(maxsize=2)
def model(settings: Settings) -> boosting.Trees:
    xs, ys, ws = [], [], []
    for page in pages(settings.pages, settings.seed):
        tree = parse(page)
        x, own = described(tree)
        y = np.array(tree.labels)
        known = y >= 0
        xs.append(x[known])
        ys.append(y[known])
        ws.append(1 + np.minimum(own[known], 500) / 100)
    return boosting.train(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws), settings.trees, settings.depth)


def decode(tree: Tree, odds: np.ndarray, own: np.ndarray, mixed: float) -> np.ndarray:
    """True for elements whose own text is taken."""
    n = len(odds)
    gain = np.clip(odds, -8, 8) * (1 + np.minimum(own, 500) / 100)
    everything, best, children = gain.copy(), np.zeros(n), np.zeros(n)
    choice = np.zeros(n, np.int8)  # 0 out, 1 in, 2 mixed
    for i in range(n - 1, -1, -1):
        # A mixed element's own text, seldom more than scraps, is taken on its own odds.
        apart = children[i] + max(0.0, gain[i] if own[i] else 0.0) - mixed
        options = (0.0, everything[i], apart if children[i] > 0 else -1.0)
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
        p = tree.parents[i]
        if p >= 0:
            everything[p] += everything[i]
            children[p] += best[i]
    taken = np.zeros(n, bool)
    for i in range(n):
        p = tree.parents[i]
        if p >= 0 and choice[p] != 2:
            choice[i] = choice[p]
        taken[i] = choice[i] == 1 or (choice[i] == 2 and gain[i] > 0 and own[i] > 0)
    return taken


def text_of(tree: Tree, taken: np.ndarray) -> str:
    blocks, last, kept = [], None, []
    for node, block, part in tree.parts:
        if not taken[node]:
            continue
        if block != last and kept:
            blocks.append(" ".join("".join(kept).split()))
            kept = []
        last = block
        kept.append(part)
    blocks.append(" ".join("".join(kept).split()))
    return "\n".join(b for b in blocks if b)


def extract_all(htmls: list[str], trees: boosting.Trees, settings: Settings) -> list[str]:
    parsed = [parse(h, marked=False) for h in htmls]
    found = [described(t) for t in parsed]
    odds = trees.log_odds(np.concatenate([x for x, _ in found])) if found else np.zeros(0)
    out, at = [], 0
    for tree, (x, own) in zip(parsed, found, strict=True):
        out.append(text_of(tree, decode(tree, odds[at:at + len(x)], own, settings.mixed)))
        at += len(x)
    return out


def extract(table: DataFrame, settings: Settings | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page; the url is null if the table has none."""
    settings = settings or Settings()
    bounded_batches(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(model(settings))
    url = F.col("url").cast("string") if "url" in table.columns else F.lit(None).cast("string")
    ready = table.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("binary").alias("html"))

    def run(batches):
        for batch in batches:
            at, kept, size = 0, [], 0
            for i, data in enumerate(text.texts_of(batch, "html"), 1):
                kept.append(data.tobytes().decode("utf-8", "replace"))
                size += len(data)
                if size > 1 << 20 or i == len(batch):
                    out = pa.array(extract_all(kept, shared.value, settings), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(kept)), batch.column(1).slice(at, len(kept)), out], names=["page_id", "url", "text"])
                    at, kept, size = i, [], 0

    return ready.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
