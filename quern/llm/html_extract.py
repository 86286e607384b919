"""Operator 7, HTML extraction: a tree-structured graphical model tells the nodes of the article from the rest.

Each element of the parsed page is a binary variable (part of the article or not). Its own potential
comes from features (tag, words in class and id, length and link share of its text); a potential for
each parent and child ties neighbours together. One upward and one downward pass of sum-product
messages give each element's marginal; text belongs to the article if the element around it
does. Parts that are no article by their tag or names have odds of their own that no neighbour outweighs. The other potentials are counts over a sample of labelled pages, with fixed pseudo-counts for tags
and words that the sample may lack. Without labels of their own, pages that mark their article
up serve as labelled: what stands in ``article`` or ``main`` and not in a part named as boilerplate.

Null html counts as empty: no elements, empty text. Pages are parsed whole, without recursion; open
elements, stray end tags and unfinished comments are taken as browsers do; a tag that is never finished is text, and
the cost of a page is in proportion to its length. Repeated rows are extracted each; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape
from itertools import repeat
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bound of the labelled sample that the potentials are counted on.
MOST_PAGES = 4000
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
MARKS = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements without content, with raw content, and those that break blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
RAW_ENDS = {tag: re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I) for tag in sorted(RAW)}
INLINE = frozenset("b i em strong a span".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Fixed values of HTML: start tags that close an open element of these.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCKS - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Words in class, id and role, and the kind of part that they name.
KINDS = [
    ("ad", ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner")),
    ("menu", ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager")),
    ("foot", ("footer", "foot", "copyright", "colophon", "contentinfo")),
    ("head", ("header", "masthead", "topbar", "logo")),
    ("side", ("sidebar", "side", "aside", "widget", "related", "recommended", "complementary", "trending")),
    ("talk", ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion")),
    ("note", ("note", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup")),
    ("share", ("share", "sharing", "social", "tags", "byline", "meta")),
    ("main", ("article", "content", "post", "entry", "story", "main", "body", "text")),
]
KIND_OF = {word: kind for kind, words in KINDS for word in words}
PLAIN_TAGS = frozenset("html body div p span a b i em strong h1 h2 h3 h4 h5 h6 ul ol li table tr td blockquote pre section img br figure figcaption dl dt dd code small sub sup time cite q mark u".split())
#: Pseudo-counts (not article, article) of features.
PRIOR = {f"tag:{t}": (200.0, 0.2) for t in "nav footer aside form button select label input script style noscript template iframe svg head title textarea dialog menu option".split()}
PRIOR |= {"tag:header": (100.0, 0.5), "tag:article": (0.2, 200.0), "tag:main": (2.0, 60.0)}
PRIOR |= {f"kind:{k}": (200.0, 0.3) for k in ("ad", "menu", "foot", "side", "talk", "note")} | {"kind:head": (60.0, 1.0), "kind:share": (60.0, 2.0), "kind:main": (5.0, 60.0)}
#: Kinds that name a part as none of the article, wherever it stands, but for the elements that hold whole pages; and their log odds.
REJECTED, WHOLE, NEVER_ODDS = frozenset(["ad", "menu", "foot", "side", "talk", "note"]), frozenset("#root html body main article".split()), -100.0
#: Log odds beyond which a belief is certain.
MOST_ODDS = 500.0
CONTAINERS = frozenset("#root html body div section article main table tbody tr td".split())
#: Elements whose share of links tells menus from texts; in others a link may be all of a paragraph or an item.
LINKED = CONTAINERS | frozenset(["nav", "aside", "footer", "header"])
#: Elements that are a page's head if their names say so; headings are not.
HEADS = frozenset("div section ul ol table p span a".split())
#: Elements that stand in menus and in articles alike: they go with what is around them.
NEUTRAL = INLINE | frozenset("ul ol li dl dt dd".split())
NEVER = frozenset("nav footer aside form button select script style noscript template iframe svg head title textarea dialog menu".split())


class Tags:
    """Where the tags, comments and declarations of a page begin and end, each search within a page's length in all.

    Marks (quotes and ``>``) have the same mark ahead of them whatever tag they are reached from, so what was once found stays known.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.marks: list[int] | None = None
        self.known: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The place of the ``>`` behind attributes that begin at ``at``; -1 if the tag is never finished."""
        if self.marks is None:
            match = ATTRIBUTES.match(self.html, at)
            if match:
                return match.end() - 1
            self.marks = [m.start() for m in MARKS.finditer(self.html)]
        passed, found = [], -1
        k = bisect_left(self.marks, at)
        while k < len(self.marks):
            mark = self.marks[k]
            if mark in self.known:
                found = self.known[mark]
                break
            passed.append(mark)
            if self.html[mark] == ">":
                found = mark
                break
            closing = self.html.find(self.html[mark], mark + 1)
            if closing < 0:
                break
            k = bisect_left(self.marks, closing + 1)
        self.known.update(dict.fromkeys(passed, found))
        return found

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, tag, attributes) of the next one from ``at`` on; a comment or declaration has no tag."""
        html = self.html
        start = html.find("<", at)
        while start >= 0:
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(html), "", "", ""
            if html[start + 1 : start + 2] in ("!", "?"):
                if self.last > start + 1:
                    return start, html.index(">", start + 2) + 1, "", "", ""
            else:
                match = OPEN.match(html, start)
                if match and (end := self.end(match.end())) >= 0:
                    return start, end + 1, match[1], match[2].lower(), html[match.end() : end]
            start = html.find("<", start + 1)
        return None


class Page:
    """Elements in page order (a parent before its children) and the pieces of text between them."""

    def __init__(self, html: str):
        self.tags, self.kinds, self.parents = ["#root"], [""], [-1]
        self.flow: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # of each tag, the places of its open elements in the stack
        self.blocks: list[int] = []  # the places of open blocks
        at, end, tags = 0, len(html), Tags(html)
        while at < end:
            found = tags.next(at)
            if found is None:
                self._text(html[at:])
                break
            if found[0] > at:
                self._text(html[at : found[0]])
            _, at, slash, tag, attributes = found
            if not tag:
                continue
            if slash:
                self._close(tag)
                continue
            for other in CLOSES.get(tag, ()):
                if self.tags[self.stack[-1]] == other:
                    self.flow.append((self.stack[-1], None))
                    self._cut(len(self.stack) - 1)
            if tag in ENDS_P and self.blocks and self.tags[self.stack[self.blocks[-1]]] == "p":
                self.flow.append((self.stack[self.blocks[-1]], None))
                self._cut(self.blocks[-1])
            self.tags.append(tag)
            self.kinds.append(self._kind(attributes))
            self.parents.append(self.stack[-1])
            own = len(self.tags) - 1
            if tag in BLOCKS:
                self.flow.append((own, None))
            if tag in RAW:
                close = RAW_ENDS[tag].search(html, at)
                at = close.end() if close else end
            elif tag not in VOID and not attributes.endswith("/"):
                self.depths.setdefault(tag, []).append(len(self.stack))
                if tag in BLOCKS:
                    self.blocks.append(len(self.stack))
                self.stack.append(own)

    def _cut(self, depth: int) -> None:
        """Closes what is open from ``depth`` on; each element is closed once, so all of it costs as much as the page."""
        for element in reversed(self.stack[depth:]):
            tag = self.tags[element]
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        del self.stack[depth:]

    @staticmethod
    def _kind(attributes: str) -> str:
        if "=" not in attributes:
            return ""
        found = ""
        for groups in NAMES.findall(attributes):
            for word in re.split(r"[^a-z]+", "".join(groups).lower()):
                kind = KIND_OF.get(word, "")
                if kind and (not found or found == "main"):
                    found = kind
        return found

    def _text(self, text: str) -> None:
        self.flow.append((self.stack[-1], unescape(text)))

    def _close(self, tag: str) -> None:
        """An end tag: closes the innermost open element of its name, if there is one and, for inline tags, no block stands between."""
        opened = self.depths.get(tag)
        top = self.blocks[-1] if self.blocks else 0
        if opened and not (tag in INLINE and opened[-1] < top):
            if top >= opened[-1]:
                self.flow.append((self.stack[opened[-1]], None))
            self._cut(opened[-1])
        elif tag == "p" or tag == "br":
            self.flow.append((self.stack[-1], None))

    def container(self, k: int) -> int:
        """1 for an element that may begin the article inside other parts, 0 for one that goes with its parent."""
        return int(self.tags[k] in CONTAINERS or self.kinds[k] == "main")

    def barred(self) -> list[bool]:
        """Whether an element's tag or names, or those of one around it, rule it out; the head of a page does, that of an article doesn't."""
        out, inside = [False] * len(self.tags), [False] * len(self.tags)
        for k, (tag, kind) in enumerate(zip(self.tags, self.kinds, strict=True)):
            up = self.parents[k]
            inside[k] = k > 0 and inside[up] or tag in ("article", "main")
            head = not inside[k] and (tag == "header" or kind == "head" and tag in HEADS)
            out[k] = k > 0 and out[up] or tag in NEVER or head or kind in REJECTED and tag not in WHOLE
        return out

    def features(self) -> list[list[str]]:
        n = len(self.tags)
        own, link = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for element, text in self.flow:
            if text is not None:
                own[element] += len(text.strip())
        inside = [t == "a" for t in self.tags]
        for k in range(1, n):
            inside[k] = inside[k] or inside[self.parents[k]]
        link[inside] = own[inside]
        for k in range(n - 1, 0, -1):
            own[self.parents[k]] += own[k]
            link[self.parents[k]] += link[k]
        out = []
        for k, tag in enumerate(self.tags):
            f = [f"size:{min(int(own[k]).bit_length(), 12) // 3}"]
            if tag not in NEUTRAL:
                f.append(f"tag:{tag}" if tag in PLAIN_TAGS or f"tag:{tag}" in PRIOR or tag == "#root" else "tag:other")
            if self.kinds[k]:
                f.append(f"kind:{self.kinds[k]}")
            if own[k] and tag in LINKED:
                f.append(f"links:{int(3 * link[k] / own[k])}")
            out.append(f)
        return out

    def labels(self) -> list[bool] | None:
        """Article or not, for pages that mark their article up; else None."""
        if "article" not in self.tags and "main" not in self.tags:
            return None
        mark = "article" if "article" in self.tags else "main"
        out = [False] * len(self.tags)
        barred = self.barred()
        for k, tag in enumerate(self.tags):
            up = self.parents[k]
            out[k] = not barred[k] and (tag == mark or up >= 0 and out[up])
        return out

    def text(self, chosen: np.ndarray) -> str:
        blocks: list[str] = []
        held: list[str] = []
        for element, text in [*self.flow, (0, None)]:
            if text is not None:
                if chosen[element]:
                    held.append(text)
                continue
            if held:
                block = SPACE.sub(" ", "".join(held)).strip()
                if block:
                    blocks.append(block)
                held = []
        return "\n\n".join(blocks)


class Model:
    """Log potentials: of features by label, and of a child's label by its parent's, apart for containers and parts of text."""

    def __init__(self, counts: dict[str, int]):
        single: dict[str, np.ndarray] = {k: np.array(v) for k, v in PRIOR.items()}
        pairs = np.array([[[60.0, 0.5], [1.0, 60.0]], [[60.0, 2.0], [1.0, 60.0]]])  # for parts of text, for containers
        totals = np.array([20.0, 10.0])
        for key, n in counts.items():
            name, _, label = key.rpartition("=")
            if name == "pair":
                pairs[int(label[0]), int(label[1]), int(label[2])] += n
            elif name == "node":
                totals[int(label)] += n
            else:
                single.setdefault(name, np.zeros(2))[int(label)] += n
        #: P(child's label | parent's label) of parts of text and of containers.
        self.pairs = (pairs / pairs.sum(axis=2, keepdims=True)).tolist()
        logs = {k: np.log((v + 0.5) / (totals + np.maximum(0, PRIOR.get(k, (0, 0))) + 1.0)) for k, v in single.items()}
        #: Log potential of the article less that of the rest, for each feature.
        self.single = {k: float(v[1] - v[0]) for k, v in logs.items()} | {"tag:#root": -20.0}

    def own(self, page: Page) -> list[float]:
        """Log potential of the article less that of the rest, of each element by itself."""
        return [NEVER_ODDS if barred else sum(map(self.single.get, names, repeat(0.0))) for barred, names in zip(page.barred(), page.features(), strict=True)]

    def marginals(self, page: Page) -> np.ndarray:
        """P(article) of each element by sum-product: messages to the parents, then to the children.

        Labels are binary, so beliefs and messages are log odds of article against the rest. A part that is ruled out
        says nothing of what is around it, so it has no tie to its parent.
        """
        n = len(page.tags)
        up = self.own(page)
        sent = [0.0] * n
        tied = [not x for x in page.barred()]
        pairs = [self.pairs[page.container(k)] for k in range(n)]
        parents = page.parents
        for k in range(n - 1, 0, -1):
            if tied[k]:
                (stay, come), (leave, go) = pairs[k]
                odds = exp(max(-MOST_ODDS, min(MOST_ODDS, up[k])))
                sent[k] = log((leave + go * odds) / (stay + come * odds))
                up[parents[k]] += sent[k]
        for k in range(1, n):
            if tied[k]:
                (stay, come), (leave, go) = pairs[k]
                odds = exp(max(-MOST_ODDS, min(MOST_ODDS, up[parents[k]] - sent[k])))
                up[k] += log((come + go * odds) / (stay + leave * odds))
        return 1 / (1 + np.exp(-np.clip(up, -500, 500)))


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> Model:
    """Potentials from about ``MOST_PAGES`` pages that mark their article up, by a hash of the id."""
    n = pages.count()
    share = F.pmod(F.xxhash64(id_column), F.lit(1_000_003)) / 1_000_003
    sample = pages.where(F.lit(n <= MOST_PAGES) | (share < MOST_PAGES / max(n, 1))).where(F.lower(html_column).rlike("<(article|main)[\\s>]"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        counts: Counter = Counter()
        for html in rows["html"]:
            page = Page(html or "")
            labels = page.labels()
            if labels is None:
                continue
            barred = page.barred()
            for k, names in enumerate(page.features()):
                if barred[k]:
                    continue
                counts[f"node={int(labels[k])}"] += 1
                for name in names:
                    counts[f"{name}={int(labels[k])}"] += 1
                if k:
                    counts[f"pair={page.container(k)}{int(labels[page.parents[k]])}{int(labels[k])}"] += 1
        return {"key": list(counts), "n": list(counts.values())}

    counts = map_arrow(sample, [F.col(html_column).alias("html")], run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Model({r["key"]: r["n"] for r in counts.collect()})  # some hundred kinds of feature


def extract(pages: DataFrame, model: Model, columns: list[str], html_column: str = "html") -> DataFrame:
    """``columns`` of the pages with ``text``, the main text, empty if there is none."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = []
        for html in rows["__html"]:
            page = Page(html or "")
            texts.append(page.text(sent.value.marginals(page) > 0.5))
        return {c: rows[c] for c in columns} | {"text": texts}

    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(pages, [*columns, F.col(html_column).alias("__html")], run, f"{schema}, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
