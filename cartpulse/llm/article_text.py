"""Main text of web pages by consensus paths of a host.

1. Every page is parsed into a light tree; its containers are scored: characters of text outside links, halved with
   each container between, weighted by tag and class words.  The best one gives the page's vote, a generalised path of
   tags and classes (``div.content>article.post-#``; digits become ``#``).
2. Spark counts votes by host and path (map-side first, so a host with a third of all pages is a few rows) and ranks
   each host's paths.
3. Every page is extracted anew with the first of its host's paths that it has with text in it, all elements at that
   path in page order; without one, with its own best container.

The text of a container leaves out menus, footers, sidebars, notices, adverts, forms, scripts, reader comments and what
is hidden (known by tag, role or class words); all else stays, whole.  Character references are decoded, white
space becomes one space, and blocks are joined by one space.

Pages are parsed row by row inside tasks; only votes are shuffled, and the pages themselves only if the ranked
paths of all hosts, which are written first, are beyond Spark's broadcast threshold (a hot host is then split by
adaptive execution).  Nulls: a null html is an empty page, with empty text.  A page
whose url is null or names no host votes for nothing and is read by its own best container.  Repeated rows are rows of
their own; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartpulse.llm.common import written

# Paths that a host keeps.
PATHS = 3

# Fixed values of HTML: elements by kind, in the standard's terms.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes title textarea".split())
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - set("br button caption dd dt body html iframe legend li option select tbody td textarea tfoot th thead title tr".split())
IN_HEAD = set("base link meta noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Start tag -> open elements that it ends, and the elements that the search for them doesn't leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
SCOPE = set("td th table caption button object template html".split())

# What is never main text, by tag, role and the words of classes and ids.
LEFT_OUT = set(
    "nav footer aside form script style noscript template iframe object embed svg canvas audio video button select input textarea dialog menu head title "
    "noembed noframes xmp".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
REMARKS = set("comment comments commentlist disqus respond reply replies discussion".split())
WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager toolbar sidebar widget widgets aside footer masthead topbar share sharing social related recommended recommendations "
    "teaser search skip hidden".split()
)
# A class "header" is one of the page alone or after these words, not in "section-header".
OF_SITE = set("site page top main global".split())
# "has-sidebar" and the like speak of a page, not of the element.
OF_PAGE = set("has with no without is open".split())
GOOD = set("content article post entry story text body main".split())
CONTAINERS = set("article main section div td body center".split())
WEIGHTS = {"article": 4.0, "main": 2.0, "section": 0.9, "body": 0.5}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"  # tag
    r"|<[!?/][^>]*+(?:>|\Z)",  # declaration
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)\s*+(?:=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Page:
    """The elements of a page (``tag``, ``parent``, ``marks``, ``flag``) and its text ``pieces`` (element, text; None ends a block)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks, self.flag = ["body"], [-1], [""], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._open: dict[str, int] = {}  # open elements by tag
        self._read(source)
        self._holds()

    def _read(self, source: str) -> None:
        stack, at, pieces, end = [0], 0, self.pieces, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                text = source[at:stop]
                if self.tag[stack[-1]] == "head" and not text.isspace():
                    self._end(stack, -1)
                pieces.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not found:
                return
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if name in BLOCKS:
                pieces.append((stack[-1], None))
            if found[1]:
                self._close(stack, name)
                continue
            if name == "html":
                continue
            if name == "body":
                self._end(stack, 1)
                continue
            self._make_room(stack, name)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            marks, flag = _judged(name, found[3]) if found[3] else ("", 2 if name in LEFT_OUT else 0)
            self.marks.append(marks)
            self.flag.append(flag)
            if name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = closing.start() if closing else end
            if name not in VOID:
                stack.append(node)
                self._open[name] = self._open.get(name, 0) + 1

    def _end(self, stack: list[int], at: int) -> None:
        """End the open elements from position ``at`` of the stack on."""
        for node in stack[at:]:
            self._open[self.tag[node]] -= 1
        del stack[at:]

    def _end_up_to(self, stack: list[int], names: set[str], stop) -> None:
        """End the innermost open element with one of ``names``, and all inside it, unless ``stop`` holds for a tag before."""
        if not any(self._open.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                self._end(stack, i)
                return
            if stop(tag):
                return

    def _close(self, stack: list[int], name: str) -> None:
        # an inline end tag doesn't reach beyond its block, nor a block's beyond its table cell
        rows = name in ("tr", "table", "tbody", "thead", "tfoot")
        self._end_up_to(stack, {name}, lambda tag: (name not in BLOCKS and tag in BLOCKS) or (tag in ("td", "th", "template") and not rows))

    def _make_room(self, stack: list[int], name: str) -> None:
        if self.tag[stack[-1]] == "head" and name not in IN_HEAD:
            self._end(stack, -1)
        if name in ENDS:
            ended, within = ENDS[name]
            self._end_up_to(stack, ended, within.__contains__)
        if name in CLOSES_P:
            self._end_up_to(stack, {"p"}, SCOPE.__contains__)
            if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                self._end(stack, -1)

    def _holds(self) -> None:
        """An element known by layout words alone stays if it holds the page's heading, or an article and most of the text."""
        n = len(self.tag)
        heading, article, size = [t == "h1" for t in self.tag], [t in ("article", "main") for t in self.tag], [0] * n
        for node, text in self.pieces:
            size[node] += len(text.strip()) if text else 0
        for i in range(n - 1, 0, -1):
            if self.flag[i] < 2:
                up = self.parent[i]
                heading[up], article[up] = heading[up] or heading[i], article[up] or article[i]
                size[up] += size[i]
        for i in range(n):
            if self.flag[i] == 1 and (heading[i] or (article[i] and 2 * size[i] > size[0])):
                self.flag[i] = 0

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.tag[node] + self.marks[node])
            node = self.parent[node]
        return ">".join(reversed(steps)) or "body"

    def places(self, paths: list[str]) -> dict[str, set[int]]:
        """The elements at each of ``paths``."""
        # a step's number is that of the way to it: no path of a deep page is ever written out
        by_way = {}
        for path in paths:
            at = hash(())
            for step in path.split(">") if path != "body" else ():
                at = hash((at, step))
            by_way[at] = path
        way, found = [hash(())] * len(self.tag), {}
        for i in range(len(self.tag)):
            if i:
                way[i] = hash((way[self.parent[i]], self.tag[i] + self.marks[i]))
            if way[i] in by_way and (i == 0 or self.tag[i] in CONTAINERS) and self.path(i) == by_way[way[i]]:
                found.setdefault(by_way[way[i]], set()).add(i)
        return found

    def best(self) -> tuple[int, float]:
        """The container with the highest score, the earlier of equal ones, and its score."""
        found = self._best(True)
        return found if found[1] > 0 else self._best(False)

    def _best(self, leave_out: bool) -> tuple[int, float]:
        n = len(self.tag)
        out, link, home = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            out[i] = tag in RAW or (leave_out and (out[up] or self.flag[i] > 0))
            link[i] = link[up] or tag == "a"
            home[i] = i if tag in CONTAINERS else home[up]
        own = [0.0] * n
        for node, text in self.pieces:
            if text and not out[node] and not link[node]:
                own[home[node]] += len(text.strip())
        score = [0.0] * n
        # children come after their parents: halves are handed upwards from the back
        for i in range(n - 1, 0, -1):
            if home[i] == i:
                score[i] += own[i]
                score[home[self.parent[i]]] += score[i] / 2
        score[0] += own[0]
        for i in range(n):
            if home[i] == i and score[i]:
                words = set(self.marks[i].split("."))
                score[i] *= WEIGHTS.get(self.tag[i], 1.0) * (1.5 if words & GOOD else 1.0)
        top = max(range(n), key=lambda i: (score[i], -i))
        return top, score[top]

    def text(self, chosen: set[int]) -> str:
        """The text inside the elements ``chosen``, without what is left out below them."""
        inside, out = [False] * len(self.tag), [False] * len(self.tag)
        for i in range(len(self.tag)):
            up = self.parent[i]
            if i in chosen and not (up >= 0 and inside[up]):
                inside[i] = True
            elif up >= 0:
                inside[i] = inside[up]
                out[i] = out[up] or self.flag[i] > 0
        return " ".join("".join([" " if t is None else t for node, t in self.pieces if inside[node] and not out[node]]).split())


def _judged(name: str, attributes: str) -> tuple[str, int]:
    """Generalised classes (``.post-#.wide``) and whether the element is left out: 2 certainly, 1 by layout words, 0 not."""
    given = {k.lower(): a or b or c or "" for k, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}
    classes = given.get("class", "").split()
    marks = "".join("." + c for c in sorted({re.sub(r"\d+", "#", c.replace(">", "")) for c in classes}))
    if name in LEFT_OUT or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return marks, 2
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return marks, 2
    flag = 0
    for c in [*classes, given.get("id", "")]:
        words = [w.lower() for w in _WORDS.findall(c)]
        if not words or words[0] in OF_PAGE or words[-1] in OF_PAGE or name == "main":
            continue
        if words[0] in REMARKS or words[-1] in REMARKS:
            return marks, 2
        site_header = words[-1] == "header" and (len(words) == 1 or words[0] in OF_SITE)
        if name != "article" and (site_header or any(w in WORDS for w in words)):
            flag = 1
    if name == "header":
        flag = 1
    return marks, flag


def vote(source: str | None) -> tuple[str | None, float]:
    """The path of the page's best container and its score; no path for a page without text."""
    page = _Page(source or "")
    node, score = page.best()
    return (page.path(node), score) if score > 0 else (None, 0.0)


def extract(source: str | None, paths: list[str]) -> str:
    """The text at the first of ``paths`` that has any, else that of the page's best container."""
    page = _Page(source or "")
    places = page.places(paths) if paths else {}
    for path in paths:
        if path in places and (text := page.text(places[path])):
            return text
    return page.text({page.best()[0]})


@F.pandas_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]))
def _votes(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([vote(p) for p in pages], columns=["path", "score"])


@F.pandas_udf(T.StringType())
def _texts(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([extract(p, [] if k is None else list(k)) for p, k in zip(pages, paths)], dtype=object)


def host(url: str = "url") -> Column:
    """The lower-case host of a url, null if it names none."""
    found = F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(found))


def consensus(pages: DataFrame) -> DataFrame:
    """host, paths: each host's paths by votes (most first; ties by total score, then by path), at most ``PATHS``."""
    votes = (
        pages.select(host().alias("host"), _votes("html").alias("vote"))
        .filter(F.col("host").isNotNull() & F.col("vote.path").isNotNull())
        .groupBy("host", F.col("vote.path").alias("path"))
        .agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("vote.score").cast("long")).alias("score"))
    )
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")  # one row per path of a host
    ranked = votes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PATHS)
    return ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    # written first, so that its size is known when the join is planned: pages are not shuffled for a small one
    paths = written(consensus(pages), "host-paths")
    read = rows.join(paths, "host", "left").select("page_id", "url", _texts("html", "paths").alias("text"))
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
