"""Main text of web pages by consensus of their hosts.

Each page votes for the generalised tag-class path of its article, the best container or what is around it; votes are counted per host in Spark; every
page is then read again along its host's winning path (along its own article where the host's path is not on
the page). Both passes read one page at a time; what meets in Spark is one row per host and path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batches, discard, materialize, texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
#: Elements whose text belongs to the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr math semantics annotation mrow mi mn mo ms mtext mspace mstyle mpadded mfenced msup msub msubsup mfrac msqrt mroot mover munder munderover".split())
#: Blocks of running text; their surroundings are the container.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead table ul ol dl figcaption figure caption address".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are never main text, those that are not unless they hold it, and the words in class, id or role that mark such elements.
NEVER = frozenset("script style noscript template iframe button select option head title canvas audio video input textarea".split())
DROP = frozenset("nav header footer aside form dialog menu".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion reply replies respond search sidebar sidenav skip sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo alert alertdialog".split())
#: Those of them that say the same of a heading or a paragraph; the others name places on a page, which these are not.
OFFERS = frozenset("ad ads adv advert adverts advertisement advertising comment comments consent cookie cookies newsletter notice notices notification promo promoted promotion reply replies sponsor sponsored subscribe subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RUNNING = HEADINGS | frozenset("p blockquote pre li dt dd figcaption caption td th tr".split())
#: What may follow a mark in a name (sidebar-left), and what turns one into a statement about a layout (has-sidebar).
AFTER = frozenset("area author bar block body bottom box button buttons container content group holder inner item items left link links list meta outer panel primary region right secondary section slot text title top unit wrap wrapper zone".split())
ABOUT = frozenset("has have hide hides no not with without".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())


def host_of(url: str | None) -> str:
    """The host in lower case; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _mark(parts: list[str]) -> str:
    """The mark that a name's parts end with, or start with if only places and kinds of boxes follow; '' if there is none.

    The header of an entry, a post or an article is a part of it.
    """
    parts = [p for p in parts if not p.isdigit()]
    if not parts or not ABOUT.isdisjoint(parts) or parts[-1] == "header" and not GOOD.isdisjoint(parts):
        return ""
    if parts[-1] in MARKS:
        return parts[-1]
    return parts[0] if parts[0] in MARKS and all(p in AFTER or p in MARKS for p in parts[1:]) else ""


def _words(attributes: str) -> tuple[list[str], list[str], set[str]]:
    """Class tokens, all words of class, id and role, and the marks of something besides the text among the names ('hidden' is one)."""
    classes, words, marks = [], [], set()
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        if name in ("class", "id", "role"):
            value = unescape(m.group(2) or m.group(3) or m.group(4) or "").lower()
            tokens = value.split()
            if name == "class":
                classes = tokens
            for t in tokens:
                parts = [w for w in re.split(r"[-_]+|(?<=\D)(?=\d)", t) if w]
                words += [t, *parts]
                marks.add(_mark(parts))
        elif name in ("hidden", "aria-hidden") and (m.group(2) or m.group(3) or m.group(4)) == "true":
            marks.add("hidden")
    return classes, words, marks - {""}


def step(tag: str, classes: list[str]) -> str:
    """One step of a generalised path: digits in class names do not count."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])


class Page:
    """The blocks of a page: (text, characters in links, containers around it); dropped elements leave none.

    What is marked as something besides the text is dropped only when the page has been read: an element stays if it
    holds more text in an article or main element than stands outside all marked ones, or, on a page without such
    text, the most of all and more than three times what stands outside. A page of which nothing would be left is read without regard to marks.
    """

    def __init__(self, html: str, drop: bool = True):
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        #: The innermost marked element around each block (-1: none), and whether an article or main stands between.
        places: list[tuple[int, bool]] = []
        #: Marked elements: the next one around it, and whether an article or main stands between.
        marked_in: list[tuple[int, bool]] = []
        self.paths: list[str] = []
        self.bonus: list[int] = []
        self.tags: list[str] = []
        #: The container around each container, or -1.
        self.above: list[int] = []
        #: Open elements: (tag, container number or -1, whether it is never text, place of what is in it)
        stack: list[tuple[str, int, bool, tuple[int, bool]]] = []
        parts: list[str] = []
        linked = at = 0
        dropped = links = 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, linked, tuple(x[1] for x in stack if x[1] >= 0)))
                    places.append(stack[-1][3] if stack else (-1, False))
            parts, linked = [], 0

        def pop() -> None:
            nonlocal dropped, links
            tag, _, gone, _ = stack[-1]
            if tag not in INLINE:
                flush()
            stack.pop()
            dropped -= gone
            links -= tag == "a"

        def close(tag: str, stops: frozenset = frozenset()) -> None:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in stops:
                    return

        while (m := TOKEN.search(html, at)) is not None:
            if not dropped and m.start() > at:
                piece = unescape(html[at : m.start()])
                parts.append(piece)
                linked += len(piece) if links else 0
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                if tag == "p" and not any(x[0] == "p" for x in stack):
                    flush()
                elif tag not in VOID:
                    close(tag, frozenset(("td", "th", "table")) if tag in INLINE or tag == "p" else frozenset())
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "body" and stack and any(x[0] == "head" for x in stack):
                close("head")
            if tag in CLOSES_P:
                close("p", frozenset(("td", "th", "button", "table", "article", "section", "div", "li")))
            elif tag == "li":
                close("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                close("dt", frozenset(("dl",)))
                close("dd", frozenset(("dl",)))
            elif tag in ("td", "th"):
                close("td", frozenset(("tr", "table")))
                close("th", frozenset(("tr", "table")))
            elif tag == "tr":
                close("tr", frozenset(("table",)))
            if tag not in INLINE:
                flush()
            if tag in VOID or m.group(3).endswith("/") and tag not in INLINE | LEAF and tag not in ("div", "section", "article", "main", "body", "html"):
                continue
            classes, words, marks = _words(m.group(3)) if "=" in m.group(3) else ([], [], set())
            main = tag in ("article", "main")
            inside = bool(stack) and stack[-1][3][1]
            if tag in HEADINGS or inside and tag in RUNNING:
                marks &= OFFERS | {"hidden"}
            marked = bool(marks)
            # the header of an article is that of its title, not of the page
            soft = drop and (tag in DROP and not (tag == "header" and any(x[0] == "article" for x in stack)) or marked and not main and tag not in ("html", "body"))
            gone = tag in NEVER or soft and tag in INLINE
            place = stack[-1][3] if stack else (-1, False)
            if soft and not gone and not dropped:
                marked_in.append(place)
                place = (len(marked_in) - 1, False)
            elif main and not marked:
                place = (place[0], True)
            number = -1
            if not gone and not dropped and tag not in INLINE and tag not in LEAF and tag not in ("html",):
                number = len(self.paths)
                above = next((x[1] for x in reversed(stack) if x[1] >= 0), -1)
                self.paths.append(f"{self.paths[above]}>{step(tag, classes)}" if above >= 0 else step(tag, classes))
                self.tags.append(tag)
                self.above.append(above)
                self.bonus.append(2 * main + (not GOOD.isdisjoint(words)))
            stack.append((tag, number, gone, place))
            dropped += gone
            links += tag == "a"
        if not dropped and at < len(html):
            parts.append(unescape(html[at:]))
        flush()
        if marked_in:
            kept = self._kept(places, marked_in)
            self.blocks = [b for b, (i, _) in zip(self.blocks, places, strict=True) if i < 0 or kept[i]]
        if drop and not self.blocks:
            self.__init__(html, False)

    def _kept(self, places: list[tuple[int, bool]], marked_in: list[tuple[int, bool]]) -> list[bool]:
        """For each marked element, whether it and all around it stay: inner ones are judged first, and count for outer ones if they stay."""
        worth, main = [0] * (len(marked_in) + 1), [0] * (len(marked_in) + 1)  # the last is outside all
        for (text, linked, _), (i, inside) in zip(self.blocks, places, strict=True):
            w = max(len(text) - 2 * linked, 0)
            worth[i] += w
            main[i] += w * inside
        outside, outside_main, most = worth[-1], main[-1], max(worth[:-1])
        any_main = any(main) or any(inside for _, inside in marked_in)
        kept = [False] * len(marked_in)
        for i in range(len(marked_in) - 1, -1, -1):
            kept[i] = main[i] > outside_main if any_main else worth[i] >= most and worth[i] > 3 * outside
            around, inside = marked_in[i]
            if kept[i] and around >= 0:
                worth[around] += worth[i]
                main[around] += worth[i] if inside else main[i]
        for i, (around, _) in enumerate(marked_in):
            kept[i] = kept[i] and (around < 0 or kept[around])
        return kept

    def scores(self) -> dict[int, float]:
        """Text outside links in the blocks right below each container, a third of it for the one above; times its bonus."""
        out: dict[int, float] = {}
        for text, linked, around in self.blocks:
            worth = max(len(text) - 2 * linked, 0)
            for share, c in zip((1.0, 0.34), reversed(around), strict=False):
                out[c] = out.get(c, 0.0) + share * worth
        return {c: s * (1 + self.bonus[c]) for c, s in out.items()}

    def best(self) -> tuple[str, float] | None:
        """The path of the article, and the score of the container that it was found by: the best one, of equal ones the first."""
        s = self.scores()
        if not s:
            return None
        c = max(s, key=lambda c: (s[c], -c))
        return self.paths[self._whole(c)], s[c]

    def _whole(self, c: int) -> int:
        """The article that a container is a part of.

        That is the outermost article or main element around it. Without one it is what is around the container, up to
        the body, as long as the text that is added is mostly outside links.
        """
        around = [c]
        while self.above[around[-1]] >= 0:
            around.append(self.above[around[-1]])
        tags = [self.tags[x] for x in around]
        if not {"article", "main"}.isdisjoint(tags):
            return around[max(i for i, t in enumerate(tags) if t in ("article", "main"))]
        at, end = 0, tags.index("body") if "body" in tags else len(tags)
        chars, linked = dict.fromkeys(around, 0), dict.fromkeys(around, 0)
        for text, links, inside in self.blocks:
            for x in inside:
                if x in chars:
                    chars[x] += len(text)
                    linked[x] += links
        for i in range(1, end):
            more, links = (of[around[i]] - of[around[at]] for of in (chars, linked))
            if more and 2 * links >= more:
                break
            if more:
                at = i
        return around[at]

    def text(self, path: str | None) -> str | None:
        """The blocks in all containers with that path, in page order, joined by newlines; None if there is no such container."""
        own = {i for i, p in enumerate(self.paths) if p == path}
        if not own:
            return None
        return "\n".join(t for t, _, around in self.blocks if own.intersection(around))


def extract(html: str, path: str | None) -> str:
    page = Page(html)
    text = page.text(path) if path else None
    if not text:
        best = page.best()
        text = page.text(best[0]) if best else "\n".join(t for t, _, _ in page.blocks)
    return text or ""


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the path with the most pages' votes, then the largest score, then the last by name.

    Votes are added up per partition before they are dealt out, so a host with very many pages is no heavy key. Pages
    without a host have no vote.
    """
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            votes: dict[tuple[str, str], list[float]] = {}
            for url, html in zip(texts(b, "url"), texts(b, "html"), strict=True):
                if host := host_of(url):
                    if best := Page(html).best():
                        v = votes.setdefault((host, best[0]), [0, 0.0])
                        v[0] += 1
                        v[1] += best[1]
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k][0] for k in keys], pa.int64()), pa.array([int(votes[k][1]) for k in keys], pa.int64())], ["host", "path", "votes", "score"])

    votes = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, votes long, score long")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return total.groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 50_000) -> DataFrame:
    """id_col, url_col, text, n_chars (code points) of every page.

    The text is that of the article, without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and comments, but with those that hold the article (see Page); white space inside a block is one space, blocks are joined by one newline. A null or empty
    page has the text ''; a page without a host uses its own article; rows with equal or null ids each get a
    row; an empty table gives an empty result; other columns are not read. The table of winning paths is broadcast
    only up to that many hosts; beyond, pages are joined to it by host, each host's row repeated for 16 salts, so
    that no task gets all pages of a heavy host.
    """
    arrow_limits(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    winners = materialize(host_paths(rows), "host-paths")
    few = winners.limit(broadcast_hosts + 1).collect()  # at most so many rows of a host and a path

    def run(batches: Iterator[pa.RecordBatch], paths: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            own = [paths.get(host_of(u)) for u in texts(b, "url")] if paths is not None else b.column(3).to_pylist()
            out = [extract(h, p) for h, p in zip(texts(b, "html"), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"
    if len(few) <= broadcast_hosts:
        known = {x.host: x.path for x in few}
        discard(winners)
        out = rows.mapInArrow(lambda bs: run(bs, known), schema)
    else:

        def with_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_batches(batches):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in texts(b, "url")], pa.string())], ["id", "url", "html", "host"])

        dealt = rows.mapInArrow(with_hosts, f"id {kind}, url string, html string, host string").withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(16)).cast("int"))
        wide = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = dealt.join(wide, ["host", "salt"], "left").select("id", "url", "html", "path").mapInArrow(run, schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
