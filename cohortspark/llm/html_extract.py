"""Main text of web pages, by a consensus on where each host keeps it.

Each page's containers are scored by the text that they hold. The best container's path, generalised (tags with
classes, digits as one sign), is the page's vote; votes are counted per host in Spark. Then each page is read
again, and its text taken from the containers on its host's winning path.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import map_batches, store

# A tag ends at the first > outside quotes or with the page; a quote that is never closed is a sign like any other.
# Nothing in it is tried twice. LOOSE is for pages whose quotes hide the end of a tag: there quotes say nothing.
TAG = re.compile(
    r"""<!--[\s\S]*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)"""
)
LOOSE = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""")
CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "svg", "math", "object"}
TO_THE_END = {"script", "style", "title", "textarea", "xmp", "iframe"}  # unclosed, they hold the rest of the page
SELF_CLOSED = {"svg", "math"}
DEEP = 256  # elements further in belong to the container at this depth
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "td", "th", "tr"}
LEAVES |= {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "figure", "caption", "hr"}
OUTSIDE = {"nav", "footer", "aside", "head", "button", "select", "menu", "dialog"}
OUTSIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "related", "replies", "share", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "widget",
}
ENDED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}}
ENDED_BY |= {"td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DIGITS = re.compile(r"\d+")


def _names(attributes: str, first: bool) -> tuple[str, list[str]]:
    """The classes as part of a path, and the names of class, id and role, each whole and, if asked, its first word."""
    classes, words = "", []
    if attributes.strip():
        for kind, *values in CLASS.findall(attributes):
            value = next((v for v in values if v), "").lower()
            words += value.split()
            if first:
                words += [re.split(r"[^a-z0-9]+", name)[0] for name in value.split()]
            if kind.lower() == "class":
                classes = "".join(f".{DIGITS.sub('#', c)}" for c in sorted(value.split()))
    return classes, words


class Page:
    """Blocks of a page in order: (path of the container, text, characters in links); what lies outside is left out."""

    def __init__(self, html: str):
        self._read(html, frozenset())
        if released := self._released():
            self._read(html, released)

    def _released(self) -> frozenset[int]:
        """Forms and elements with an outside name that stay: they hold article or main, or most text of a page
        without either."""
        whole, held = sum(self.sizes.values()), Counter()
        for around, n in self.sizes.items():
            for at in around:
                held[at] += n
        return frozenset(at for at in self.named if at in self.holders or (not self.has_main and 2 * held[at] > whole))

    def _read(self, html: str, released: frozenset[int]) -> None:
        """released: positions of elements whose names say nothing."""
        self.blocks: list[tuple[str, str, int]] = []
        self.named: set[int] = set()  # positions of elements that are outside by their name
        self.holders: set[int] = set()  # those of them that hold article or main
        self.has_main = False
        self.sizes: dict[tuple[int, ...], int] = {}  # text by the named elements around it
        stack: list[tuple] = []  # (tag, path, outside, container path, in a link, named elements, outside by its tag)
        self.text: list[str] = []
        self.linked = 0
        top = ("", "", False, ">root", False, (), False)  # text outside any element
        at = 0
        n = len(html)
        tags = TAG
        opened: Counter[str] = Counter()  # tags on the stack
        unclosed: set[str] = set()  # tags that the rest of the page does not close
        while at < n:
            found = tags.search(html, at)
            if found and found[2] and not found[4] and tags is TAG:
                tags = LOOSE
                found = tags.search(html, at)
            now = stack[-1] if stack else top
            end = found.start() if found else n
            text = html[at:end]
            if text and not now[6]:
                self.sizes[now[5]] = self.sizes.get(now[5], 0) + len("".join(text.split()))
            if text and not now[2]:
                self.text.append(text)
                if now[4]:
                    self.linked += len(text)
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
            if not tag:
                continue
            if tag in RAW and not closing:
                if tag in SELF_CLOSED and attributes.endswith("/"):
                    continue
                last = None if tag in unclosed else re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
                if last:
                    at = last.end()
                elif tag in TO_THE_END:
                    at = n
                else:
                    unclosed.add(tag)
                continue
            if tag == "br":
                self.text.append(" ")
                continue
            if tag not in INLINE:
                self._flush(now[3])
            if closing:
                while opened[tag]:
                    last_tag = stack.pop()[0]
                    opened[last_tag] -= 1
                    if last_tag == tag:
                        break
                continue
            if tag in VOID or attributes.endswith("/"):
                continue
            if tag not in INLINE:
                self._imply(stack, tag, opened)
            now = stack[-1] if stack else top
            classes, words = _names(attributes, tag not in LEAVES)
            path = f"{now[1]}>{tag}{classes}" if len(stack) < DEEP else now[1]
            header = tag == "header" and not re.search(r">(article|main)\b", now[1])
            by_tag = now[6] or tag in OUTSIDE or header
            around = now[5]
            if tag in ("article", "main") and not by_tag:
                self.has_main = True
                self.holders.update(around)
            outside = now[2] or by_tag
            by_name = tag not in INLINE and not OUTSIDE_NAMES.isdisjoint(words)
            if tag not in ("body", "html", "article", "main") and at not in released and (by_name or tag == "form"):
                outside = True
                if len(around) < DEEP:
                    around = (*around, at)
                    self.named.add(at)
            container = now[3]
            if tag not in INLINE and tag not in LEAVES and not re.search(r">(article|main)\b", container):
                container = path
            stack.append((tag, path, outside, container, now[4] or tag == "a", around, by_tag))
            opened[tag] += 1
        self._flush((stack[-1] if stack else top)[3])

    @staticmethod
    def _imply(stack: list[tuple], tag: str, opened: Counter[str]) -> None:
        """Ends the paragraph, list item or cell that a new block ends, if not too many inline elements are between."""
        for k in range(len(stack) - 1, max(-1, len(stack) - DEEP), -1):
            open_tag = stack[k][0]
            if open_tag == "p" or tag in ENDED_BY.get(open_tag, ()):
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if open_tag not in INLINE:
                return

    def _flush(self, container: str) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                self.blocks.append((container, text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def scores(self) -> dict[str, float]:
        """Score of each container path: characters outside links, and half of a container's for the one around it."""
        scores: dict[str, float] = {}
        for container, text, linked in self.blocks:
            value = float(len(text) - linked)
            while container and value >= 1:
                scores[container] = scores.get(container, 0.0) + value
                container, value = container.rpartition(">")[0], value / 2
        return scores

    def best(self) -> tuple[str, float]:
        scores = self.scores()
        path = max(scores, key=lambda p: (scores[p], -len(p), p), default="")
        path = self._wider(path)
        return path, scores.get(path, 0.0)

    def _wider(self, path: str) -> str:
        """The path, or that of the container around it while the text that it adds is mostly outside links.

        article and main are whole as they are; body is never taken for what one of its children holds.
        """
        if re.search(r">(article|main)\b", path):
            return path
        inside = lambda c, p: c == p or c.startswith(p + ">")
        parent = path.rpartition(">")[0]
        while parent and not re.search(r">(body|html|root)[^>]*\Z", parent):
            added = [(len(t), linked) for c, t, linked in self.blocks if inside(c, parent) and not inside(c, path)]
            if 2 * sum(n for _, n in added) > sum(n for n, _ in added):
                break
            if added:
                path = parent
            parent = parent.rpartition(">")[0]
        return path

    def extract(self, path: str | None) -> str:
        """Text in the containers on a path; on a page without them, in its own best container."""
        inside = lambda c, p: c == p or c.startswith(p + ">")
        if not path or not any(inside(c, path) for c, _, _ in self.blocks):
            path = self.best()[0]
        return "\n".join(text for c, text, _ in self.blocks if path and inside(c, path))


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, score): the best container of each page. Pages without text don't vote."""

    def run(batch):
        best = [Page(h or "").best() for h in batch.column(1).to_pylist()]
        return batch.column(0), [p for p, _ in best], [s for _, s in best]

    found = map_batches(pages, [url_host(F.col(url)), html], run, "host string, path string, score double")
    return found.where("path <> ''")


def winning_paths(voted: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, then most text, then the first in order.

    Votes are counted by (host, path) with partial sums, so a host with very many pages is no more than a few rows.
    """
    counted = voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    best = F.min_by("path", F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path"))
    return counted.groupBy("host").agg(best.alias("path"))


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): main text of every page, from the whole html.

    Null html is an empty page with an empty text; a null url belongs to the host ''. Character references are
    decoded, white space within a block becomes one space, blocks are joined by a line break. Repeated rows give
    repeated results, an empty table none. Pages whose host has no vote use their own best container.
    """
    paths = store(winning_paths(votes(pages, url, html)), "host-paths")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", url_host(F.col("url"))).join(paths, "host", "left")

    def run(batch):
        text = [Page(h or "").extract(p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return batch.column(0), batch.column(1), text

    schema = f"page_id {id_type(rows, 'page_id')}, url string, text string"
    return map_batches(rows, ["page_id", "url", "html", "path"], run, schema)
