"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text they hold, and the page votes for the generalised tag-class path of its
best one. Spark sums the votes of a host; the path with most votes is the host's. A second pass takes the text below
that path, or below the page's own best container where the page has no such path.

An article's own header is part of it; its footer, which holds tags and links for sharing, is not. Elements may be nested
as deep as they like, and end tags that close nothing cost nothing: work grows with the length of a page.

A null or empty page has an empty text; a page without markup is one container. Pages with no host vote together. Rows
that repeat a page stay separate rows. Other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import workers
from docloom.llm.shared import written

#: Share of a container's score that counts for the container around it.
OUTER_SHARE = 0.5

CONTAINERS = frozenset("body main article section div td".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head header iframe map menu nav noscript object script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
CLOSES_PARAGRAPH = BLOCKS - {"caption", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "head", "html", "title", "summary", "legend", "figcaption"}
#: Elements within which a new block does not end a paragraph around them.
KEEPS_PARAGRAPH = CONTAINERS | {"table", "blockquote", "li", "form"}
#: Elements that an opening tag of the same kind ends, up to the element that limits the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of class, id and role attributes that mark what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|alert|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|consent|cookies?|disqus|disclaimer|dialog|footer|form|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pagination|pager|paywall|popup|promo\w*|recommend\w*|related(?=$|\s|[_-](?:articles?|box|content|entries|items?|links?|list|news|pages?|posts?|reading|section|stories|topics?|videos?|widget)(?=$|[\s_-]))|replies|reply|search|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|tags|toolbar|toc|warning|widget)(?=$|[\s_-])"
)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_DIGITS = re.compile(r"\d+")


class Node:
    """An open element that matters: a container, or one whose text is dropped."""

    __slots__ = ("dropped", "label", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, label: str, dropped: bool):
        self.tag, self.parent, self.label, self.dropped = tag, parent, label, dropped
        self.score = 0.0

    @property
    def path(self) -> str:
        labels, node = [], self
        while node is not None:
            labels.append(node.label)
            node = node.parent
        return "/".join(reversed(labels))


class Stack:
    """Open elements with the places of each tag, so that looking for one takes no walk."""

    def __init__(self, root: Node):
        self.tags, self.nodes = [""], [root]
        self.where: dict[str, list[int]] = {"": [0]}

    def push(self, tag: str, node: Node) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of the tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.where.get(t))), default=0)

    def first_after(self, tags: Iterable[str], place: int) -> int:
        """The outermost one behind `place`; 0 if there is none."""
        found = [at[k] for t in tags if (at := self.where.get(t)) and (k := bisect_right(at, place)) < len(at)]
        return min(found, default=0)

    def cut(self, to: int) -> bool:
        """Close all from `to` on; whether a block ended."""
        block = self.nodes[-1] is not self.nodes[to - 1]
        for tag in self.tags[to:]:
            self.where[tag].pop()
            block = block or tag in BLOCKS
        del self.tags[to:], self.nodes[to:]
        return block


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTRIBUTE.finditer(raw)}


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def _is_boilerplate(tag: str, attributes: dict[str, str], parent: Node) -> bool:
    if tag == "header" and parent.tag in ("article", "main", "section"):
        return False  # the title of an article, not the head of the page
    if tag in DROPPED or "hidden" in attributes:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    marks = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
    return bool(marks and BOILERPLATE.search(marks))


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks of visible text with their container, and the containers of a page, both in page order."""
    root = Node("", None, "", False)
    nodes, blocks, stack = [root], [], Stack(root)
    text: list[str] = []
    state = {"linked": 0}

    def flush(node: Node) -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block and not node.dropped:
                blocks.append((node, block))
                node.score += max(0, len(block) - 3 * state["linked"])
        state["linked"] = 0

    def say(raw: str) -> None:
        if raw:
            node = stack.nodes[-1]
            if not node.dropped:
                raw = entities.unescape(raw) if "&" in raw else raw
                text.append(raw)
                if "a" in stack.tags[-3:]:
                    state["linked"] += len(raw.strip())

    def pop(to: int) -> None:
        node = stack.nodes[-1]
        if stack.cut(to):
            flush(node)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if k := stack.last((tag,)):
                pop(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush(stack.nodes[-1])
            if tag in CLOSES_PARAGRAPH and (k := stack.last("p")) > stack.last(KEEPS_PARAGRAPH):
                pop(k)
        if tag in SIBLINGS:
            ended, limits = SIBLINGS[tag]
            if cut := stack.first_after(ended, stack.last(limits)):
                pop(cut)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        node = stack.nodes[-1]
        raw = m[3]
        attributes = _attributes(raw) if "=" in raw else ({"hidden": ""} if "hidden" in raw.lower().split() else {})
        if tag in RAW:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else end
            continue
        dropped = node.dropped or _is_boilerplate(tag, attributes, node)
        if tag in CONTAINERS or dropped != node.dropped:
            flush(node)
            node = Node(tag, node, _label(tag, attributes), dropped)
            if not dropped:
                nodes.append(node)
        stack.push(tag, node)
    flush(stack.nodes[-1])
    return blocks, nodes


def best_container(nodes: list[Node]) -> Node:
    """Containers pass a share of their score outwards; the page's is the first with the highest total, or what it is part of.

    That is the nearest article or main around it; without one, the outermost container below the body to which each
    step outwards adds text.
    """
    total = {id(n): n.score for n in nodes}
    whole = dict(total)
    for n in reversed(nodes):
        if n.parent is not None:
            total[id(n.parent)] = total.get(id(n.parent), 0.0) + OUTER_SHARE * total[id(n)]
            whole[id(n.parent)] = whole.get(id(n.parent), 0.0) + whole[id(n)]
    best = max(nodes, key=lambda n: total[id(n)])
    around = best
    while around is not None:
        if around.tag in ("article", "main"):
            return around
        around = around.parent
    around = best
    while (around := around.parent) is not None and around.tag not in ("", "body"):
        if whole[id(around)] > whole[id(best)]:
            best = around
    return best


def extract(page: str, path: str | None) -> str:
    """The blocks below `path`, or below the page's best container if the page has no text there, one to a line."""
    blocks, nodes = parse(page)
    inside = _within(blocks, nodes, _at_path(nodes, path)) if path is not None else []
    if not inside:
        inside = _within(blocks, nodes, {id(best_container(nodes))})
    return "\n".join(inside)


def _at_path(nodes: list[Node], path: str) -> set[int]:
    """The nodes at `path`, found by the length of the path that each node and those around it match."""
    matched: dict[int, int] = {}
    for n in nodes:  # a node comes after the one around it
        before = 0 if n.parent is None else matched.get(id(n.parent), -1)
        own = n.label if n.parent is None else "/" + n.label
        if before >= 0 and path.startswith(own, before):
            matched[id(n)] = before + len(own)
    return {i for i, length in matched.items() if length == len(path)}


def _within(blocks: list[tuple[Node, str]], nodes: list[Node], chosen: set[int]) -> list[str]:
    inside: set[int] = set()
    for n in nodes:
        if id(n) in chosen or (n.parent is not None and id(n.parent) in inside):
            inside.add(id(n))
    return [text for node, text in blocks if id(node) in inside]


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: host, path. Votes are one for each page; ties go to the path first in order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            paths = []
            for page in batch.column("html").to_pylist():
                blocks, nodes = parse(page or "")
                paths.append(best_container(nodes).path if blocks else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(host_of("url").alias("host"), "html").mapInArrow(vote, "host string, path string").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = written(host_paths(pages), "host-paths")
    chosen = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(winners, "host", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return chosen.select("page_id", "url", "html", "path").mapInArrow(take, f"page_id {kind}, url string, text string, n_chars long")
