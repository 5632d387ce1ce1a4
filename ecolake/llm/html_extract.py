"""Main text of web pages by paths that the pages of a host agree on.

Each page names the smallest container that holds all of its text outside menus, notices and
the like, or its article. The containers' paths, as tags with generalised classes, are votes:
Spark counts them per host, and every page is then read again along the paths its host has
chosen. A page that has other text than its host's paths hold, and its host does not leave out
beside them, keeps its own container.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecolake.llm.common import extended, written

# --- fixed values -----------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog button select datalist svg annotation annotation-xml object canvas audio video map fieldset script style noscript template iframe textarea title noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center blockquote".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond related recommended share sharing social widget pagination pager search form alert".split()
)
LAYOUT = frozenset("site page container wrapper wrap box bar list block area section posts links buttons".split())  # may stand beside a word of NOISE in a name
NAMED = frozenset("div section aside ul ol dl table".split())  # elements that their names can leave out
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
KEPT_TAGS = frozenset("html body main article".split())
# ----------------------------------------------------------------------------------------
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("children", "noise", "path", "size", "tag")

    def __init__(self, tag: str, path: str, noise: bool) -> None:
        self.tag, self.path, self.noise = tag, path, noise
        self.children: list[Node | str] = []
        self.size = 0


def _names(attributes: str) -> tuple[str, bool, str, bool]:
    """Generalised class for the path, whether a class or the id as a whole names noise, the role,
    and whether the element is hidden."""
    css = role = ""
    named = hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role":
            role = value.strip().lower()
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or _UNSEEN.search(value) is not None
        elif name in ("class", "id"):
            named = named or any(map(_is_noise, value.split()))
            if name == "class" and not css:
                css = ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in value.split()}))
    return css, named, role, hidden


def _is_noise(token: str) -> bool:
    """A word of NOISE, alone or with others of NOISE and LAYOUT: cookie-notice and site-footer,
    but not related-work or form-2."""
    parts = set(_PARTS.findall(_CAMEL.sub(" ", token).lower()))
    return bool(parts & NOISE) and parts <= NOISE | LAYOUT


def parsed(html: str) -> Node:
    """The page as a tree: unclosed and crossed tags are settled as browsers do for the common
    cases, comments and raw elements hold no text."""
    root = Node("", "", False)
    stack, at, end = [root], 0, len(html)

    def text(upto: int) -> None:
        if upto > at:
            top = stack[-1]
            if not top.noise:
                top.children.append(unescape(html[at:upto]))

    while True:
        m = _TAG.search(html, at)
        if m is None:
            text(end)
            return root
        text(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0] == "<!--":
                close = html.find("-->", m.start() + 2)
                at = end if close < 0 else close + 3
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "body") and tag in INLINE | {"p", "li", "div"} and stack[k].tag != "body":
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("button", "li", "object"):
                    break
        like = CLOSES_LIKE.get(tag)
        if like:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in BARRIERS[tag]:
                    break
                if stack[k].tag in like:
                    del stack[k:]
                    if tag != "tr" or not any(s.tag == "tr" for s in stack[k - 1 :]):
                        break
        top = stack[-1]
        css, named, role, hidden = _names(attributes) if attributes else ("", False, "", False)
        noise = top.noise or tag in LEFT_OUT or (tag not in KEPT_TAGS and ((named and tag in NAMED) or role in ROLES or hidden))
        node = Node(tag, f"{top.path}>{tag}{'.' + css if css else ''}" if tag in CONTAINERS else top.path, noise)
        top.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end if close is None else close.end()
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math")):
            stack.append(node)


def _measure(root: Node) -> None:
    """``size`` of every node: characters outside white space below it, links at a tenth."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        todo += [(c, linked) for c in node.children if isinstance(c, Node) and not c.noise]
    for node, linked in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.size = own * (1 if linked else 10) + sum(c.size for c in node.children if isinstance(c, Node) and not c.noise)


def own_container(root: Node, share: float = 0.9) -> Node:
    """Walk down to an article with ``share`` of the text, which is not entered, or else while
    one container holds all words: what lies beside it are marks of one character, as x or |."""
    _measure(root)
    node = root
    while node.tag != "article":
        inner = [c for c in _containers_below(node) if c.size and (c.size >= share * node.size if c.tag == "article" else c.size == node.size or (2 * c.size > node.size and not _words_beside([node], [c])))]
        if not inner:
            break
        node = inner[0]
    return node


def _words_beside(nodes: list[Node], taken: list[Node], paths: frozenset[str] = frozenset()) -> bool:
    """Whether a word of two characters or more lies below the nodes, but not in ``taken`` or in
    containers with one of these paths."""
    return any(len(w) > 1 for w in text_of(nodes, {id(n) for n in taken}, paths).split())


def beside(root: Node, taken: Node) -> set[str]:
    """Paths of the outermost containers with text that hold nothing of ``taken``."""
    found: set[str] = set()
    above = set()
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        node, line = todo.pop()
        if node is taken:
            while line:
                above.add(id(line[0]))
                line = line[1]
            break
        todo += [(c, (node, line)) for c in node.children if isinstance(c, Node) and not c.noise]
    nodes = [root]
    while nodes:
        node = nodes.pop()
        if node is taken or node.noise:
            continue
        if node.tag in CONTAINERS and id(node) not in above:
            if node.size:
                found.add(node.path)
        else:
            nodes += [c for c in node.children if isinstance(c, Node)]
    return found


def _containers_below(node: Node) -> Iterator[Node]:
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and not c.noise:
            if c.tag in CONTAINERS:
                yield c
            else:
                todo += reversed(c.children)


def on_path(root: Node, path: str) -> list[Node]:
    """The outermost containers with this path, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        if node.path == path and node.tag in CONTAINERS:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def text_of(nodes: list[Node], without: set[int] = frozenset(), paths: frozenset[str] = frozenset()) -> str:
    """The text below the nodes in page order, blocks joined and white space turned into single
    spaces; nodes with their id in ``without`` and containers with one of the paths hold none."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.noise and id(c) not in without and not (c.path in paths and c.tag in CONTAINERS):
            gap = [] if c.tag in INLINE else [" "]
            todo += [*gap, *reversed(c.children), *gap]
        elif c.tag not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Host in lower case; null and other texts are hosts of their own."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(host, paths, left): the paths with at least ``share`` of a host's votes, most first (ten
    at most by that share), and those that most of its pages leave out beside their containers.
    Tasks count their own votes before the shuffle."""

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parsed(html or "")
                own = own_container(root)
                if own.size:
                    for path, out, size in [(own.path, False, own.size), *((p, True, 0) for p in (beside(root, own) if own.size < root.size else ()))]:
                        v = votes[host, path, out]
                        v[0], v[1] = v[0] + 1, v[1] + size
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array([k[2] for k in votes], pa.bool_()),
                 pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([v[1] for v in votes.values()], pa.int64())],
                names=["host", "path", "out", "votes", "size"],
            )

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, out boolean, votes long, size long")
    votes = votes.groupBy("host", "path", "out").agg(F.sum("votes").alias("votes"), F.sum("size").alias("size"))
    votes = votes.withColumn("of", F.sum(F.when(F.col("out"), 0).otherwise(F.col("votes"))).over(Window.partitionBy("host")))
    votes = votes.filter(F.col("votes") >= F.when(F.col("out"), 0.5).otherwise(share) * F.col("of"))
    ranked = F.array_sort(F.collect_list(F.when(~F.col("out"), F.struct((-F.col("votes")).alias("v"), (-F.col("size")).alias("s"), "path"))))
    left = F.array_sort(F.collect_list(F.when(F.col("out"), F.col("path"))))
    return written(votes.groupBy("host").agg(F.transform(ranked, lambda r: r["path"]).alias("paths"), left.alias("left")), "paths")


def main_texts(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null or empty html, and one without text in a container, give an empty text. Null urls and
    urls without a host vote together. Repeated pages stay, other columns play no part, and an
    empty table gives an empty one. A host with most pages is joined like any other: the chosen
    paths are one short row per host, which Spark broadcasts or splits.
    """
    picked = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = picked.join(host_paths(pages, share), "host", "left").select("page_id", "url", "html", "paths", "left")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths, left in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                root, text = parsed(html or ""), ""
                for path in paths or []:
                    nodes = on_path(root, path)
                    text = text_of(nodes)
                    if text and (all(n.tag == "article" for n in nodes) or not _words_beside([root], nodes, frozenset(left or ()))):
                        break
                    text = ""
                texts.append(text or text_of([own_container(root)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, extended(picked.select("page_id", "url").schema, ("text", "string"), ("n_chars", "long")))
