"""Main text of pages by consensus paths: score containers, vote per host, re-extract.

A page is read into elements and blocks in one pass of a regular expression.  Each page
names its best container; its generalised path (tags and class names, digits folded) is a
vote for its host.  Spark counts the votes; pages are then read again with the path that
won on their host.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored



def _tokens_with(quoted: str) -> re.Pattern:
    """Comments, elements whose text is no text, tags with quotes in attributes or without, other markup."""
    return re.compile(
        r"<!--.*?(?P<open>-->|\Z)"
        r"|<(?P<raw>script|style|noscript|iframe|textarea|title|noembed|noframes|xmp)(?=[\s/>])[^>]*+>.*?(?P<shut></(?P=raw)\s*>|\Z)"
        rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{quoted})>"
        r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
        r"|<[!?/][^>]*+>",
        re.S | re.I,
    )


_TOKEN, _PLAIN = _tokens_with(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+"), _tokens_with(r"(?!)")
#: Tags with a quote that is never closed, after which quotes are no longer heeded in a page.
_BROKEN = 16
_ATTR = re.compile(r"([a-zA-Z_:@][^\s=/>\"']*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article main section div td body center blockquote table tbody tr".split())
#: Start tags that close an open paragraph, and elements that close an open one of their own kind.
_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": set()}
_DROP_TAGS = frozenset("head nav footer aside button label fieldset dialog menu search select template svg object canvas video audio datalist".split())
_DROP_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
_HEADER_WORDS = frozenset("header headers masthead topbar".split())
#: Names that tell of other elements' text when they stand first in a compound, as in ``related-posts``.
_LEADING_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu nav navbar newsletter pagination popup promo recommended related share sharing sidebar sponsor sponsored subscribe".split()
)
_DROP_WORDS = (
    _COMMENT_WORDS | _HEADER_WORDS | _LEADING_WORDS
    | frozenset(
        "adbox adsense adslot alert alerts aside banner banners consent copyright crumbs disclaimer disclaimers footers gdpr legal login menus modal modals navigation newsletters notice notices overlay overlays pager popups promos promotion promotions recommendations sidebars signup skip social sponsors subscription toc toolbar widget widgets".split()
    )
)
#: Names of what may stand inside an article and is not of it; there a compound is only judged where it is made of such names alone.
_NOISE = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comments commentlist cookie cookies disqus footer menu menus nav navbar navigation newsletter newsletters notice notices pagination popup popups promo promos promotion promotions recommended recommendations related replies respond share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar".split()
)
_OF_NOISE = frozenset("post posts story stories article articles news content user users reader readers site page email more banner banners main primary secondary mobile sub dropdown".split())
#: These say what a compound is wherever they end it.
_LAST_NOISE = frozenset("ads advert adverts advertisement advertisements breadcrumb breadcrumbs comments commentlist footer nav navbar navigation newsletter pagination popup replies sidebar sidebars".split())
_GOOD_WORDS = frozenset("article articlebody content entry post posts story main text body".split())
#: A compound that begins or ends so tells of a state, not of what the element is: ``with-sidebar``, ``menu-open``.
_STATE_FIRST = frozenset("with without has have no not non is are show hide can enable disable js".split())
_STATE_LAST = frozenset("open opened active visible hidden enabled disabled shown on off closed collapsed expanded loaded ready free".split())
#: Endings that say nothing about what the element holds: ``ad-box``, ``sidebar-left``.
_NEUTRAL = frozenset(
    "left right top bottom box boxes wrapper wrap container inner outer list block area section bar item items link links button buttons icon icons panel unit slot zone group row column col".split()
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "parent", "name", "good", "dropped", "word", "mass", "raw", "depth", "holds", "article", "inside", "heads")

    def __init__(self, tag: str, parent: _Node | None, name: str, good: bool, dropped: bool, word: str = ""):
        self.tag, self.parent, self.name, self.good, self.dropped, self.word = tag, parent, name, good, dropped, word
        self.mass, self.raw, self.holds, self.inside, self.heads = 0.0, 0, False, False, False
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.depth = parent.depth + 1 if parent else 0


@functools.lru_cache(1 << 16)
def judged(name: str) -> tuple[bool, str]:
    """Whether a class or id names the article, and the word by which it names something else, if any.

    The whole name is judged, as a compound: its last telling part says what it is.
    """
    parts = [p.lower() for p in _WORD.findall(name)]
    if not parts:
        return False, ""
    good = any(p in _GOOD_WORDS for p in parts)
    whole = "".join(parts)
    if whole in _DROP_WORDS:
        return False, whole
    if parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST:
        return False, ""
    while len(parts) > 1 and parts[-1] in _NEUTRAL:
        parts.pop()
    last = parts[-1]
    if last in _HEADER_WORDS and any(p in _GOOD_WORDS for p in parts[:-1]):
        return True, ""
    if last in _DROP_WORDS:
        return False, last
    if parts[0] in _LEADING_WORDS:
        return False, parts[0]
    return good, ""


@functools.lru_cache(1 << 16)
def noise(name: str) -> str:
    """The word by which a class or id inside an article names something else, if all of it does.

    ``related-posts`` and ``ad-box`` do; ``share-price``, ``ad-hoc``, ``legal`` may well be
    parts of the article.
    """
    parts = [p.lower() for p in _WORD.findall(name)]
    whole = "".join(parts)
    if whole in _NOISE:
        return whole
    told = [p for p in parts if p not in _NEUTRAL]
    if told and told[-1] in _LAST_NOISE and parts[0] not in _STATE_FIRST and parts[-1] not in _STATE_LAST:
        return told[-1]
    if told and all(p in _NOISE or p in _OF_NOISE for p in told) and (told[0] in _NOISE or told[-1] in _NOISE):
        return next(p for p in (told[-1], told[0]) if p in _NOISE)
    return ""


def _element(tag: str, attrs: str, parent: _Node) -> _Node:
    names, cls, role = [], "", ""
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            k = m[1].lower()
            if k in ("class", "id", "role", "itemprop"):
                v = m[2] or m[3] or m[4] or ""
                if k == "role":
                    role = v.strip().lower()
                else:
                    names += v.split()
                if k == "class":
                    cls = ".".join(sorted(_DIGITS.sub("0", x) for x in v.lower().split())[:3])
    # The header of an article holds its title; any other is the page's.
    bad = tag in _DROP_TAGS or role in _DROP_ROLES or (tag == "header" and not parent.article)
    good, word = tag in ("article", "main"), "form" if tag == "form" else ""
    if tag in ("html", "body", "article", "main"):
        good = good or bool(names)
    else:
        for n in names:
            says, other = judged(n)
            good = good or says
            if parent.article:
                other = noise(n)
            if other:
                word = other if word in ("", "form") or other in _COMMENT_WORDS else word
    return _Node(tag, parent, tag + ("." + cls if cls else ""), good, parent.dropped or bad, word)


def _text(segments: list[str]) -> str:
    return " ".join(html_module.unescape("".join(segments)).split())


def parse(page: str) -> tuple[list[tuple[_Node, str]], list[_Node], list[_Node]]:
    """Blocks of text outside dropped elements, each with its element; all containers; all elements, outer ones first.

    Elements that their tag or role rules out are dropped as they are read.  A class or id
    only suggests it: an element that holds an ``article`` or ``main``, or most of the text
    of a page without one, is kept (by its text not if it is named after adverts, menus,
    comments and the like, which no article is).  So is a form, which on many sites is the
    whole page, and for its text also where it holds the page's headline.

    All work is in proportion to the page: sums go from leaves to the root once, and a tag
    is not searched for again where its end was not found.
    """
    root = _Node("#root", None, "", False, False)
    here, nodes, named = root, [root], []
    raw: list[tuple[_Node, list[tuple[_Node, str, bool]]]] = []
    held: list[tuple[_Node, str, bool]] = []
    link = False
    open_tags: Counter = Counter()
    every = [root]

    def flush() -> None:
        nonlocal held
        if held:
            raw.append((here, held))
            held = []

    def open_(node: _Node) -> None:
        nonlocal here
        here = node
        every.append(node)
        open_tags[node.tag] += 1
        if node.tag == "h1" and not node.dropped:
            up = node
            while up is not None and not up.heads:
                up.heads = True
                up = up.parent
        if node.word and not node.dropped:
            named.append(node)
        if node.tag in ("article", "main") and not node.dropped:
            up = node
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent

    def close(tag: str) -> None:
        nonlocal here
        while here is not root:
            gone = here
            here = here.parent
            open_tags[gone.tag] -= 1
            if gone.tag == tag:
                return

    at = 0
    for m in _tokens(page):
        if m.start() > at and not here.dropped:
            held.append((here, page[at : m.start()], link))
        # What is not closed before the last tag goes on to the end of the page.
        at = len(page) if m["open"] == "" or m["shut"] == "" else m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, ends, attrs = tag.lower(), bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag not in _BLOCK:
            if tag == "a":
                link = not ends
            if tag == "br" and not here.dropped:
                held.append((here, " ", False))
            if tag in _VOID or (attrs.endswith("/") and tag in ("svg", "math")):
                continue
            # An inline element counts where it is dropped or named; those of its tag inside it keep the ends in step.
            if ends:
                if open_tags[tag]:
                    close(tag)
            elif tag in _DROP_TAGS or "=" in attrs:
                node = _element(tag, attrs, here)
                if node.dropped and not here.dropped or node.word or open_tags[tag]:
                    open_(node)
            elif open_tags[tag]:
                open_(_Node(tag, here, tag, False, here.dropped))
            continue
        flush()
        link = False
        if ends:
            if open_tags[tag] > 0:
                close(tag)
            continue
        if tag == "hr":
            continue
        if open_tags["p"] > 0:
            close("p")
        if open_tags["head"] > 0:
            close("head")
        if tag in _SAME and open_tags[tag] > 0:
            up = here
            while up is not root and up.tag != tag and up.tag not in _SAME[tag]:
                up = up.parent
            if up.tag == tag:
                close(tag)
        open_(_element(tag, attrs, here))
        if tag in _CONTAINER and not here.dropped:
            nodes.append(here)
    if at < len(page) and not here.dropped:
        held.append((here, page[at:], link))
    flush()

    if named:
        for _, segments in raw:
            for node, text, _ in segments:
                node.raw += len(text.strip())
        for node in reversed(every[1:]):
            node.parent.raw += node.raw
        for node in named:
            most = not root.holds and 2 * node.raw > root.raw and node.word not in _COMMENT_WORDS and node.word not in _LEADING_WORDS
            headed = node.word == "form" and not root.holds and node.heads
            if not (node.holds or most or headed):
                node.dropped = True
    gone: dict[int, bool] = {}

    def is_gone(node: _Node | None) -> bool:
        if node is None:
            return False
        known = gone.get(id(node))
        if known is None:
            up, chain = node, []
            while up is not None and id(up) not in gone and not up.dropped:
                chain.append(up)
                up = up.parent
            known = up is not None and (up.dropped or gone.get(id(up), False))
            for x in (*chain, node):
                gone[id(x)] = known
        return known

    blocks = []
    for element, segments in raw:
        kept = [x for x in segments if not is_gone(x[0])] if named else segments
        text = _text([t for _, t, _ in kept])
        if text:
            blocks.append((element, text))
            links = sum(len(t) for _, t, linked in kept if linked)
            element.mass += len(text) * (1 - min(1.0, links / len(text)))
    for node in reversed(every[1:]):
        node.parent.mass += node.mass
    return blocks, nodes, every


def _tokens(page: str) -> Iterator[re.Match]:
    """Markup in order.  Nothing behind the last ``>`` is any; after some tags with an open quote, quotes are not heeded."""
    at, end, broken, pattern = 0, page.rfind(">") + 1, 0, _TOKEN
    while at < end:
        for m in pattern.finditer(page, at, end):
            yield m
            broken += m["tag2"] is not None
            if broken >= _BROKEN and pattern is _TOKEN:
                at, pattern = m.end(), _PLAIN
                break
        else:
            return


def path(node: _Node) -> str:
    """The generalised path: names of the element and what holds it, up to twelve."""
    out, up = [], node
    while up is not None and up.parent is not None and len(out) < 12:
        out.append(up.name)
        up = up.parent
    return ">".join(reversed(out))


def best_container(nodes: list[_Node]) -> _Node:
    """The container that scores best: its share of the page's text, a bonus for a telling name, and a little for depth."""
    total = max(nodes[0].mass, 1.0)
    return max(nodes, key=lambda n: (n.mass / total + 0.25 * n.good * (n.mass > 0) + 0.01 * min(n.depth, 20) * (n.mass > 0.6 * total), -n.depth))


def _headline(blocks: list[tuple[_Node, str]]) -> set[int]:
    """Blocks of a headline before the containers, and of the paragraphs between: a page's only one, beside what holds them.

    Nothing if the containers have a headline of their own.
    """
    first = next((i for i, (n, _) in enumerate(blocks) if n.inside), 0)
    tops = [i for i, (n, _) in enumerate(blocks) if n.tag == "h1"]
    if len(tops) != 1 or tops[0] >= first:
        return set()
    beside, top = blocks[tops[0]][0].parent, blocks[first][0]
    while top is not None and top is not beside:
        top = top.parent
    if top is None:
        return set()
    return {i for i in range(tops[0], first) if i == tops[0] or (blocks[i][0].parent is beside and blocks[i][0].tag in ("p", "h2", "h3") and blocks[i][0].mass > 0)}


def main_text(page: str, winner: str | None) -> str:
    """The text of the containers on the winning path, or of the page's own best one, with the headline right before them."""
    blocks, nodes, every = parse(page)
    tops: set[int] = set()
    if winner is not None:
        tops = {id(n) for n in nodes if n.mass > 0 and n.parent is not None and path(n) == winner}
    if not tops:
        tops = {id(best_container(nodes))}
    for n in every:
        n.inside = id(n) in tops or (n.parent is not None and n.parent.inside)
    more = _headline(blocks)
    return "\n".join(t for i, (n, t) in enumerate(blocks) if n.inside or i in more)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def consensus_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes``: the path that most pages of a host name as their best container."""

    def run(batches):
        for b in batches:
            votes: Counter = Counter()
            for h, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = p.as_py()
                if page:
                    _, nodes, _ = parse(page)
                    top = best_container(nodes)
                    if top.mass > 0 and top.parent is not None:
                        votes[h, path(top)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"]
            )

    cast = pages.select(host(F.col(url)).alias("host"), html).mapInArrow(run, "host string, path string, votes long")
    counted = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # One row a host after the counts: max over a struct is a map-side aggregate, not a sort.
    won = counted.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("_w"))
    return won.select("host", F.col("_w.path").alias("path"), F.col("_w.votes").alias("votes"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page, by the winning path of its host.

    Null or empty html gives an empty text; a page without a container on the winning path
    falls back to its own best one; pages without a host share the empty host.  Repeated
    rows and null keys stay, an empty table gives no rows, other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    # Stored, so that the join below is between plain exchanges and its hot partitions can be split.
    won = stored(consensus_paths(pages, url, html).select(F.col("host").alias("_h"), "path"), "paths")
    here = pages.select(key, url, html, host(F.col(url)).alias("_host"))
    # A host with very many pages is split by adaptive execution: both sides are plain exchanges.
    joined = here.hint("shuffle_merge").join(won.hint("shuffle_merge"), F.col("_host") == F.col("_h"), "left")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [main_text(p.as_py(), w.as_py()) if p.is_valid else "" for p, w in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], [key, url, "text", "n_chars"])

    return joined.select(key, url, html, "path").mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")


