"""Main text of web pages by site template removal.

A page is read into a tree. Each subtree gets a hash of its shape and text;
Spark counts beside how many other texts each hash stands on a host, and subtrees
that recur beside many are deleted, along with the elements that HTML itself or
their class names mark as no part of the article. Copies of a page or an article
stand beside one text, so they count once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, settled, table

# HTML's elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
WHOLE = frozenset("html body main".split())
#: What a start tag of each element ends, and where the search for it stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("html body table td th ul ol dl menu button article section div main aside nav".split())

# What is never part of an article, by element, by role, and by a word of its class or id.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe button select textarea title dialog menu svg math object canvas video audio map search input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts adsense sponsor sponsored promo promotion banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager form search skip".split())
#: First words of a class that speaks of what else is on the page ("has-sidebar").
AROUND = frozenset("has no with without is".split())

#: A tag whose quotes end, any tag, and what else ends with the next ">".
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
OTHER = re.compile(r"<[!?/][^>]*>")
#: After so many tags whose quotes never end, quotes count no more on a page.
BELIEVED = 32
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Words that are hashed together, and how many of the least hashes stand for a text.
SHINGLE, LEAST = 3, 4
#: Templates of pages up to this measured size are broadcast.
BROADCAST_BYTES = 32 << 20


class Node:
    __slots__ = ("block", "items", "tag", "unwanted")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False) -> None:
        self.tag, self.block = tag, tag in BLOCK
        self.items: list[str | Node] = []
        self.unwanted = tag in OUTSIDE or bool(attributes) and tag not in WHOLE and marked(attributes, inside)


def marked(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is no part of an article.

    ``inside`` an article only a whole class name says so: a section
    "related-work" or a paragraph "share-price" is a part of it.
    """
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class" and inside and not WORDS.isdisjoint(value.split()):
            return True
        if name in ("class", "id") and not inside and any(not WORDS.isdisjoint(w) and w[0] not in AROUND for w in map(WORD.findall, value.split())):
            return True
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Path:
    """The open elements, and where the last ones of each kind are: every question takes a fixed time."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], defaultdict(list)

    @staticmethod
    def kinds(node: Node) -> Iterator[str]:
        yield node.tag
        if node.block:
            yield "(block)"
        if node.tag in FENCE:
            yield "(fence)"
            if node.tag not in ("td", "th"):
                yield "(outer fence)"
        if node.tag in ("article", "main"):
            yield "(article)"

    def last(self, *kinds: str) -> int:
        return max((self.places[x][-1] for x in kinds if self.places[x]), default=0)

    def add(self, node: Node) -> None:
        for x in self.kinds(node):
            self.places[x].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            for x in self.kinds(self.nodes.pop()):
                self.places[x].pop()


def parse(html: str) -> Node:
    """The tree of a page, in time that grows with its length. Broken markup gives some tree as well: what is left open ends with what holds it."""
    root = Node("")
    path, at, n, doubts = Path(root), 0, len(html), 0
    last, last_data = html.rfind(">"), html.rfind("]]>")
    begun = html.find("<")
    while 0 <= begun <= last:
        m = None
        if html.startswith("<!--", begun):
            end = html.find("-->", begun + 4)
            end = end + 3 if end >= 0 else n
        elif html.startswith("<![CDATA[", begun) and begun < last_data:
            end = html.find("]]>", begun) + 3
        else:
            if doubts < BELIEVED:
                m = TAG.match(html, begun)
            if m is None:
                m = BROKEN.match(html, begun)
                doubts += m is not None
            other = m or OTHER.match(html, begun)
            if other is None:
                begun = html.find("<", begun + 1)
                continue
            end = other.end()
        if begun > at:
            path.nodes[-1].items.append(unescape(html[at:begun]))
        at = end
        if m is not None:
            at = _tag(path, m, html, at)
        begun = html.find("<", at)
    if rest := html[at:].split("<!--", 1)[0]:
        path.nodes[-1].items.append(unescape(rest))
    return root


def _tag(path: Path, m: re.Match, html: str, at: int) -> int:
    """Takes one tag, and what a raw element holds; where the page goes on."""
    tag = m[2].lower()
    if m[1]:
        place = path.last(tag)
        if place and (tag in BLOCK or place > path.last("(block)")):
            path.cut(place)
        return at
    over = ENDS.get(tag) or ({"p"} if tag in BLOCK else None)
    if over:
        place = path.last(*over)
        if place > path.last("(outer fence)" if tag in ("tr", "td", "th") else "(fence)"):
            path.cut(place)
    node = Node(tag, m[3], bool(path.last("(article)")))
    path.nodes[-1].items.append(node)
    if tag in RAW:
        found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
        if found is None:
            return len(html)
        close = html.find(">", found.start())
        return close + 1 if close >= 0 else len(html)
    if tag not in VOID and not m[3].rstrip().endswith("/"):
        path.add(node)
    return at


def walk(root: Node) -> list[Node]:
    """All nodes, each before what it holds; without recursion, as trees may be deep."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [x for x in node.items if isinstance(x, Node)][::-1]
    return order


def hashes(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """By node: the hash of its subtree, and the length of its text."""
    hashed: dict[int, int] = {}
    length: dict[int, int] = {}
    for node in reversed(walk(root)):
        parts, total = [node.tag], 0
        for x in node.items:
            if isinstance(x, Node):
                parts.append(f"\x01{hashed[id(x)]:x}")
                total += length[id(x)]
            elif words := x.split():
                parts.append("\x02" + " ".join(words))
                total += sum(map(len, words))
        hashed[id(node)] = xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)
        length[id(node)] = total
    return hashed, length


def main_parts(root: Node) -> list[Node]:
    """The article elements that are not inside another or inside something unwanted; else the main element, else the page."""
    for wanted in ("article", "main"):
        found, waiting = [], [root]
        while waiting:
            node = waiting.pop()
            if node.unwanted:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                waiting += [x for x in node.items if isinstance(x, Node)][::-1]
        if found:
            return found
    return [root]


def flow(part: Node, gone: Callable[[Node], bool] = lambda x: False) -> Iterator[tuple[Node | None, str | None]]:
    """The blocks and texts of a part in order: ``(block, "")`` where one begins, ``(block, None)`` where it ends, else ``(None, text)``.

    What is unwanted or ``gone`` is left out; it separates texts as it would itself.
    """
    article = part.tag in ("article", "main")
    waiting: list[Node | str | tuple[Node, None]] = [part]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            yield None, x
        elif isinstance(x, tuple):
            yield x
        elif x is not part and (x.unwanted or x.tag == "header" and not article):
            yield None, " "
            if x.block:
                yield x, ""
                yield x, None
        elif gone(x):
            yield x, ""
            yield x, None
        elif x.tag == "br":
            yield None, " "
        elif x.block or x is part:
            yield x, ""
            waiting += [(x, None), *x.items[::-1]]
        else:
            waiting += x.items[::-1]


def main_text(html: str | None, templates: frozenset[int]) -> str:
    """The text of the article in blocks; ``templates`` are the hashes of subtrees to delete, unless one holds most of the text."""
    if not html:
        return ""
    root = parse(html)
    hashed, length = hashes(root) if templates else ({}, {})
    parts = main_parts(root)
    total = sum(length[id(x)] for x in parts) if templates else 0
    blocks: list[str] = []
    for part in parts:
        run: list[str] = []
        for node, text in flow(part, lambda x: bool(templates) and x.block and hashed[id(x)] in templates and 2 * length[id(x)] <= total):
            if node is None:
                run.append(text)
                continue
            if words := "".join(run).split():
                blocks.append(" ".join(words))
            run = []
    return "\n\n".join(blocks)


def sketch(text: str) -> tuple[int, ...]:
    """The least hashes of a text's runs of words."""
    words = text.split()
    runs = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else ()
    return tuple(sorted(map(xxhash.xxh64_intdigest, runs))[:LEAST])


def subtrees(html: str | None) -> tuple[int, dict[int, int]]:
    """A hash of a page's main text, and for its block elements with text their hashes, each with one of the main text beside it.

    Hashes of texts are made of their sketches, so that most near copies have
    the same one. A block with nothing beside it has 0.
    """
    if not html:
        return 0, {}
    root = parse(html)
    hashed, length = hashes(root)
    merged = lambda a, b: tuple(sorted({*a, *b})[:LEAST])
    texts: list[tuple[int, ...]] = []
    found: list[tuple[int, int, int]] = []
    for part in main_parts(root):
        run: list[str] = []
        open_: dict[int, int] = {}
        for node, text in flow(part):
            if node is None:
                run.append(text)
                continue
            if least := sketch("".join(run)):
                texts.append(least)
            run = []
            if text is not None:
                open_[id(node)] = len(texts)
            elif node.block and len(texts) > (at := open_[id(node)]):
                found.append((hashed[id(node)], at, len(texts)))
    before, after = [()], [()]
    for x in texts:
        before.append(merged(before[-1], x))
    for x in reversed(texts):
        after.append(merged(after[-1], x))
    named = lambda x: xxhash.xxh64_intdigest(repr(x)) - (1 << 63) if x else 0
    return named(before[-1]), {x: named(merged(before[low], after[len(texts) - high])) for x, low, high in found}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [subtrees(x) for x in batch.column("html").to_pylist()]
        rows = pa.array([i for i, (_, x) in enumerate(found) for _ in x], pa.int64())
        longs = [[story for story, x in found for _ in x], [y for _, x in found for y in x], [y for _, x in found for y in x.values()]]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("host", "a", "b")), *(pa.array(x, pa.int64()) for x in longs)], ["host", "a", "b", "story", "subtree", "beside"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, url_col: str, html_col: str, out_col: str = "text", least_pages: int = 5, least_share: float = 0.01) -> DataFrame:
    """``pages`` with the main text of each page in ``out_col``, which replaces a column of that name.

    A subtree of the main text is a template if it stands beside ``least_pages``
    texts of a host and beside ``least_share`` of its distinct main texts at
    least, and if those texts are, for the pages it stands on, at least half as
    many as for all pages of the host: copies and near copies have few. Hosts are
    compared in lower case; pages without one share an empty host. A page that
    occurs several times counts once. Null, empty and textless pages have an
    empty text; each row is kept, and markup of any length is read whole. Other
    columns are left as they are.
    """
    @F.arrow_udf("string")
    def text_of(html: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([main_text(x, frozenset(t or ())) for x, t in zip(html.to_pylist(), templates.to_pylist(), strict=True)], pa.string())

    key = {"a": F.xxhash64(col(url_col), col(html_col)), "b": F.xxhash64(F.lit(1), col(html_col), col(url_col))}
    read = pages.select(host_of(col(url_col)).alias("host"), col(html_col).alias("html"), *(v.alias(k) for k, v in key.items()))
    found = settled(read.mapInArrow(_hashed, "host string, a long, b long, story long, subtree long, beside long").distinct())
    total = found.select("host", "a", "b", "story").distinct().groupBy("host", "story").agg(F.count(F.lit(1)).alias("k"))
    total = total.groupBy("host").agg(F.count(F.lit(1)).alias("stories"), F.sum("k").alias("pages"))
    often = found.groupBy("host", "subtree", "beside").agg(F.count(F.lit(1)).alias("k")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("on"))
    often = often.where(F.col("n") >= least_pages).join(total, "host")
    often = often.where((F.col("n") >= least_share * F.col("stories")) & (2 * F.col("n") * F.col("pages") >= F.col("on") * F.col("stories"))).select("host", "subtree")
    given = found.join(often, ["host", "subtree"]).groupBy("a", "b").agg(F.collect_list("subtree").alias("templates"))
    taken = {c.lower() for c in pages.columns}
    name = next(f"_{k}" for k in range(len(taken) + 3) if not any(c.startswith(f"_{k}") for c in taken))
    keyed = pages.withColumns({f"{name}{k}": v for k, v in key.items()})
    given = settled(given.select(*(F.col(c).alias(f"{name}{c}") for c in ("a", "b", "templates"))))
    size = given.agg(F.coalesce(F.sum(F.size(f"{name}templates") * 8 + 32), F.lit(0))).first()[0]
    # Within the measured size pages stay where they are; beyond it they meet their templates in a shuffle.
    done = keyed.join(F.broadcast(given) if size <= BROADCAST_BYTES else given.hint("merge"), [f"{name}a", f"{name}b"], "left")
    done = done.withColumn(out_col, text_of(col(html_col), F.col(f"{name}templates")))
    return done.drop(f"{name}a", f"{name}b", f"{name}templates")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    done = extract(table(spark, sf_dir, "pages"), "url", "html")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
