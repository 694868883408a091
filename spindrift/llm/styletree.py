"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of block
elements with their class, id and role.  A node has presentation, the layouts of
its children, and content, the texts in its branch.  Where layouts differ from page
to page, or texts do, the node is important; what comes back page after page is
not.  Presentation counts by the entropy of the layouts to the base of the number
of pages.  A text on c of m pages has the entropy log c to the base m, and content
counts by one less that, averaged over the characters of the branch.  With l
layouts presentation weighs 1 - GAMMA ** l and content the rest.

Names and elements say what a node is before any page is seen: a prior that weighs
as much as WEIGHT pages.  The branch of a node whose importance is too low is cut
from each page, unless the branch holds an article or over half of the host's
text, and so is rather the page itself.  Elements that are page
furniture by their definition, and names of what differs on every page by its
nature (adverts, comments), go whatever the tree says.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Elements that begin a block, and those among them that are page furniture.
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 hgroup ul ol li menu dl dt dd blockquote pre figure figcaption "
    "table caption thead tbody tfoot tr td th form fieldset legend details summary dialog address center hr head button select option label".split()
)
FURNITURE = frozenset("head nav footer aside form menu dialog button select option fieldset".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video math".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
VOID = frozenset("hr br img input meta link base col embed source track wbr area param".split())
#: Elements that end an open one of the second kind, not beyond one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Names of what goes always, and of what probably goes.
ALWAYS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription signup login "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager skip sidebar side-bar footer site-header page-header"
)
HINTS = "promo promos promotion banner masthead notice notices notification notifications popup modal overlay share sharing social related recommended widget widgets toolbar hidden"
PARTS = "box block list links posts items wrapper wrap container section area bar buttons icons widget inner outer group panel pane unit slot form left right top bottom main site page global"


def names(words: str) -> re.Pattern:
    """One of the words as a whole class name or id, with or without the name of a part of a page."""
    parts = "|".join(PARTS.split())
    return re.compile(rf"(?:^|\s)(?:(?:{parts})[-_])?(?:{'|'.join(words.split())})(?:[-_]?(?:{parts}|\d+))*(?=\s|$)", re.I)


ALWAYS_NAMED, HINT_NAMED = names(ALWAYS), names(HINTS)
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+(?:["'][^>]*+)?)>)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)

#: Importance below which a branch goes; the same within an article or main element.
LOW, LOW_INSIDE = 0.6, 0.1
#: Pages that the prior counts for; how fast more layouts make presentation weigh more.
WEIGHT, GAMMA = 8, 0.9
MEMO = 20_000


class Node:
    """A node of the style tree: the path of an element, which all pages with that path share."""

    __slots__ = ("tag", "path", "inside", "furniture", "hint", "above")

    def __init__(self, tag: str, path: int, inside: bool, furniture: bool, hint: bool, above: tuple[int, ...]) -> None:
        self.tag, self.path, self.inside, self.furniture, self.hint, self.above = tag, path, inside, furniture, hint, above

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.path == other.path

    def __hash__(self) -> int:
        return self.path


ROOT = Node("", 0, False, False, False, ())
_nodes: dict[tuple, Node] = {}


def child(parent: Node, tag: str, attributes: str) -> Node:
    key = (parent.path, parent.furniture, tag, attributes)
    node = _nodes.get(key)
    if node is None:
        if len(_nodes) >= MEMO:
            _nodes.clear()
        node = _nodes[key] = _child(parent, tag, attributes)
    return node


def _child(parent: Node, tag: str, attributes: str) -> Node:
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    name = f"{found.get('class', '')} {found.get('id', '')}"
    inside = parent.inside or tag in ("article", "main")
    frame = tag in ("html", "body", "article", "main")
    # an article within an article is a comment on it
    element = tag in FURNITURE or "hidden" in found or found.get("role", "").lower() in ROLES or (tag == "header" and not parent.inside) or (tag == "article" and "article" in parent.tag.split())
    furniture = parent.furniture or element or (not frame and bool(ALWAYS_NAMED.search(name)))
    path = xxhash.xxh64_intdigest(f"{parent.path}|{tag}|" + re.sub(r"\d{2,}", "0", f"{found.get('class', '')}|{found.get('id', '')}|{found.get('role', '')}|{'hidden' in found}")) - 2**63
    # the tag of a node within an article says so
    within = f"{tag} article" if tag != "article" and "article" in parent.tag.split() else tag
    return Node(within, path, inside, furniture, not frame and (parent.hint or bool(HINT_NAMED.search(name))), (*parent.above, path))


class Open:
    """An element of a page while it is open, and the paths of its children."""

    __slots__ = ("node", "tag", "layout")

    def __init__(self, node: Node, tag: str) -> None:
        self.node, self.tag, self.layout = node, tag, []


def blocks(page: str, elements: list[Open] | None = None) -> Iterator[tuple[Node, str]]:
    """Blocks of text of a page in order, each with the node it stands in; ``elements`` collects all elements."""
    stack, text, at = [Open(ROOT, "")], [], 0
    mute, depth = "", 0  # an inline element of page furniture, and how often its tag is open in it
    while m := TAG.search(page, at):
        if m.start() > at and not mute:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                # nothing within is a tag but the end of this element; without it the page ends here
                end = END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            if mute:
                depth += (tag == mute) * (-1 if m[1] else not m[3].endswith("/"))
                mute = mute if depth else ""
            elif not m[1] and ATTRIBUTE.search(m[3]) and tag not in VOID and not m[3].endswith("/") and _child(stack[-1].node, tag, m[3]).furniture > stack[-1].node.furniture:
                mute, depth = tag, 1
            continue
        mute = ""
        joined = " ".join("".join(text).split())
        if joined:
            yield stack[-1].node, joined
        text = []
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        ends, beyond = ENDS.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                break
            if stack[i].tag in beyond or not ends:
                break
        if tag not in VOID:
            node = child(stack[-1].node, tag, m[3])
            if not stack[-1].layout or stack[-1].layout[-1] != node.path:  # however many like it in a row
                stack[-1].layout.append(node.path)
            stack.append(Open(node, tag))
            if elements is not None:
                elements.append(stack[-1])
    if at < len(page) and not mute:
        text.append(html.unescape(page[at:]))
    joined = " ".join("".join(text).split())
    if joined:
        yield stack[-1].node, joined


def main_text(page: str, cut: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the blocks outside of cut branches and page furniture; those in an article or main element alone if such a one has text."""
    kept = [(n, t) for n, t in blocks(page) if not n.furniture and cut.isdisjoint(n.above)]
    inside = [t for n, t in kept if n.inside]
    return "\n".join(inside or [t for _, t in kept])


def host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


CONTENT, LAYOUT, PAGE = 0, 1, 2
SEEN = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("size", T.LongType())]
    + [T.StructField("inside", T.BooleanType()), T.StructField("hint", T.BooleanType()), T.StructField("above", T.ArrayType(T.LongType())), T.StructField("pages", T.LongType())]
)


def seen(page: str) -> set[tuple]:
    """What a page shows of the tree: texts and layouts of its nodes, and the nodes themselves."""
    elements: list[Open] = []
    out: set[tuple] = set()
    for n, t in blocks(page, elements):
        if not n.furniture:
            out.add((n, CONTENT, xxhash.xxh64_intdigest(t) - 2**63, len(t)))
    for e in elements:
        if not e.node.furniture:
            out.add((e.node, PAGE, 0, 0))
            if e.layout:
                out.add((e.node, LAYOUT, xxhash.xxh64_intdigest(",".join(map(str, e.layout))) - 2**63, 0))
    return out


def tree(rows: DataFrame) -> DataFrame:
    """Nodes of each host's tree, as (host, path, inside, hint, holds, n_pages, importance).

    holds: whether an article or main element stands in the branch, or over half of
    the text.  Nodes of page furniture are not in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html"):
                counts: Counter = Counter()
                for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    counts.update((name, n.path, kind, value, size, n.inside, n.hint, n.above if kind == PAGE else None) for n, kind, value, size in seen(page))
                if counts:
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, f) for v, f in zip(zip(*counts), TYPES)), pa.array(counts.values(), pa.int64())], names=SEEN.fieldNames())

    each = rows.mapInArrow(run, SEEN)
    is_ = lambda kind: F.col("kind") == kind
    # the ancestors of a path are the same wherever it is seen
    each = each.groupBy("host", "path", "kind", "value", "above").agg(F.max("size").alias("size"), F.max("inside").alias("inside"), F.max("hint").alias("hint"), F.sum("pages").alias("pages"))
    node = each.groupBy("host", "path").agg(
        F.max("inside").alias("inside"),
        F.max("hint").alias("hint"),
        F.max("above").alias("above"),
        F.max(F.when(is_(PAGE), F.col("pages"))).alias("n_pages"),
        # a text on c pages is read c times, and each time has the entropy log c
        F.sum(F.when(is_(CONTENT), F.col("size") * F.col("pages"))).alias("size"),
        F.sum(F.when(is_(CONTENT), F.col("size") * F.col("pages") * F.log("pages"))).alias("spread"),
        F.sum(F.when(is_(LAYOUT), F.col("pages"))).alias("shown"),
        F.sum(F.when(is_(LAYOUT), F.col("pages") * F.log("pages"))).alias("alike"),
        F.sum(F.when(is_(LAYOUT), 1)).alias("layouts"),
    )
    node = common.staged(node, "nodes").filter("above is not null")
    base = F.log(F.col("n_pages"))
    content = F.coalesce(F.when(F.col("n_pages") > 1, F.col("spread") / base), F.lit(0.0))
    branch = node.select("host", F.explode("above").alias("path"), "inside", "size", content.alias("spread")).groupBy("host", "path")
    branch = branch.agg(F.max("inside").alias("holds"), F.sum("size").alias("size"), F.sum("spread").alias("spread")).filter("size > 0")
    layout = F.coalesce(F.when(F.col("n_pages") > 1, (F.log("shown") - F.col("alike") / F.col("shown")) / base), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.coalesce("layouts", F.lit(0)))
    importance = (1 - weight) * layout + weight * (1 - F.col("b.spread") / F.col("b.size"))
    whole = node.groupBy("host").agg(F.sum("size").alias("whole"))
    both = node.alias("n").join(branch.alias("b"), (F.col("n.host") == F.col("b.host")) & (F.col("n.path") == F.col("b.path"))).join(whole.alias("w"), F.col("n.host") == F.col("w.host"))
    holds = (F.col("holds") & ~F.col("inside")) | (2 * F.col("b.size") > F.col("whole"))
    return both.select("n.host", "n.path", "inside", "hint", holds.alias("holds"), "n_pages", importance.alias("importance"))


def weak(nodes: DataFrame, low: float = LOW, low_inside: float = LOW_INSIDE, weight: float = WEIGHT) -> Column:
    """Whether a node's branch is to be cut: by its pages' evidence, and a prior of 0 for a name of page furniture and else 1."""
    judged = F.when(F.col("n_pages") > 1, F.col("n_pages")).otherwise(0)
    importance = (F.when(judged > 0, judged * F.col("importance")).otherwise(0.0) + F.when(F.col("hint"), 0.0).otherwise(weight)) / (judged + weight)
    return ~F.col("holds") & (importance < F.when(F.col("inside") & ~F.col("hint"), low_inside).otherwise(low))


TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, low_inside: float = LOW_INSIDE, weight: float = WEIGHT) -> DataFrame:
    """Main text of each page, as (page_id, url, text, n_chars).

    One row comes out for each row, none for an empty table.  A null page counts as
    empty and gives an empty text; pages without a host are judged together; of a
    host with one page the prior decides.  Null ids and addresses stay null;
    repeated rows give repeated results; other columns are ignored, whatever their
    names.  A very long page is parsed whole.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    since = len(common.paths())
    nodes = tree(rows.select("host", "html"))
    # a table of its own, by whose size the join is planned
    cut = common.concluded(nodes.filter(weak(nodes, low, low_inside, weight)).groupBy("host").agg(F.collect_set("path").alias("cut")), "cut", since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html"):
                sets: dict[str, frozenset[int]] = {}
                out = []
                for name, page, paths in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "cut"))):
                    if name not in sets:
                        sets[name] = frozenset(paths or ())
                    out.append(main_text(page, sets[name]))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=EXTRACTED.fieldNames())

    return rows.join(cut, "host", "left").select("page_id", "url", "host", "html", "cut").mapInArrow(run, EXTRACTED)
