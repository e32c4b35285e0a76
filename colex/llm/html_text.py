"""Main text of web pages by union-free wrapper inference.

The pages of a host come from few templates.  A page is an expression without unions: elements in
page order, text slots, repeated groups and optional groups.  Siblings that repeat, one by one or
in periods (h2 p h2 p), fold into a repeated group.  Two expressions are aligned element by element,
their children in order by a longest common subsequence of labels: what only one has becomes
optional, and differing texts become a slot.  Pages are aligned one after the other within a batch
of the scan, batches' wrappers in levels of FAN_IN, so a hot host is pre-aggregated and no task
gets more than about that many.  Wrappers are bounded: an expression with more than BREADTH children
in one element, DEPTH levels or NODES nodes is generalised (labels lose their classes, then their
tags; what is deeper becomes a slot), which only ever keeps more text.

The wrapper decides which blocks are template: constant on pages that differ, outside article and
main elements, and not prose of an element whose prose varies (a recipe's "Ingredients").  All else
is kept, but for the parts that no article has (menus, headers, ..), told by tag, role or class.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot html body".split())
#: A start tag ends an open element of one of these tags, unless a holder is in between.
ENDS_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}

# What is no part of an article: tags and roles, and words of the class or id of a container.
DROP_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg math button select option textarea title dialog menu object canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related recommended "
    "comment comments disqus respond reply replies".split()
)
#: Within an article these may hold text of its own; of such a part only blocks of mere links go.
SOFT_WORDS = frozenset("alert popup modal share sharing social related recommended".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Words that may stand beside those: a class or id with any other word (social-impact, related-work) names a subject.
NEUTRAL = frozenset(
    "main site page top bottom left right center side box bar block container wrapper wrap inner outer area section list item items thread content "
    "primary secondary global widget widgets group panel slot unit text message policy buttons links link posts post articles article entry site "
    "form feed sticky fixed mobile desktop small large first last js the this signup more read story stories news user reader readers google".split()
)
KEEP_TAGS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Possessive, so that no input makes it go back: a tag ends at the first > outside quotes, with a
# quote that is never closed at the first >, and without any > it takes the rest of the page.
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|{_NAME}((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|{_NAME}([^>]*+)>|</?[a-zA-Z][^>]*+\Z|[^<]++|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"

#: Elements of layout; text, and elements of any other tag, are prose.
CONTAINERS = frozenset("html body div section main article center details fieldset header footer aside".split())
#: Bounds of a wrapper, beyond which it is generalised, and wrappers that one task aligns.
BREADTH, DEPTH, NODES, FAN_IN = 128, 128, 8_192, 64
#: Wrappers of a batch that is sent on, and numbers of templates likewise.
BATCH_CHARS, BATCH_NUMBERS = 16_000_000, 1_000_000
#: Hosts up to which the templates are broadcast (a few numbers each, NODES at most).
BROADCAST_HOSTS = 20_000


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds open, close, text.  Comments and raw contents are skipped."""
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        ends, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if page[m.start()] != "<" or at - m.start() == 1:
                yield "text", m[0], ""
            continue
        name = name.lower()
        if ends:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            yield "close", name, ""


@functools.lru_cache(4096)
def _names(words: str, unwanted: frozenset) -> bool:
    """Whether a class or an id names something unwanted: it has such a word, and no word beyond these and the neutral ones."""
    parts = {p for p in re.split(r"[^a-z]+", words.lower()) if p}
    return not parts.isdisjoint(unwanted) and parts <= unwanted | NEUTRAL


NOTHING, LINKS, ALL = 0, 1, 2


def label(name: str, attributes: str, in_article: bool = False) -> tuple[str, int]:
    """The element's label (its tag, and the first class without a digit), and what of it is no part
    of an article: NOTHING, its blocks of mere LINKS, or ALL."""
    of_article = name == "header" and in_article  # it holds the title
    gone = ALL if name in DROP_TAGS and not of_article else NOTHING
    if not attributes or attributes.isspace():
        return name, gone
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    classes = found.get("class", "").split()
    if role in DROP_ROLES:
        gone = ALL
    if not gone and name not in HEADINGS:
        unwanted = COMMENTS if name in KEEP_TAGS else DROP_WORDS
        if of_article or any(c.lower() in ("post-header", "entry-header", "article-header") for c in classes):
            unwanted = unwanted - {"header"}
        names = (*classes, found.get("id", ""))
        if in_article and any(_names(c, unwanted & SOFT_WORDS) for c in names):
            gone, unwanted = LINKS, unwanted - SOFT_WORDS
        if any(_names(c, unwanted) for c in names):
            gone = ALL
    first = next((c for c in classes if not any(map(str.isdigit, c))), "")
    return name + (".main" if role == "main" else f".{first}" if first else ""), gone


def walk(page: str) -> Iterator[tuple[str, str, list, int, int]]:
    """(event, value, open labels, what goes, open links) with implied end tags: events open, close, text."""
    stack: list[str] = []  # tags
    path: list[str] = []  # labels
    drops: list[int] = []
    links = texts = 0  # open a, and open article and main

    def close_to(depth: int) -> Iterator[tuple[str, str, list, int, int]]:
        nonlocal links, texts
        while len(stack) > depth:
            yield "close", stack[-1], path, drops[-1], links
            path.pop(), drops.pop()
            tag = stack.pop()
            links -= tag == "a"
            texts -= tag in ("article", "main")

    def last(names: str, holders: tuple = ()) -> int | None:
        wanted = names.split()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in wanted:
                return i
            if stack[i] in holders:
                return None
        return None

    for kind, value, attributes in tokens(page):
        if kind == "text":
            yield "text", value, path, drops[-1] if drops else NOTHING, links
        elif kind == "close":
            if (i := last(value)) is not None:
                yield from close_to(i)
        else:
            if value in ENDS_P and (i := last("p", ("button", "td", "th"))) is not None:
                yield from close_to(i)
            if value in ENDS_SAME and (i := last(*ENDS_SAME[value])) is not None:
                yield from close_to(i)
            if value in ("html", "body") and value in stack:
                continue
            name, drop = label(value, attributes, texts > 0)
            drop = max(drop, drops[-1]) if drops else drop
            stack.append(value), path.append(name), drops.append(drop)
            links += value == "a"
            texts += value in ("article", "main")
            yield "open", value, path, drop, links
            if value in VOID or (attributes.endswith("/") and value in ("path", "circle")):
                yield from close_to(len(stack) - 1)
    yield from close_to(0)


# ------------------------------------------------------------------ blocks


@functools.lru_cache(65536)
def _node(parent: int, name: str) -> int:
    """The number of a path of labels, from its parent's."""
    digest = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, key=parent.to_bytes(8, "big", signed=True)).digest()
    return int.from_bytes(digest, "big", signed=True)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def is_text_region(name: str) -> bool:
    """Whether a label is that of an article or main element."""
    tag, _, kind = name.partition(".")
    return tag in ("article", "main") or kind == "main"


def blocks(page: str) -> Iterator[tuple[str, str, int, bool, bool, str]]:
    """(event, label, path, in an article or main, mere links, text) of a page's block elements, in
    page order, without what goes.  Events are open, close, and text, which has the text between two
    block boundaries, its white space made one space."""
    nodes = [("", 0, False, True)]  # label, path, region, and whether it is kept
    depth = [0]  # of the path, for each open block
    buffer: list[str] = []
    soft, linked = False, True

    def flush() -> Iterator[tuple]:
        nonlocal soft, linked
        if buffer and (text := " ".join("".join(buffer).split())) and not (soft and linked):
            yield "text", *nodes[-1][:3], linked, text
        buffer.clear()
        soft, linked = False, True

    for event, value, path, drop, links in walk(page):
        if event == "text":
            if drop != ALL:
                buffer.append(html.unescape(value))
                soft |= drop == LINKS
                linked &= links > 0 or value.isspace()
        elif value in BLOCK:
            yield from flush()
            if event == "open":
                _, parent, region, _ = nodes[-1]
                name = path[-1]
                nodes.append((name, _node(parent, name), region or is_text_region(name), drop != ALL))
                depth.append(len(path))
                if drop != ALL:
                    yield "open", *nodes[-1][:3], False, ""
            elif depth[-1] == len(path):
                *gone, kept = nodes.pop()
                depth.pop()
                if kept:
                    yield "close", *gone, False, ""
    yield from flush()


# ------------------------------------------------------------------ wrappers

TEXT = "#"


class Node:
    """A part of an expression: an element or a text.  seen: instances of its parent that have it;
    times: its own; of a text the least and greatest digest, of its pages the same of their whole
    texts; chars; loop: what repeats along with its neighbours."""

    __slots__ = ("label", "seen", "times", "many", "loop", "low", "high", "page_low", "page_high", "chars", "kids")

    def __init__(self, label: str, low: int = 0, chars: int = 0):
        self.label, self.seen, self.times, self.many, self.loop, self.chars = label, 1, 1, False, 0, chars
        self.low = self.high = low
        self.page_low = self.page_high = 0
        self.kids: list[Node] = []

    def pack(self) -> list:
        return [*(getattr(self, f) for f in self.__slots__[:-1]), [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, row: list) -> Node:
        node = cls.__new__(cls)
        for field, value in zip(cls.__slots__, row, strict=True):
            setattr(node, field, value)
        node.kids = [cls.unpack(k) for k in node.kids]
        return node


def align(a: Node, b: Node, siblings: bool = False) -> Node:
    """The expression of two instances of one label, in a's place."""
    a.seen = max(a.seen, b.seen) if siblings else a.seen + b.seen
    a.times += b.times
    a.many |= b.many or siblings
    a.loop = a.loop or b.loop
    a.chars += b.chars
    a.low, a.high = min(a.low, b.low), max(a.high, b.high)
    a.page_low, a.page_high = min(a.page_low, b.page_low), max(a.page_high, b.page_high)
    if b.kids:
        a.kids = widen(align_children(a.kids, b.kids)) if a.kids else b.kids
    return a


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; of several the one that takes earlier places."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, label = rows[i], rows[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if label == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_children(a: list[Node], b: list[Node]) -> list[Node]:
    """Children of two instances in order: those in common aligned, the others optional."""
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start].label == b[start].label:
        start += 1
    while end < least - start and a[-1 - end].label == b[-1 - end].label:
        end += 1
    mid_a, mid_b = a[start : len(a) - end], b[start : len(b) - end]
    out = [align(x, y) for x, y in zip(a[:start], b[:start], strict=True)]
    i = j = 0
    pairs = common([x.label for x in mid_a], [y.label for y in mid_b]) if mid_a and mid_b else []
    for x, y in [*pairs, (len(mid_a), len(mid_b))]:
        out += mid_a[i:x] + mid_b[j:y]
        if x < len(mid_a):
            out.append(align(mid_a[x], mid_b[y]))
        i, j = x + 1, y + 1
    return out + [align(x, y) for x, y in zip(a[len(a) - end :], b[len(b) - end :], strict=True)]


def squares(kids: list[Node]) -> list[Node]:
    """Neighbouring periods of two and more labels (h2 p h2 p) made one repeated group."""
    out: list[Node] = []
    latest: dict[str, int] = {}
    i = 0
    while i < len(kids):
        j = latest.get(kids[i].label)
        if j is not None and (p := len(out) - j) > 1 and i + p <= len(kids) and all(out[j + t].label == kids[i + t].label for t in range(p)):
            loop = _digest("\0".join(k.label for k in out[j:]))
            for t in range(p):
                align(out[j + t], kids[i + t], siblings=True).loop = loop
            i += p
            continue
        latest[kids[i].label] = len(out)
        out.append(kids[i])
        i += 1
    return out


def widen(kids: list[Node]) -> list[Node]:
    """At most BREADTH children: equal labels, else equal tags, else all elements become one repeated group."""
    for key in (lambda k: k.label, lambda k: k.label.partition(".")[0], lambda k: k.label if k.label == TEXT else "*"):
        if len(kids) <= BREADTH:
            break
        groups: dict[str, Node] = {}
        for k in kids:
            name = key(k)
            if name in groups:
                align(groups[name], k, siblings=True)
            else:
                groups[name], k.label = k, name
        kids = list(groups.values())
        for k in kids:
            k.loop = 1
    return kids


def prune(root: Node) -> Node:
    """A wrapper of at most NODES nodes: what is deeper than fits becomes a slot."""
    level, total = [root], 0
    while level:
        total += len(level)
        below = [k for node in level for k in node.kids]
        if total + len(below) > NODES:
            for node in level:
                if node.kids:
                    slot = Node(TEXT, 0, sum(k.chars for k in node.kids))
                    slot.high, slot.many, node.kids = 1, True, [slot]
            break
        level = below
    return root


def fold(page: str) -> Node:
    """A page's expression."""
    root = Node("")
    stack, over, leaves = [root], 0, []
    whole = hashlib.blake2b(digest_size=8)

    def add(node: Node) -> None:
        kids = stack[-1].kids
        if kids and kids[-1].label == node.label:
            align(kids[-1], node, siblings=True)
        else:
            kids.append(node)

    def shut() -> None:
        node = stack.pop()
        node.kids = widen(squares(node.kids))
        add(node)

    for event, name, _, _, _, text in blocks(page):
        if event == "text":
            whole.update(f"{text}\n".encode("utf-8", "surrogatepass"))
            add(Node(TEXT, _digest(text), len(text)))
        elif name.partition(".")[0] in VOID:
            continue
        elif event == "open":
            if len(stack) > DEPTH:
                over += 1
            else:
                stack.append(Node(name))
        elif over:
            over -= 1
        else:
            shut()
    while len(stack) > 1:
        shut()
    root.kids = widen(squares(root.kids))
    of_page = int.from_bytes(whole.digest(), "big", signed=True)
    leaves = [root]
    while leaves:
        node = leaves.pop()
        node.page_low = node.page_high = of_page
        leaves += node.kids
    return prune(root)


def expression(root: Node) -> str:
    """The wrapper as text: <p>, (..)+ repeated, (..)? optional, (..)* both, # a slot, = a constant text."""

    def inside(node: Node) -> str:
        out = [one(k, node) for k in node.kids]
        for loop in dict.fromkeys(k.loop for k in node.kids if k.loop):
            places = [i for i, k in enumerate(node.kids) if k.loop == loop]
            out[places[0]] = "(" + out[places[0]]
            out[places[-1]] += ")+"
        return "".join(out)

    def one(node: Node, parent: Node) -> str:
        body = ("=" if node.low == node.high else "#") if node.label == TEXT else f"<{node.label}>{inside(node)}</{node.label.partition('.')[0]}>"
        optional, many = node.seen < parent.times, node.many and not node.loop
        group = "*" if many and optional else "+" if many else "?" if optional else ""
        return f"({body}){group}" if group else body

    return inside(root)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of Node.pack) of every host of (host, html)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            known: dict[str, Node] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = fold(page.as_py() or "")
                known[host] = prune(align(known[host], one)) if host in known else one
            rows: list[tuple[str, int, str]] = []
            size = 0
            for host, root in known.items():
                rows.append((host, block, json.dumps(root.pack())))
                size += len(rows[-1][2])
                if size > BATCH_CHARS:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
            block += 1

    def batch_of(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "block", "wrapper"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        roots = (Node.unpack(json.loads(w)) for w in group["wrapper"])
        root = next(roots)
        for other in roots:
            root = prune(align(root, other))
        return pd.DataFrame({"host": group["host"].iloc[:1], "block": group["block"].iloc[:1], "wrapper": [json.dumps(root.pack())]})

    schema = "host string, block long, wrapper string"
    known = materialise(pages.select("host", "html").mapInArrow(partial, schema), "html-wrappers")
    while (most := known.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salt = F.pmod(F.xxhash64("block"), F.lit(-(-most // FAN_IN)))
        merged = materialise(known.groupBy("host", salt.alias("salt")).applyInPandas(merge, schema), "html-wrappers")
        discard(known)
        known = merged
    return known


def templates(root: Node) -> list[int]:
    """What is template on a wrapper's host, as numbers of (path of labels, text): constant texts on
    pages that differ, on at least half of those that have the parent, outside article and main
    elements.  No h1 is, nor prose of an element with prose that varies.  Pages that agree on more
    than they differ in may be near copies and prove nothing."""
    varying = constant = 0
    found: list[int] = []

    def varies(node: Node) -> bool:
        return node.low != node.high if node.label == TEXT else any(map(varies, node.kids))

    def visit(node: Node, path: int) -> None:
        nonlocal constant
        prose = {id(k) for k in node.kids if k.label.partition(".")[0] not in CONTAINERS}
        in_prose = any(id(k) in prose and varies(k) for k in node.kids)
        for k in node.kids:
            if is_text_region(k.label) or k.label.partition(".")[0] == "h1" or (in_prose and id(k) in prose):
                continue
            if k.label != TEXT:
                visit(k, _node(path, k.label))
            elif k.low == k.high and k.page_low != k.page_high and 2 * k.seen >= node.times:
                found.append(_node(path, str(k.low)))
                constant += k.chars

    visit(root, 0)
    todo = [root]
    while todo:
        node = todo.pop()
        varying += node.chars if node.label == TEXT and node.low != node.high else 0
        todo += node.kids
    return found if constant <= varying else []


# ------------------------------------------------------------------ extraction


def extract(page: str | None, template: frozenset = frozenset()) -> str:
    """The text of a page's blocks, joined by newlines, without template blocks outside article and
    main elements; beside such elements blocks of mere links are menus.  White space in a block
    becomes one space; empty blocks are none.
    """
    found = [b for b in blocks(page or "") if b[0] == "text"]
    has_region = any(region for _, _, _, region, _, _ in found)
    return "\n".join(
        text
        for _, _, path, region, linked, text in found
        if region or not ((has_region and linked) or (template and _node(path, str(_digest(text))) in template))
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    Null and empty html give an empty text; a null url or one without a host belongs to the
    host ''; null, repeated and equal ids play no part, repeated rows are read each, and equal pages
    prove nothing about a template; an empty table gives an empty result.  Time and memory are linear
    in a page's length, however long, deep or broken it is.  Other columns are ignored.
    """
    hosted = pages.select("page_id", "url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), "html")
    known = wrappers(hosted)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, list[int]]] = []
            held = 0
            for host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if numbers := templates(Node.unpack(json.loads(wrapper.as_py()))):
                    rows.append((host, numbers))
                    held += len(numbers)
                    if held > BATCH_NUMBERS:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple[str, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], type=pa.list_(pa.int64()))], names=["h", "template"])

    side = materialise(known.select("host", "wrapper").mapInArrow(decide, "h string, template array<long>"), "html-templates")
    discard(known)
    joined = hosted.join(F.broadcast(side) if side.count() <= BROADCAST_HOSTS else side, F.col("host") == F.col("h"), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), frozenset(template or ())) for page, template in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    key = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "template", "html").mapInArrow(work, f"page_id {key}, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's texts over the whole pages table."""
    return main_text(table(spark, sf_dir, "pages"))
