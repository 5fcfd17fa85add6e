"""Operator 8, HTML extraction with inferred wrappers.

A wrapper is a union-free regular expression over a host's pages: elements in a row, each plain, optional (?) or
repeated (+), groups of several elements that repeat together, and text slots. A page is turned into such an expression
(inline tags belong to their text slot, open paragraphs are closed, runs of equal siblings become repeats); expressions
are aligned node by node: equal keys are merged, a mismatch becomes an optional element or joins a repeat. Each slot
keeps whether its text differs between pages, how long it is and how much of it is link text.

All pages take part: each task folds its pages host by host, partial wrappers meet by (host, salt), then by host, so a host
that holds a third of all pages is folded by many tasks. From its wrapper a host's main content is read off: the article
or main element, else the element whose paragraphs hold most text outside links. Template text in it is dropped: slots that
every page has in this place, neither optional nor repeated, whose text never changes although the element holds
``constant_pages`` different texts or more (copies of a page count once). A page loses such a slot where the text is the
slot's own and no more often than the wrapper has it; siblings and repeats of some pages stay. Each page is then read once
more with this decision.

Text: character references decoded, white space runs in a block become one space, blocks are joined by one newline. Menus,
page headers, footers, asides, forms, scripts, styles, adverts, notices and reader comments are left out, wherever they
stand (page headers only outside the content). An element is such a part by its tag, or by a class, id or role of its own that names
nothing else (``related-posts``, ``ad_slot``); a name that says more (``related-work``, ``sponsor-interview``) doesn't count.

Bounds: a wrapper reaches ``deepest`` elements down, and a row of it holds ``widest`` elements at most: beyond that its optional
elements take their tag's key and meet there, so classes that differ from page to page can't make it grow. Pages themselves are
parsed and read at any depth and width; what the wrapper doesn't know of is judged by the page's own expression.

Defined cases: null or empty html gives an empty text; a url without ``://`` belongs to the empty host; unclosed tags,
comments and scripts run to where the page ends; of equally dense elements the outermost, then the first by path is the content;
repeated rows are read each; a very long page is read whole by one task; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words
from tessaprobe.llm.url_reputation import url_parts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?=/?[a-zA-Z])[^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

# HTML element kinds, and class or id words of page parts that aren't the article.
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
    "section table ul".split()
)
KNOWN = frozenset(
    "div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption form "
    "details summary address hgroup body html head hr img meta link input".split()
)
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select option textarea menu dialog object audio video canvas title".split()
)
OTHER_WORDS = frozenset(
    "box block section list wrapper wrap container bar content area top bottom left right inline item items inner outer row col column page site global "
    "post posts article articles story stories link links button buttons icon icons text title slot unit zone panel group holder module component primary "
    "secondary main form thread entry body js is has small large mobile desktop".split()
)
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer related recommended share sharing social newsletter subscribe "
    "signup login comment comments disqus replies respond reply widget toolbar skip".split()
)
OUTSIDE_WORDS = frozenset("header masthead topbar".split())


sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # for ``deepest`` levels of wrappers


@dataclass(frozen=True)
class Extract:
    constant_pages: int = 10
    longest_unit: int = 8
    deepest: int = 300
    widest: int = 120
    hosts_held: int = 2000
    salts: int = 16
    broadcast_bytes: int = 16 << 20


class Node:
    __slots__ = ("children", "key", "tag", "text", "links")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.children, self.text, self.links = tag, key, [], [], 0


def key_of(tag: str, attributes: str) -> str:
    """The element's name, with its classes, id, role and itemprop: each as its words joined by -; digits don't count."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes and "=" in attributes or "hidden" in attributes else ():
        value = a or b or c
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            found.append("hidden")
        elif name.lower() != "aria-hidden":
            split = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
            found += [w for w in (re.sub(r"[^a-z]+", "-", name).strip("-") for name in split.split()) if w]
    return ".".join([tag, *dict.fromkeys(found)])


def parsed(page: str) -> Node:
    """The page's block elements; text and inline markup between them are their own text. An element's pieces of text and its
    child elements keep their order: ``children`` holds strings and nodes."""
    root = Node("#", "#")
    stack, link = [root], 0
    opened: Counter = Counter()  # how many elements of each tag are open
    at, size = 0, len(page)

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            text = html.unescape(text) if "&" in text else text
            if stack[-1].children and isinstance(stack[-1].children[-1], str):
                stack[-1].children[-1] += text
            else:
                stack[-1].children.append(text)
            if link:
                stack[-1].links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag not in INLINE and opened[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        link = 0
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                if stack[-1].children and isinstance(stack[-1].children[-1], str):
                    stack[-1].children[-1] += " "
                else:
                    stack[-1].children.append(" ")
            link += tag == "a"
            continue
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    link = 0
                    break
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            barrier = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table", "select"))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in barrier:
                    break
                if stack[depth].tag in alike:
                    close(depth)
                    link = 0
                    break
        node = Node(tag, key_of(tag, m[3]))
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def is_part(key: str, inside: bool) -> bool:
    """Whether an element is a page part that isn't article text."""
    tag, *names = key.split(".")
    if tag in LEFT_OUT or (tag == "header" and not inside):
        return True
    for name in names:
        parts = set(name.split("-"))
        own = parts & PART_WORDS or (not inside and parts & OUTSIDE_WORDS)
        if name == "hidden" or (own and parts <= PART_WORDS | OTHER_WORDS | OUTSIDE_WORDS):
            return True
    return False


def is_article(key: str) -> bool:
    tag, *names = key.split(".")
    main = any("main" in (parts := set(n.split("-"))) and parts <= OTHER_WORDS for n in names)
    return tag in ("article", "main") or main and tag != "body" or "articlebody" in names or "article-body" in names


# A wrapper node is [key, quantifier, hashes of the different texts that it holds with its children (the ``constant_pages``
# smallest; none without children), characters, characters in links, text hash or None if it differs, children].


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def own_hash(own: str) -> int:
    return xxhash.xxh64_intdigest(own) if own else 0


def expression(node: Node, extract: Extract) -> list:
    return described(node, extract)[0]


def described(node: Node, extract: Extract, depth: int = 0) -> tuple[list, int]:
    """The node's expression, and a hash of its text with its children's, page parts left out. Frames are the interpreter's own, no
    stack of C calls, so ``deepest`` of them are no trouble."""
    own = own_text(node)
    slot, held, children = own_hash(own), [], []
    for c in node.children:
        if isinstance(c, Node) and depth < extract.deepest:
            child, text = described(c, extract, depth + 1)
            children.append(child)
            if text and not is_part(c.key, True):
                held.append(text)
    whole = xxhash.xxh64_intdigest(repr((slot, held))) if held else slot
    return [node.key, "", [whole] if children else [], len(own), node.links, slot, folded(children, extract)], whole


def distinct(a: list, b: list, extract: Extract) -> list:
    return a if not b or a == b else sorted({*a, *b})[: extract.constant_pages]


def more(a: str, b: str) -> str:
    """The weaker of two quantifiers: repeats and options add up."""
    return "*" if {"+", "*"} & {a, b} and {"?", "*"} & {a, b} else (a or b)


def merged(a: list, b: list, extract: Extract) -> list:
    return [
        a[0], more(a[1], b[1]), distinct(a[2], b[2], extract), a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None,
        a[6] if not b[6] and not a[6] else folded(aligned(a[6], b[6], extract), extract),
    ]


def folded(children: list, extract: Extract) -> list:
    """Runs of equal units, of one element or several, become one repeated unit; at most ``widest`` elements are left."""
    for unit in range(1, extract.longest_unit + 1):
        out: list = []
        for child in children:
            out.append(child)
            if len(out) >= 2 * unit and [c[0] for c in out[-unit:]] == [c[0] for c in out[-2 * unit : -unit]]:
                new, old = out[-unit:], out[-2 * unit : -unit]
                del out[-2 * unit :]
                if unit == 1:
                    both = merged(old[0], new[0], extract)
                    both[1] = more(both[1], "+")
                    both[2] = max(old[0][2], new[0][2], key=len)
                    out.append(both)
                else:
                    joined = [merged(x, y, extract) for x, y in zip(old, new, strict=True)]
                    out.append(["(" + " ".join(c[0] for c in joined) + ")", "+", [], 0, 0, 0, joined])
            elif unit > 1 and len(out) > unit and out[-unit - 1][0] == "(" + " ".join(c[0] for c in out[-unit:]) + ")":
                group, new = out[-unit - 1], out[-unit:]
                del out[-unit:]
                group[6] = [merged(x, y, extract) for x, y in zip(group[6], new, strict=True)]
        children = out
    return children if len(children) <= extract.widest else met_by_tag(children, extract)


def met_by_tag(children: list, extract: Extract) -> list:
    """A row that is too long: all elements of one tag meet in one, optional and repeated; unknown tags are one."""
    met: dict[str, list] = {}
    for child in children:
        for c in child[6] if child[0].startswith("(") else [child]:
            tag = c[0].split(".")[0]
            tag = tag if tag in KNOWN else "other"
            own = [tag, *c[1:6], []]  # what such a mixture holds is no row of elements
            own[3] += sum(x[3] for x in c[6])
            if tag in met:
                met[tag] = merged(met[tag], own, extract)
            else:
                met[tag] = own
            met[tag][1] = "*"
    return list(met.values())


def aligned(a: list, b: list, extract: Extract) -> list:
    """One row of elements that both rows fit: the longest common row of keys, the rest optional."""
    if [c[0] for c in a] == [c[0] for c in b]:
        return [merged(x, y, extract) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j], extract))
            i, j = i + 1, j + 1
        else:
            left = j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1])
            child = list(a[i] if left else b[j])
            child[1] = more(child[1], "?")
            out.append(child)
            i, j = i + left, j + (not left)
    return out


def shown(wrapper: list) -> str:
    """The wrapper as text: <key> (...)+ ? and #slot."""
    inner = "".join(map(shown, wrapper[6]))
    slot = "" if wrapper[5] == 0 else "#slot" if wrapper[5] is None else "#text"
    body = f"({inner})" if wrapper[0].startswith("(") else f"<{wrapper[0]}>{slot}{inner}</{wrapper[0].split('.')[0]}>"
    return f"({body}){wrapper[1]}" if wrapper[1] else body


def decision(wrapper: list, extract: Extract) -> dict:
    """Paths of the content elements and, for each, how often a slot (path, text hash) in it holds template text."""
    articles, dense = [], []

    def walk(node: list, path: tuple, inside: bool) -> None:
        if node[0].startswith("("):
            for child in node[6]:
                walk(child, path, inside)
            return
        path = (*path, node[0])
        if is_part(node[0], inside):
            return
        if is_article(node[0]) and not inside:
            articles.append((path, node))
        direct = sum(max(0, c[3] - c[4]) for c in flat(node[6]) if not is_part(c[0], True) and c[0].split(".")[0] in ("p", "blockquote", "pre", "h1", "h2", "h3", "li"))
        dense.append((direct + max(0, node[3] - node[4]), -len(path), path, node))
        for child in node[6]:
            walk(child, path, inside or is_article(node[0]))

    def flat(children: list) -> Iterator[list]:
        for c in children:
            if c[0].startswith("("):
                yield from flat(c[6])
            else:
                yield c

    def total(node: list) -> int:
        return node[3] + sum(total(c) for c in node[6] if not is_part(c[0], True))

    walk(wrapper, (), False)
    inner = [(p, n) for p, n in articles if total(n)]
    narrowed = []
    for path, node in inner:
        if node[0].split(".")[0] != "article":  # an article within main is the content, not the rest of main
            nested: list = []

            def look(x: list, p: tuple) -> None:
                for c in x[6]:
                    if c[0].startswith("("):
                        look(c, p)
                    elif not is_part(c[0], True):
                        if c[0].split(".")[0] == "article" and total(c):
                            nested.append(((*p, c[0]), c))
                        else:
                            look(c, (*p, c[0]))

            look(node, path)
            narrowed += nested or [(path, node)]
        else:
            narrowed.append((path, node))
    chosen = narrowed or [(p, n) for _, _, p, n in sorted(dense, key=lambda d: (-d[0], d[1], d[2]))[:1] if _ is not None]
    constant: dict[str, Counter] = {}

    def slots(node: list, path: str, into: Counter) -> None:
        for c in node[6]:
            if not c[1] and not is_part(c[0], True):
                own = f"{path}/{c[0]}"
                if c[5]:
                    into[f"{own} {c[5]}"] += 1
                slots(c, own, into)

    for path, node in chosen:
        found: Counter = Counter()
        if len(node[2]) >= extract.constant_pages:
            slots(node, "/".join(path), found)
        place = "/".join(path)  # elements of one path can't be told apart in a page: only what all of them hold goes
        constant[place] = constant[place] & found if place in constant else found
    return {"content": list(constant), "constant": {p: dict(c) for p, c in constant.items() if c}}


def text_of(page: Node, decided: dict, extract: Extract, own: bool = False) -> str:
    """The main text of a page; a page without the decided content elements is judged by its own expression."""
    content, constant = set(decided["content"]), decided["constant"]
    blocks: list[str] = []

    def collect(top: Node, path: str, left: dict) -> None:
        waiting: list = [(top, path, False)]  # nodes and pieces of text in page order, the next one last
        while waiting:
            node, path, template = waiting.pop()
            if isinstance(node, str):
                line = " ".join(node.split())
                if line and not template:
                    blocks.append(line)
                continue
            slot = f"{path} {own_hash(own_text(node))}" if left else ""
            template = left.get(slot, 0) > 0
            if template:
                left[slot] -= 1
            for child in reversed(node.children):
                if isinstance(child, str):
                    waiting.append((child, "", template))
                elif not is_part(child.key, True):
                    waiting.append((child, f"{path}/{child.key}" if left else "", False))

    def find(wanted) -> None:
        waiting = [(page, page.key, 0)]
        while waiting:
            node, path, depth = waiting.pop()
            if wanted(node, path):
                collect(node, path, dict(constant.get(path, ())))
                continue
            for child in reversed(node.children):
                if isinstance(child, Node) and not is_part(child.key, False):
                    waiting.append((child, f"{path}/{child.key}" if depth < extract.deepest else "", depth + 1))

    find(lambda node, path: path in content)
    if not blocks and not own:
        return text_of(page, decision(expression(page, extract), extract), extract, own=True)
    if not blocks:  # an article deeper than the wrapper reaches, or else all that isn't a page part
        find(lambda node, path: is_article(node.key))
    if not blocks:
        constant = {}
        find(lambda node, path: node is page)
    return "\n".join(blocks)


def wrappers(pages: DataFrame, extract: Extract = Extract()) -> DataFrame:
    """host, wrapper (JSON): one row per host of ``pages`` (host, html)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held = TaskContext.get().partitionId() % extract.salts, {}

        def out() -> pa.RecordBatch:
            rows = [json.dumps(w) for w in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array(rows, pa.string())], names=["host", "salt", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                new = expression(parsed(page or ""), extract)
                held[host] = merged(held[host], new, extract) if host in held else new
                if len(held) > extract.hosts_held:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = None
        for row in group.column("wrapper"):
            new = json.loads(row.as_py())
            whole = new if whole is None else merged(whole, new, extract)
        yield pa.RecordBatch.from_arrays(
            [group.column("host")[:1].combine_chunks(), group.column("salt")[:1].combine_chunks(), pa.array([json.dumps(whole)])], names=["host", "salt", "wrapper"]
        )

    schema = "host string, salt int, wrapper string"
    partial = pages.select("host", "html").mapInArrow(first, schema)
    partial = store.per_run(partial, ["host", "salt"], meet, schema)
    return store.per_run(partial, ["host"], meet, schema).select("host", "wrapper")


def extracted(pages: DataFrame, extract: Extract = Extract()) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [json.dumps(decision(json.loads(w), extract)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rows, pa.string())], names=["host", "decided"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in words.slices(batch, "html"):
                texts = []
                for page, decided in zip(part.column("html").to_pylist(), part.column("decided").to_pylist(), strict=True):
                    if decided not in known:
                        if len(known) > extract.hosts_held:
                            known.clear()
                        known[decided] = json.loads(decided) if decided else None
                    texts.append(text_of(parsed(page or ""), known[decided] or {"content": [], "constant": {}}, extract))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    host, _ = url_parts("url")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit("")))
    found = store.written(wrappers(rows, extract).mapInArrow(decide, "host string, decided string"), "html-decisions")
    size = found.agg(F.sum(F.length("host") + F.length("decided"))).first()[0] or 0
    side = F.broadcast(found) if size <= extract.broadcast_bytes else found
    return rows.join(side, "host", "left").select("page_id", "url", "html", "decided").mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(store.table(spark, sf_dir, "pages"))
