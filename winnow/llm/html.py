"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each has a hidden label: it is part of the article,
has the article somewhere below it, or neither. The label depends on the parent's label, the element's tag and what its class, id and role say
(parent-child potentials), and shows in what can be seen of the element: amount of text, share of
links, sentences (element potentials). Both kinds are estimated from labelled pages by counting.

Sum-product message passing, once up and once down the tree, gives each element's marginal
probability, exactly, as the graph is a tree. All pages of a batch pass messages together, one
level of depth at a time. A block of text is main text if its element is part of the article with a
probability of a half or more.

Pages are read in their own row, nothing is shuffled. Text keeps its order; only scripts, styles,
other code and controls, comments and head elements are never text. A head also ends where a tag
or text comes that cannot be in one, a control or drawing where a block around it ends.

Defined results: null and empty pages, and pages without an article, have an empty text; unclosed
and misnested tags follow what browsers do in the common cases; text outside of all elements is not part
of an article; bytes that are no UTF-8 are read as U+FFFD; repeated pages are read each on its own; an
element with a probability of exactly a half is main text; an empty table gives no rows. Other
columns stay as they are.

Long and broken pages: open tags are counted, elements are grouped by depth with one sort, and what
follows the last `>` is read as text at once, so deep nesting and rows of unclosed tags take time in
proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_COMMENT = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|()()()(?!)", re.S)
_NAMES = re.compile(r"""\b(class|id|role|data-main)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
NEVER = {"head", "template", "svg", "math", "canvas", "button", "select", "datalist", "object", "video", "audio", "map"}
#: Start tags that a head holds; any other, or text, ends it, as `</head>` may be left out.
IN_HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template", "noframes", "head", "html"}
#: Within these a block's start tag is no part of them but ends them, except in these parts.
FOREIGN, FOREIGN_PARTS = {"svg", "math"}, {"foreignobject", "desc", "annotation-xml"}
#: Start tags that end an open element of the same tag.
ALONE = {"button", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {"br", "hr"}
BLOCKS = {
    "html", "body", "main", "article", "section", "nav", "aside", "header", "footer", "div", "p", "h1", "h2", "h3",
    "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "details", "summary",
    "menu", "center", "dialog", "hgroup", "search", "legend",
}
#: A start tag ends an open element of these tags, up to the nearest boundary.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_BOUNDARY = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
    "tbody": {"table"}, "tfoot": {"table"}, "p": {"table", "td", "th", "caption", "html", "body", "article", "section"},
}
_KIND = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("p", "pre", "blockquote", "figure", "figcaption", "address"), "prose"),
    **dict.fromkeys(("form", "fieldset", "legend", "search", "dialog"), "form"),
    **dict.fromkeys(("article", "main"), "article"),
    **dict.fromkeys(("html", "body"), "root"),
    **dict.fromkeys(("div", "center", "section", "details", "summary"), "box"),
}
KINDS = ["root", "article", "box", "prose", "heading", "list", "item", "table", "form", "nav", "aside", "header", "footer"]
# Parts of class, id and role names: what they say about an element.
_AGAINST = set(
    """nav navigation navbar menu sidebar side aside foot footer head header masthead banner breadcrumb breadcrumbs
    ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice
    notification alert popup modal overlay newsletter subscribe subscription signup login register search form share
    sharing social related recommended recommendations more widget comment comments commentlist reply replies respond
    discussion disqus feedback copyright legal imprint pager pagination tags toolbar skip complementary contentinfo
    teaser teasers toc byline meta outbrain taboola""".split()
)
_HEAD = {"head", "header"}
_FOR = set("article content post entry story main body text prose".split())


class Tree(NamedTuple):
    """Block elements of a page in order of their start, and the page's blocks of text."""

    parent: list[int]
    kind: list[int]  # kind of tag and what the names say
    label: list[int]  # 1: marked as article, 0: not, of labelled pages
    text: list[int]  # letters, own
    linked: list[int]  # letters in links
    sentences: list[int]
    blocks: list[tuple[int, str]]  # element, text


def _said(attributes: str) -> tuple[int, str | None]:
    """0 nothing, 1 against, 2 for; and the mark of labelled pages."""
    stand, mark = 0, None
    for name, a, b, c in _NAMES.findall(attributes):
        value = a or b or c
        if name.lower() == "data-main":
            mark = value
            continue
        parts = {p.lower() for p in _PART.findall(value)}
        if parts & _AGAINST and not (parts & _AGAINST <= _HEAD and parts & _FOR):  # not entry-header
            stand = 1
        elif parts & _FOR and not stand:
            stand = 2
    return stand, mark


_known_names: dict[str, tuple[int, str | None]] = {}


def tree(page: str) -> Tree:
    """Elements and text blocks of a page."""
    t = Tree([-1], [0], [0], [0], [0], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # tag, block element
    opened: Counter[str] = Counter()  # tags on the stack, but for the first
    last_end = page.rfind(">")  # no tag begins behind it
    links = 0
    hidden: list[str] = []
    below: Counter[str] = Counter()  # blocks open within what is hidden
    parts: list[str] = []

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts = []
            if text:
                own = stack[-1][1]
                t.blocks.append((own, text))
                t.text[own] += len(text)
                t.sentences[own] += len(_SENTENCE.findall(text))

    def close(k: int) -> None:
        """End all open elements from the k-th on."""
        nonlocal links
        if any(tag in BLOCKS for tag, _ in stack[k:]):
            flush()
        for tag, _ in stack[k:]:
            opened[tag] -= 1
            links -= tag == "a"
        del stack[k:]

    def stays_hidden(end: str, tag: str, attributes: str) -> bool:
        """Whether a tag belongs to the open hidden elements; else they are at their end."""
        if hidden == ["head"] and (tag in {"body", "html", "br"} if end else tag not in IN_HEAD):
            return False
        if end and tag in hidden:
            while hidden.pop() != tag:
                pass
        elif end and tag in BLOCKS:
            if not below[tag] and opened[tag]:
                return False
            below[tag] -= below[tag] > 0
        elif end or attributes.endswith("/"):
            return True
        elif tag in BLOCKS:
            if hidden[-1] in FOREIGN:
                return False
            below[tag] += 1
        elif tag in NEVER and not (tag in ALONE and tag in hidden) and tag != "head":
            hidden.append(tag)
        elif tag in FOREIGN_PARTS and hidden[-1] in FOREIGN:
            hidden.append(tag)
        return True

    at = 0
    while True:
        m = (_TOKEN if at <= last_end else _COMMENT).search(page, at)
        said = page[at : m.start()] if m else page[at:]
        if hidden == ["head"] and said.strip():
            hidden.clear()
        if said and not hidden:
            parts.append(said)
            if links:
                t.linked[stack[-1][1]] += len(said.strip())
        if not m:
            break
        at = m.end()
        end, tag, attributes = m[1], (m[2] or "").lower(), m[3]
        if not tag:
            continue
        if hidden and tag in RAW and not end:
            stop = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            if stop or hidden == ["head"]:
                at = stop.start() if stop else len(page)
            continue
        if hidden:
            if stays_hidden(end, tag, attributes):
                continue
            hidden.clear()
        if end:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in BLOCKS and tag not in BLOCKS:
                    break  # an inline end tag does not reach beyond its block
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if tag in VOID:
            if tag in BREAKS:
                parts.append("\n")
            continue
        if tag in NEVER:
            if not attributes.endswith("/") or tag == "head":
                hidden.append(tag)
                below.clear()
            continue
        if tag not in BLOCKS:
            if not attributes.endswith("/"):
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
                links += tag == "a"
            continue
        if tag == "html" or (tag == "body" and opened["body"]):
            continue
        ended = ENDS.get(tag, {"p"})
        edge = _BOUNDARY.get(tag, _BOUNDARY["p"])
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ended) else ():
            if stack[k][0] in ended:
                close(k)
                break
            if stack[k][0] in edge:
                break
        flush()
        stand, mark = _known_names.get(attributes) or _said(attributes)
        if len(_known_names) < 10_000:
            _known_names[attributes] = stand, mark
        parent = stack[-1][1]
        t.parent.append(parent)
        t.kind.append(KINDS.index(_KIND.get(tag, tag)) * 3 + stand)
        t.label.append(t.label[parent] if mark is None else int(mark.lower() != "no"))
        for column in (t.text, t.linked, t.sentences):
            column.append(0)
        stack.append((tag, len(t.parent) - 1))
        opened[tag] += 1
    flush()
    return t


class Forest(NamedTuple):
    """The elements of many pages."""

    first: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    seen: np.ndarray  # what can be seen of an element, one column per trait
    label: np.ndarray


TRAITS = (8, 5, 4)


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The elements of each depth, in order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1])


def forest(trees: list[Tree]) -> Forest:
    first = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.array(t.parent) + a * (np.array(t.parent) >= 0) for t, a in zip(trees, first, strict=False)])
    depth = (parent >= 0).astype(np.int64)
    up = parent
    while (up >= 0).any():  # twice as far up each time
        depth, up = depth + np.where(up >= 0, depth[up], 0), np.where(up >= 0, up[up], -1)
    text, linked, sentences = (np.concatenate([getattr(t, n) for t in trees]).astype(np.float64) for n in ("text", "linked", "sentences"))
    for own in reversed(levels(depth)[1:]):  # with all that is below
        for x in (text, linked, sentences):
            np.add.at(x, parent[own], x[own])
    share = np.where(text > 0, linked / np.maximum(text, 1), 0)
    seen = np.stack(
        [
            np.minimum(np.ceil(np.log2(text + 1) / 2), TRAITS[0] - 1).astype(np.int64),
            np.where(text == 0, 4, np.digitize(share, [0.05, 0.3, 0.7])),
            np.digitize(sentences, [1, 2, 4]),
        ],
        axis=1,
    )
    kind = np.concatenate([t.kind for t in trees])
    return Forest(first, parent, depth, kind, seen, np.concatenate([t.label for t in trees]))


#: Labels: around the article, part of it, neither.
AROUND, INSIDE, OTHER = 0, 1, 2


class Model(NamedTuple):
    """Logarithms of potentials: root [y], step [kind, parent's y, y], one array [value, y] per trait."""

    root: np.ndarray
    step: np.ndarray
    traits: list[np.ndarray]


def labels(f: Forest) -> np.ndarray:
    """Labels of all elements from the marks of labelled pages."""
    holds = f.label.copy()
    for own in reversed(levels(f.depth)[1:]):
        np.maximum.at(holds, f.parent[own], holds[own])
    return np.where(f.label == 1, INSIDE, np.where(holds == 1, AROUND, OTHER))


def counted(f: Forest) -> list[tuple[str, int, int, int, int]]:
    """What a model is estimated from: (what, kind or value, parent's y, y, count)."""
    found: Counter = Counter()
    y = labels(f)
    tops = f.parent < 0
    found.update(("root", 0, 0, k) for k in y[tops].tolist())
    below = np.flatnonzero(~tops)
    steps = zip(f.kind[below].tolist(), y[f.parent[below]].tolist(), y[below].tolist(), strict=True)
    found.update(("step", *s) for s in steps)
    for k in range(len(TRAITS)):
        found.update((f"trait{k}", v, 0, x) for v, x in zip(f.seen[below, k].tolist(), y[below].tolist(), strict=True))
    return [(*key, n) for key, n in found.items()]


def estimated(counts: Iterable[tuple[str, int, int, int, int]], weight: float = 0.2, power: float = 0.25) -> Model:
    """Potentials from counts. Rare kinds lean on what their names say, that on all kinds.

    An element's traits cover what is below it, so the same text is seen again on every level;
    `power` takes that back. Both numbers were chosen for the fewest wrong blocks on labelled pages.
    """
    root = np.full(3, 0.5)
    step = np.zeros((len(KINDS), 3, 3, 3))
    traits = [np.full((n, 3), 0.5) for n in TRAITS]
    for what, a, b, y, n in counts:
        if what == "root":
            root[y] += n
        elif what == "step":
            step[a // 3, a % 3, b, y] += n
        else:
            traits[int(what[5:])][a, y] += n
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    overall = share(step.sum(axis=(0, 1)) + 0.02)
    by_names = share(step.sum(axis=0) + weight * overall)
    own = share(step + weight * by_names)
    return Model(
        np.log(share(root)), np.log(own).reshape(-1, 3, 3), [power * np.log(t / t.sum(axis=0)) for t in traits]
    )


def marginals(f: Forest, model: Model) -> np.ndarray:
    """The probability of each element to be part of the article."""
    total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    up = sum(t[f.seen[:, k]] for k, t in enumerate(model.traits))
    up[f.parent < 0] = model.root
    step = model.step[f.kind]
    to_parent = np.zeros_like(up)
    by_depth = levels(f.depth)
    for own in reversed(by_depth[1:]):
        to_parent[own] = total(up[own, None, :] + step[own], 2)
        np.add.at(up, f.parent[own], to_parent[own])
    belief = up.copy()
    for own in by_depth[1:]:
        rest = belief[f.parent[own]] - to_parent[own]
        belief[own] = up[own] + total(rest[:, :, None] + step[own], 1)
    return np.exp(belief[:, INSIDE] - total(belief, 1))


def trained(spark: SparkSession, labelled: DataFrame | None = None, html: str = "html") -> Model:
    """A model from labelled pages (see html_pages): all pages are counted on the cluster."""
    if labelled is None:
        from winnow.llm.html_pages import PAGES

        labelled = spark.createDataFrame([(p,) for p in PAGES], f"{html} string")
    schema = "what string, a int, b int, y int, n long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pages in chunks(batches, "html"):
            rows = counted(forest([tree(p.decode("utf-8", "replace")) for p in pages]))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=["what", "a", "b", "y", "n"])

    counts = labelled.select(F.col(col_name(html)).alias("html")).filter("html IS NOT NULL").mapInArrow(count, schema)
    # As many rows as a model has numbers.
    return estimated([tuple(r) for r in counts.groupBy("what", "a", "b", "y").agg(F.sum("n").alias("n")).collect()])


def main_texts(pages: list[str], model: Model) -> list[list[str]]:
    """The main text's blocks of each page."""
    trees = [tree(p) for p in pages]
    f = forest(trees)
    p = marginals(f, model)
    return [[text for own, text in t.blocks if p[a + own] >= 0.5] for t, a in zip(trees, f.first, strict=False)]


def extracted(
    pages: DataFrame, model: Model | None = None, html: str = "html", name: str = "blocks"
) -> DataFrame:
    """The pages with one column more instead of `html`: the blocks of their main text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    known = spark.sparkContext.broadcast(model or trained(spark))  # some hundred numbers
    others = [f for f in pages.schema.fields if f.name.lower() != html.lower()]
    schema = T.StructType([*others, T.StructField(name, T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, html):
            blocks = pa.array(main_texts([t.decode("utf-8", "replace") for t in texts], known.value), type=arrow.field(name).type)
            kept = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in arrow if f.name != name]
            yield pa.RecordBatch.from_arrays([*kept, blocks], schema=arrow)

    return pages.mapInArrow(run, schema)


def report(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: its main text, blocks joined by a space, and the text's length."""
    found = extracted(pages.select("page_id", "url", "html"), model)
    text = F.array_join("blocks", " ")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
