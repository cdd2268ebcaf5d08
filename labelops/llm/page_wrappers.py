"""Main text of web pages by wrappers inferred per host.

The pages of a host are aligned into one union-free regular expression over
their block structure. Neighbouring elements of one kind fold into a repeated
group; where two streams differ, an element becomes optional and a text that is
not the same becomes a slot. Every task aligns the pages it reads, host by
host; the partial wrappers are then aligned in two further steps, so a host with
most of the pages is no single task.

The wrapper tells where the host keeps its article: its article or main element,
if that holds a slot. Hosts without one get the whole body but for texts that
are the same on all pages. Menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are never part of the text. They
are told by element, role, and class or id tokens made of such words only; a
token that has them beside others, as with-sidebar, says nothing. A page that
lacks its host's article element is taken by a wrapper of its own.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.llm.url_rules import after_scheme, host_of
from labelops.session import stored

SALTS = 32
#: Pages that must agree before an unchanging text counts as part of the wrapper.
LEAST_PAGES = 3
SLOT = "*"

BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo banner menu nav navbar navigation sidebar footer breadcrumb breadcrumbs "
    "cookie cookies consent notice newsletter subscribe share social comment comments disqus related popup modal widget".split()
)
HEADER_MARKS = frozenset("header masthead".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S | re.I,
)
# One attribute at a time, its value included, so that nothing inside a value counts as a name.
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[a-z]+")
#: Elements that hold the content and are never left out for a class or id.
CONTENT = frozenset("html body main article".split())
#: A header inside one of these belongs to the content.
SECTIONS = frozenset("main article section".split())


def _attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag, in lower case; of repeated names the first one counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _marked(tokens: list[str], marks: frozenset[str]) -> bool:
    """Whether a class or id token is a mark or made of marks only, as in ad-banner."""
    return any((words := _WORD.findall(token)) and marks.issuperset(words) for token in tokens)


class Element:
    """A block element: its kind, whether it is left out, and its children (elements and texts)."""

    __slots__ = ("name", "kind", "dropped", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name = name
        roles = set(attributes.get("role", "").split())
        self.dropped = name in DROPPED or bool(roles & ROLES) or "hidden" in attributes
        if "main" in roles:
            name = "main"
        if name not in CONTENT:
            self.dropped |= _marked(attributes.get("class", "").split() + attributes.get("id", "").split(), MARKS | HEADER_MARKS)
        self.kind = ".".join([name, *sorted(attributes.get("class", "").split())])
        self.children: list[Element | str] = []


def parse(source: str) -> Element:
    """The block elements of a page. Inline markup is dropped; unclosed and stray tags are tolerated."""
    root = Element("#page", {})
    stack = [root]
    text: list[str] = []

    def flush() -> None:
        words = " ".join("".join(text).split())
        if words:
            stack[-1].children.append(words)
        text.clear()

    def close(k: int) -> None:
        flush()
        del stack[k:]

    at = 0
    for m in _MARKUP.finditer(source):
        if m.start() > at:
            text.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        ending, name, raw = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
        marked = name not in BLOCKS and name not in VOID and not ending and raw and _attributes(raw)
        if name not in BLOCKS:
            # Inline elements that are left out as a whole stand as elements of their own.
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
                    if stack[k].name in BLOCKS:
                        break
            elif (marked or name in DROPPED) and (element := Element(name, marked or {})).dropped:
                flush()
                stack[-1].children.append(element)
                stack.append(element)
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    # Only a closed header: one that is never closed holds the rest of the page.
                    if name == "header" and SECTIONS.isdisjoint(e.kind.split(".")[0] for e in stack[:k]):
                        stack[k].dropped = True
                    close(k)
                    break
            flush()
            continue
        flush()
        if stack[-1].name in _CLOSED_BY_BLOCK:
            stack.pop()
        if name in _SELF_CLOSING and stack[-1].name in _SELF_CLOSING[name]:
            stack.pop()
        element = Element(name, _attributes(raw))
        stack[-1].children.append(element)
        if name not in VOID:
            stack.append(element)
    if at < len(source):
        text.append(entities.unescape(source[at:]))
    flush()
    return root


# A wrapper node is [kind, optional, repeated, content]: content is a list of nodes, or for
# the kind "#text" the checksum of an unchanging text or SLOT.


def wrapper(element: Element) -> list:
    """The wrapper of one page: neighbouring children of one kind are aligned into a repeated one."""
    children: list[list] = []
    for child in element.children:
        node = ["#text", False, False, f"{zlib.crc32(child.encode()):08x}"] if isinstance(child, str) else wrapper(child)
        if children and children[-1][0] == node[0]:
            children[-1] = align(children[-1], node)
            children[-1][2] = True
        else:
            children.append(node)
    return [element.kind, False, False, children]


def align(a: list, b: list) -> list:
    """One wrapper for what either of two wrappers of one kind stands for."""
    optional, repeated = a[1] or b[1], a[2] or b[2]
    if a[0] == "#text":
        return [a[0], optional, repeated, a[3] if a[3] == b[3] else SLOT]
    x, y = a[3], b[3]
    if [n[0] for n in x] == [n[0] for n in y]:
        return [a[0], optional, repeated, [align(p, q) for p, q in zip(x, y)]]
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            same = longest[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else 0
            longest[i][j] = max(same, longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0] and longest[i][j] == longest[i + 1][j + 1] + 1:
            node, i, j = align(x[i], y[j]), i + 1, j + 1
        elif j == len(y) or (i < len(x) and longest[i + 1][j] >= longest[i][j + 1]):
            node, i = [x[i][0], True, *x[i][2:]], i + 1
        else:
            node, j = [y[j][0], True, *y[j][2:]], j + 1
        if out and out[-1][0] == node[0]:
            node = align(out[-1], node)
            node[2] = True
            out[-1] = node
        else:
            out.append(node)
    return [a[0], optional, repeated, out]


def _has_slot(node: list) -> bool:
    return node[3] == SLOT if node[0] == "#text" else node[2] or any(map(_has_slot, node[3]))


def article_kinds(node: list, single: bool = False) -> list[str]:
    """Kinds of the outermost article or main elements of a wrapper that hold a slot (or anything, for a single page)."""
    name = node[0].split(".")[0]
    if name in ("article", "main") and (single or _has_slot(node)):
        return [node[0]]
    if node[0] == "#text":
        return []
    return sorted({k for child in node[3] for k in article_kinds(child, single)})


def unchanging(node: list) -> list[str]:
    """Checksums of the texts that are the same on all pages of a wrapper."""
    if node[0] == "#text":
        return [] if node[3] == SLOT or node[1] else [node[3]]
    return sorted({t for child in node[3] for t in unchanging(child)})


def rules_of(node: list, pages: int) -> dict:
    """What extraction needs of a wrapper: article kinds, else the texts to leave out."""
    kinds = article_kinds(node, single=pages < LEAST_PAGES)
    return {"articles": kinds, "fixed": [] if kinds or pages < LEAST_PAGES else unchanging(node)}


def _blocks(element: Element, fixed: frozenset[str], out: list[str]) -> None:
    """Texts of an element in page order, without what is left out. Elements nest as deep as the page says."""
    pending: list[Element | str] = [element]
    while pending:
        child = pending.pop()
        if isinstance(child, str):
            if not fixed or f"{zlib.crc32(child.encode()):08x}" not in fixed:
                out.append(child)
        elif not child.dropped:
            pending.extend(reversed(child.children))


def _articles(root: Element, kinds: set[str]) -> list[Element]:
    found, pending = [], [root]
    while pending:
        element = pending.pop()
        if element.dropped:
            continue
        if element.kind in kinds:
            found.append(element)
        else:
            pending.extend(c for c in reversed(element.children) if not isinstance(c, str))
    return found


def extract(source: str | None, rules: dict) -> str:
    """Main text of a page; empty for null, empty or textless pages."""
    root = parse(source or "")
    articles = _articles(root, set(rules["articles"]))
    fixed = frozenset(rules["fixed"])
    if not articles:
        own = rules_of(_flat(root), 1)
        articles = _articles(root, set(own["articles"]))
    out: list[str] = []
    for article in articles or [root]:
        for child in article.children if article is root else [article]:
            if isinstance(child, str):
                out.append(child)
            else:
                _blocks(child, fixed if not articles else frozenset(), out)
    return "\n".join(out)


MAX_DEPTH = 60


def _flat(root: Element) -> list:
    """The wrapper of a page; deeper elements than any layout has are moved up into their ancestor."""
    _limit_depth(root)
    return wrapper(root)


def _limit_depth(root: Element) -> None:
    pending = [(root, 0)]
    while pending:
        element, depth = pending.pop()
        if depth < MAX_DEPTH:
            pending.extend((c, depth + 1) for c in element.children if not isinstance(c, str))
            continue
        out: list[str] = []
        for child in element.children:
            _blocks(child, frozenset(), out) if not isinstance(child, str) else out.append(child)
        element.children = list(out)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) to one partial wrapper per host."""
    found: dict[str, tuple[list, int]] = {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            node = _flat(parse(source or ""))
            old = found.get(host)
            found[host] = (align(old[0], node), old[1] + 1) if old else (node, 1)
    yield _wrapper_rows(list(found), list(found.values()))


def _wrapper_rows(hosts: list[str], found: list[tuple[list, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hosts, pa.string()),
            pa.array([json.dumps(node) for node, _ in found], pa.string()),
            pa.array([pages for _, pages in found], pa.int64()),
        ],
        names=["host", "wrapper", "pages"],
    )


def _aligned(rows: DataFrame, *keys: str) -> DataFrame:
    """Align the partial wrappers of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[list, int]] = {}
        for batch in batches:
            for host, text, pages, *salt in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                node, key = json.loads(text), (host, *salt)
                old = found.get(key)
                found[key] = (align(old[0], node), old[1] + pages) if old else (node, pages)
        yield _wrapper_rows([key[0] for key in found], list(found.values()))

    columns = ["host", "wrapper", "pages", *(k for k in keys if k != "host")]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "wrapper")
    return dealt.select(*columns).mapInArrow(run, "host string, wrapper string, pages long")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): one wrapper, as JSON, for every host of ``pages`` (host, html)."""
    parts = pages.select("host", "html").mapInArrow(_partial, "host string, wrapper string, pages long")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return _aligned(_aligned(salted, "host", "salt"), "host")


def host_rules(wrappers: DataFrame) -> DataFrame:
    """(host, rules): what extraction needs of each wrapper, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(rules_of(json.loads(w), n)) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], names=["host", "rules"])

    return wrappers.select("host", "wrapper", "pages").mapInArrow(run, "host string, rules string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null url belongs to the host ''. A null or empty html, and one without
    article text, gives an empty text. Rows stay as they are, repeated ones too;
    other columns are dropped.
    """
    named = pages.select("page_id", "url", "html", host_of(after_scheme(F.col("url"))).alias("host"))
    rules = stored(host_rules(infer_wrappers(named)), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text not in known:
                    known[text] = json.loads(text)
                texts.append(extract(source, known[text]))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    joined = named.join(rules, "host").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "rules")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
