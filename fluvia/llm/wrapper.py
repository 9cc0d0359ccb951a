"""Main-text extraction by wrapper induction.

A page is parsed into a tree of its elements.  Trees of pages of one host are aligned by simple tree matching:
the largest order-keeping match of equal nodes, level by level, in which nodes of equal texts go first.  The host's
wrapper is the union of its aligned trees: siblings of constant texts stay nodes of their own, siblings of one label
in which all texts vary are folded into one.  In it, a text that is the same on all pages of a host, while
the pages' main parts differ, is template, whatever its element is called; a text that varies is a slot.

The wrapper's content region is found from the page down: the element, once on a page at most, that holds ``REGION`` of the
host's varying text, in it the next one, until one has varying headings or paragraphs of its own; slots outside it are not content, whatever they are called.  Inside it, or on a page or host without one, names tell
what alignment cannot: a slot in an element that is named as menu, header, footer, sidebar, notice, advert, form or reader
comments is furniture, and the innermost elements named as the main part are the region, unless the wrapper's region lies in an
element so named, which then holds nearly all varying text (``HULL``).  A page's text is what its content slots hold, in page
order.  A host of too few pages for a wrapper goes by names alone.

Wrappers are induced from all pages, from all their elements and at any depth: steps that call each other run on a stack of
their own.  A task folds its pages into one wrapper a host as it reads them, small ones together before a large one; wrappers of
a host are merged by twos in salted groups, so a host of any share of the rows takes no task of its own,
and a wrapper's size depends on the host's layouts and on the texts that its pages agree on, not on its pages.

Defined cases: null or empty html gives an empty text; a page without a host belongs to the host of the empty
name; a host with fewer than ``LEAST_PAGES`` different main texts has no wrapper; rows with equal ids are rows of their own; unclosed and stray tags are
closed and ignored as browsers do; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter, deque
from collections.abc import Generator, Iterable, Iterator, Sequence
from html import unescape
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import per_batch, per_task, stored

#: Different main texts that a host must show before a constant text counts as template.
LEAST_PAGES = 5
#: Wrappers are sent to all executors up to this many bytes in all; beyond it pages are shuffled to them.
SENT_BYTES = 32 << 20
SALTS = 32
#: Shares of a host's varying text from which an element holds the content region: one without, and one with a name of furniture.
REGION, HULL = 0.8, 0.9
#: Pairs of siblings up to which a match takes one table; more of them are halved first, to the same largest match.
MATCHED = 1 << 16
#: Hosts whose wrappers a task holds at once, while it folds pages and while it reads them.
HELD_HOSTS = 500
#: Nodes from which a wrapper is not gone through for every page of less than half its nodes: such pages are folded together first.
FOLDED = 1000
#: An equal text outweighs any number of equal labels in an alignment.
EQUAL = 1 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ADDRESS = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)")

# Element names of HTML by their role: fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("br td th tr tbody thead tfoot caption option legend summary body html head title".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th tbody thead tfoot", ("table",)), "tfoot": ("tr td th tbody thead tfoot", ("table",)),
}
_FURNITURE_TAGS = frozenset("nav aside footer form button select input textarea label fieldset dialog menu head script style noscript template iframe svg math object canvas audio video title".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar header masthead footer sidebar side rail aside widget widgets"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond disqus replies reply"
    " share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar skip copyright legal disclaimer form search".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies reply".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
_MAIN_WORDS = frozenset("article post entry content main story body text".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def host_of(url: str | None) -> str:
    found = _ADDRESS.match(url or "")
    return found[1].lower() if found else ""


class Node:
    """An element: name, label (name and class words), kind of furniture, children and texts in order."""

    __slots__ = ("tag", "label", "furniture", "main", "items")

    def __init__(self, tag: str, label: str, furniture: bool, main: bool):
        self.tag, self.label, self.furniture, self.main = tag, label, furniture, main
        self.items: list[Node | str] = []


_labels: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, furniture, main) of a start tag."""
    got = _labels.get((tag, attributes))
    if got is not None:
        return got
    named = {k.lower(): unescape((v or "").strip("\"'")) for k, v in _NAMES.findall(attributes)} if attributes.strip() else {}
    words = [w.lower() for key in ("class", "id") for w in _WORD.findall(named.get(key, ""))]
    hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or named.get("role", "").lower() in ("main", "article")
    furniture = tag in _FURNITURE_TAGS or hidden or named.get("role", "").lower() in _FURNITURE_ROLES
    if not furniture and tag not in ("html", "body", "main", "p", "h1"):
        furniture = bool(_FURNITURE_WORDS & set(words)) and not (_MAIN_WORDS & set(words) and "comment" not in words and "comments" not in words and tag in ("article", "section", "div"))
    classes = " ".join(sorted(c for c in named.get("class", "").split() if not any(map(str.isdigit, c))))
    got = f"{tag}.{classes}" if classes else tag, furniture, main
    if len(_labels) > 20_000:
        _labels.clear()
    if len(attributes) < 500:
        _labels[(tag, attributes)] = got
    return got


def parse(html: str) -> Node:
    """The page's tree. Texts are kept as they stand, character references decoded."""
    root = Node("#page", "#page", False, False)
    stack = [root]
    at, n = 0, len(html)
    for token in _TOKEN.finditer(html):
        begin = token.start()
        if begin < at:
            continue
        if begin > at:
            stack[-1].items.append(unescape(html[at:begin]) if "&" in html[at:begin] else html[at:begin])
        at = token.end()
        slash, tag, attributes = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "table", "td", "th", "section") and tag not in _BLOCK:
                    break
            continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            ended, inside = _CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in inside:
                    break
                if stack[depth].tag in ended.split():
                    del stack[depth:]
                    break
        node = Node(tag, *_label(tag, attributes))
        stack[-1].items.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else (n if tag in ("script", "style", "template", "svg", "math", "iframe", "noscript") else at)
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    if at < n:
        rest = html[at:n]
        stack[-1].items.append(unescape(rest) if "&" in rest else rest)
    return root


# A wrapper node is a list: label, digest of its own text ("" none yet, None varying), furniture, children, up to LEAST_PAGES
# digests of main texts of pages that have it, the characters of its own text on all pages, how often it stands on them, and
# whether no text in its subtree is constant.
_LABEL, _TEXT, _FURNITURE, _CHILDREN, _PAGES, _CHARS, _COUNT, _VARIES = range(8)


def _digest(text: str) -> str:
    return xxhash.xxh64_hexdigest(text)


def _inline(node: Node) -> list[Node]:
    """The node and its descendants within the same block."""
    out, todo = [], [node]
    while todo:
        out.append(todo.pop())
        todo += [x for x in out[-1].items if isinstance(x, Node) and x.tag not in _BLOCK and not x.furniture]
    return out


def _own_text(node: Node) -> str:
    """A block's text without blocks inside; an inline element has none of its own."""
    if node.tag not in _BLOCK:
        return ""
    return " ".join(x for part in _inline(node) for x in part.items if isinstance(x, str) and not x.isspace())


def _region(root: Node) -> list[Node]:
    """Main elements outside furniture; else the page itself."""
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        if node.main:
            found.append(node)
            continue
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    if len(found) > 1 and any(x.tag == "main" for x in found):
        found = [x for x in found if x.tag == "main"] or found
    return found or [root]


def _pieces(nodes: list[Node], keep) -> str:
    """Text of the nodes outside furniture, blocks parted by one space; ``keep(node)`` decides on own texts."""
    out: list[str] = []
    # An explicit stack: pages may nest deeper than Python recurses.
    # A header heads the page, or else the article that it stands in.
    headed = nodes[0].tag != "#page"
    stack: list = [(x, True) for x in reversed(nodes)]
    while stack:
        item, begins = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if not begins:
            out.append(" ")
            continue
        if item.furniture or item.tag == "header" and not headed:
            out.append(" ")
            continue
        if item.tag in _BLOCK:
            out.append(" ")
            stack.append((item, False))
        kept = keep(item)
        for x in reversed(item.items):
            if isinstance(x, Node):
                stack.append((x, True))
            elif kept:
                stack.append((x, True))
    return " ".join("".join(out).split())


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node))


def _page_wrapper(root: Node) -> list:
    """The wrapper of one page."""
    # Pages differ in what the names call main, or in their longest block where the names err.
    longest = max((_own_text(x) for x in _nodes(root)), key=len)
    return _outline(root, _digest(_pieces(_region(root), lambda _: True) + "\n" + longest), {})


def _outline(root: Node, page: str, origin: dict[int, Node]) -> list:
    """The page's nodes as wrapper nodes, without what holds no text; ``origin`` gets their elements by id."""

    def made(node: Node) -> list:
        own = _own_text(node)
        new = [node.label, _digest(own) if own else "", node.furniture, [], [page], len(own), 1, False]
        origin[id(new)] = node
        return new

    top = made(root)
    order = [top]
    todo = deque([(root, top)])
    while todo:
        node, own = todo.pop()
        for x in node.items:
            if isinstance(x, Node):
                new = made(x)
                own[_CHILDREN].append(new)
                order.append(new)
                todo.appendleft((x, new))
    for own in reversed(order):
        own[_CHILDREN] = [c for c in own[_CHILDREN] if c[_TEXT] != "" or c[_CHILDREN]]
        own[_VARIES] = _all_vary(own)
    return top


def _packed(wrapper: list) -> str:
    """The wrapper as JSON of one row a node, parents first, with numbers of children: no nesting, whatever its depth."""
    rows, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        rows.append([*node[:_CHILDREN], len(node[_CHILDREN]), *node[_CHILDREN + 1 :]])
        todo += reversed(node[_CHILDREN])
    return json.dumps(rows)


def _unpacked(data: str) -> list:
    done: list[list] = []
    for node in reversed(json.loads(data)):
        node[_CHILDREN] = [done.pop() for _ in range(node[_CHILDREN])]
        done.append(node)
    return done[0]


Steps = Generator["Steps", Any, Any]


def _run(steps: Steps) -> Any:
    """The result of steps that yield the steps whose results they need: pages may nest deeper than Python recurses."""
    stack, value = [steps], None
    while stack:
        try:
            asked = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(asked)
            value = None
    return value


def _fold(into: list, other: list) -> None:
    """Join the texts and pages of matched nodes."""
    a, b = into[_TEXT], other[_TEXT]
    if a != b:
        into[_TEXT] = b if a == "" else a if b == "" else None
    into[_CHARS] += other[_CHARS]
    into[_COUNT] += other[_COUNT]
    if len(into[_PAGES]) < LEAST_PAGES:
        into[_PAGES] = sorted({*into[_PAGES], *other[_PAGES]})[:LEAST_PAGES]


def matched(a: list[list], b: list[list], sizes: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of siblings: the order-keeping pairs of equal labels of largest total size.

    ``sizes`` keeps the sizes of subtree matches, so each pair of nodes is matched once.
    """
    return _run(_matching(a, b, {} if sizes is None else sizes))


def _matching(a: list[list], b: list[list], sizes: dict[tuple[int, int], int]) -> Steps:
    labels = [x[_LABEL] for x in a]
    if labels == [x[_LABEL] for x in b] and len(set(labels)) == len(labels):
        return [(i, i) for i in range(len(a))]
    # Equal leaves at either end belong to a largest match.
    first, last = 0, 0
    while first < min(len(a), len(b)) and _same_leaf(a[first], b[first]):
        first += 1
    while last < min(len(a), len(b)) - first and _same_leaf(a[-1 - last], b[-1 - last]):
        last += 1
    n, m = len(a) - last, len(b) - last
    x, y = a[first:n], b[first:m]
    rows, columns = _needed(x, y), _needed(y, x)
    between = yield (_matching_long if len(rows) * len(columns) > MATCHED else _matching_table)([x[i] for i in rows], [y[j] for j in columns], sizes)
    return [(i, i) for i in range(first)] + [(first + rows[i], first + columns[j]) for i, j in between] + [(n + k, m + k) for k in range(last)]


def _needed(nodes: list[list], others: list[list]) -> Sequence[int]:
    """Places of siblings that suffice for a largest match: of leaves in a row that differ in nothing that the others have, as many as there are others."""
    if len(nodes) <= 4 * len(others):
        return range(len(nodes))
    texts = {x[_TEXT] for x in others if x[_TEXT]}
    needed, before, run = [], None, 0
    for i, x in enumerate(nodes):
        plain = None if x[_CHILDREN] or x[_TEXT] in texts else x[_LABEL]
        run = run + 1 if plain == before else 1
        before = plain
        if plain is None or run <= len(others):
            needed.append(i)
    return needed


def _matching_table(a: list[list], b: list[list], sizes: dict[tuple[int, int], int]) -> Steps:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    taken = [[False] * m for _ in range(n)]
    for i in range(n - 1, -1, -1):
        x, row, below = a[i], best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            most = max(below[j], row[j + 1])
            if x[_LABEL] == b[j][_LABEL]:
                size = _known(x, b[j], sizes)
                if size is None:
                    size = yield _sizing(x, b[j], sizes)
                if below[j + 1] + size >= most:
                    most = below[j + 1] + size
                    taken[i][j] = True
            row[j] = most
    out = []
    i = j = 0
    while i < n and j < m:
        if taken[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _matching_long(a: list[list], b: list[list], _: dict[tuple[int, int], int]) -> Steps:
    """The largest match of many siblings in the memory of one row: both lists are halved where a largest match may be parted.

    Texts that only one side has equal nothing, so siblings that differ in them alone have one form and are compared once.
    """
    shared = _texts(a) & _texts(b)
    interned: dict[tuple, list] = {}
    sizes: dict[tuple[int, int], int] = {}
    x, y = _interned(a, shared, interned), _interned(b, shared, interned)
    forms_x, forms_y = ({id(form): form for form in side}.values() for side in (x, y))
    texts = {id(form): _texts([form]) for form in (*forms_x, *forms_y)}
    count_x, count_y = (Counter(text for form in forms for text in texts[id(form)]) for forms in (forms_x, forms_y))
    # Forms without a rarer text in common match like their bare forms, which keep only the frequent texts.
    frequent = {text for text in shared if count_x[text] * count_y[text] > len(x) + len(y)}
    bare_x, bare_y = _interned(x, frequent, interned), _interned(y, frequent, interned)
    kinds = {id(form): form for form in bare_y}
    code = {key: k for k, key in enumerate(kinds)}
    codes = np.array([code[id(form)] for form in bare_y])
    bare: dict[int, np.ndarray] = {}
    for form in bare_x:
        if id(form) not in bare:
            bare[id(form)] = row = np.zeros(len(kinds), np.int64)
            for k, other in enumerate(kinds.values()):
                if form[_LABEL] == other[_LABEL]:
                    size = _known(form, other, sizes)
                    row[k] = (yield _sizing(form, other, sizes)) if size is None else size
                    sizes.pop((id(form), id(other)), None)
    places: dict[int, list[int]] = {}
    for j, form in enumerate(y):
        places.setdefault(id(form), []).append(j)
    having: dict[str, list[list]] = {}
    for form in forms_y:
        for text in texts[id(form)] - frequent:
            having.setdefault(text, []).append(form)
    # For each form of one side: where the other has a rarer text in common, and the size there.
    alike: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for form in forms_x:
        at: dict[int, int] = {}
        for other in {id(f): f for text in texts[id(form)] - frequent for f in having.get(text, ()) if f[_LABEL] == form[_LABEL]}.values():
            size = _known(form, other, sizes)
            size = (yield _sizing(form, other, sizes)) if size is None else size
            sizes.pop((id(form), id(other)), None)
            at.update(dict.fromkeys(places[id(other)], size))
        alike[id(form)] = np.array(sorted(at), np.int64), np.array([at[j] for j in sorted(at)], np.int64)

    def weights(i: int, begin: int, end: int) -> np.ndarray:
        row = bare[id(bare_x[i])][codes[begin:end]]
        where, size = alike[id(x[i])]
        low, high = np.searchsorted(where, (begin, end))
        row[where[low:high] - begin] = size[low:high]
        return row

    def largest(rows: Iterable[int], begin: int, end: int, step: int) -> np.ndarray:
        """Sizes of the largest matches of all rows with the first 0, 1, 2 ... siblings in the direction of ``step``."""
        best = np.zeros(end - begin + 1, np.int64)
        for i in rows:
            np.maximum(best[1:], best[:-1] + weights(i, begin, end)[::step], out=best[1:])
            np.maximum.accumulate(best, out=best)
        return best

    out, windows = [], [(0, len(x), 0, len(y))]
    while windows:
        i, n, j, m = windows.pop()
        # Equal forms at either end belong to a largest match.
        while i < n and j < m and x[i] is y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] is y[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if n - i > 1 and (n - i) * (m - j) > MATCHED:
            half = (i + n) // 2
            cut = j + int(np.argmax(largest(range(i, half), j, m, 1) + largest(range(n - 1, half - 1, -1), j, m, -1)[::-1]))
            windows += [(i, half, j, cut), (half, n, cut, m)]
        elif i < n and j < m:
            out += [(i + p, j + q) for p, q in (yield _matching_table(x[i:n], y[j:m], sizes))]
    return sorted(out)


def _texts(nodes: list[list]) -> set[str]:
    """The constant texts in the nodes' subtrees."""
    order = list(nodes)
    for node in order:
        order += node[_CHILDREN]
    return {node[_TEXT] for node in order if node[_TEXT]}


def _interned(nodes: list[list], texts: set[str], interned: dict[tuple, list]) -> list[list]:
    """The nodes without all but the given texts, one list for all that are equal then."""
    order = list(nodes)
    for node in order:
        order += node[_CHILDREN]
    forms: dict[int, list] = {}
    for node in reversed(order):
        if id(node) not in forms:
            children = [forms[id(c)] for c in node[_CHILDREN]]
            text = node[_TEXT] if node[_TEXT] in texts else ""
            forms[id(node)] = interned.setdefault((node[_LABEL], text, *map(id, children)), [node[_LABEL], text, False, children])
    return [forms[id(x)] for x in nodes]


def _same_leaf(a: list, b: list) -> bool:
    return bool(a[_TEXT]) and a[_TEXT] == b[_TEXT] and a[_LABEL] == b[_LABEL] and not a[_CHILDREN] and not b[_CHILDREN]


def _known(a: list, b: list, sizes: dict[tuple[int, int], int]) -> int | None:
    """Nodes of the subtrees' match, equal texts weighted, if it needs no matching or has had it."""
    if not a[_CHILDREN] or not b[_CHILDREN]:
        return 1 + EQUAL if a[_TEXT] and a[_TEXT] == b[_TEXT] else 1
    return sizes.get((id(a), id(b)))


def _sizing(a: list, b: list, sizes: dict[tuple[int, int], int]) -> Steps:
    total = 1 + EQUAL if a[_TEXT] and a[_TEXT] == b[_TEXT] else 1
    x, y = a[_CHILDREN], b[_CHILDREN]
    for i, j in (yield _matching(x, y, sizes)):
        size = _known(x[i], y[j], sizes)
        total += (yield _sizing(x[i], y[j], sizes)) if size is None else size
    sizes[id(a), id(b)] = total
    return total


def _size(a: list, b: list, sizes: dict[tuple[int, int], int]) -> int:
    size = _known(a, b, sizes)
    return _run(_sizing(a, b, sizes)) if size is None else size


def _all_vary(node: list) -> bool:
    """Whether no text in the subtree is constant, as its children tell."""
    return not node[_TEXT] and all(c[_VARIES] for c in node[_CHILDREN])


def _varying(node: list) -> list:
    """The node with all its texts taken as varying."""
    todo = [node]
    while todo:
        own = todo.pop()
        if not own[_VARIES]:
            own[_TEXT] = own[_TEXT] and None
            own[_VARIES] = True
            todo += own[_CHILDREN]
    return node


def merged(a: list, b: list) -> list:
    """Union of two aligned wrappers of one host."""
    return _run(_merging(a, b, {}))


def _merging(a: list, b: list, sizes: dict[tuple[int, int], int]) -> Steps:
    _fold(a, b)
    x, y = a[_CHILDREN], b[_CHILDREN]
    if x or y:
        partner = dict((yield _matching(x, y, sizes)))
        both, lone, at = [], set(), 0
        for i, node in enumerate(x):
            j = partner.get(i)
            if j is None:
                lone.add(id(node))
            else:
                lone.update(map(id, y[at:j]))
                both += y[at:j]
                at = j + 1
                yield _merging(node, y[j], sizes)
            both.append(node)
        lone.update(map(id, y[at:]))
        a[_CHILDREN] = yield _slotting(both + y[at:], lone)
    a[_VARIES] = _all_vary(a)
    return a


def _slotting(nodes: list[list], lone: set[int]) -> Steps:
    """One slot a label for the siblings that vary; where there is one, siblings that only one side has belong to it."""
    slots: dict[str, list] = {}
    kept = []
    for node in nodes:
        label = node[_LABEL]
        if not node[_VARIES]:
            kept.append(node)
        elif label in slots:
            yield _merging(slots[label], node, {})
        else:
            slots[label] = node
            kept.append(node)
    out = []
    for node in kept:
        slot = slots.get(node[_LABEL], node)
        if slot is node or id(node) not in lone:
            out.append(node)
        else:
            yield _merging(slot, _varying(node), {})
    return out


def _content_path(wrapper: list) -> list[list]:
    """The wrapper's nodes from the page down to the content region."""
    order = [wrapper]
    for node in order:
        order.extend(node[_CHILDREN])
    varying: dict[int, int] = {}
    for node in reversed(order):
        varying[id(node)] = (node[_CHARS] if node[_TEXT] is None else 0) + sum(varying[id(c)] for c in node[_CHILDREN])
    whole, path = max(1, varying[id(wrapper)]), [wrapper]
    while True:
        # An element with headings or paragraphs of its own is no mere frame.
        if any(varying[id(c)] and c[_LABEL].split(".")[0] in _PROSE for c in path[-1][_CHILDREN]):
            return path
        fit = [c for c in path[-1][_CHILDREN] if c[_CHILDREN] and varying[id(c)] >= (HULL if c[_FURNITURE] else REGION) * whole and c[_COUNT] <= wrapper[_COUNT]]
        if not fit or fit[0][_FURNITURE] and _COMMENT_WORDS & set(map(str.lower, _WORD.findall(fit[0][_LABEL]))):
            return path
        path.append(fit[0])


def _settled(root: Node, wrapper: list | None, path: list[list] | None) -> tuple[set[int], list[Node]]:
    """(ids of the page's nodes whose own text is the host's template, nodes of the content region or none)."""
    out: set[int] = set()
    if wrapper is None or len(wrapper[_PAGES]) < LEAST_PAGES:
        return out, []
    origin: dict[int, Node] = {}
    sizes: dict[tuple[int, int], int] = {}
    top = _outline(root, "", origin)
    path = path or _content_path(wrapper)
    on_path = set(map(id, path))
    # The page and its body are no region.
    region = id(path[-1]) if path[-1][_LABEL].split(".")[0] not in ("#page", "html", "body") else 0
    content: set[int] = set()
    todo = [(top, wrapper)]
    while todo:
        node, own = todo.pop()
        if id(own) in on_path:
            origin[id(node)].furniture = False
        if id(own) == region:
            content.add(id(origin[id(node)]))
        if own[_TEXT] and own[_TEXT] == node[_TEXT] and len(own[_PAGES]) >= LEAST_PAGES:
            out.update(map(id, _inline(origin[id(node)])))
        x, y = node[_CHILDREN], own[_CHILDREN]
        partner = dict(matched(x, y, sizes))
        named: dict[str, list[list]] = {}
        for c in y:
            named.setdefault(c[_LABEL], []).append(c)
        for i, child in enumerate(x):
            # More siblings than the wrapper has go by the one most like them.
            alike = [y[partner[i]]] if i in partner else named.get(child[_LABEL])
            if alike:
                todo.append((child, max(alike, key=lambda c: _size(child, c, sizes))))
    return out, [x for x in _nodes(root) if id(x) in content]


def extract(html: str | None, wrapper: list | None = None, path: list[list] | None = None) -> str:
    """A page's main text under its host's wrapper; ``path`` is the wrapper's content path, if it is known."""
    if not html:
        return ""
    root = parse(html)
    template, region = _settled(root, wrapper, path)
    return _pieces(region or _region(root), lambda node: id(node) not in template)


class Folds:
    """Wrappers of one host's pages in their order, each large one more than twice as large as the next."""

    def __init__(self) -> None:
        self.parts: list[tuple[list, int]] = []

    def add(self, own: list) -> None:
        if self.parts and self.parts[-1][1] < FOLDED:
            own = merged(self.parts.pop()[0], own)
        self._push(own)
        while len(self.parts) > 1 and self.parts[-1][1] * 2 >= self.parts[-2][1]:
            self._join()

    def whole(self) -> list:
        while len(self.parts) > 1:
            self._join()
        return self.parts[0][0]

    def _join(self) -> None:
        own, _ = self.parts.pop()
        self._push(merged(self.parts.pop()[0], own))

    def _push(self, own: list) -> None:
        order = [own]
        for node in order:
            order += node[_CHILDREN]
        self.parts.append((own, len(order)))


def _induced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among a task's pages."""
    held: dict[str, Folds] = {}
    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                held.setdefault(host_of(url), Folds()).add(_page_wrapper(parse(html)))
                if len(held) >= HELD_HOSTS:
                    yield _wrapper_rows(held)
                    held = {}
    yield _wrapper_rows(held)


def _wrapper_rows(held: dict[str, Folds]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_packed(w.whole()) for w in held.values()], pa.string())], ["host", "wrapper"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbouring wrappers of one host; rows come in order of host."""
    host, own = None, None
    for batch in batches:
        for name, data in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if name == host:
                own = merged(own, _unpacked(data))
                continue
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([_packed(own)], pa.string())], ["host", "wrapper"])
            host, own = name, _unpacked(data)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([_packed(own)], pa.string())], ["host", "wrapper"])


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper of all hosts of ``url, html``: one row a host."""
    schema = "host string, wrapper string"
    parts = pages.select("url", "html").mapInArrow(per_task(_induced), schema)
    salted = parts.withColumn("salt", (F.rand(3) * SALTS).cast("int")).repartition("host", "salt").sortWithinPartitions("host").select("host", "wrapper")
    return stored(salted.mapInArrow(per_task(_joined), schema).repartition("host").sortWithinPartitions("host").mapInArrow(per_task(_joined), schema), "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page of ``page_id, url, html``."""
    wrappers = induce(pages)
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])
    held = wrappers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("bytes")).first()
    if held["bytes"] <= SENT_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        opened: dict[str, tuple[list, list[list]] | tuple[()]] = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                if len(opened) >= HELD_HOSTS:
                    opened.clear()
                if host not in opened:
                    own = _unpacked(sent.value[host]) if host in sent.value else None
                    opened[host] = (own, _content_path(own)) if own else ()
                out.append(extract(html, *opened[host]))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

        return rows.mapInArrow(per_batch(run), schema)
    # The host's name is taken the same way on both sides; a hot host is split over salts.
    hosts = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", _ADDRESS.pattern, 1), F.lit("")))).withColumn("salt", (F.rand(5) * SALTS).cast("int"))
    dealt = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("page", F.lit(False))
    # A wrapper heads the pages of its host and salt, so it is opened once for them, whatever its size.
    both = dealt.unionByName(hosts.withColumn("page", F.lit(True)), allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")

    def run_headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, opened = None, ()
        for batch in batches:
            out = []
            for host, salt, data, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper", "page", "html")), strict=True):
                if not page:
                    own = _unpacked(data)
                    head, opened = (host, salt), (own, _content_path(own))
                else:
                    out.append(extract(html, *(opened if head == (host, salt) else ())))
            if out:
                pages_only = batch.filter(batch.column("page"))
                yield pa.RecordBatch.from_arrays([pages_only.column("page_id"), pages_only.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(per_task(run_headed), schema)
