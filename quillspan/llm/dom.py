"""A small tolerant DOM, simple tree matching, and the extraction of text blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph, and those that end an open element of the same kind.
_ENDS_P = BLOCK - {"html", "head", "body"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)
    text: str = ""
    shape: int = 0
    size: int = 1


def parse(page: str) -> Node:
    """Never fails: unknown end tags are skipped, open elements end with the page, elements nest as deep as they come."""
    root = Node("#root")
    stack = [root]
    # Numbers of open elements by tag, so that a deep stack isn't searched for one that isn't open.
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            t = m.group(0)
            if t[0] != "<" or t == "<":
                stack[-1].children.append(Node("#text", text=t))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "article", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "body", "html", "main", "div", "section"):
                    break
            continue
        if tag in _ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _SAME and (opened[tag] or (tag in ("dt", "dd", "td", "th") and (opened["dt"] or opened["dd"] or opened["td"] or opened["th"]))):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[i].tag in ("td", "th")):
                    close(i)
                    break
                if stack[i].tag in _SAME[tag]:
                    break
        raw = m.group(3)
        node = Node(tag, {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and raw != "/" else {})
        stack[-1].children.append(node)
        if tag in VOID or (raw.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            node.text = page[at : end.start() if end else n]
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def prepare(root: Node) -> list[Node]:
    """Drops blank text nodes, sets shapes (equal for subtrees of the same tags) and sizes; all nodes in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if c.tag != "#text" or not c.text.isspace()]
        stack.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum([c.size for c in node.children])
        node.shape = hash((node.tag, *[c.shape for c in node.children]))
    return order


def match_trees(a: Node, b: Node, budget: int = 250_000) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest set of pairs of nodes of one tag that keeps parents and order.

    Children alike at the front and the back are paired at once. Where two lists need more than `budget` cells, rows are kept in place of the table and the lists
    are halved until the table fits (Hirschberg): as large a set, in linear memory and twice the time. Scores depend on shapes alone and are kept by shapes.
    """
    memo: dict[tuple[int, int], int] = {}

    def middle(x: Node, y: Node) -> tuple[int, int, int]:
        p, q = x.children, y.children
        m, n, i, j = len(p), len(q), 0, 0
        while i < min(m, n) and p[i].shape == q[i].shape:
            i += 1
        while j < min(m, n) - i and p[m - 1 - j].shape == q[n - 1 - j].shape:
            j += 1
        return i, m - j, n - j

    def known(x: Node, y: Node) -> int:
        return x.size if x.shape == y.shape else memo[x.shape, y.shape] if x.tag == y.tag else 0

    def table(p: list[Node], q: list[Node]) -> list[list[int]]:
        t = [[0] * (len(q) + 1)]
        for x in p:
            above, row = t[-1], [0]
            for j, y in enumerate(q):
                best = above[j + 1] if above[j + 1] >= row[j] else row[j]
                if x.tag == y.tag:
                    w = above[j] + (x.size if x.shape == y.shape else memo[x.shape, y.shape])
                    if w > best:
                        best = w
                row.append(best)
            t.append(row)
        return t

    def last_row(p: list[Node], q: list[Node]) -> np.ndarray:
        """The last row of table(p, q)."""
        kinds = {y.shape: y for y in q}
        place = {k: i for i, k in enumerate(kinds)}
        codes = np.array([place[y.shape] for y in q])
        t = np.zeros(len(q) + 1, np.int64)
        rows: dict[int, np.ndarray] = {}
        for x in p:
            if x.shape not in rows:
                if len(rows) >= 64:
                    rows.clear()
                rows[x.shape] = np.array([known(x, y) for y in kinds.values()], np.int64)[codes]
            t[1:] = np.maximum.accumulate(np.maximum(t[1:], t[:-1] + rows[x.shape]))
        return t

    def align(p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        if not p or not q:
            return []
        if len(p) * len(q) > budget:
            if len(p) == 1:
                y = max(q, key=lambda y: known(p[0], y))
                return [(p[0], y)] if known(p[0], y) else []
            half = len(p) // 2
            cut = int(np.argmax(last_row(p[:half], q) + last_row(p[half:][::-1], q[::-1])[::-1]))
            return align(p[:half], q[:cut]) + align(p[half:], q[cut:])
        t, r, c, found = table(p, q), len(p), len(q), []
        while r and c:
            if t[r][c] == t[r - 1][c]:
                r -= 1
            elif t[r][c] == t[r][c - 1]:
                c -= 1
            else:
                r, c = r - 1, c - 1
                found.append((p[r], q[c]))
        return found[::-1]

    def score(a: Node, b: Node) -> None:
        """Fills memo for a, b and all pairs below them that may be asked for; a pair waits on the stack until those below it are known."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if x.shape == y.shape or (x.shape, y.shape) in memo:
                stack.pop()
                continue
            i, m, n = middle(x, y)
            p, q = x.children[i:m], y.children[i:n]
            if p and q:
                right = {v.shape: v for v in q}
                lacking = [(u, v) for u in {u.shape: u for u in p}.values() for v in right.values() if u.tag == v.tag and u.shape != v.shape and (u.shape, v.shape) not in memo]
                if lacking:
                    stack.extend(lacking)
                    continue
            stack.pop()
            same = sum([c.size for c in x.children[:i]]) + sum([c.size for c in x.children[m:]])
            memo[x.shape, y.shape] = 1 + same + ((table(p, q)[-1][-1] if len(p) * len(q) <= budget else int(last_row(p, q)[-1])) if p and q else 0)

    if a.tag != b.tag:
        return []
    score(a, b)
    pairs: list[tuple[Node, Node]] = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        i, m, n = middle(x, y)
        below = [*zip(x.children[:i], y.children[:i]), *align(x.children[i:m], y.children[i:n]), *zip(x.children[m:], y.children[n:])]
        stack.extend(reversed(below))
    return pairs


#: Elements that never hold main text, and names in class, id or role that mark such parts.
NOT_TEXT = frozenset("script style noscript template iframe object svg canvas nav footer aside form button select option input textarea label menu dialog head title audio video".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menus?|sidebar|footer|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|subscription"
    r"|social|share|sharing|related|recommend\w*|comments?|disqus|respond|replies|pagination|pager|toolbar|widgets?|skip|login|signup|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Words of a class that tell what else is on the page, and names of parts that are never taken for a wrapper of the main text, however long they are.
_STATES = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without)[_-]\S*", re.I)
_NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|breadcrumbs?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|comments?|disqus|respond|replies|pagination|pager|login|signup)(?:$|[\s_-])", re.I)
_HEADERS = re.compile(r"^(?:(?:site|page|top|main)[_-]?)?header$", re.I)
#: Elements that are read where a page has no other text: some pages lie in one form.
_AT_LAST = frozenset("form aside header dialog label".split())
#: Share of the text outside links that article and main elements must hold, or else the whole page is read.
MAIN_SHARE = 0.75


def _names(node: Node) -> list[str]:
    return [_STATES.sub("", node.attributes[k]) for k in ("class", "id", "role") if k in node.attributes]


def _marked(node: Node, inside: bool) -> bool:
    if not node.attributes or node.tag in ("body", "html", "main"):
        return False
    names = _names(node)
    return any(_MARKS.search(v) for v in names) or (not inside and any(_HEADERS.match(w) for v in names for w in v.split()))


def _unread(node: Node, inside: bool) -> bool:
    return node.tag in NOT_TEXT or (node.tag == "header" and not inside)


def excluded(node: Node, inside: bool) -> bool:
    """inside: below an article or main element, where a header belongs to the text."""
    return _unread(node, inside) or _marked(node, inside)


def _role(node: Node) -> str:
    return "main" if node.attributes.get("role") == "main" else node.tag


def content(root: Node, template: set[int]) -> tuple[list[Node], set[int]]:
    """The elements to read, and the ids of those below them that their names don't exclude.

    A main element is read whatever its wrappers are called. Where no article or main lies outside marked parts, a marked element is a wrapper if it has no less text
    than lies outside all marked ones. The outermost article and main elements are read if they hold most of the text, or else the whole page. Text in links and in
    template doesn't count.
    """
    found: list[tuple[Node, int, bool]] = [(root, -1, False)]
    marked: list[int] = []
    amount, main = [0], [False]
    stack = [(root, 0, False, False)]
    while stack:
        node, at, inside, link = stack.pop()
        for c in node.children:
            if id(c) in template:
                continue
            if c.tag == "#text":
                amount[at] += 0 if link else len("".join(c.text.split()))
            elif not _unread(c, inside):
                i = len(found)
                found.append((c, at, inside))
                amount.append(0)
                main.append(_role(c) == "main")
                if _marked(c, inside):
                    marked.append(i)
                stack.append((c, i, inside or _role(c) in ("article", "main"), link or c.tag == "a"))
    own = amount[:]
    for i in range(len(found) - 1, 0, -1):
        amount[found[i][1]] += amount[i]
        main[found[i][1]] |= main[i]

    def outermost(kept: set[int]) -> tuple[list[int], int]:
        """Article and main elements outside marked parts, and the text outside those."""
        gone, below, roots, text = [False] * len(found), [False] * len(found), [], 0
        for i in range(len(found)):
            node, up, _ = found[i]
            gone[i] = (up >= 0 and gone[up]) or (i in names and i not in kept)
            below[i] = up >= 0 and (below[up] or (_role(found[up][0]) in ("article", "main")))
            if not gone[i]:
                text += own[i]
                if not below[i] and _role(node) in ("article", "main"):
                    roots.append(i)
        return roots, text

    def held(kept: set[int], roots: list[int]) -> int:
        top, text = set(roots), 0
        gone, inner = [False] * len(found), [False] * len(found)
        for i in range(len(found)):
            up = found[i][1]
            gone[i] = (up >= 0 and gone[up]) or (i in names and i not in kept)
            inner[i] = i in top or (up >= 0 and inner[up])
            text += own[i] if inner[i] and not gone[i] else 0
        return text

    names = set(marked)
    kept = {i for i in marked if main[i]}
    roots, text = outermost(kept)
    if not roots:
        kept |= {i for i in marked if amount[i] and amount[i] >= text and not any(_NEVER.search(v) for v in _names(found[i][0]))}
        roots, text = outermost(kept)
    whole = not roots or held(kept, roots) < MAIN_SHARE * text
    # The stack above goes through siblings from the last; reading goes in page order.
    order = {id(found[i][0]) for i in roots}
    return [root] if whole else _in_order(root, order), {id(found[i][0]) for i in kept}


def _in_order(root: Node, wanted: set[int]) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            out.append(node)
        else:
            stack.extend(reversed(node.children))
    return out


#: Elements that may be the root of the content slots; the share of the varying text that it must hold.
CONTAINERS = frozenset("article body center div html main section table tbody td tr #root".split())
VARYING_SHARE = 0.9


def varying(root: Node, owner: dict[int, int], same: set[int]) -> Counter[int]:
    """Letters of a page's text outside links and excluded parts, under the number that owner gives the node or the nearest element above it; without the nodes in same."""
    found: Counter[int] = Counter()
    stack = [(root, 0, False)]
    while stack:
        node, at, inside = stack.pop()
        for c in node.children:
            own = owner.get(id(c), at)
            if c.tag == "#text":
                if id(c) not in same:
                    found[own] += len("".join(c.text.split()))
            elif c.tag != "a" and not excluded(c, inside):
                stack.append((c, own, inside or _role(c) in ("article", "main")))
    return found


def content_root(nodes: list[Node], amounts: dict[int, float]) -> int | None:
    """The number of the innermost container of an exemplar that holds most of its group's varying text, and any main heading that varies; None if there is none.

    nodes are in page order; amounts tells the varying text under each number.
    """
    number = {id(n): i for i, n in enumerate(nodes)}
    up = {number[id(c)]: i for i, n in enumerate(nodes) for c in n.children}
    total = [amounts.get(i, 0.0) for i in range(len(nodes))]
    for i in range(len(nodes) - 1, 0, -1):
        total[up[i]] += total[i]
    if not nodes or total[0] <= 0:
        return None
    headings = [i for i, n in enumerate(nodes) if n.tag == "h1" and total[i] > 0]
    at, best = 0, None
    while at is not None:
        if nodes[at].tag in CONTAINERS:
            best = at
        below = [number[id(c)] for c in nodes[at].children]
        at = next((i for i in below if total[i] >= VARYING_SHARE * total[0]), None)
    while best and any(not _above(best, h, up) for h in headings):
        best = up[best]
    return best or None


def _above(top: int, at: int, up: dict[int, int]) -> bool:
    while at > top:
        at = up[at]
    return at == top


def _slot(root: Node, chosen: Node, template: set[int]) -> set[int] | None:
    """The ids of chosen and of what it lies in, if chosen holds most of the page's text outside links, excluded parts and template; their names don't exclude these."""
    path: list[Node] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, left = stack.pop()
        if left:
            path.pop()
            continue
        path.append(node)
        if node is chosen:
            break
        stack.append((node, True))
        stack.extend((c, False) for c in node.children if c.children)
    kept = {id(n) for n in path}
    held = everything = 0
    todo = [(root, False, False)]
    while todo:
        node, inside, within = todo.pop()
        for c in node.children:
            if id(c) in template:
                continue
            if c.tag == "#text":
                n = len("".join(c.text.split()))
                everything += n
                held += n if within else 0
            elif c.tag != "a" and (id(c) in kept or not excluded(c, inside)):
                todo.append((c, inside or within or _role(c) in ("article", "main"), within or c is chosen))
    return kept if held and held >= MAIN_SHARE * everything else None


def blocks(root: Node, template: set[int], chosen: Node | None = None) -> list[str]:
    """Texts of the content's blocks in page order, without excluded parts and the nodes whose id() is in template.

    chosen is the page's node for the wrapper's content, which is read if it holds most of the page's text; if there is none or it doesn't, elements and names tell
    what is read. Where nothing is left, parts that only their names exclude are read, and where there are none, forms, asides and headers.
    """
    kept = _slot(root, chosen, template) if chosen is not None else None
    if kept is not None:
        found = _read([chosen], template, lambda c, inside: id(c) not in kept and _marked(c, inside) or _unread(c, inside), True)
        if found:
            return found
    roots, kept = content(root, template)
    return _read(roots, template, lambda c, inside: id(c) not in kept and _marked(c, inside) or _unread(c, inside)) or _read([root], template, _unread) or _read([root], template, lambda c, _: c.tag in NOT_TEXT and c.tag not in _AT_LAST)


def _read(roots: list[Node], template: set[int], skip: Callable[[Node, bool], bool], inner: bool = False) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(line)

    for r in roots:
        stack = [(iter(r.children), (inner and r.tag not in ("body", "html")) or _role(r) in ("article", "main"), True)]
        while stack:
            rest, inside, block = stack[-1]
            for c in rest:
                if id(c) in template:
                    continue
                if c.tag == "#text":
                    parts.append(html.unescape(c.text))
                elif c.tag in ("br", "wbr"):
                    parts.append(" " if c.tag == "br" else "")
                elif not skip(c, inside):
                    if c.tag in BLOCK:
                        flush()
                    stack.append((iter(c.children), inside or _role(c) in ("article", "main"), c.tag in BLOCK))
                    break
            else:
                stack.pop()
                if block:
                    flush()
    return out
