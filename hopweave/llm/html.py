"""HTML extraction by wrapper induction: pages of one host are aligned by simple tree matching.

Each page becomes a tree of elements. All pages of a host, whatever their outlines, are folded into one
wrapper: the wrapper's tree is aligned with the page's by simple tree matching (the largest matching of
nodes of equal tag that keeps order; equal classes, and blocks whose usual text is equal, weigh more), and
holds the nodes of either. Ids and words with digits are no part of a label. A node counts its pages, those
on which it has text of its own (inline elements are nodes themselves), and its most frequent texts, each
with a few hashes of different main texts that it came with. Wrappers fold two by two inside a partition
and then wrapper by wrapper (some tens at once, level by level) across partitions, so a host of any size is
never gathered, and all pages take part.

A text is template, and its node constant, where it is the node's text on at least SHARE of the pages on
which the node has any, is on at least LEAST of the wrapper's pages (INLINE for inline elements, whose
words could be a text's; one that is part of a word stays), and came with at least MIN_DISTINCT different main texts: what is equal on copies
of one article is no template. Counts are Misra-Gries ones of TEXTS texts, never too large and short by
little for a text that frequent. A wrapper over NODES nodes forgets those on fewer than half of LEAST of
its pages.

On extraction the page is aligned with its host's wrapper: text of constant nodes is template and goes, the
slots give the text. Alignment can't tell a menu or an advert that differs on every page from an article,
so names are a prior: a page is cut to its outermost articles and main elements, if it has any, and
elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms or
comments go as well. ``names=False`` leaves that out; then alignment alone decides. What share of the
removed text alignment finds depends on the pages: all of it where layouts have neutral names (as in the
tests), none in the synthetic ``pages`` table, whose menus, adverts and footers are drawn anew for each page
and all carry their names (0 of 2,500 pages of sf0.1 differ without wrappers).

Wrappers are small; they are broadcast while their total size is under BROADCAST_BYTES, else joined by host,
pages of a host being dealt to SALTS copies of its wrapper.

Defined cases: a null or empty html gives an empty text and n_chars 0; a null url counts as the host "";
null page_ids and repeated rows pass through and count as pages; an attribute whose quote is never closed
ends with its tag's first ">"; very long pages are parsed whole; of equally good alignments the first is
taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import dropped, stored

MIN_DISTINCT = 3
SHARE = 0.9
LEAST = 0.1
INLINE = 0.5
TEXTS = 8
NODES = 2_000
#: Nodes of the wrappers that a worker holds at once.
HELD = 200_000
#: What an equal usual text is worth in an alignment, in matched nodes.
SAME_TEXT = 2
BROADCAST_BYTES = 32_000_000
#: Copies of a wrapper in a join by host, and wrappers of a host folded in one call.
SALTS = 64
FOLDED = 32
#: Elements nested deeper are taken as their ancestor's; no text is lost.
MAX_DEPTH = 150

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S
)
#: One attribute after the other: its name, and its value in either kind of quotes or none.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'=/]")
_WORD = re.compile(r"[a-z0-9]+")
#: Element names of HTML by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
_AUTO = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg math canvas audio video button select option textarea input menu dialog title map frame frameset noframes applet datalist".split()
)
_UNSEEN = frozenset("head script style noscript template iframe object embed svg math canvas audio video title map frame frameset noframes applet".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
    "widget pagination pager search searchform login signup copyright skip".split()
)
#: Words that name no main text in whatever compound; the others count if every further word says only where or how large a box is.
_SURE_WORDS = frozenset("advert adverts advertisement advertising adsense sponsor sponsored cookie cookies gdpr newsletter sidebar navbar breadcrumb breadcrumbs comment comments commentlist disqus pagination".split())
_PLACE_WORDS = frozenset("site main top bottom page global primary secondary left right wp js sticky fixed float box bar buttons button links link list lists wrapper wrap container section area block unit slot panel items item icons thread posts articles form inner outer row col content group".split())
_AD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo".split())
#: Elements that hold others; names on headings, paragraphs and inline elements tell of a style.
_CONTAINERS = frozenset("div section ul ol dl li table tbody thead tfoot tr td th fieldset details center figure blockquote address".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
_CONTENT_WORDS = frozenset("article content entry main post story text body".split())


class Node:
    """An element: tag, noise flag, label, children, and its own text parts between them."""

    __slots__ = ("tag", "marks", "names", "ids", "hidden", "label", "children", "parts")

    def __init__(self, tag: str, marks: frozenset, hidden: bool, classes: set = frozenset(), names: frozenset = frozenset(), ids: frozenset = frozenset()):
        # marks: words of classes and ids, and roles; names and ids: whole classes and ids.
        self.tag, self.marks, self.hidden, self.names, self.ids = tag, marks, hidden, names, ids
        # Ids and words with digits tell pages apart, and so do the classes of the body.
        words = [] if tag in ("html", "body") else sorted(m for m in classes if not any(map(str.isdigit, m)))
        self.label = ".".join([tag, *words])
        self.children: list[Node] = []
        self.parts: list[tuple[int, str]] = []

    def nodes(self) -> list[Node]:
        """The children that wrappers know: all elements that can hold text."""
        return [c for c in self.children if c.tag not in _RAW and c.tag not in _VOID]

    def own(self) -> str:
        """The text outside of all elements within."""
        return " ".join(" ".join([p for _, p in self.parts]).split()) if self.parts else ""


def parsed(page: str) -> Node:
    """The page as a tree, with the end tags that HTML lets authors leave out."""
    root = Node("#root", frozenset(), False)
    stack, at = [root], 0
    forms: list[Node] = []
    over: dict[str, int] = {}  # open elements beyond the depth limit, by name
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if "&" in text:
                text = _html.unescape(text)
            stack[-1].parts.append((len(stack[-1].children), text))
        if not m:
            for form in forms:  # one around the page is no form to fill in
                if 2 * _size(form) > _size(root) or any(c.tag in ("article", "main") for c in _walk(form)):
                    form.tag = "div"
            return root
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].parts.append((len(stack[-1].children), m.group()[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m.group(1):
            if over.get(name):
                over[name] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if name not in _BLOCK and stack[i].tag in _BLOCK:  # an inline end tag doesn't leave its block
                    break
            continue
        if name in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if name in _AUTO:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _AUTO[name]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE[name]:
                    break
        marks, hidden = frozenset(), False
        rest = m.group(3) if m.group(3) is not None else m.group(4)
        classes, names, ids = set(), set(), set()
        if len(rest) > 1:
            found = set()
            for a in _ATTRIBUTE.finditer(rest):
                key, value = (a.group(1) or "").lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
                if key in ("class", "id", "itemprop"):
                    found.update(words := _WORD.findall(value))
                    if key == "class":
                        classes.update(words)
                    (ids if key == "id" else names).update(value.split())
                elif key == "role":
                    found.add("role=" + value.strip())
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
            marks = frozenset(found)
        node = Node(name, marks, hidden, classes, frozenset(names), frozenset(ids))
        if name == "form":
            forms.append(node)
        stack[-1].children.append(node)
        if name in _VOID:
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            stop = end.start() if end else len(page)
            if name in ("title", "textarea"):
                node.parts.append((0, _html.unescape(page[at:stop])))
            close = page.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if rest.endswith("/") and name not in _BLOCK:
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
        else:
            over[name] = over.get(name, 0) + 1


_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in _RAW}


@lru_cache(100_000)
def noise_name(name: str) -> bool:
    """Whether a whole class or id says that its element is no main text."""
    words = {w for w in _WORD.findall(name) if not any(map(str.isdigit, w))}
    return bool(words & _SURE_WORDS) or bool(words & _NOISE_WORDS) and words <= _NOISE_WORDS | _PLACE_WORDS


def noisy(node: Node, inside: bool, named: bool = False) -> bool:
    """Whether an element is no content by its tag, role, class or id. inside: where headers may be the text's own; named: within an article or main, where ids don't decide but for the surest words."""
    if node.hidden or node.tag in _NOISE_TAGS:
        return True
    if node.tag == "header" or node.tag in _CONTAINERS and node.names & {"header", "masthead"}:
        return not (inside and any(c.tag in _HEADINGS for c in _walk(node)))
    if any(m.startswith("role=") and m[5:] in _NOISE_ROLES for m in node.marks):
        return True
    if node.tag == "article":
        return bool(node.names & {"comment", "comments", "reply", "ad", "ads", "related", "promo", "sponsored"})
    if node.tag in _CONTAINERS:
        return any(map(noise_name, node.names)) or any(i in _SURE_WORDS if named else noise_name(i) for i in node.ids)
    return node.tag not in ("html", "body", "main") and node.tag not in _HEADINGS and bool(node.names & _AD_WORDS)


def _size(node: Node) -> int:
    """Characters of text in an element, without what is never shown."""
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        n += sum(len(t.strip()) for _, t in x.parts)
        todo += [c for c in x.children if c.tag not in _UNSEEN]
    return n


def _walk(node: Node):
    for c in node.children:
        yield c
        yield from _walk(c)


def regions(root: Node) -> tuple[list[Node], bool]:
    """The content regions in page order, and whether they are articles or main elements.

    The outermost articles and main elements, or else the whole body: a box whose class or id sounds like
    content is too weak a mark to shut out the text around it.
    """
    found: list[Node] = []
    body = None

    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "body" and body is None:
            body = node
        if node is not root and noisy(node, False):
            continue
        if node.tag in ("article", "main") or node.marks & {"role=article", "role=main"}:
            found.append(node)
            continue
        todo += reversed(node.children)
    return (found, True) if found else ([body or root], False)


def marked(node: Node) -> bool:
    return node.tag in ("div", "section", "td") and bool(node.marks & _CONTENT_WORDS)


def clean_marked(node: Node) -> bool:
    """Whether a box marked as content is below an element, outside noise."""
    return any(not noisy(c, False) and (marked(c) or clean_marked(c)) for c in node.children)


def text_of(root: Node, template: set[int] = frozenset(), names: bool = True) -> str:
    """The blocks of the content regions, joined by newlines, without the text of template nodes (by id()).

    Without names, the whole page is the region and only what a browser never shows goes.
    """
    blocks: list[str] = []
    run: list = []

    def close() -> None:
        if any(isinstance(t, tuple) for t in run):  # inline templates go, but for what is part of a word
            follows, after = [""] * len(run), ""
            for i in range(len(run) - 1, -1, -1):
                follows[i] = after
                after = (run[i][0] if isinstance(run[i], tuple) else run[i])[:1] or after
            before = ""
            for i, t in enumerate(run):
                if isinstance(t, tuple):
                    run[i] = t[0] if before.isalnum() and t[0][:1].isalnum() or follows[i].isalnum() and t[0][-1:].isalnum() else ""
                before = run[i][-1:] or before
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    def visit(node: Node, top: bool, inside: bool) -> None:
        if not top and (noisy(node, inside, named) if names else node.hidden or node.tag in _UNSEEN):
            run.append(" ")
            return
        inside = inside or marked(node)
        block = node.tag in _BLOCK
        if block:
            close()
        if node.tag == "br":
            run.append(" ")
        parts, k = node.parts, 0
        own = id(node) not in template
        for i, child in enumerate(node.children):
            while k < len(parts) and parts[k][0] <= i:
                if own or not block:
                    run.append(parts[k][1] if own else (parts[k][1],))
                k += 1
            visit(child, False, inside)
        for _, t in parts[k:]:
            if own or not block:
                run.append(t if own else (t,))
        if block:
            close()

    found, named = regions(root) if names else ([root], True)
    for r in found:
        # Where boxes are marked as content, a header outside them is the site's.
        visit(r, True, named or not clean_marked(r))
        close()
    return "\n".join(blocks)


# Wrappers are nested lists [label, texts, children, pages, pages with own text]; texts: hash to [pages, hashes of main texts].
# Those used in extraction are nested lists [label, hash of the constant own text or None, children].


def as_wrapper(node: Node, digest: int) -> list:
    own = node.own()
    texts = {f"{zlib.crc32(own.encode('utf-8', 'surrogatepass')):x}": [1, [digest]]} if own else {}
    return [node.label, texts, [as_wrapper(c, digest) for c in node.nodes()], 1, len(texts)]


@lru_cache(100_000)
def _tag(label: str) -> str:
    return label.partition(".")[0]


def usual(tree: list) -> str | None:
    """The text that a node has on most of its pages with any."""
    texts = tree[1]
    if not isinstance(texts, dict):
        return texts
    for h, (n, _) in texts.items():
        if 2 * n > tree[4]:
            return h
    return None


def counted(a: dict, b: dict) -> dict:
    """Counts of two wrappers together; beyond TEXTS texts, the next largest count is taken from all (Misra and Gries)."""
    for h, (n, came) in b.items():
        if h in a:
            old = a[h]
            old[0] += n
            if len(came) > 1 or came[0] not in old[1]:
                old[1] = sorted({*old[1], *came})[:MIN_DISTINCT]
        else:
            a[h] = [n, came]
    if len(a) > TEXTS:
        less = sorted((n for n, _ in a.values()), reverse=True)[TEXTS]
        a = {h: [n - less, came] for h, (n, came) in a.items() if n > less}
    return a


def forget(tree: list, least: float) -> list:
    """Without the nodes of fewer pages."""
    tree[2] = [forget(c, least) for c in tree[2] if c[3] >= least]
    return tree


def final(tree: list, pages: int) -> list:
    """A wrapper for extraction: constant texts, and the nodes that place them."""
    least = LEAST if _tag(tree[0]) in _BLOCK else INLINE
    text = next((h for h, (n, came) in tree[1].items() if n >= SHARE * tree[4] and n >= least * pages and len(came) >= MIN_DISTINCT), None)
    return [tree[0], text, [final(c, pages) for c in tree[2] if c[3] >= LEAST * pages]]


class Matcher:
    """Simple tree matching of wrapper trees, with what equal subtrees gave before."""

    def __init__(self):
        self.names: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.sizes: dict[int, int] = {}

    def shape(self, tree: list) -> tuple[int, list]:
        """A number that equal structures share, and the same for each child."""
        kids = [self.shape(c) for c in tree[2]]
        key = (tree[0], *(k[0] for k in kids))
        number = self.names.setdefault(key, len(self.names))
        self.sizes[number] = 1 + sum(self.sizes[k[0]] for k in kids)
        return number, kids

    def score(self, a: list, sa: tuple, b: list, sb: tuple) -> int:
        """The most that matched pairs of nodes are worth: one each, and one more where the labels are equal."""
        if sa[0] == sb[0]:
            return 2 * self.sizes[sa[0]]
        if _tag(a[0]) != _tag(b[0]):
            return 0
        key = (sa[0], sb[0])
        if key not in self.scores:
            self.scores[key] = 1 + (a[0] == b[0]) + self.table(list(zip(a[2], sa[1])), list(zip(b[2], sb[1])))[-1][-1]
        return self.scores[key]

    def table(self, left: list, right: list, bonus=None) -> list[list[int]]:
        """The dynamic program over two runs of children with their shapes; bonus(i, j) is added where it is given."""
        tags = [_tag(y[0]) for y, _ in right]
        last = [0] * (len(right) + 1)
        rows = [last]
        for i, (x, sx) in enumerate(left):
            row, tag = [0], _tag(x[0])
            for j, (y, sy) in enumerate(right):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if tag == tags[j]:
                    got = last[j] + self.score(x, sx, y, sy) + (bonus(i, j) if bonus else 0)
                    best = got if got > best else best
                row.append(best)
            rows.append(row)
            last = row
        return rows

    def pairs(self, a: list, sa: tuple, b: list, sb: tuple) -> list[tuple[int, int]]:
        """Which children match, in order."""
        left, right = [usual(x) for x in a[2]], [usual(y) for y in b[2]]
        if sa[0] == sb[0] and all(x is None or x == y for x, y in zip(left, right)):
            return [(i, i) for i in range(len(a[2]))]
        # Equal structures at the ends belong together unless an equal text lies elsewhere.
        both, n, start, end = {*left} & {*right} - {None}, min(len(left), len(right)), 0, 0
        same = lambda i, j: sa[1][i][0] == sb[1][j][0] and (left[i] == right[j] or left[i] not in both and right[j] not in both)
        while start < n and same(start, start):
            start += 1
        while end < n - start and same(-1 - end, -1 - end):
            end += 1
        m, n = len(left) - end, len(right) - end
        alike = lambda i, j: SAME_TEXT if left[start + i] is not None and left[start + i] == right[start + j] else 0
        rows = self.table(list(zip(a[2], sa[1]))[start:m], list(zip(b[2], sb[1]))[start:n], alike)
        i, j, out = m - start, n - start, [(m + k, n + k) for k in reversed(range(end))]
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((start + i, start + j))
        return [*((k, k) for k in range(start)), *out[::-1]]

    def folded(self, a: list, sa: tuple, b: list, sb: tuple) -> list:
        """Two wrappers as one, with the nodes of either (a and b are used up)."""
        kids, i, j = [], 0, 0
        for k, n in [*self.pairs(a, sa, b, sb), (len(a[2]), len(b[2]))]:
            kids += a[2][i:k] + b[2][j:n]
            i, j = k + 1, n + 1
            if k < len(a[2]):
                kids.append(self.folded(a[2][k], sa[1][k], b[2][n], sb[1][n]))
        return [a[0], counted(a[1], b[1]), kids, a[3] + b[3], a[4] + b[4]]

    def constants(self, a: list, sa: tuple, node: Node, b: list, sb: tuple, out: set[int]) -> None:
        """Collect the page's nodes that match constant nodes of the wrapper with the same text."""
        if a[1] and a[1] in b[1]:
            out.add(id(node))
        kids = node.nodes()
        for i, j in self.pairs(a, sa, b, sb):
            self.constants(a[2][i], sa[1][i], kids[j], b[2][j], sb[1][j], out)

    def trimmed(self) -> None:
        if len(self.names) > 20_000 or len(self.scores) > 200_000:
            self.__init__()


def has_constant(tree: list) -> bool:
    return bool(tree[1]) or any(map(has_constant, tree[2]))


def joined(m: Matcher, a: list, b: list) -> tuple[list, int]:
    """Two wrappers folded and kept small, and the number of nodes of the larger."""
    sa, sb = m.shape(a), m.shape(b)
    n = max(m.sizes[sa[0]], m.sizes[sb[0]])
    tree = m.folded(a, sa, b, sb)
    m.trimmed()
    return forget(tree, LEAST / 2 * tree[3]) if n > NODES else tree, n


def _host():
    rest = F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")
    return F.lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """Wrappers of all pages that have constant nodes: host, tree (JSON)."""

    def fold(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        # Per host wrappers of 1, 2, 4, ... pages, as in a binary counter: a large one meets few others.
        held: dict[str, list[tuple[int, list, int]]] = {}
        m, nodes = Matcher(), 0

        def folded(stack: list) -> None:
            """The last two of a host's wrappers as one."""
            nonlocal nodes
            level, b, y = stack.pop()
            _, a, x = stack.pop()
            tree, n = joined(m, a, b)
            nodes += n - x - y
            stack.append((level + 1, tree, n))

        def rows():
            for stack in held.values():
                while len(stack) > 1:
                    folded(stack)
            return pd.DataFrame([(h, part, json.dumps(stack[0][1])) for h, stack in held.items()], columns=["host", "part", "tree"])

        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                root = parsed(page)
                tree = as_wrapper(root, zlib.crc32(text_of(root).encode("utf-8", "surrogatepass")))
                stack = held.setdefault(host, [])
                stack.append((0, tree, m.sizes[m.shape(tree)[0]]))
                nodes += stack[-1][2]
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                    folded(stack)
                if nodes > HELD:
                    yield rows()
                    held.clear()
                    nodes = 0
        if held:
            yield rows()

    def gather(pdf: pd.DataFrame, last: bool = False) -> pd.DataFrame:
        m, tree = Matcher(), None
        for raw in pdf["tree"]:
            tree = joined(m, tree, json.loads(raw))[0] if tree else json.loads(raw)
        if last:
            tree = final(tree, tree[3])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0]], "tree": [json.dumps(tree) if not last or has_constant(tree) else None]})

    schema = "host string, part int, tree string"
    rows = pages.where("html is not null and html <> ''").select(_host().alias("host"), "html")
    made = stored(rows.mapInPandas(fold, schema), "folded")
    parts, level = made, 1 + (made.agg(F.max("part")).first()[0] or 0)
    while level > FOLDED:
        parts = parts.withColumn("part", F.expr(f"part div {FOLDED}").cast("int")).groupBy("host", "part").applyInPandas(lambda pdf: gather(pdf), schema)
        level = -(-level // FOLDED)
    known = stored(parts.groupBy("host").applyInPandas(lambda pdf: gather(pdf, True), schema).where("tree is not null").select("host", "tree"), "wrappers")
    dropped(made)
    return known


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    known = induce(pages)
    bytes_ = known.agg(F.sum(F.length("tree"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    if bytes_ <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left")

    def work(batches):
        m, trees = Matcher(), {}
        for pdf in batches:
            texts = []
            for page, host, wrapper in zip(pdf["html"], pdf["host"], pdf["tree"]):
                if not page:
                    texts.append("")
                    continue
                root, template = parsed(page), set()
                if wrapper is not None:
                    if host not in trees:
                        if len(trees) > 1_000:
                            trees.clear()
                        trees[host] = json.loads(wrapper)
                    tree, own = trees[host], as_wrapper(root, 0)
                    m.constants(tree, m.shape(tree), root, own, m.shape(own), template)
                    m.trimmed()
                texts.append(text_of(root, template, names))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
