"""Operator 3: main-text extraction with wrappers inferred per template of a host.

Pages of a host come from a few templates, told apart by the containers that hold text outside the page's likeliest
content. All pages are parsed into nested tokens; those of a template are aligned one after another into a wrapper, a
union-free expression: equal tags match, runs of equal siblings (of one to three tags) fold into repeated groups,
siblings without a partner become optional, differing texts become slots (their sizes are kept). The wrapper tells where
the content stands: the path of the part whose slots hold the most running text, an ``article`` or ``main`` element with a
quarter of it first; a class or id that sounds like content only breaks near ties. A page is cut at its template's path;
the only page of a template, or one without the path, falls back to its own best part.

Inside the content, elements go that are menus, asides, forms or scripts by their tag, or whose class or id says nothing
but advert, sidebar, cookie, comments and so on (CHROME). A name that an article may use as well (MAYBE: discussion,
related, alert ...) is no reason by itself: the wrapper decides. Such a part goes if its texts are the same on all pages
of the template, if it holds mostly links, or if it is a repeated group of containers, as reader comments are. Nothing
else is dropped: hidden elements, formulas and constant paragraphs of an article stay.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed in page order.

Each task aligns the pages it reads into partial wrappers (at most NODES parts of pages before it hands them on, texts as
digests); only partial wrappers meet by host and template, where they are aligned again. Content paths are a table that
joins pages by host and template, so a host with a third of all pages is spread over tasks.

Defined cases: null or empty html gives an empty text; a null url or one without a host shares the wrapper of the host
"" ; broken or cut markup is repaired (open elements end where the page ends); repeated rows are extracted alike; an
empty table gives an empty result; extra columns are ignored; pages of any length are read whole.
"""

import hashlib
import json
import re
import sys
import zlib
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

NODES = 1 << 19
#: Frames that following a tree may take; Python frames need no C stack.
DEEP = 10_000_000

_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "noembed")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(?<![^\s"'])(id|class|role|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead title tr ul br option".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "option", "html", "body", "head", "title"}
_ENDS = {  # an opening tag ends these, up to the nearest of the stops
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
_CHROME_TAGS = frozenset(
    "nav aside footer form script style noscript template button select input textarea iframe svg head title menu "
    "dialog object embed canvas audio video label fieldset noembed".split()
)
_CONTAINERS = frozenset("body div section article main table td center".split())
CHROME = (
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sidebar cookie cookies consent gdpr newsletter "
    "share sharing social comment comments disqus breadcrumb breadcrumbs menu nav navbar navigation footer toolbar popup modal "
    "paywall pagination pager"
)
MAYBE = (
    "side notice notices alert banner promo promoted subscribe subscription signup reply replies respond responses discussion "
    "related recommended overlay widget skip login search"
)
_CHROME_NAME, _MAYBE_NAME = (
    re.compile(rf"(?:^|[\s_-])(?:{'|'.join(names.split())})(?:$|[\s_-])", re.IGNORECASE) for names in (CHROME, MAYBE)
)
#: Elements that a list of reader comments or teasers repeats.
_ITEMS = frozenset("div li article section dd tr".split())
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.IGNORECASE)
_CONTENT_NAME = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body|text|hentry)(?:$|[\s_-])", re.IGNORECASE
)


class Node:
    __slots__ = ("tag", "name", "kids", "text", "opt", "rep", "chars", "links")

    def __init__(self, tag: str, name: str = "", text: str = ""):
        self.tag, self.name, self.text = tag, name, text
        self.kids: list = []
        self.opt = self.rep = False
        self.chars = self.links = 0

    @property
    def key(self) -> str:
        return f"{self.tag}|{self.name}"


def parse(html: str) -> Node:
    """Token tree of a page; never fails on broken markup."""
    root = Node("#root")
    stack = [root]

    def close(tags, stops):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    for m in _TOKEN.finditer(html):
        tag = m["tag"]
        if tag is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                stack[-1].kids.append(Node("#text", text=token))
            elif token.startswith("<![CDATA["):
                stack[-1].kids.append(Node("#text", text=token[9:].removesuffix("]]>").replace("&", "&amp;")))
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P:
            close({"p"}, {"table", "td", "th", "div", "article", "section", "li", "blockquote", "aside", "main", "button", "body"})
        if tag in _ENDS:
            close(*_ENDS[tag])
        name = ""
        if m["attrs"]:
            got = {a[0].lower(): a[1].strip("\"'") for a in _ATTR.findall(m["attrs"])}
            name = re.sub(r"\d+", "0", " ".join(got[x] for x in ("id", "class", "role", "itemprop") if got.get(x)))
        node = Node(tag, name)
        stack[-1].kids.append(node)
        if tag not in _VOID and not m[0].endswith("/>"):
            stack.append(node)
    return root


def listed(node: Node) -> bool:
    """Is a part mostly links, or does it hold a repeated group of containers?"""
    chars = links = 0
    todo = [(node, node.tag == "a")]
    while todo:
        part, linked = todo.pop()
        last = None
        for k in part.kids:
            if k.tag == "#text":
                size = k.chars or len(k.text.strip())
                chars += size
                links += size if linked else k.links
                if k.text.strip():
                    last = None
            else:
                if k.tag in _ITEMS and (k.rep or k.key == last):
                    return True
                last = k.key
                todo.append((k, linked or k.tag == "a"))
    return 2 * links > chars


def constant(node: Node) -> bool:
    """Has a part of a wrapper texts, and no slot?"""
    found, todo = False, [node]
    while todo:
        for k in todo.pop().kids:
            if k.tag != "#text":
                todo.append(k)
            elif k.text:
                found = True
            elif k.chars:
                return False
    return found


def maybe(node: Node) -> bool:
    """Has an element a name that adverts, notices and comments share with parts of articles?"""
    return bool(node.name) and node.tag not in _PLAIN and bool(_MAYBE_NAME.search(node.name))


_PLAIN = frozenset("article main body html b i em strong h1 h2 h3".split())


def chrome(node: Node, inside: bool, template: frozenset[str] = frozenset()) -> bool:
    """Is this element no part of an article? ``inside``: the content's element has been entered; ``template``: keys of
    elements with a doubtful name that are the template's."""
    if node.tag in _CHROME_TAGS or (node.tag == "header" and not inside):
        return True
    if not node.name or node.tag in _PLAIN:
        return False
    if _CHROME_NAME.search(node.name) or (not inside and _HEADER_NAME.search(node.name)):
        return True
    return maybe(node) and (node.key in template or listed(node))


def text_of(node: Node, template: frozenset[str] = frozenset()) -> str:
    """Blocks of an element, without chrome."""
    blocks: list[str] = []
    now: list[str] = []

    def cut():
        if now:
            block = " ".join(unescape("".join(now)).split())
            if block:
                blocks.append(block)
            now.clear()

    todo: list[tuple[Node | None, bool]] = [(k, False) for k in reversed(node.kids)]
    while todo:
        kid, done = todo.pop()
        if kid is None:
            cut()
        elif kid.tag == "#text":
            now.append(kid.text)
        elif not chrome(kid, True, template):
            if kid.tag in _BLOCK:
                cut()
                todo.append((None, True))
            todo += [(k, False) for k in reversed(kid.kids)]
        elif kid.tag in _BLOCK:
            cut()
    cut()
    return "\n".join(blocks)


# ---- wrapper inference ---------------------------------------------------------------------------------------------


def _alike(a: Node, b: Node) -> bool:
    """May two siblings with one key be turns of a repeated group? Containers only if half of what they hold is alike."""
    if a.tag not in _CONTAINERS:
        return True
    x, y = {k.key for k in a.kids}, {k.key for k in b.kids}
    return 2 * len(x & y) >= len(x | y)


def _fold(kids: list[Node]) -> list[Node]:
    """Runs of the same one to three siblings become one repeated group."""
    out: list[Node] = []
    for kid in kids:
        out.append(kid)
        for size in (1, 2, 3):
            if len(out) < 2 * size:
                continue
            a, b = out[-2 * size : -size], out[-size:]
            if [x.key for x in a] == [x.key for x in b] and a[0].tag != "#text" and all(map(_alike, a, b)):
                out[-2 * size :] = [_align(x, y, repeated=True) for x, y in zip(a, b, strict=True)]
                break
    return out


def _align(a: Node, b: Node, repeated: bool = False) -> Node:
    """The wrapper of two parts with the same tag."""
    made = Node(a.tag, a.name)
    made.opt, made.rep = a.opt or b.opt, a.rep or b.rep or repeated
    made.chars, made.links = a.chars + b.chars, a.links + b.links
    if a.tag == "#text":
        made.text = a.text if a.text == b.text else ""  # a mismatch of strings: a slot
        return made
    made.kids = _merge(a.kids, b.kids)
    return made


def _merge(a: list[Node], b: list[Node]) -> list[Node]:
    """Longest common alignment of two sibling lists; parts without a partner become optional."""
    head = tail = 0
    while head < min(len(a), len(b)) and a[head].key == b[head].key:
        head += 1
    while tail < min(len(a), len(b)) - head and a[-1 - tail].key == b[-1 - tail].key:
        tail += 1
    out = [_align(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    i = j = 0
    for x, y in [*_partners([k.key for k in left], [k.key for k in right]), (len(left), len(right))]:
        for node in (*left[i:x], *right[j:y]):
            node.opt = True
            out.append(node)
        if x < len(left):
            out.append(_align(left[x], right[y]))
        i, j = x + 1, y + 1
    out += [_align(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return out if head == len(a) == len(b) else _fold(out)


#: Cells of an alignment table; beyond, runs without a partner are skipped from left to right.
CELLS = 1 << 16


def _partners(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places that match, rising in both lists: a longest alignment, or, of very long lists, one found in one pass."""
    n, m = len(a), len(b)
    out, i, j = [], 0, 0
    if n * m > CELLS:
        places: dict[str, list[int]] = {}
        for k, x in enumerate(b):
            places.setdefault(x, []).append(k)
        for i, x in enumerate(a):
            here = places.get(x, [])
            k = bisect_left(here, j)
            if k < len(here) and here[k] - j <= max(64, 2 * (i + 1) - j):  # no far jump, which would leave many alone
                out.append((i, here[k]))
                j = here[k] + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], (best[i + 1][j + 1] + 1) if a[i] == b[j] else 0)
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _template(node: Node) -> Node:
    """A page's part as a wrapper of one example: repeats folded, text sizes noted; trees of any depth."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))  # _align follows the tree with Python frames only
    made = Node(node.tag, node.name)
    order = [(node, made, node.tag == "a")]
    for part, copy, linked in order:
        for k in part.kids:
            if k.tag == "#text" and not k.text.strip():
                continue
            kid = Node(k.tag, k.name, k.text)
            if k.tag == "#text":
                kid.chars = len(k.text.strip())
                kid.links = kid.chars if linked else 0
            else:
                order.append((k, kid, linked or k.tag == "a"))
            copy.kids.append(kid)
    for _, copy, _ in reversed(order):
        copy.kids = _fold(copy.kids)
    return made


def infer(pages: list[str]) -> Node:
    """Wrapper of pages, aligned one after another."""
    wrapper = None
    for page in pages:
        one = _template(parse(page))
        wrapper = one if wrapper is None else _align(wrapper, one)
    return wrapper if wrapper is not None else Node("#root")


def _sizes(root: Node, own: bool) -> dict[int, float]:
    """Running text outside chrome below each part, by id(part)."""
    order = [root]
    for x in order:
        order += x.kids
    sizes: dict[int, float] = {}
    for x in reversed(order):
        if x.tag == "#text":
            sizes[id(x)] = 0 if x.text and not own else x.chars - 2 * x.links
        else:
            sizes[id(x)] = sum((sizes[id(k)] for k in x.kids if k.tag == "#text" or not chrome(k, True)), 0.0)
    return sizes


def best_path(root: Node, own: bool = False) -> list[str]:
    """Steps from the root to the content; ``own``: of one page, where every text counts.

    A step is a key; where siblings share it and it is no repeated group, a tab and which of how many it is follow.
    """
    found: list[tuple[int, float, int, Node]] = []
    sizes = _sizes(root, own)
    above: dict[int, Node] = {}
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, depth, inside = todo.pop()
        inside = inside or (depth > 0 and node.tag in ("article", "main"))
        size = sizes[id(node)]
        named = (3 if node.tag == "article" else 2 if node.tag == "main" else 0) if 4 * size >= sizes[id(root)] else 0
        near = 1.25 if _CONTENT_NAME.search(node.name) and node.tag in ("div", "section", "td") else 1.0
        direct = any(k.tag in ("p", "h1", "h2", "h3", "#text", "blockquote", "pre", "ul", "ol", "table") for k in node.kids)
        if depth and (named or direct):
            found.append((named, near * size, depth, node))
        for k in node.kids:
            if k.tag != "#text" and not chrome(k, named > 1 or inside):
                above[id(k)] = node
                todo.append((k, depth + 1, inside))
    named = [x for x in found if x[0] and x[1] > 0]
    plain = [x for x in found if x[1] > 0]
    if named:
        top = max(x[0] for x in named)
        node = max((x for x in named if x[0] == top), key=lambda x: (x[1], -x[2]))[3]
    elif plain:
        node = max(plain, key=lambda x: (x[1], x[2]))[3]
    else:
        return []
    path = []
    while node is not root:
        same = [k for k in above[id(node)].kids if k.key == node.key]
        path.append(node.key if node.rep or len(same) == 1 else f"{node.key}\t{[k is node for k in same].index(True)}/{len(same)}")
        node = above[id(node)]
    return path[::-1]


def at_path(root: Node, path: list[str]) -> list[Node]:
    """Elements of a page at the end of a path, in page order; of siblings that are no group the one in its place, or,
    where a page has another number of them, the one with the most text."""
    nodes = [root]
    for step in path:
        key, _, place = step.partition("\t")
        found = []
        for n in nodes:
            same = [k for k in n.kids if k.tag != "#text" and k.key == key]
            if place and len(same) > 1:
                at, of = map(int, place.split("/"))
                same = [same[at] if len(same) == of else max(same, key=_length)]
            found += same
        nodes = found
        if not nodes:
            return []
    return nodes


def _length(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            total += len(k.text)
            todo.append(k)
    return total


def template_keys(root: Node, path: list[str]) -> list[str]:
    """Keys of the elements inside a wrapper's content whose names are doubtful and whose texts are the template's."""
    found: dict[str, bool] = {}
    todo = at_path(root, path)
    if all(map(constant, todo)):  # repeats of one page tell nothing
        return []
    while todo:
        for k in todo.pop().kids:
            if k.tag != "#text":
                if maybe(k):
                    found[k.key] = found.get(k.key, True) and (constant(k) or listed(k))
                todo.append(k)
    return sorted(k for k, x in found.items() if x)


def extract(html: str | None, path: list[str], template: frozenset[str] = frozenset()) -> str:
    """The main text of a page, by its host's content path or else by its own."""
    if not html:
        return ""
    root = parse(html)
    found = at_path(root, path) if path else []
    if not found:
        own = best_path(_template(root), own=True)
        found = at_path(root, own) if own else [root]
    return "\n".join(t for t in (text_of(x, template) for x in found) if t)


def template_of(one: Node, own: list[str]) -> str:
    """Digest of a page's containers that hold text, those inside its likeliest content left out."""
    sizes = _sizes(one, own=True)
    found = set()
    todo: list[tuple[Node, int, int]] = [(one, 0, 0)]  # part, digest of its path, how much of ``own`` it follows (-1: none)
    while todo:
        node, path, at = todo.pop()
        if at == len(own) and own:
            continue
        for k in node.kids:
            if k.tag != "#text" and sizes[id(k)] and not chrome(k, False):
                below = zlib.crc32(k.key.encode(), path)
                if k.tag in _CONTAINERS:
                    found.add(below)
                todo.append((k, below, at + 1 if 0 <= at < len(own) and k.key == own[at].partition("\t")[0] else -1))
    return hashlib.blake2b(repr(sorted(found)).encode(), digest_size=8).hexdigest()


def _read(html: str) -> tuple[Node, Node, list[str], str]:
    """Tree, wrapper of the page alone, its own content path, its template."""
    root = parse(html)
    one = _template(root)
    own = best_path(one, own=True)
    return root, one, own, template_of(one, own)


def _packed(root: Node) -> str:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append([x.tag, x.name, x.opt + 2 * x.rep, x.chars, x.links, x.text, len(x.kids)])
        todo += reversed(x.kids)
    return json.dumps(out)


def _unpacked(text: str) -> Node:
    top = Node("")
    open_: list[list] = [[top, 1]]
    for tag, name, flags, chars, links, words, kids in json.loads(text):
        node = Node(tag, name, words)
        node.opt, node.rep, node.chars, node.links = bool(flags & 1), bool(flags & 2), chars, links
        while not open_[-1][1]:
            open_.pop()
        open_[-1][0].kids.append(node)
        open_[-1][1] -= 1
        open_.append([node, kids])
    return top.kids[0]


def _digested(root: Node) -> int:
    """Puts digests in place of texts; the number of parts."""
    order = [root]
    for x in order:
        order += x.kids
        if x.text:
            x.text = hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=8).hexdigest()
    return len(order)


def _partial(batches):
    """host, html -> host, template, pages, wrapper: the pages of a task, aligned."""
    held: dict[tuple[str, str], list] = {}

    def flush():
        rows = [(h, t, n, _packed(w)) for (h, t), (w, n) in sorted(held.items())]
        held.clear()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["host", "template", "n", "wrapper"])

    parts = 0
    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not html:
                continue
            _, one, _, template = _read(html)
            parts += _digested(one)
            now = held.get((host, template))
            held[host, template] = [_align(now[0], one), now[1] + 1] if now else [one, 1]
            if parts >= NODES:
                yield flush()
                parts = 0
    yield flush()


def _inferred(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Content path and template keys of a template from its partial wrappers; null where only one page has it."""
    path = keys = None
    if sum(table.column("n").to_pylist()) > 1:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
        wrapper = None
        for text in sorted(table.column("wrapper").to_pylist()):
            wrapper = _unpacked(text) if wrapper is None else _align(wrapper, _unpacked(text))
        best = best_path(wrapper)
        path, keys = json.dumps(best), json.dumps(template_keys(wrapper, best))
    made = {"host": key[0].as_py(), "template": key[1].as_py(), "path": path, "keys": keys}
    return pa.table({k: pa.array([x], pa.string()) for k, x in made.items()})


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(host)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template, path, keys: content path and template keys of each template of a host that several pages share."""
    partial = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_partial, "host string, template string, n long, wrapper string")
    found = partial.groupBy("host", "template").applyInArrow(_inferred, "host string, template string, path string, keys string")
    return found.filter("path IS NOT NULL AND path <> '[]'")


def _own(batches):
    """page_id, url, host, html -> with the page's template, its own content path and the text there."""
    for batch in batches:
        templates, paths, texts = [], [], []
        for html in batch.column(3).to_pylist():
            if html:
                root, _, own, template = _read(html)
                found = at_path(root, own) if own else [root]
                made = template, json.dumps(own), "\n".join(t for t in map(text_of, found) if t)
            else:
                made = None, "[]", ""
            for kept, x in zip((templates, paths, texts), made, strict=True):
                kept.append(x)
        more = [pa.array(x, pa.string()) for x in (templates, paths, texts)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "template", "own", "text"])


def _extracted(batches):
    """page_id, url, html, own, text, path, keys: cut anew where the template tells more than the page does."""
    for batch in batches:
        texts = []
        for html, own, text, path, keys in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
            known = path is None or (path == own and keys == "[]")
            texts.append(text if known else extract(html, json.loads(path), frozenset(json.loads(keys))))
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = written(wrappers(pages))
    hosted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    read = hosted.mapInArrow(_own, "page_id long, url string, host string, html string, template string, own string, text string")
    joined = read.join(found, ["host", "template"], "left").select("page_id", "url", "html", "own", "text", "path", "keys")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
