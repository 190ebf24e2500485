"""Main text of web pages, by what the pages of a host share.

Two things can't be told from one page: texts that stay the same wherever they
stand (template words), and lists that are links throughout (menus). Both are
counted by path, a path being the signatures (a tag with its class, id and role
words) from the root down: pages by (host, path, line of text), and characters
and linked characters by (host, path). Counts are grouped aggregates of small
rows with numbers in place of paths and texts, joined back to each page by the
paths that it has, so no task and no row holds a host. Both are dropped outside
the article; regions whose signature names them (navigation, footers, adverts,
forms, comments and so on) are dropped everywhere, but a form or a layout
element (``content-sidebar-wrap``) that holds a main part is gone into.

``infer`` shows the structure that pages of a host share as a wrapper, a
union-free regular expression over tags. Equal signatures match; signatures
that one side lacks become optional; neighbours that repeat, alone or in turns
of up to three, become repeated groups; a text is a slot. Its wrapper has the
size of the host's structure; ``extract`` doesn't use it.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ledgerlife.llm.common import free, stored

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = ("script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "object", "math")
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html head body br option".split())
#: Tags, and words of classes, ids and roles, whose regions are never main text.
CHROME_TAGS = frozenset("head nav footer aside form button select input menu dialog label fieldset".split())
#: Tags among them that may hold a whole page.
FORM_TAGS = frozenset(("form", "fieldset"))
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising adsense banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond replies widget toolbar pagination pager "
    "skip login signin signup search masthead topbar contentinfo complementary alert".split()
)
MAIN_WORDS = frozenset("article articlebody post entry story content main maincontent text".split())

#: Tags whose elements are dropped where they are links throughout.
LIST_TAGS = frozenset("ul ol table div section p".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>?|[^<]+|<", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")

#: A wrapper's rules need so many pages of a host, and a template text so large a share of them.
PAGES, SHARE = 5, 0.5
SALTS = 16


class Node:
    """An element, a text (``#``) or a group of siblings; in wrappers with quantifiers and counts over pages."""

    __slots__ = ("sig", "tag", "kids", "text", "many", "maybe", "pages", "chars", "linked", "hidden")

    def __init__(self, sig: str, tag: str, text: str | None = None) -> None:
        self.sig, self.tag, self.text, self.kids = sig, tag, text, []
        self.many = self.maybe = self.hidden = False
        self.pages, self.chars, self.linked = 1, 0, 0


def signature(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag and words of class, id and role, digits as 0; whether the element is hidden."""
    if not attributes.strip():
        return tag, False
    words: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            words.update(re.sub(r"[0-9]+", "0", w) for w in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value.lower()):
            hidden = True
    return ".".join([tag, *sorted(words)]), hidden


def parse(page: str | None) -> Node:
    """The tree of a page. Ends that are left out are supplied; stray ends are ignored."""
    root = Node("", "")
    stack, at, low = [root], 0, None
    opened: Counter[str] = Counter()  # tags on the stack, so that no search goes through it in vain

    def leave(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    page = page or ""
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if not m[0].startswith(("<!", "<?")) or m[0] == "<":
                stack[-1].kids.append(Node("#", "#", _html.unescape(m[0])))
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
            continue
        if tag in SILENT:
            if low is None:
                low = page.lower() if page.isascii() else re.sub(r"[A-Z]", lambda c: c[0].lower(), page)
            if not attributes.endswith("/"):
                end = low.find(f"</{tag}", at)
                end = len(page) if end < 0 else end
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
            continue
        closing = ("p",) if tag in CLOSES_P else ()
        closing += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if not any(opened[t] for t in closing):
                break
            if stack[i].tag in closing:
                leave(i)
            if i < len(stack) and stack[i].tag in BLOCK and stack[i].tag not in closing:
                break
        sig, hidden = signature(tag, attributes)
        node = Node(sig, tag)
        node.hidden = hidden
        stack[-1].kids.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def words_of(sig: str) -> set[str]:
    return {w for part in sig.split(".")[1:] for w in _WORDS.findall(part)}


def is_chrome(node: Node) -> bool:
    if node.hidden or node.tag in CHROME_TAGS:
        return True
    return "." in node.sig and node.tag not in ("html", "body", "article", "main") and bool(words_of(node.sig) & CHROME_WORDS)


def is_layout(node: Node) -> bool:
    """Whether chrome may be the frame of a main part: a form, or names like content-sidebar-wrap with no name that is chrome as a whole."""
    if node.hidden or node.tag in CHROME_TAGS - FORM_TAGS:
        return False
    return not any((w := _WORDS.findall(part)) and all(x in CHROME_WORDS or x.isdigit() for x in w) for part in node.sig.split(".")[1:])


def is_named(node: Node) -> bool:
    """Whether chrome is so by its words or as a form, not by a tag of its own or by being hidden."""
    return not node.hidden and node.tag not in CHROME_TAGS - FORM_TAGS


def opened(root: Node, may: Callable[[Node], bool] = is_layout) -> set[int]:
    """Ids of the chrome elements that hold a main part with text, among those that ``may``; nothing in other chrome counts."""
    nodes, todo = [], [(root, -1)]
    while todo:
        k, above = todo.pop()
        if k.tag != "#" and is_chrome(k) and not may(k):
            continue
        nodes.append((k, above))
        todo += [(c, len(nodes) - 1) for c in k.kids]
    texts, parts, out = bytearray(len(nodes)), bytearray(len(nodes)), set()
    for i in range(len(nodes) - 1, 0, -1):
        k, above = nodes[i]
        if k.tag == "#":
            texts[above] |= not k.text.isspace()
            continue
        chrome = is_chrome(k)
        if chrome and parts[i]:
            out.add(id(k))
        if not chrome or parts[i]:  # text of a form or sidebar doesn't make a part
            texts[above] |= texts[i]
        parts[above] |= parts[i] or texts[i] and not chrome and main_level(k) > 0
    return out


def main_level(node: Node) -> int:
    """3 for an article, 2 for the main part, 1 for a name like content, else 0."""
    if node.tag == "article" or "." in node.sig and "articlebody" in node.sig.replace("-", ""):
        return 3 if not words_of(node.sig) & {"comment", "comments"} else 0
    if node.tag == "main" or "." in node.sig and "main" in node.sig.split(".")[1:]:
        return 2
    return 1 if "." in node.sig and node.tag in ("div", "section", "td") and words_of(node.sig) & MAIN_WORDS else 0


# Inference ---------------------------------------------------------------------------------------

def stepwise(make: Callable[..., Generator]) -> Callable:
    """Call a generator function that yields the calls it waits for, on a stack of its own: depth is bounded by memory alone."""

    @wraps(make)
    def call(*args, **kw):
        stack, value = [make(*args, **kw)], None
        while stack:
            try:
                stack.append(stack[-1].send(value))
                value = None
            except StopIteration as end:
                stack.pop()
                value = end.value
        return value

    call.step = make
    return call


@stepwise
def folded(node: Node, link: bool = False, texts: bool = True) -> Generator:
    """The wrapper of a single page: white space left out, repeated neighbours folded; without ``texts`` all texts are slots."""
    out = Node(node.sig, node.tag)
    if node.tag == "#":
        out.text = " ".join(node.text.split())
        out.chars = len(out.text)
        out.linked = out.chars if link else 0
        out.text = out.text if texts else None
        return out
    link = link or node.tag == "a"
    kids = []
    for k in node.kids:
        if k.tag != "#" or not k.text.isspace():
            kids.append((yield folded.step(k, link, texts)))
    out.chars, out.linked = sum(k.chars for k in kids), sum(k.linked for k in kids)
    out.kids = yield squeezed.step(kids)
    return out


@stepwise
def squeezed(kids: list[Node]) -> Generator:
    """Turns of one to three signatures that follow themselves become one repeated node or group."""
    for n in (1, 2, 3):
        i, out = 0, []
        while i < len(kids):
            turn = [k.sig for k in kids[i : i + n]]
            times = 1
            if len(turn) == n and (n == 1 or len(set(turn)) > 1):
                while [k.sig for k in kids[i + times * n : i + (times + 1) * n]] == turn:
                    times += 1
            if times == 1:
                out.append(kids[i])
                i += 1
                continue
            group = [kids[i + j] for j in range(n)]
            for t in range(1, times):
                for j in range(n):
                    group[j] = yield merged.step(group[j], kids[i + t * n + j], same_page=True)
            if n == 1:
                whole = group[0]
            else:
                whole = Node("(" + " ".join(turn) + ")", "()")
                whole.kids, whole.pages = group, max(k.pages for k in group)
                whole.chars, whole.linked = sum(k.chars for k in group), sum(k.linked for k in group)
            whole.many = True
            out.append(whole)
            i += times * n
        kids = out
    return kids


@stepwise
def merged(a: Node, b: Node, same_page: bool = False) -> Generator:
    """Align two nodes of one signature; b's content is taken over into a."""
    a.many, a.maybe = a.many or b.many, a.maybe or b.maybe
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
    if a.text != b.text:
        a.text = None  # a slot
    a.kids = yield aligned.step(a.kids, b.kids, same_page)
    return a


@stepwise
def aligned(xs: list[Node], ys: list[Node], same_page: bool = False) -> Generator:
    """Longest common order of two sibling lists; what only one side has becomes optional."""
    p, q = [x.sig for x in xs], [y.sig for y in ys]
    out, i, j = [], 0, 0
    for u, v in [*_common(p, q), (len(xs), len(ys))]:
        for k in [*xs[i:u], *ys[j:v]]:
            k.maybe = True
            out.append(k)
        if u < len(xs) and v < len(ys):
            out.append((yield merged.step(xs[u], ys[v], same_page)))
        i, j = u + 1, v + 1
    return out if p == q else (yield squeezed.step(out))


def _common(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Matched positions of a longest common subsequence of two signature lists, by halving (Hirschberg) in linear memory."""
    pairs, todo = [], [(0, len(p), 0, len(q))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and p[i] == q[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and p[n - 1] == q[m - 1]:
            n, m = n - 1, m - 1
            pairs.append((n, m))
        if i == n or j == m:
            continue
        if n - i == 1:
            if (k := next((k for k in range(j, m) if q[k] == p[i]), None)) is not None:
                pairs.append((i, k))
            continue
        half = (i + n) // 2
        ahead, behind = _lengths(p[i:half], q[j:m]), _lengths(p[half:n][::-1], q[j:m][::-1])
        cut = max(range(m - j + 1), key=lambda k: ahead[k] + behind[m - j - k])
        todo += [(i, half, j, j + cut), (half, n, j + cut, m)]
    return sorted(pairs)


def _lengths(p: list[str], q: list[str]) -> list[int]:
    """Length of the longest common subsequence of p and each prefix of q, a bit for each position of q."""
    at: dict[str, int] = {}
    for j, s in enumerate(q):
        at[s] = at.get(s, 0) | 1 << j
    every = (1 << len(q)) - 1
    row = every
    for s in p:
        hit = row & at.get(s, 0)
        row = (row + hit | row - hit) & every
    out = [0]
    for bit in reversed(f"{row:0{len(q)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def packed(node: Node) -> list:
    """The nodes of a tree in order, each with its depth."""
    rows, todo = [], [(0, node)]
    while todo:
        depth, k = todo.pop()
        rows.append([depth, k.sig, k.tag, k.text, int(k.many), int(k.maybe), k.pages, k.chars, k.linked])
        todo += [(depth + 1, c) for c in reversed(k.kids)]
    return rows


def unpacked(rows: list) -> Node:
    line: list[Node] = []  # the nodes above the next row
    for depth, sig, tag, text, many, maybe, *counts in rows:
        node = Node(sig, tag, text)
        node.many, node.maybe = bool(many), bool(maybe)
        node.pages, node.chars, node.linked = counts
        del line[depth:]
        if line:
            line[-1].kids.append(node)
        line.append(node)
    return line[0]


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags: ``#`` is a slot, quotes hold template text."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        quantifier = {(True, True): "*", (True, False): "+", (False, True): "?"}.get((k.many, k.maybe), "")
        start, end = "", ""
        if k.tag == "#":
            start = "#" if k.text is None else json.dumps(k.text, ensure_ascii=False)
        elif k.tag == "()":
            start, end = "(", ")"
        elif k.tag:
            start, end = (f"<{k.sig}> ", f" </{k.tag}>") if k.kids else (f"<{k.sig}>", "")
        if quantifier and k.tag != "()":
            start, end = f"({start}", f"{end})"
        out.append(start)
        todo.append(end + quantifier)
        for i, c in enumerate(reversed(k.kids)):
            todo += [" ", c] if i else [c]
    return "".join(out)


def rules(wrapper: Node) -> dict:
    """What a wrapper adds to a page's own evidence: paths of link lists, and template texts by path."""
    lists, template = [], {}
    todo: list[tuple[Node, tuple]] = [(wrapper, ())]

    def spelled(path: tuple) -> str:
        parts = []
        while path:
            path, sig = path
            parts.append(sig)
        return "".join(f"/{sig}" for sig in reversed(parts))

    while todo:
        k, path = todo.pop()
        if k is not wrapper and k.tag != "()":
            path = (path, k.sig)
            if is_chrome(k) or main_level(k) >= 2:
                continue
            if k.tag in LIST_TAGS and k.pages >= PAGES and k.chars and k.linked >= 0.8 * k.chars:
                lists.append(spelled(path))
                continue
            if k.tag == "#":
                if k.text and k.pages >= PAGES and k.pages >= SHARE * wrapper.pages:
                    template.setdefault(spelled(path), []).append(k.text)
                continue
        todo += [(c, path) for c in reversed(k.kids)]
    return {"lists": lists, "template": template} if lists or template else {}


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, its structure as JSON. Pages without a host share the host ''."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held: dict[str, Node] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = folded(parse(page.as_py()), texts=False)
                held[host] = merged(held[host], own) if host in held else own
            rows = [json.dumps(packed(n), ensure_ascii=False) for n in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(rows, pa.string())], names=["host", "wrapper"])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        host, node = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(packed(node), ensure_ascii=False)], pa.string())], names=["host", "wrapper"])
        for batch in batches:
            for h, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = unpacked(json.loads(row.as_py()))
                if h == host:
                    node = merged(node, own)
                    continue
                if node is not None:
                    yield out()
                host, node = h, own
        if node is not None:
            yield out()

    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    kind = "host string, wrapper string"
    # The order of alignment is fixed by the text of the wrappers, so reruns agree.
    part = pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInArrow(fold, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = part.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(join, kind)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join, kind)


# Extraction --------------------------------------------------------------------------------------

def path_id(text: str, above: int = 0) -> int:
    """Number of a path below another one; paths are not spelled out, as deep pages would take the square of their depth."""
    for part in text.split("/"):
        above = xxh64_intdigest(part, above)
    return above


def main_text(page: str | None, told: dict | set[int] | None = None) -> str:
    """Main text of a page, a line for each block. ``told``: rules of a wrapper, or the numbers of the page's facts that are rules."""
    root = parse(page)
    if isinstance(told, dict):
        lists = {_fact(LIST, path_id(p[1:])) for p in told.get("lists", ())}
        told = lists | {_fact(TEXT, path_id(p[1:]), t) for p, texts in told.get("template", {}).items() for t in texts}
    level, lines = _main_lines(root, opened(root), told)
    if not level and (named := opened(root, is_named)):  # a main part in regions that are chrome by their whole name
        other = _main_lines(root, named, told)[1]
        lines = max(lines, other, key=lambda x: sum(map(len, x)))
    if not lines and (forms := _forms(root)):
        lines = _main_lines(root, forms, told)[1]
    return "\n".join(lines)


def _forms(root: Node) -> set[int]:
    return {id(k) for k in _below(root) if k.tag in FORM_TAGS and not k.hidden}


def _tops(root: Node, open_: set[int]) -> tuple[int, list[tuple[Node, int]]]:
    """The level of the main part, and its outermost elements with their paths."""
    found: dict[int, list[tuple[Node, int]]] = {1: [], 2: [], 3: []}
    todo = [(k, 0) for k in reversed(root.kids)]
    while todo:
        k, path = todo.pop()
        if k.tag == "#" or is_chrome(k) and id(k) not in open_:
            continue
        path = path_id(k.sig, path)
        level = 0 if id(k) in open_ else main_level(k)
        if level:
            found[level].append((k, path))
        if level < 3:
            todo += [(c, path) for c in reversed(k.kids)]
    for level in (3, 2, 1):
        tops = [n for n in found[level] if has_text(n[0], open_)]
        if tops:
            inside: set[int] = set()  # of nested ones the outer
            for n, _ in tops:
                if id(n) not in inside:
                    inside.update(id(k) for k in _below(n))
            return level, [n for n in tops if id(n[0]) not in inside]
    return 0, [(root, 0)]


def _main_lines(root: Node, open_: set[int], told: set[int] | None) -> tuple[int, list[str]]:
    level, tops = _tops(root, open_)
    return level, [x for n, path in tops for x in _Walk(open_, level >= 2, told if level < 2 else None).lines(n, path)]


def _below(node: Node) -> Iterator[Node]:
    todo = node.kids[::-1]
    while todo:
        k = todo.pop()
        yield k
        todo += reversed(k.kids)


def has_text(node: Node, open_: set[int]) -> bool:
    todo = node.kids[::-1]
    while todo:
        k = todo.pop()
        if k.tag == "#":
            if not k.text.isspace():
                return True
        elif not is_chrome(k) or id(k) in open_:
            todo += reversed(k.kids)
    return False


#: Kinds of facts: a list by its path, a line by the path of its block, a text among others of its line by its place, a text by its path.
LIST, LINE, SLOT, TEXT = range(4)


def _fact(kind: int, path: int, text: str = "") -> int:
    return xxh64_intdigest(text, path ^ kind)


class _Walk:
    """A walk over main parts that gives the lines that no rule drops; with ``facts``, it counts what may become a rule."""

    def __init__(self, open_: set[int], article: bool, told: set[int] | None, facts: dict[int, list[int]] | None = None) -> None:
        self.open, self.article, self.told, self.facts = open_, article, told or (), facts
        self.line: list[tuple[str, int, int, int]] = []  # text, the paths of its parent and block, its place
        self.out: list[str] = []

    def end(self) -> None:
        line, self.line = self.line, []
        whole = " ".join("".join(x[0] for x in line).split())
        if not whole:
            return
        if self.facts is None and not self.told:
            self.out.append(whole)
            return
        texts = [x for x in line if not x[0].isspace()]
        key = _fact(LINE, texts[0][2], whole)
        slots = {x: _fact(SLOT, path_id(f"#{x[3]}", x[1])) for x in texts} if len(texts) > 1 else {}
        if self.facts is not None:
            self.facts[key] = [LINE, 0, 0, 0, 0]
            for x, slot in slots.items():
                n = xxh64_intdigest(" ".join(x[0].split())) >> 1
                old = self.facts.setdefault(slot, [SLOT, 0, 0, n, n])
                old[3:] = min(old[3], n), max(old[4], n)
        if key not in self.told:
            kept = [x[0] for x in line if slots.get(x) not in self.told and _fact(TEXT, path_id("#", x[1]), " ".join(x[0].split())) not in self.told]
            if text := " ".join("".join(kept).split()):
                self.out.append(text)

    def lines(self, top: Node, path: int, sizes: dict[int, tuple[int, int]] | None = None) -> list[str]:
        keyed = bool(self.told) or self.facts is not None
        todo: list[tuple[Node | None, int, int, int]] = [(k, path, path, i) for i, k in _placed(top)]
        while todo:
            k, path, block, place = todo.pop()
            if k is None:  # a block ends
                self.end()
                continue
            if k.tag == "#":
                self.line.append((k.text, path, block, place))
                continue
            own = path_id(k.sig, path) if keyed else 0
            if k.tag in BLOCK:
                self.end()
            if is_chrome(k) and id(k) not in self.open or k.tag == "header" and not self.article or self.facts is not None and main_level(k) >= 2:
                continue
            if keyed and k.tag in LIST_TAGS:
                key = _fact(LIST, own)
                if self.facts is None:
                    if key in self.told:
                        continue
                elif (n := sizes[id(k)])[0]:
                    old = self.facts.setdefault(key, [LIST, 0, 0, 0, 0])
                    old[1:3] = old[1] + n[0], old[2] + n[1]
            if k.tag in BLOCK:
                block = own
                todo.append((None, 0, 0, 0))
            todo += [(c, own, block, i) for i, c in _placed(k)]
        self.end()
        return self.out


def _placed(node: Node) -> list[tuple[int, Node]]:
    """Children from last to first, each with the number of those before it that are no white space."""
    out, i = [], 0
    for k in node.kids:
        out.append((i, k))
        i += k.tag != "#" or not k.text.isspace()
    return out[::-1]


def _sizes(root: Node) -> dict[int, tuple[int, int]]:
    """Characters and linked characters of every element, by id."""
    nodes, todo = [], [(root, -1, False)]
    while todo:
        k, above, link = todo.pop()
        link = link or k.tag == "a"
        n = len(" ".join(k.text.split())) if k.tag == "#" else 0
        nodes.append([k, above, n, n if link else 0])
        todo += [(c, len(nodes) - 1, link) for c in k.kids]
    for k, above, n, linked in (nodes[i] for i in range(len(nodes) - 1, 0, -1)):
        nodes[above][2] += n
        nodes[above][3] += linked
    return {id(k): (n, linked) for k, _, n, linked in nodes if k.tag in LIST_TAGS}


def page_facts(page: str | None) -> tuple[bool, dict[int, list[int]]]:
    """Whether rules apply to a page, and its facts by number: kind, characters, linked characters, least and largest text number."""
    root = parse(page)
    open_ = opened(root)
    used = _tops(root, open_)[0] < 2
    facts: dict[int, list[int]] = {}
    sizes = _sizes(root)
    if not _Walk(open_ | opened(root, is_named), False, None, facts).lines(root, 0, sizes) and used and (forms := _forms(root)):
        _Walk(forms, False, None, facts).lines(root, 0, sizes)
    return used, facts


FACTS = "host string, page long, used boolean, kind long, fact long, chars long, linked long, lo long, hi long"


def counted(pages: DataFrame, most: int = 50_000) -> DataFrame:
    """A row for each fact of each page (host, page, html)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [f.split(" ")[0] for f in FACTS.split(", ")]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[4] = np.array(columns[4], dtype=np.uint64).view(np.int64)
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for host, number, page in zip(batch.column(0), batch.column(1), batch.column(2)):
                used, facts = page_facts(page.as_py())
                host, number = host.as_py(), number.as_py()
                rows += [(host, number, used, kind, fact, *rest) for fact, (kind, *rest) in facts.items()]
                if len(rows) >= most:
                    yield out()
        if rows:
            yield out()

    return pages.mapInArrow(run, FACTS)


def learned(facts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, fact) of the facts that are rules of their host, which has ``of`` pages."""
    rows = facts.groupBy("host", "kind", "fact").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = rows.filter((F.col("n") >= PAGES) & ((F.col("kind") != LIST) | (F.col("linked") >= 0.8 * F.col("chars"))) & (F.col("lo") == F.col("hi")))
    return rows.join(hosts, "host").filter((F.col("kind") == LIST) | (F.col("n") >= SHARE * F.col("of"))).select("host", "fact")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each whole page; empty where it has none, or the page is null or empty.

    Rules reach a page by (host, hash of the page), only those of its own
    facts, broadcast only where Spark finds them small. Pages that repeat are
    treated alike; malformed markup is read as far as it goes.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    number = F.xxhash64(F.col(html_col))
    facts = stored(counted(pages.select(host.alias("host"), number.alias("page"), F.col(html_col).alias("html"))), "facts")
    rules_of = stored(learned(facts, pages.groupBy(host.alias("host")).agg(F.count("*").alias("of"))), "rules")
    names = free(pages.columns, "_host", "_page", "_rules")
    known = facts.filter("used").select("host", "page", "fact").join(rules_of, ["host", "fact"]).groupBy("host", "page").agg(F.collect_set("fact").alias("facts"))
    known = known.toDF(*names)
    joined = pages.withColumn(names[0], host).withColumn(names[1], number).join(known, names[:2], "left").drop(*names[:2])
    return _extracted(joined, html_col, names[2], into)


def _extracted(df: DataFrame, html_col: str, rules_col: str, into: str) -> DataFrame:
    """Run main_text over (page, numbers of rules) and drop the rules; a column named ``into`` is replaced."""
    kept = [i for i, c in enumerate(df.columns) if c != rules_col and c.lower() != into.lower()]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(into, T.StringType())])
    html_at, rules_at = df.columns.index(html_col), df.columns.index(rules_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py(), {x & (1 << 64) - 1 for x in told.as_py() or ()}) for page, told in zip(batch.column(html_at), batch.column(rules_at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
