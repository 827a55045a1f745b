"""Main text of web pages by union-free regular-expression wrappers.

All distinct pages of a host are parsed into token trees, and the wrapper grows from them: the token streams of
equal elements are aligned, neighbours of the same kind become a repeated group, elements that only one side has
an optional group, and texts that differ a slot. A text that agrees is proof of a template only on pages that are
not near-equal themselves: every text keeps up to ``TEMPLATE_PAGES`` pages, as sketches of their words, that differ
from each other in most of them; near-equal pages count as one.

The slots show where the host keeps its content: the path leads from the body to the element with most slot text,
and stops where going on would leave a heading out. Extraction matches each page against its host's wrapper: of
that element everything is kept but parts whose markup names them as something else than the article, and template
text that is no heading. Only for hosts without a usable wrapper (all pages near-equal, or no slots) markup alone
shows the article.

Wrappers merge in an order that the pages alone decide: by digest, first those of a host that share 16 bits of it,
then 8, then all. So the result does not depend on partitions, and a host of any size is many tasks' work, whose
rows stream through. Neither the number of parts nor the depth of elements changes a rule.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .urlfilter import host_of

#: An element is entered while it holds this share of the slot text around it.
MAJORITY = 0.6
#: Text that stands at its place on so many pages that differ from each other, and is the same on each, is template text.
TEMPLATE_PAGES = 3
#: Registers of a page's sketch, and how many must agree for two pages to be near-equal.
SKETCH, NEAR = 8, 4
#: Digits of the pages' digests by which wrappers merge, level by level.
LEVELS = (4, 2, 0)
#: Share of a page's text that its article elements must hold for markup to show the article.
ARTICLE_SHARE = 0.2
#: Wrappers up to which they are broadcast to the pages.
BROADCAST_HOSTS = 100_000
#: And their bytes.
BROADCAST_BYTES = 64 << 20

# Fixed values of HTML: elements without content, and with raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same family ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SKIPPED = frozenset("nav footer aside form script style noscript template svg iframe button select textarea object canvas dialog menu head title".split())
#: A class or id with one of these words as a part names something else than the article.
ASIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|banners?|cookies?|consent|gdpr|sidebars?|menus?|nav(?:bar|igation)?"
    r"|breadcrumbs?|comments?|disqus|newsletter|popups?|modals?|footer|pagination|pager|toolbar|masthead)(?:$|[-_\s])",
    re.I,
)
#: These do so only if all the other parts of the class or id are such words, general ones or numbers.
WEAK = frozenset("alert alerts discussion login notice notices overlay promo promos promotion recommended related replies respond share sharing side signup skip social subscribe tags widget widgets".split())
GENERAL = frozenset(
    "area article articles author bar blog block body board bottom box button buttons card cards column container content count entry for form group header icon icons inner item items label left link links list main media"
    " message more now outer page panel post posts reader readers right row section site slot stories story text this title to top unit user users via with wrap wrapper you your".split()
)
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|articlebody|content|main|post|entry|story|body)(?:$|[-_\s])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    """An element; children are nodes and texts."""

    name: str
    marks: str = ""
    children: list = field(default_factory=list)
    blocky: bool = False  # a block, or holds one

    @property
    def key(self) -> str:
        return self.name + _without_numbers(self.marks) if self.marks else self.name


@lru_cache(1 << 16)
def _without_numbers(marks: str) -> str:
    return re.sub(r"[0-9]+", "0", marks)


def parse(page: str) -> Node:
    """A tree for any input; end tags that fit nothing are dropped, open elements end with the page."""
    root = Node("html")
    stack, at = [root], 0

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add_text(page[at:])
            break
        add_text(page[at : m.start()])
        at = m.end()
        if m[0] == "<":
            add_text("<")
        elif m[1]:
            name = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name not in BLOCKS and stack[k].name in BLOCKS:
                    break
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body", "head") and name == "html":
                continue
            ends = CLOSES.get(name, ("p",) if name in BLOCKS else ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS and stack[k].name != "p":
                    break
            marks = " ".join(b or c or d for a, b, c, d in ATTRIBUTE.findall(m[3] or "") if a.lower() in ("class", "id", "role", "itemprop")) if m[3] else ""
            node = Node(name, f".{marks}" if marks else "", blocky=name in BLOCKS)
            stack[-1].children.append(node)
            if node.blocky:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].blocky:
                        break
                    stack[k].blocky = True
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
                node.children.append(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
            elif name not in VOID and not (m[3] or "").endswith("/"):
                stack.append(node)
    return root


@lru_cache(1 << 16)
def names_aside(marks: str) -> bool:
    """Whether classes and ids name something else than the article. A plain content word beside a weak one keeps it."""
    if ASIDE.search(marks):
        return True
    told = [[w for w in re.split(r"[-_0-9]+", mark.lower()) if w] for mark in marks.split()]
    weak = any(WEAK.intersection(t) and all(w in WEAK or w in GENERAL for w in t) for t in told)
    return weak and not any(CONTENT.fullmatch(mark) for mark in marks.split())


def is_aside(node: Node, inside: bool) -> bool:
    """Whether an element is something else than the article; inside: within the article's element."""
    if node.name in SKIPPED or node.name == "header" and not inside:
        return True
    return bool(node.marks) and node.name not in ("article", "main", "body", "html") and names_aside(node.marks[1:])


# Wrappers ---------------------------------------------------------------------------------


@dataclass(slots=True)
class Group:
    """A part of a wrapper: an element with parts, or a text (key "#"; text None: a slot)."""

    key: str
    parts: list = field(default_factory=list)
    text: str | None = None
    mass: float = 0.0
    optional: bool = False
    repeated: bool = False
    pages: tuple[str, ...] = ()  # sketches of pages that differ from each other; of texts and the root

    def pattern(self) -> str:
        inner = ("*" if self.text is None else "_") if self.key == "#" else f"{self.key}({' '.join([p.pattern() for p in self.parts])})"
        return inner + "+" * self.repeated + "?" * self.optional

    def packed(self) -> str:
        """All groups in order, each with the number of its parts."""
        out, todo = [], [self]
        while todo:
            g = todo.pop()
            out.append([g.key, g.text, g.mass, g.optional | g.repeated << 1, "".join(g.pages), len(g.parts)])
            todo += reversed(g.parts)
        return json.dumps(out, separators=(",", ":"))

    @classmethod
    def unpacked(cls, data: str) -> Group:
        root, open_ = cls(""), []
        open_.append((root, 1))
        for key, text, mass, flags, pages, n in json.loads(data):
            while not open_[-1][1]:
                open_.pop()
            above, left = open_[-1]
            open_[-1] = above, left - 1
            g = cls(key, [], text, mass, bool(flags & 1), bool(flags & 2), tuple(pages[i : i + 2 * SKETCH] for i in range(0, len(pages), 2 * SKETCH)))
            above.parts.append(g)
            open_.append((g, n))
        return root.parts[0]


#: Odd multipliers that turn one hash into the registers'.
_TURNS = shared.mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(text: str) -> str:
    """``SKETCH`` bytes, in hex, of the least hashes of a page's runs of three words; near-equal pages share most of them."""
    words = text.encode("utf-8", "surrogatepass").split()
    codes = np.fromiter(map(crc32, words), np.uint64, len(words))
    runs = codes if len(words) < 3 else (codes[:-2] * np.uint64(0x100000001B3) + codes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + codes[2:]
    hashes = shared.mix(runs) if len(runs) else np.zeros(1, np.uint64)
    return (shared.mix(hashes[:, None] * _TURNS).min(axis=0) & np.uint64(255)).astype(np.uint8).tobytes().hex()


def _near(a: str, b: str) -> bool:
    return sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 2 * SKETCH, 2)) >= NEAR


def _different(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """Pages of a, and those of b that differ from all taken, as many as are asked for."""
    if a == b or len(a) >= TEMPLATE_PAGES:
        return a
    out = list(a)
    for page in b:
        if len(out) < TEMPLATE_PAGES and not any(_near(page, other) for other in out):
            out.append(page)
    return tuple(out)


def _any_depth() -> None:
    """Lets functions here call themselves as deep as elements nest; Python calls take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def _raw(items: list, inside: bool = True) -> str:
    """Text of nodes and texts without what is named as something else."""
    if len(items) == 1 and isinstance(items[0], str):
        return items[0]
    out, todo = [], list(reversed(items))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name in ("br", "wbr"):
            out.append(" " if item.name == "br" else "")
        elif not is_aside(item, inside):
            space = [" "] if item.name in BLOCKS else []
            todo += [*space, *reversed(item.children), *space]
    return "".join(out)


def _plain(items: list, inside: bool = True) -> str:
    return " ".join(_raw(items, inside).split())


def items_of(node: Node) -> list[tuple[str, list]]:
    """(key, members) of the children as wrappers see them: an element (and the space before it), or a run of text with its inline elements (key "#")."""
    out, run = [], []

    def flush() -> None:
        if not run:
            return
        for c in run:
            if isinstance(c, str) and not c.isspace():
                out.append(("#", list(run)))
                break
        else:
            gap = ""
            for c in run:
                if isinstance(c, str) or c.name in ("br", "wbr"):
                    gap = gap if not isinstance(c, str) and c.name == "wbr" else " "
                else:
                    out.append((c.key, [c, gap]))
                    gap = ""
        run.clear()

    for child in node.children:
        if isinstance(child, str) or child.name in ("br", "wbr"):
            run.append(child)
        elif child.name in RAW:
            continue
        elif not child.blocky:
            run.append(child)
        else:
            flush()
            out.append((child.key, [child]))
    flush()
    return out


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def wrapper_of(page: str) -> Group:
    """The wrapper of one page."""
    _any_depth()
    root = parse(page)
    own = (sketch(_plain([root], False)),)
    out = _page_group(root, own)
    out.pages = own
    return out


def _page_group(node: Node, own: tuple[str, ...]) -> Group:
    """Neighbours of the same key fold into a repeated group. Texts are held as digests."""
    parts: list[Group] = []
    for key, members in items_of(node):
        if key == "#":
            text = _plain(members)
            if not text:
                continue
            part = Group("#", text=_digest(text), mass=len(text), pages=own)
        elif is_aside(members[0], True):
            part = Group(key)  # what is never read has no parts
        else:
            part = _page_group(members[0], own)
        if parts and parts[-1].key == part.key:
            parts[-1] = unify(parts[-1], part)
            parts[-1].repeated = True
        else:
            parts.append(part)
    return Group(node.key, parts)


def _aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """(i, j) in order; -1 where one side has no partner. The n-th part of a key may meet the other side's n-th; of these
    pairs the longest rising sequence is taken, so that the time is n log n for lists of any length."""
    if x == y:
        return [(i, i) for i in range(len(x))]

    def told(keys: list[str]) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
            out.append((k, seen[k]))
        return out

    at = {k: j for j, k in enumerate(told(y))}
    pairs = [(i, at[k]) for i, k in enumerate(told(x)) if k in at]
    ends: list[int] = []
    last, before = [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        last[k : k + 1] = [n]
        before[n] = last[k - 1] if k else -1
    chosen, n = [], last[-1] if last else -1
    while n >= 0:
        chosen.append(pairs[n])
        n = before[n]
    out, i, j = [], 0, 0
    for a, b in [*reversed(chosen), (len(x), len(y))]:
        out += [(k, -1) for k in range(i, a)] + [(-1, k) for k in range(j, b)] + [(a, b)]
        i, j = a + 1, b + 1
    return out[:-1]


def unify(a: Group, b: Group) -> Group:
    """The least wrapper here that fits both."""
    out = Group(a.key, [], a.text if a.text == b.text else None, a.mass + b.mass, a.optional or b.optional, a.repeated or b.repeated, _different(a.pages, b.pages))
    x, y = a.parts, b.parts
    for i, j in _aligned([p.key for p in x], [p.key for p in y]):
        if i >= 0 and j >= 0:
            part = unify(x[i], y[j])
        else:
            part = x[i] if j < 0 else y[j]
            part.optional = True
        if out.parts and out.parts[-1].key == part.key:  # a part on one side only may repeat its neighbour
            part = unify(out.parts[-1], part)
            part.repeated = True
            out.parts[-1] = part
        else:
            out.parts.append(part)
    return out


def is_template(part: Group) -> bool:
    """Whether a text of a wrapper is proven to be the host's own."""
    return part.text is not None and len(part.pages) >= TEMPLATE_PAGES


def _named(key: str) -> Node:
    name, _, marks = key.partition(".")
    return Node(name, f".{marks}" if marks else "")


def slot_masses(wrapper: Group) -> dict[int, float]:
    """By id of a group: characters of slot text below it, without what its markup names as something else. Text that
    is the same on pages that differ is no slot, though two of them are not enough to drop it."""
    found: dict[int, float] = {}
    todo = [(wrapper, False)]
    while todo:
        g, done = todo.pop()
        if g.key == "#":
            found[id(g)] = 0.0 if g.text is not None and len(g.pages) > 1 else g.mass
        elif is_aside(_named(g.key), False):
            found[id(g)] = 0.0
        elif done:
            total = 0.0
            for p in g.parts:
                total += found[id(p)]
            found[id(g)] = total
        else:
            todo.append((g, True))
            todo += [(p, False) for p in g.parts]
    return found


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENTERED = ("body", "article", "main", "section", "div", "td", "table", "tbody", "tr", "center")


def content_parts(wrapper: Group) -> list[Group]:
    """Groups from the root to the element with most slot text."""
    path, here, masses = [], wrapper, slot_masses(wrapper)
    while True:
        total = masses.get(id(here), 0.0)
        best = max((p for p in here.parts if p.key != "#"), key=lambda p: masses.get(id(p), 0.0), default=None)
        if best is None or not total or masses.get(id(best), 0.0) < MAJORITY * total or best.repeated or best.key.partition(".")[0] not in ENTERED:
            return path
        if here.key.partition(".")[0] not in ("html", "body", "main") and any(p is not best and p.key.partition(".")[0] in HEADINGS for p in here.parts):
            return path
        path.append(best)
        here = best


def content_path(wrapper: Group) -> list[str]:
    """Keys from the root to the element with most slot text."""
    return [p.key for p in content_parts(wrapper)]


def learn(pages: list[str]) -> Group | None:
    """Wrapper of the different pages of one host, merged as ``wrappers`` does."""
    _any_depth()
    held = [(_page_digest(page), wrapper_of(page)) for page in sorted(set(pages), key=_page_digest)]
    for digits in LEVELS:
        made: list[tuple[str, Group]] = []
        for digest, own in held:
            if made and made[-1][0][:digits] == digest[:digits]:
                made[-1] = made[-1][0], unify(made[-1][1], own)
            else:
                made.append((digest, own))
        held = made
    return held[0][1] if held else None


def _page_digest(page: str) -> str:
    return hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest()


def infer(pages: list[str]) -> tuple[str, list[str]]:
    """Wrapper of pages of one host, as a pattern, and the path to their content."""
    wrapper = learn(pages)
    return (wrapper.pattern(), content_path(wrapper)) if wrapper else ("", [])


def rules_of(wrapper: Group | None) -> list | None:
    """What extraction needs of a wrapper, a list of [key, template digest or "", whether the path leads through it,
    number of parts] in order of the groups; None if it is not usable."""
    if wrapper is None or len(wrapper.pages) < 2 or not slot_masses(wrapper).get(id(wrapper)):
        return None
    path = {id(p) for p in content_parts(wrapper)}
    out, todo = [], [wrapper]
    while todo:
        g = todo.pop()
        parts = [] if g.key != "#" and is_aside(_named(g.key), True) else g.parts
        out.append([g.key, g.text if g.key == "#" and is_template(g) else "", id(g) in path, len(parts)])
        todo += reversed(parts)
    return out


def _rule_tree(rules: list) -> list:
    """[key, digest, on the path, parts] from the list of ``rules_of``."""
    root: list = ["", "", False, []]
    open_ = [(root, 1)]
    for key, digest, on, n in rules:
        while not open_[-1][1]:
            open_.pop()
        above, left = open_[-1]
        open_[-1] = above, left - 1
        node = [key, digest, on, []]
        above[3].append(node)
        open_.append((node, n))
    return root[3][0]


# Extraction -------------------------------------------------------------------------------


def _find(node: Node, test) -> Node | None:
    todo = [node]
    while todo:
        node = todo.pop()
        if test(node):
            return node
        if not is_aside(node, True):
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return None


def _text_size(node: Node) -> int:
    return len(_plain([node]))


def content_of(root: Node, path: list[str]) -> tuple[list[Node], bool]:
    """The elements with the article; and whether they are known to be the article's own. Article elements that hold
    little of the page's text (cards before the story) are not it."""
    size = _text_size(root)
    articles, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "article":
            articles.append(node)
        elif node is root or not is_aside(node, True):
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    sizes = [_text_size(a) for a in articles]
    if articles and sum(sizes) >= ARTICLE_SHARE * size:
        largest = max(sizes)
        return ([articles[sizes.index(largest)]] if 2 * largest >= sum(sizes) else articles), True
    own = _find(root, lambda n: n.name == "main" or ".main" == n.marks.lower() or "articlebody" in n.marks.lower())
    if own and _text_size(own) >= ARTICLE_SHARE * size:
        return [own], True
    here = root
    for key in path:
        here = next((c for c in here.children if not isinstance(c, str) and c.key == key), None)
        if here is None:
            break
    else:
        if path:
            return [here], here.name not in ("body", "html")
    marked = _find(root, lambda n: n.name in ("div", "section", "td") and bool(n.marks) and bool(CONTENT.search(n.marks[1:])))
    return ([marked], True) if marked and _text_size(marked) >= ARTICLE_SHARE * size else ([root], False)


def blocks(root: Node, own: bool) -> list[str]:
    """Texts of the blocks in page order, white space folded."""
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.name in ("br", "wbr"):
            line.append(" " if item.name == "br" else "")
        elif item is root or not is_aside(item, own):
            if item.name in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return out


def _paired(items: list[tuple[str, list]], parts: list) -> list:
    """The wrapper's part for each item of a page, or None."""
    runs: list[list[int]] = []
    for i, (key, _) in enumerate(items):
        if runs and items[runs[-1][0]][0] == key:
            runs[-1].append(i)
        else:
            runs.append([i])
    first: dict = {}
    for p in parts:
        first.setdefault(p[0], p)
    out: list = [None] * len(items)
    for i, j in _aligned([items[r[0]][0] for r in runs], [p[0] for p in parts]):
        if i >= 0:
            part = parts[j] if j >= 0 else first.get(items[runs[i][0]][0])
            for k in runs[i]:
                out[k] = part
    return out


def matched(root: Node, rules: list) -> str:
    """Text of the content by a wrapper's rules. A page that lacks the path is read from where it ends; of it
    only the article's own element, if markup names just one."""
    _any_depth()
    here, only = root, None
    while any(p[2] for p in rules[3]):
        items = items_of(here)
        at = next((i for i, p in enumerate(_paired(items, rules[3])) if p is not None and p[2]), None)
        if at is None:
            only = _sole(here, "article") or _sole(here, "main")
            break
        here, rules = items[at][1][0], next(p for p in rules[3] if p[2])
    own = only is not None or here.name not in ("body", "html")
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    def read(node: Node, parts: list, on: bool) -> None:
        items = items_of(node)
        for (key, members), part in zip(items, _paired(items, parts), strict=True):
            if key == "#":
                if on and not (part and part[1] and node.name not in HEADINGS and part[1] == _digest(_plain(members))):
                    line.append(_raw(members, own))
                continue
            child = members[0]
            if is_aside(child, own):
                continue
            block = child.name in BLOCKS
            flush() if block else line.append("".join(members[1:]))
            read(child, part[3] if part else [], on or child is only)
            if block:
                flush()

    read(here, rules[3], only is None or only is here)
    flush()
    return "\n\n".join(out)


def _sole(root: Node, name: str) -> Node | None:
    """The element of this name, if there is one only."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == name:
            found.append(node)
        elif not is_aside(node, True):
            todo += [c for c in node.children if not isinstance(c, str)]
    return found[0] if len(found) == 1 else None


def extract(page: str | None, path: list[str], rules: list | None = None) -> str:
    root = parse(page or "")
    if rules:
        return matched(root, rules)
    found, own = content_of(root, path)
    return "\n\n".join(b for node in found for b in blocks(node, own))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, path, rules) for each non-empty host; path is a JSON list of keys, rules JSON for ``extract``."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host != '' and html is not null")

    def read(batches):
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                made = [(_page_digest(page), wrapper_of(page).packed()) for page in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d for d, _ in made], pa.string()), pa.array([w for _, w in made], pa.string())], ["host", "digest", "part"])

    def merge(digits: int, last: bool):
        def run(batches):
            _any_depth()
            held, names = None, ["host", "wrapper", "path", "rules"] if last else ["host", "digest", "part"]

            def done():
                host, digest, wrapper = held
                if last:
                    values = host, wrapper.pattern(), json.dumps(content_path(wrapper)), json.dumps(rules_of(wrapper), separators=(",", ":"))
                else:
                    values = host, digest, wrapper.packed()
                return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in values], names)

            for batch in batches:
                for host, digest, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                    host, digest, own = host.as_py(), digest.as_py(), Group.unpacked(data.as_py())
                    if held and held[0] == host and held[1][:digits] == digest[:digits]:
                        held = host, held[1], unify(held[2], own)
                    else:
                        if held:
                            yield done()
                        held = host, digest, own
            if held:
                yield done()

        return run

    # copies go first; the shuffle deals by host and html, so that a large host is many tasks' work
    grown = rows.distinct().mapInArrow(shared.tidy(read), "host string, digest string, part string")
    for digits in LEVELS:
        dealt = grown.repartition("host", F.substring("digest", 1, digits)) if digits else grown.repartition("host")
        last = not digits
        fields = "host string, wrapper string, path string, rules string" if last else "host string, digest string, part string"
        grown = dealt.sortWithinPartitions("host", "digest").mapInArrow(shared.tidy(merge(digits, last)), fields)
    return grown


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars.

    A null html counts as empty and gives an empty text. A page without a url or host is read
    by its markup alone. The result depends on the pages alone, not on their order or partitions. Repeated rows give equal rows; other columns are not read; an empty
    table gives no rows.
    """
    known = shared.cut_lineage(wrappers(pages, url_col, html_col).select(F.col("host").alias("w"), "path", "rules"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    hosts, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("rules")), F.lit(0))).first()
    side = F.broadcast(known) if hosts <= BROADCAST_HOSTS and size <= BROADCAST_BYTES else known
    rows = rows.join(side, F.col("host") == F.col("w"), "left").select("id", "url", "html", "path", "rules")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                paths = {p: json.loads(p) if p else [] for p in set(part.column(3).to_pylist())}
                rules = {r: _rule_tree(found) if r and (found := json.loads(r)) else None for r in set(part.column(4).to_pylist())}
                texts = [extract(h, paths[p], rules[r]) for h, p, r in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(shared.tidy(run), f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
