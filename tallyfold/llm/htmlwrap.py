"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over tags and texts. It is made from all pages of a host. The
token streams of 8 of them are aligned one after another, then every page, whole, is matched with the result:
what it explains changes no more than the constants that the page has otherwise, and the forms of all other
pages are aligned in a tree of merges and then with it. Equal tags stay; runs of the same tags become repeated
groups; what only one side has becomes an optional group; texts that differ become slots, and texts that are
the same on every page stay constants. Pages and wrappers are aligned whole, however long they are: long ones at
the tags and texts that both have once, and between them by a longest common sequence, with one bit for a part.
Where a wrapper grows over 2,000 tags and texts, its optional groups become gaps, which stand for anything; what
all pages have stays, with its constants. The wrapper also knows in which element its slots hold most text,
summed over all pages that need it.

Every page is matched, whole, with its host's expression, and read in its content element: all text there is
main text, also what a host writes on each of its pages (a heading such as "Method"), but for what fixed tag
and class lists name: menus, adverts, forms, comments and the like. Pages without an article or main element
are read in the element that the wrapper found, so there the wrapper decides. Of its constants there, headings
with nothing of the page below them are left out, and where that element is the whole body, all but headings.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import staged

SAMPLE = 8  # pages of a host that its wrapper begins with, before all are matched
SAMPLE_CHARS = 100_000  # it begins with shorter pages
WIDEST = 2000  # tags and texts of a wrapper, beyond which its optional groups become gaps
ALIGNED = 2_000_000  # product of two sides' lengths, up to which they are aligned by SequenceMatcher
MASKS = 256  # frequent parts whose places are kept as bits
FAN = 16  # forms of pages merged in one task
HELD = 8_000_000  # characters of pages whose forms a task holds
PATHS = 200_000  # elements that a task counts before it passes them on
LEAST_PAGES = 3  # different pages from which a common text counts as the template's
_SALTS = 64
BROADCAST_ROWS = 100_000  # of about 100 bytes: sampled pages
BROADCAST_CHARS = 32_000_000  # of all wrappers together; more are joined by a shuffle

# Elements of HTML by their role.
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|select|object"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("head title nav footer aside form script style noscript template textarea iframe svg math select object button dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
# Class and id names of what is no main text: a whole name, with customary words before or after it.
_CLASSES = re.compile(
    r"(?:(?:site|global|top|main)-(?:header|footer)|header|footer|masthead|skip-link|"
    r"(?:(?:site|global|top|main|primary|secondary|mobile|user|reader)-)?(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget|notices?|cookies?|consent|gdpr|banner|ads?|advert\w*|sponsor\w*|promo\w*|comments?|discussions?|feedback|disqus|replies|respond|responses|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|pagination|pager)"
    r"(?:-(?:bar|box|list|area|section|block|container|wrapper|wrap|inner|form|links?|buttons?|icons?|menu|nav|banner|notice|thread|posts?|articles?|items?|slot|unit|widget|body|author|text))*)",
    re.I,
)
# Elements that class names say nothing about: those of running text. Names that a part of an article may also
# have (a study of social animals, related work) count there only for boxes.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th em strong b i u a span code q cite html body article main".split())
_BOXES = frozenset("div aside ul ol".split())
_EITHER = re.compile(r"(?:related|recommended|social|widget|banner|promo\w*|header|footer|discussions?|feedback|responses|respond|menu|notices?|share|sharing)", re.I)
# No attribute reaches over a <, so that a page is read in one pass however broken it is.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s<>"'][^\s<>]*+)"""
_ATTRS = rf"(?:[\s/]++|[^\s/<>=][^\s/<>=]*+(?:\s*+=\s*+{_VALUE}?+)?+|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<({_RAW})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRS})>|[^<]++|<", re.S | re.I)
_ATTR = re.compile(r"""([^\s/<>=][^\s/<>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s<>"'][^\s<>]*+))?+)?+""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): kind is open, close or text; value is a tag's class, id and role, or the text."""
    for m in _TOKEN.finditer(page):
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "close", name, ""
            else:
                found: dict[str, str] = {}
                for a in _ATTR.finditer(m[4]) if m[4].strip() else ():
                    found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
                mark = " ".join(found[k] for k in ("class", "id") if found.get(k))
                if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
                    mark += " role:drop"
                yield "open", name, mark
        elif m[0][0] != "<" or m[0] == "<":
            yield "text", "", m[0]


def _clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


class Walk:
    """Texts of a page with the open elements around them; wrongly nested tags are closed by their parents.

    `stream` holds the page's block tags and marked tags, and # for each run of text, whatever inline tags
    are in it; `runs` holds each run's places in `items`. An item names its innermost open element in `nodes`,
    which names the one around it, so that deep pages take no longer than flat ones.
    """

    def __init__(self, page: str):
        self.items: list[tuple[int, str, bool]] = []  # node, text, dropped
        self.nodes: list[tuple[int, str, str]] = [(-1, "", "")]  # node around it, name, tag with its marks
        self.breaks: set[int] = set()
        self.stream: list[str] = []
        self.runs: list[list[int]] = []
        self._stack: list[tuple[str, str, bool, bool, int]] = []  # name, tag, dropped, in an article, node
        self._blocks: list[int] = []  # places of blocks in the stack
        self._open: Counter = Counter()
        stack = self._stack
        for kind, name, value in tokens(page):
            node, out = (stack[-1][4], stack[-1][2]) if stack else (0, False)
            if kind == "text":
                if value.strip():
                    if not self.stream or self.stream[-1] != "#":
                        self.stream.append("#")
                        self.runs.append([])
                    self.runs[-1].append(len(self.items))
                self.items.append((node, value, out))
            elif kind == "open":
                mark = _DIGITS.sub("0", value).strip()
                tag = f"{name}.{mark}" if mark else name
                if name == "br":
                    self.items.append((node, " ", out))
                if name in _BLOCK:
                    self.breaks.add(len(self.items))
                    # a paragraph ends at a block, also with inline elements left open in it
                    if self._blocks and stack[self._blocks[-1]][0] == "p":
                        self._close(self._blocks[-1])
                    if name == "li" and stack and stack[-1][0] == "li":
                        self._close(len(stack) - 1)
                if name in _VOID:
                    continue
                if name in _BLOCK or mark:
                    self.stream.append(f"<{tag}>")
                node, out, inside = (stack[-1][4], stack[-1][2], stack[-1][3]) if stack else (0, False, False)
                out = out or name in _DROP or (name == "header" and not inside) or "role:drop" in value
                if value and not out and name not in _TEXTUAL:
                    marks = [w for w in value.replace("_", "-").split() if _CLASSES.fullmatch(w)]
                    out = any(not inside or name in _BOXES or not _EITHER.fullmatch(w) for w in marks)
                self.nodes.append((node, name, tag))
                if name in _BLOCK:
                    self._blocks.append(len(stack))
                self._open[name] += 1
                stack.append((name, tag, out, inside or name in ("article", "main"), len(self.nodes) - 1))
            else:
                if name in _BLOCK:
                    self.breaks.add(len(self.items))
                if self._open[name]:
                    self._close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        self._close(0)

    def _close(self, at: int) -> None:
        """Closes the open elements from `at` on, so the stream is well nested whatever the page left out."""
        while len(self._stack) > at:
            name, tag, *_ = self._stack.pop()
            self._open[name] -= 1
            if name in _BLOCK or tag != name:
                self.stream.append(f"</{name}>")
        while self._blocks and self._blocks[-1] >= at:
            self._blocks.pop()

    def inside(self, found) -> list[bool]:
        """For each node whether it, or one around it, is of those that `found` (of a node's number) names."""
        out: list[bool] = []
        for k, (around, _, _) in enumerate(self.nodes):
            out.append((around >= 0 and out[around]) or found(k))
        return out

    def text_of(self, run: int) -> str:
        return _clean("".join(self.items[i][1] for i in self.runs[run]))

    def parts(self) -> list:
        """The stream with the texts: a wrapper that matches this page alone."""
        texts = iter(range(len(self.runs)))
        return [["#", self.text_of(next(texts))] if x == "#" else x for x in self.stream]


# A wrapper is a list of tags, "#" (a slot), ["#", text] (a constant), ["+", parts], ["?", parts] and a gap.
GAP = ["*", ["..."]]


def _shape(part) -> str:
    return part if isinstance(part, str) else "#" if part[0] == "#" else json.dumps(part)


def _slots(parts: list) -> list:
    return ["#" if not isinstance(p, str) and p[0] == "#" else p for p in parts]


def _groups(parts: list) -> set[tuple[str, ...]]:
    """What stands before each repeated group, and the group."""
    return {(_shape(parts[i - 1]) if i else "", *p[1]) for i, p in enumerate(parts) if not isinstance(p, str) and p[0] == "+"}


def _nested(group: list[str]) -> bool:
    """Whether a group of tags is one or more whole elements."""
    depth = 0
    for i, s in enumerate(group):
        depth += 0 if s == "#" else -1 if s[1] == "/" else 1
        if depth < 0 or (depth == 0 and i == 0):
            return False
    return depth == 0


def fold(parts: list, known: set[tuple[str, ...]] = frozenset(), longest: int = 10) -> list:
    """Three or more of one group of tags become a repeated group, and so does any number of a group known
    to be repeated at such a place; their texts become slots."""
    shape = [_shape(p) for p in parts]
    sizes = sorted({len(k) - 1 for k in known})
    out: list = []
    i = 0
    while i < len(parts):
        n = 0
        if shape[i][0] == "<" and shape[i][1] != "/":
            before = shape[i - 1] if i else ""
            n = next((n for n in sizes if (before, *shape[i : i + n]) in known), 0)
            n = n or next((n for n in range(2, min(longest, (len(parts) - i) // 3) + 1) if shape[i : i + n] == shape[i + n : i + 2 * n] == shape[i + 2 * n : i + 3 * n] and all(s[0] in "<#" for s in shape[i : i + n]) and _nested(shape[i : i + n])), 0)
        group = shape[i : i + n]
        if n:
            out.append(["+", group])
            while shape[i : i + n] == group:
                i += n
        else:
            out.append(parts[i])
            i += 1
    return out


def _agreed(a: list, b: list) -> list:
    """Two wrappers of one shape: texts that differ become slots."""
    return [x if x == y else "#" for x, y in zip(a, b, strict=True)]


def _width(parts: list) -> int:
    return sum(_width(p[1]) if not isinstance(p, str) and p[0] in "+?" else 1 for p in parts)


def _narrow(parts: list) -> list:
    """Optional groups and gaps that stand together, with the slots between, as one gap; constants and tags stay."""
    out: list = []
    loose: list = []
    for p in [*parts, None]:
        if p is not None and (p == "#" or (not isinstance(p, str) and p[0] in "?*")):
            loose.append(p)
            continue
        out += loose if all(x == "#" for x in loose) else [GAP]
        out += [] if p is None else [p]
        loose = []
    return out


def _shared(a: list[str], b: list[str]) -> np.ndarray:
    """For every length of b's beginning the most parts that it has in common, in order, with all of a.

    A bit for each part of b is 0 where that number grows; sums of whole numbers carry all bits through a part
    of a at once. What is held is a few such numbers and b's places.
    """
    at: dict[str, list[int]] = {}
    for j, s in enumerate(b):
        at.setdefault(s, []).append(j)

    def bits(s: str) -> int:
        held = bytearray(len(b) // 8 + 1)
        for j in at[s]:
            held[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(held, "little")

    kept = {s: bits(s) for s, _ in Counter(s for s in a if s in at).most_common(MASKS)}
    whole = (1 << len(b)) - 1
    free = whole
    for s in a:
        if s in at:
            hit = free & (kept[s] if s in kept else bits(s))
            free = ((free + hit) | (free - hit)) & whole
    grows = np.unpackbits(np.frombuffer((whole ^ free).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(grows, dtype=np.int64)]


def common(a: list[str], b: list[str], i: int = 0, k: int = 0) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of a longest common sequence; a is halved where b's best cut is known (Hirschberg)."""
    n = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - n
    m = next((m for m in range(most) if a[-1 - m] != b[-1 - m]), most)
    yield from ((i + x, k + x) for x in range(n))
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    if len(x) == 1 and x[0] in y:
        yield i + n, k + n + y.index(x[0])
    elif len(x) > 1 and y:
        half = len(x) // 2
        cut = int((_shared(x[:half], y) + _shared(x[half:][::-1], y[::-1])[::-1]).argmax())
        yield from common(x[:half], y[:cut], i + n, k + n)
        yield from common(x[half:], y[cut:], i + n + half, k + n + cut)
    yield from ((i + len(a) - m + x, k + len(b) - m + x) for x in range(m))


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of tags and texts that both sides have exactly once, the most of them that stand in one order."""
    once = []
    for parts in (a, b):
        keys = [p if isinstance(p, str) else "#" + p[1] if p[0] == "#" else "#" for p in parts]
        n = Counter(keys)
        once.append({k: i for i, k in enumerate(keys) if n[k] == 1 and k != "#"})
    pairs = [(i, once[1][k]) for k, i in once[0].items() if k in once[1]]
    ends: list[int] = []  # the smallest last place in b of so many in order, and which pair that is
    last: list[int] = []
    before = []
    for x, (_, k) in enumerate(pairs):
        at = bisect_left(ends, k)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [k], [x]
    out, x = [], last[-1] if last else -1
    while x >= 0:
        out.append(pairs[x])
        x = before[x]
    return out[::-1]


def _steps(a: list, b: list) -> Iterator[tuple[str, int, int, int, int]]:
    """What SequenceMatcher calls opcodes: stretches of equal shapes and stretches of others.

    Long sides are aligned at what both have once, and between by a longest common sequence.
    """
    x, y = [_shape(p) for p in a], [_shape(p) for p in b]
    if len(a) * len(b) <= ALIGNED:
        yield from SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return
    same: list[tuple[int, int]] = []
    i = k = 0
    for j, n in [*_anchors(a, b), (len(a), len(b))]:
        same += [*common(x[i:j], y[k:n], i, k), (j, n)]
        i, k = j + 1, n + 1
    i = k = run = 0  # the ends of what is done, and how much of it is equal
    for j, n in same:
        if j > i or n > k or j == len(a):
            if run:
                yield "equal", i - run, i, k - run, k
            if j > i or n > k:
                yield "replace", i, j, k, n
            run = 0
        i, k, run = j + 1, n + 1, run + 1


def align(wrapper: list, parts: list) -> list:
    """The wrapper that also matches `parts`: unequal texts to slots, one-sided parts to optional groups.

    Where that is wider than WIDEST, optional groups become gaps. They hold slots only, so no constant goes.
    """
    a = fold(wrapper, _groups(fold(parts)))
    b = fold(parts, _groups(a))
    out: list = []
    for op, i, j, k, n in _steps(a, b):
        if op == "equal":
            out += _agreed(a[i:j], b[k:n])
        else:
            for part in (a[i:j], b[k:n]):
                if GAP in part:
                    out.append(GAP)
                elif part:
                    out += part if len(part) == 1 and part[0][0] == "?" else [["?", _slots(part)]]
    return _narrow(out) if GAP in out or _width(out) > WIDEST else out


def shown(wrapper: list) -> str:
    """The wrapper as one writes it: (<li>#</li>)+ and the like."""
    return "".join(p if isinstance(p, str) else p[1] if p[0] == "#" else "(" + shown(p[1]) + ")" + p[0] for p in wrapper)


class Expression:
    """A wrapper compiled to a regular expression over one character for each tag and T for a text.

    Groups are possessive, so a page is matched in one pass. Any text may be missing, and a text may stand
    behind any tag. With several gaps there is no one place for what stands between them, so no page is said to
    be of the form: all are aligned, and constants are found by their text.
    """

    def __init__(self, wrapper: list):
        self.letters: dict[str, str] = {"#": "T"}
        self.constants: list[str] = []
        written = self._written(wrapper)
        self.pattern = re.compile("T?+" + written) if wrapper.count(GAP) < 2 else None

    def _written(self, wrapper: list) -> str:
        out = []
        for i, p in enumerate(wrapper):
            if isinstance(p, str) and p != "#":
                follows = i + 1 < len(wrapper) and _shape(wrapper[i + 1]) == "#"
                out.append(re.escape(self.letters.setdefault(p, chr(0x10000 + len(self.letters)))) + ("" if follows else "T?+"))
            elif p == "#":
                out.append("T?+")
            elif p[0] == "*":
                out.append("(?s:.*)")
            elif p[0] == "#":
                self.constants.append(p[1])
                out.append("(T?+)")
            else:
                out.append(f"(?:{self._written(p[1])}){p[0]}+")
        return "".join(out)

    def _match(self, walk: Walk) -> re.Match | None:
        return self.pattern and self.pattern.fullmatch("".join([self.letters.get(x, "\x02") for x in walk.stream]))

    def _places(self, walk: Walk, m: re.Match) -> Iterator[tuple[int, int, bool]]:
        """(number, run, same text) of each constant in whose place the page has a text."""
        number = {at: run for run, at in enumerate(i for i, x in enumerate(walk.stream) if x == "#")}
        for k, text in enumerate(self.constants):
            if m.end(k + 1) > m.start(k + 1):
                run = number[m.start(k + 1)]
                yield k, run, walk.text_of(run) == text

    def differing(self, walk: Walk) -> list[int] | None:
        """Numbers of the constants in whose place the page has another text; None if it is not of this form."""
        m = self._match(walk)
        return None if m is None else [k for k, _, same in self._places(walk, m) if not same]

    def template_items(self, walk: Walk) -> set[int]:
        """Places in `walk.items` of the template's texts: those that stand where the wrapper has them.

        In a page that is not of this form they are taken by their text alone, each one once and in order.
        """
        m = self._match(walk)
        fixed: set[int] = set()
        if m is None:
            at = 0
            for text in self.constants:
                here = next((run for run in range(at, len(walk.runs)) if walk.text_of(run) == text), None)
                if here is not None:
                    fixed.update(walk.runs[here])
                    at = here + 1
            return fixed
        for _, run, same in self._places(walk, m):
            if same:
                fixed.update(walk.runs[run])
        return fixed


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of one host, aligned one after another."""
    wrapper: list = []
    for i, page in enumerate(sorted(set(pages))):
        parts = Walk(page).parts()
        wrapper = align(wrapper, parts) if i else fold(parts)
    return wrapper


def _own_element(walk: Walk) -> tuple[str, list[bool] | None]:
    """article or main, whichever of the page's own holds text, and the nodes in it; else nothing."""
    held_text = {node for node, text, dropped in walk.items if not dropped and text.strip()}
    for want in ("article", "main"):
        within = walk.inside(lambda k, want=want: walk.nodes[k][1] == want)
        if any(within[k] for k in held_text):
            return want, within
    return "", None


def measured(walk: Walk, form: Expression) -> dict[int, tuple[int, str, int, int]]:
    """By an element's number its parent's, its tag, the text in it that is not the template's, how often it is there.

    Elements are known by the tags around them. Only blocks are counted; number 0 is the page.
    """
    fixed = form.template_items(walk)
    own = [0] * len(walk.nodes)
    for i, (node, text, dropped) in enumerate(walk.items):
        if not dropped and i not in fixed:
            own[node] += len(text.strip())
    path = [0] * len(walk.nodes)
    for k, (around, _, tag) in enumerate(walk.nodes[1:], 1):
        path[k] = xxhash.xxh3_64_intdigest(f"{path[around]}\t{tag}") >> 1
    out: dict[int, tuple[int, str, int, int]] = {}
    for k in range(len(walk.nodes) - 1, -1, -1):
        around, name, tag = walk.nodes[k]
        if not k or name in _BLOCK:
            _, _, size, times = out.get(path[k], (0, "", 0, 0))
            out[path[k]] = (path[around] if k else -1, tag, size + own[k], times + 1)
        if k:
            own[around] += own[k]
    return out


def content_path(elements: list[tuple[int, int, str, int, int]], pages: int) -> str:
    """The tags that lead to the deepest element, one a page, that keeps most of the slots' text."""
    below: dict[int, list[tuple[str, int, int]]] = {}
    best, whole, tags = 0, 0, []
    for number, parent, tag, size, times in elements:
        if parent < 0:
            whole = size
        elif times <= pages and tag.split(".")[0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            below.setdefault(parent, []).append((tag, size, number))
    while True:
        top = max(sorted(below.get(best, [])), key=lambda x: x[1], default=None)
        if top is None or top[1] < 0.7 * whole:
            return "\t".join(tags)
        tags.append(top[0])
        _, whole, best = top


def _left_out(walk: Walk, fixed: set[int], home: list[bool] | None, whole_body: bool) -> set[int]:
    """Of the template's texts those that are none of the page's: headings with nothing of the page below them and,
    where the content element is the whole body, all but headings."""
    headings = walk.inside(lambda k: walk.nodes[k][1] in ("h1", "h2", "h3", "h4", "h5", "h6"))
    out, below = set(), False  # whether text of the page follows
    for i in range(len(walk.items) - 1, -1, -1):
        node, text, dropped = walk.items[i]
        if dropped or not text.strip() or not (home is None or home[node]):
            continue
        if i not in fixed:
            below = True
        elif headings[node]:
            if not below:
                out.add(i)
        elif whole_body:
            out.add(i)
            below = False
    return out


def extract_text(page: str | None, content: str = "", form: Expression | None = None) -> str:
    """Blocks of the main text, joined by line breaks.

    `content` is article, main or the tags that lead to the host's content element. An article or main element
    of the page goes before; a page without any of them is read whole. Of pages without an article or main
    element, headings that `form` has at their place on every page are left out where no text of the page
    follows; and where a host has no element of its own for its content (it is the body), so are other such
    texts.
    """
    if not page:
        return ""
    walk = Walk(page)
    _, home = _own_element(walk)
    fixed: set[int] = set()
    if home is None and content not in ("article", "main"):
        tags = content.split("\t") if content else []
        on = [0] * len(walk.nodes)  # how many of the tags lead to the node, or -1; inside of them all, all
        for k, (around, _, tag) in enumerate(walk.nodes[1:], 1):
            at = on[around]
            on[k] = at if at == len(tags) else at + 1 if at >= 0 and tag == tags[at] else -1
        within = [x == len(tags) for x in on]
        if any(within[node] for node, text, dropped in walk.items if not dropped and text.strip()):
            home = within
        if form:
            fixed = _left_out(walk, form.template_items(walk), home, not tags or tags[-1].split(".")[0] in ("html", "body"))
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        block = _clean("".join(held))
        if block:
            blocks.append(block)
        held.clear()

    for i, (node, text, dropped) in enumerate(walk.items):
        if i in walk.breaks:
            end()
        if not dropped and i not in fixed and (home is None or home[node]):
            held.append(text)
    end()
    return "\n".join(blocks)


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _handed(rows: DataFrame, made: DataFrame) -> tuple[DataFrame, object]:
    """`rows` with their hosts' content and rules, and None; or with nulls, and a broadcast table, if all are short."""
    if (made.agg(F.sum(F.length("rules") + F.length("content") + F.length("host"))).first()[0] or 0) <= BROADCAST_CHARS:
        known = rows.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in made.select("host", "content", "rules").collect()})
        return rows.select("*", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("rules")), known
    return rows.join(made, "host", "left").select(*rows.columns, "content", "rules"), None


class _Forms:
    """A host's content element and expression, compiled once a task for hosts in use."""

    def __init__(self, known: object):
        self.known, self.made = known, {}

    def of(self, host: str, content: str | None, rules: str | None) -> tuple[str, Expression | None]:
        if host not in self.made:
            if len(self.made) > 1000:
                self.made.clear()
            content, rules = self.known.value.get(host, ("", None)) if self.known is not None else (content, rules)
            self.made[host] = content or "", Expression(json.loads(rules)) if rules else None
        return self.made[host]


def _learned(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """What all pages (host, html) say about the wrappers that they begin with: host, kind, at, form, n.

    Counts of pages by the element that they have of their own (kind bare, article or main), the constants
    that a page has otherwise (differs, at: its number) and the forms of pages that are not of the wrapper's
    (form; at: hash of the shape). Pages of one shape are one form in a task.
    """
    rows, known = _handed(rows, seeds)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers, counts, forms, held = _Forms(known), Counter(), {}, 0

        def said() -> pa.RecordBatch:
            out = [(*k, None, n) for k, n in counts.items()] + [(host, "form", at, json.dumps(parts), 1) for (host, at), parts in forms.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["host", "kind", "at", "form", "n"])

        for b in batches:
            for host, page, content, rules in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                walk, form = Walk(page), wrappers.of(host, content, rules)[1]
                counts[host, _own_element(walk)[0] or "bare", 0] += 1
                other = form.differing(walk) if form else None
                for k in other or ():
                    counts[host, "differs", k] += 1
                if other is None:
                    parts = fold(walk.parts())
                    key = host, xxhash.xxh3_64_intdigest("\n".join(_shape(p) for p in parts)) >> 1
                    held += 0 if key in forms else len(page)
                    forms[key] = _agreed(forms[key], parts) if key in forms else parts
            if held > HELD or len(counts) > PATHS:
                yield said()
                counts.clear()
                forms.clear()
                held = 0
        yield said()

    return staged(rows.select("host", "html", "content", "rules").mapInArrow(learn, "host string, kind string, at long, form string, n long"), "learned")


def _merged(forms: DataFrame) -> DataFrame:
    """host, rules: all forms (host, at, form) of each host aligned, about 16 shapes in a task, in as many rounds as that takes."""
    sizes = forms.groupBy("host").agg(F.countDistinct("at").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper, shape, of_shape = None, None, []
        for at, rules in [*sorted(zip(pdf["at"], pdf["rules"], strict=True)), (None, None)]:
            parts = json.loads(rules) if rules is not None else None
            if parts is not None and at == shape:
                of_shape = _agreed(of_shape, parts)
                continue
            if shape is not None:
                wrapper = of_shape if wrapper is None else align(wrapper, of_shape)
            shape, of_shape = at, parts
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "rules": [json.dumps(wrapper)]})

    now = forms.join(sizes, "host").select("host", F.pmod("at", F.ceil(F.col("n") / FAN)).cast("long").alias("chunk"), "at", F.col("form").alias("rules"))
    while True:
        now = staged(now.groupBy("host", "chunk").applyInPandas(merge, "host string, chunk long, rules string"), "merged")
        if most <= FAN:
            return now.select("host", F.col("rules").alias("others"))
        most = -(-most // FAN)
        now = now.select("host", F.floor(F.col("chunk") / FAN).cast("long").alias("chunk"), F.col("chunk").alias("at"), "rules")


def _contents(rows: DataFrame, made: DataFrame) -> DataFrame:
    """host, content: the element that keeps most text, over all pages without an article or main element; made: host, content, rules, bare."""
    rows, known = _handed(rows, made.select("host", "content", "rules"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers, found = _Forms(known), {}

        def said() -> pa.RecordBatch:
            out = [(host, number, *v) for (host, number), v in found.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "number", "parent", "tag", "size", "times"])

        for b in batches:
            for host, page, content, rules in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                form = wrappers.of(host, content, rules)[1]
                walk = Walk(page) if form else None
                if walk is None or _own_element(walk)[0]:
                    continue
                for number, (parent, tag, size, times) in measured(walk, form).items():
                    _, _, before, n = found.get((host, number), (0, "", 0, 0))
                    found[host, number] = parent, tag, before + size, n + times
                if len(found) > PATHS:
                    yield said()
                    found.clear()
        yield said()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        elements = list(pdf[["number", "parent", "tag", "size", "times"]].itertuples(index=False, name=None))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "content": [content_path(elements, int(pdf["bare"].iloc[0]))]})

    sums = rows.select("host", "html", "content", "rules").mapInArrow(measure, "host string, number long, parent long, tag string, size long, times long")
    sums = sums.groupBy("host", "number", "parent", "tag").agg(F.sum("size").alias("size"), F.sum("times").alias("times")).where("size > 0")
    return sums.join(made.select("host", "bare"), "host").groupBy("host").applyInPandas(choose, "host string, content string")


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper, content, n_sample, n_pages, rules for every host of `pages` that has a page with text.

    All pages teach, of any length. A host's wrapper begins with n_sample pages, 8 different ones of up to
    100,000 characters, those with the smallest hashes; they are chosen from light columns, first within salted
    parts of a host, so a hot host is shared out. Then all pages are matched with it, and what it does not
    explain is merged into it (see above). n_pages counts the different pages. `content` is summed over all
    rows without an article or main element of their own, the ones that need it; if there are none, it is
    article or main. `wrapper` is the expression as one writes it, `rules` the same as JSON.
    """
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"), F.col(id_col).cast("long").alias("page_id")).where(F.length("html") > 0)
    hashed = rows.select("host", F.xxhash64("html").alias("h"), "page_id", F.length("html").alias("chars"))
    light = hashed.where((F.col("chars") <= SAMPLE_CHARS) & F.col("page_id").isNotNull()).groupBy("host", "h").agg(F.min("page_id").alias("page_id")).withColumn("salt", F.pmod("h", F.lit(_SALTS)))
    first = light.withColumn("n", F.row_number().over(Window.partitionBy("host", "salt").orderBy("h"))).where(F.col("n") <= SAMPLE)
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("n") <= SAMPLE).select("host", "page_id", "h")
    chosen = staged(chosen, "sampled")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sample = rows.select("page_id", "html", F.xxhash64("html").alias("h")).join(chosen, ["page_id", "h"])
    sample = sample.groupBy("host", "h").agg(F.min("html").alias("html"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "content": [""], "rules": [json.dumps(infer(pdf["html"].tolist()))], "n_sample": [len(pdf)]})

    seeds = staged(sample.groupBy("host").applyInPandas(make, "host string, content string, rules string, n_sample long"), "seeds")
    learned = _learned(rows.select("host", "html"), seeds.select("host", "content", "rules"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    facts = learned.groupBy("host").agg(count("bare"), count("article"), F.sort_array(F.collect_set(F.when(F.col("kind") == "differs", F.col("at")))).alias("differs"))
    facts = facts.join(hashed.groupBy("host").agg(F.countDistinct("h").alias("n_pages")), "host").join(seeds.select("host", "rules", "n_sample"), "host", "left")
    facts = facts.join(_merged(learned.where("kind = 'form'").select("host", "at", "form")), "host", "left").select("host", "bare", "article", "n_pages", F.coalesce("n_sample", F.lit(0).cast("long")).alias("n_sample"), "differs", "rules", "others")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n_pages, differs, rules, others in zip(*(b.column(i).to_pylist() for i in (3, 5, 6, 7)), strict=True):
                wrapper = json.loads(rules or others)
                constants = [i for i, p in enumerate(wrapper) if not isinstance(p, str) and p[0] == "#"]  # groups hold none
                for k in differs:
                    wrapper[constants[k]] = "#"
                wrapper = align(wrapper, json.loads(others)) if rules and others else wrapper
                out.append(_slots(wrapper) if n_pages < LEAST_PAGES else wrapper)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array([shown(w) for w in out], pa.string()), pa.array([json.dumps(w) for w in out], pa.string())], names=["host", "bare", "article", "n_pages", "n_sample", "wrapper", "rules"])

    made = staged(facts.mapInArrow(finish, "host string, bare long, article long, n_pages long, n_sample long, wrapper string, rules string"), "made")
    needed = made.where("bare > 0").withColumn("content", F.lit(""))
    content = F.when(F.col("bare") > 0, F.coalesce("path", F.lit(""))).when(F.col("article") > 0, F.lit("article")).otherwise(F.lit("main"))
    if not needed.isEmpty():
        made = made.join(_contents(rows.select("host", "html"), needed).withColumnRenamed("content", "path"), "host", "left")
    else:
        made = made.withColumn("path", F.lit(""))
    return made.select("host", "wrapper", content.alias("content"), "n_sample", "n_pages", "rules")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    Each whole page, however long, is read with its host's wrapper. Null or empty pages give an empty text;
    pages without a usable url share the wrapper of the empty host; repeated rows come back as they are; an
    empty table gives no rows; other columns are ignored.
    """
    made = staged(wrappers(pages, id_col, url_col, html_col).select("host", "content", "rules"), "wrappers")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    rows, known = _handed(rows, made)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms(known)
        for b in batches:
            texts = []
            for page, host, content, rules in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                texts.append(extract_text(page, *forms.of(host, content, rules)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
