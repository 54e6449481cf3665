"""HTML to the text that a reader sees, with its layout.

A tokenizer feeds a tree builder that supplies the end tags HTML leaves out (paragraphs, list items,
table parts, options) and treats script and style as raw text. A renderer walks the
tree: elements hidden by kind, attribute, inline style or style sheet rules are left out;
blocks stand on lines of their own with blank lines around paragraphs and headings, lists are
indented with their markers, preformatted text keeps its spaces, and table cells are aligned.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks

# ---------------------------------------------------------------- fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER_SHOWN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas annotation annotation-xml datalist area param source track".split())
BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul xmp caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu table figure xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Start tag -> (elements it ends, elements beyond which it ends nothing)
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Inside svg only these show text, and nothing within those.
SVG_TEXT, SVG_NEVER = frozenset("text foreignobject".split()), frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient".split())
#: Elements of math whose parts stand apart on the page.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr mtd mmultiscripts".split())
#: HTML elements that end svg and math, and the elements there that may hold them.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INSETS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: What may stand in head; anything else, or text, ends it and opens the body.
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
#: Where the search for an element to close by </p> and the like stops.
BARRIERS = frozenset("table td th caption html template button object".split())
#: Width beyond which cells are wrapped, and columns to which nested lists and quotes are indented at most.
WRAP, MAX_INDENT = 60, 512
#: HTML's own limits.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_WS = " \\t\\n\\f\\r"
#: The attributes of a tag: a quote opens a value only behind "=".
_ATTRS = rf"(?:[{_WS}/]++|[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+=[{_WS}]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^{_WS}>\"'][^{_WS}>]*+|(?=>)|\Z))?+)*+"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^{_WS}/>]*+){_ATTRS}(?:>|\Z)|<([A-Za-z][^{_WS}/>]*+)({_ATTRS})(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^{_WS}/>][^{_WS}/>=]*+)(?:[{_WS}]*+=[{_WS}]*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^{_WS}>\"'][^{_WS}>]*+)?))?")
#: The screen for which media queries are answered, in CSS pixels.
SCREEN = {"width": 1280, "height": 800, "device-width": 1280, "device-height": 800}
FEATURES = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "color": "8", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "enabled", "update": "fast", "grid": "0", "display-mode": "browser", "forced-colors": "none"}
DISPLAYS = frozenset("none block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item contents run-in ruby math initial inherit unset revert revert-layer -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split())
_CSS_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|\"(?:[^\"\\\n]|\\.)*+(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|[{};]|\((?:[^()\"']|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+')*+\)|[^\"'{};/<(-]++|.", re.S)
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+|var\(.*\))(?:\s+[a-z-]+)*\s*(!\s*important)?\s*\Z", re.I | re.S)
_COMPOUND = re.compile(r"(?:(\*|[A-Za-z][\w-]*))?((?:[.#](?:[\w-]|[^\x00-\x7f]|\\.)+|\[[^\]\"']*+(?:\"[^\"]*+\"|'[^']*+')?+[^\]\"']*+\]|:not\([^()]+\)|:root)*)\Z", re.S)
_PART = re.compile(r"([.#])((?:[\w-]|[^\x00-\x7f]|\\.)+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*([iIsS])?\s*)?\]|:not\(([^()]+)\)|(:root)", re.S)
_LENGTH = re.compile(r"([\d.]+)(px|em|rem|cm|mm|in|pt|pc)?\Z")
_UNIT = {"px": 1, "em": 16, "rem": 16, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "in": 96, "pt": 96 / 72, "pc": 16, None: 1}
_SPACE = re.compile(r"[ \t\n\f\r]+")
_BLANK = re.compile(r"[ \t\n\f\r]*\Z")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(self.attrs):
            out.setdefault(name.lower(), html.unescape(a or b or c))
        return out


def parse(text: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree, and media query and text of all style sheets."""
    root = Node("html")
    stack = [root]
    # Where on the stack the open elements of each tag are, and the blocks and barriers among them.
    open_: dict[str, list[int]] = {"html": [0]}
    blocks, barriers = [0], [0]
    styles: list[tuple[str, str]] = []
    pos, size, headless = 0, len(text), False

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        tag, at = node.tag, len(stack)
        stack.append(node)
        open_.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            blocks.append(at)
        if tag in BARRIERS:
            barriers.append(at)

    def content(s: str) -> None:
        nonlocal headless
        s = html.unescape(s)
        if not headless and not _BLANK.match(s):
            headless = True
            if stack[-1].tag == "head":
                pop()
                push(Node("body"))
            elif open_.get("head"):  # in a template or the like
                headless = False
        stack[-1].children.append(s)

    def pop() -> None:
        tag = stack.pop().tag
        open_[tag].pop()
        if tag in BLOCKS:
            blocks.pop()
        if tag in BARRIERS:
            barriers.pop()

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def close(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        at = last(tags)
        if at and at >= (blocks[-1] if until is BLOCKS else barriers[-1] if until is BARRIERS else last(until)):
            while len(stack) > at:
                pop()

    while pos < size:
        m = _TOKEN.search(text, pos)
        if m is None:
            content(text[pos:])
            break
        if m.start() > pos:
            content(text[pos : m.start()])
        pos = m.end()
        end, start = m[1], m[2]
        if start:
            tag = start.lower()
            if tag == "head":
                if not headless and not open_.get("head"):
                    push(Node(tag, m[3]))
                continue
            if not headless and tag not in HEAD and tag != "html" and (stack[-1].tag == "head" or not open_.get("head")):
                headless = True
                if stack[-1].tag == "head":
                    pop()
                    if tag != "body":
                        push(Node("body"))
            if tag in BREAKOUT and (open_.get("svg") or open_.get("math")):
                close({"svg", "math"}, INSETS)
            if tag in ENDS_P:
                close({"p"}, BARRIERS)
            if tag in IMPLIED_ENDS:
                close(*IMPLIED_ENDS[tag])
            if tag in ("html", "body") and open_.get(tag):
                continue
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
            node = Node(tag, m[3])
            if tag in VOID:
                stack[-1].children.append(node)
                continue
            if tag in RAW:
                stack[-1].children.append(node)
                stop = re.compile(f"</{tag}[\\s/>]", re.I).search(text, pos)
                raw = text[pos : stop.start() if stop else size]
                if tag == "style":
                    if not open_.get("template"):
                        styles.append((node.attributes().get("media", "") if m[3] else "", raw))
                else:
                    node.children.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
                after = text.find(">", stop.end() - 1) if stop else -1
                pos = after + 1 if after >= 0 else size
                continue
            foreign = tag in ("svg", "math") or (open_.get("svg") or open_.get("math")) and not open_.get("foreignobject")
            if foreign and m[3][-1:] == "/" and max((a.end() for a in _ATTR.finditer(m[3])), default=0) < len(m[3]):
                stack[-1].children.append(node)
            else:
                push(node)
        elif end:
            tag = end.lower()
            if tag == "head":
                if open_.get("head"):
                    close({"head"}, frozenset())
                    headless = True
            elif tag == "br":
                if stack[-1].tag == "head":
                    pop()
                    push(Node("body"))
                    headless = True
                stack[-1].children.append(Node("br"))
            elif tag in ("html", "body"):
                continue
            elif tag in BLOCKS:
                close({tag}, {"table"} if tag in ("td", "th", "tr", "caption", "thead", "tbody", "tfoot") else BARRIERS if tag != "table" else {"html"})
            elif tag in ("template", "object"):
                close({tag}, BARRIERS - {tag} if tag == "object" else frozenset())
            elif open_.get(tag):
                close({tag}, BLOCKS)
    return root, styles


def _length(value: str) -> float | None:
    m = _LENGTH.match(value.strip())
    try:
        return float(m[1]) * _UNIT[m[2]] if m else None
    except ValueError:
        return None


def _feature(text: str) -> bool:
    """A media feature in its parentheses; one that is not known does not hold."""
    t = " ".join(text.lower().split())
    if t[:4] == "not " or t[:1] == "(":
        return _condition(t)
    name, colon, value = (x.strip() for x in t.partition(":"))
    if colon:
        bound, bare = name[:4], name[4:]
        if bound in ("min-", "max-") and bare in SCREEN:
            n = _length(value)
            return n is not None and (SCREEN[bare] >= n if bound == "min-" else SCREEN[bare] <= n)
        if name in SCREEN:
            return _length(value) == SCREEN[name]
        if bound in ("min-", "max-") and bare == "color":
            return value.isdigit() and (int(value) <= 8 if bound == "min-" else int(value) >= 8)
        return FEATURES.get(name) == value
    parts = [x.strip() for x in re.split(r"(<=|>=|<|>|=)", t)]
    if len(parts) > 1:
        sizes = [SCREEN[x] if x in SCREEN else _length(x) for x in parts[::2]]
        holds = {"<": float.__lt__, ">": float.__gt__, "<=": float.__le__, ">=": float.__ge__, "=": float.__eq__}
        return all(a is not None and b is not None and holds[op](float(a), float(b)) for a, op, b in zip(sizes, parts[1::2], sizes[1:], strict=False))
    return t in SCREEN or FEATURES.get(t, "none") not in ("none", "0", "no-preference")


def _condition(text: str) -> bool:
    """Features joined by and, or, not."""
    depth, start, value, joint, negate, word = 0, 0, None, "and", False, ""
    for i, c in enumerate(text):
        if c == "(":
            if not depth:
                for w in word.split():
                    joint, negate = (w, negate) if w in ("and", "or") else (joint, w == "not")
                start, word = i + 1, ""
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                one = _feature(text[start:i]) != negate
                value, negate = one if value is None else (value and one if joint == "and" else value or one), False
        elif not depth:
            word += c
    return bool(value) and not word.strip()


def on_screen(query: str) -> bool:
    """Whether a media query list holds on SCREEN (an empty one does)."""
    if not query.strip():
        return True
    for q in re.split(r",(?![^()]*\))", query.lower()):
        q = q.strip()
        m = re.match(r"(not|only)?\s*\b(?!not\b|only\b)([a-z][\w-]*)\s*(?:and\b(.*))?\Z", q, re.S)
        if m:
            holds = m[2] in ("all", "screen") and (m[3] is None or _condition(m[3]))
            holds = holds != (m[1] == "not")
        else:
            holds = _condition(q)
        if holds:
            return True
    return False


def _compound(text: str) -> tuple | None:
    """(tag or '', parts, weight); None for what is not supported."""
    m = _COMPOUND.match(text)
    if not m or not text:
        return None
    tag = "" if m[1] in (None, "*") else m[1].lower()
    parts, weight = [], [0, 0, bool(tag)]
    for mark, name, attr, op, a, b, c, fold, inner, _ in _PART.findall(m[2]):
        if mark:
            parts.append((mark, re.sub(r"\\(.)", r"\1", name)))
            weight[mark == "."] += 1
        elif attr:
            parts.append(("[", attr.lower(), op, a or b or c, fold in ("i", "I")))
            weight[1] += 1
        elif inner:
            options = [_compound(x.strip()) for x in inner.split(",")]
            if None in options:
                return None
            parts.append(("not", options))
            top = max(o[2] for o in options)
            weight = [x + y for x, y in zip(weight, top, strict=True)]
        else:
            parts.append(("root",))
            weight[1] += 1
    return tag, parts, tuple(int(x) for x in weight)


def _selector(text: str) -> tuple[list, tuple] | None:
    """Groups from right to left, each a list of compounds joined by '>', and the weight; None for what is not supported."""
    groups, weight, child = [[]], (0, 0, 0), True
    tokens = re.findall(r">|(?:[^\s>\[(]|\[[^\]]*\]|\([^)]*\))+", text)
    for t in reversed(tokens):
        if t == ">":
            child = True
            continue
        c = _compound(t)
        if c is None:
            return None
        if not child:
            groups.append([])
        groups[-1].append(c)
        child = False
        weight = tuple(x + y for x, y in zip(weight, c[2], strict=True))
    return (groups, weight) if groups[0] and tokens[-1] != ">" and tokens[0] != ">" else None


class Sheet:
    """What the style sheets say of display and visibility.

    Selectors are compounds of tag, class, id, attribute, :not() and :root, joined by descendant and
    child combinators; rules with others are left out. The cascade is CSS's: importance, inline
    style, layers, specificity, order. Rules inside @media count where the query holds on SCREEN.
    """

    def __init__(self, styles: list[tuple[str, str]]):
        self.rules: dict[str, list] = {}
        self.order = 0
        for media, css in styles:
            if ("display" in (low := css.lower()) or "visibility" in low) and on_screen(media):
                self._read(css)

    def _read(self, css: str) -> None:
        # Open blocks: (rules inside count, selectors that declarations inside are for, in a layer)
        blocks: list[tuple[bool, list, bool]] = [(True, [], False)]
        text: list[str] = []
        for t in _CSS_TOKEN.findall(css):
            if t[:2] == "/*" or t in ("<!--", "-->"):
                continue
            if t == "{":
                head, (counts, own, layer) = "".join(text).strip(), blocks[-1]
                if head[:1] == "@":
                    name, _, rest = head[1:].partition(" ") if not head[1:].startswith(("media(", "supports(")) else (head[1 : head.index("(")], "", head[head.index("(") :])
                    name = name.strip().lower()
                    if name == "media":
                        counts = counts and on_screen(rest)
                    elif name == "supports":
                        counts = counts and not rest.strip().lower().startswith("not")
                    elif name == "layer":
                        layer = True
                    else:
                        counts = False
                    blocks.append((counts, own, layer))
                else:
                    found = [] if own or not counts else [x for x in map(_selector, re.findall(r"(?:[^,(\[]|\([^)]*\)|\[[^\]]*\])+", head)) if x]
                    blocks.append((counts and not own, found, layer))
                text = []
            elif t in ("}", ";"):
                self._declare("".join(text), *blocks[-1])
                text = []
                if t == "}" and len(blocks) > 1:
                    blocks.pop()
            else:
                text.append(t)
        self._declare("".join(text), *blocks[-1])

    def _declare(self, text: str, counts: bool, selectors: list, layer: bool) -> None:
        d = _declared(text) if counts and selectors else None
        if not d:
            return
        name, value, important = d
        self.order += 1
        for groups, weight in selectors:
            tag, parts, _ = groups[0][0]
            key = next((m + n for m, n, *_ in (x for x in parts if x[0] == "#")), None) or next((m + n for m, n, *_ in (x for x in parts if x[0] == ".")), None) or tag or "*"
            self.rules.setdefault(key, []).append((groups, name, (important, False, layer == important, weight, self.order), value))

    def look(self, node: Node, chain: tuple | None, svg: bool = False) -> tuple[bool, bool | None]:
        """Whether a node (its ancestors in chain, nearest first) is displayed, and its own visibility (None: its parent's)."""
        tag = node.tag
        if tag in NEVER_SHOWN or svg and tag in SVG_NEVER:
            return False, None
        rules = self.rules
        bare = not node.attrs or node.attrs.isspace()
        if bare and (not rules or tag not in rules and "*" not in rules):
            return tag != "dialog", None
        a = {} if bare else node.attributes()
        if tag == "input" and a.get("type", "").lower() == "hidden":
            return False, None
        default = not ("hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a)
        best: dict[str, tuple] = {}
        for name in ("display", "visibility") if svg or tag == "svg" else ():
            if name in a and (d := _declared(f"{name}:{a[name]}")):
                best[name] = ((False, False, False, (-1, 0, 0), 0), d[1])
        if rules:
            keys = [tag, "*", *(f".{c}" for c in dict.fromkeys(a["class"].split()))] if "class" in a else [tag, "*"]
            if "id" in a:
                keys.append("#" + a["id"])
            for key in keys:
                for groups, name, rank, value in rules.get(key, ()):
                    if (name not in best or rank > best[name][0]) and _fits(groups, node, a, chain):
                        best[name] = (rank, value)
        if "style" in a:
            for k, part in enumerate(a["style"].split(";")):
                if d := _declared(part):
                    rank = (d[2], True, True, (0, 0, 0), k)
                    if d[0] not in best or rank > best[d[0]][0]:
                        best[d[0]] = (rank, d[1])
        display, visibility = best.get("display", (0, "revert"))[1], best.get("visibility", (0, "inherit"))[1]
        shown = default if display.startswith("revert") else display != "none"
        return shown, {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(visibility)


def _declared(text: str) -> tuple[str, str, bool] | None:
    m = _DECLARATION.match(text)
    if not m:
        return None
    name, value = m[1].lower(), m[2].lower()
    if value[:4] == "var(":
        value = "unset"
    if value not in (DISPLAYS if name == "display" else ("visible", "hidden", "collapse", "inherit", "initial", "unset", "revert", "revert-layer")):
        return None
    return name, value, bool(m[3])


def _is(c: tuple, node: Node, a: dict[str, str], root: bool) -> bool:
    if c[0] and c[0] != node.tag:
        return False
    for p in c[1]:
        kind = p[0]
        if kind == ".":
            ok = p[1] in a.get("class", "").split()
        elif kind == "#":
            ok = a.get("id") == p[1]
        elif kind == "root":
            ok = root
        elif kind == "not":
            ok = not any(_is(o, node, a, root) for o in p[1])
        else:
            _, name, op, want, fold = p
            have = a.get(name)
            if have is not None and fold:
                have, want = have.lower(), want.lower()
            if have is None or not op:
                ok = have is not None
            elif op == "=":
                ok = have == want
            elif op == "~=":
                ok = want in have.split()
            elif op == "|=":
                ok = have == want or have.startswith(want + "-")
            else:
                ok = bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)
        if not ok:
            return False
    return True


def _fits(groups: list, node: Node, a: dict[str, str], chain: tuple | None) -> bool:
    """Of each group the nearest place is taken, which leaves most ancestors to those before it."""
    if not _is(groups[0][0], node, a, chain is None):
        return False
    at = chain
    for c in groups[0][1:]:
        if at is None or not _is(c, at[0], at[1], at[2] is None):
            return False
        at = at[2]
    for group in groups[1:]:
        while at is not None:
            up = at
            for c in group:
                if up is None or not _is(c, up[0], up[1], up[2] is None):
                    break
                up = up[2]
            else:
                break
            at = at[2]
        else:
            return False
        at = up
    return True


def _link(node: Node, chain: tuple | None) -> tuple:
    """Ancestors as (node, attributes, those above)."""
    return node, node.attributes() if node.attrs else {}, chain


class Page:
    """Lines as they are laid out."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.marker = 0, False, "", ""

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def start(self) -> None:
        if self.gap or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.gap)
            if self.marker:
                self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker)
                self.marker = ""
            else:
                self.parts.append(self.indent)
            self.gap, self.space = 0, False
        elif self.space:
            self.parts.append(" ")
            self.space = False

    def text(self, s: str) -> None:
        t = _SPACE.sub(" ", s)
        if t[:1] == " ":
            self.space = True
        body = t.strip(" ")
        if body:
            self.start()
            self.parts.append(body)
            self.space = t[-1] == " "

    def lines(self, s: str) -> None:
        """Preformatted text: every line as it is."""
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.gap = self.gap + 1 if self.gap and self.parts else 1
            if line:
                self.start()
                self.parts.append(line)

    def __str__(self) -> str:
        return "".join(self.parts)


def _number(value: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value)
    return int(m[1]) if m else default


def _deeper(indent: str, n: int) -> str:
    return (indent + " " * n)[: max(n, MAX_INDENT)]


def render(node: Node, sheet: Sheet, page: Page, state: tuple) -> None:
    """Lay a node's children out; an explicit stack carries what is to be done.

    state: preformatted, visible, in svg outside its texts, the ancestors from the node on.
    """
    todo: list = [("in", c, state, None) for c in reversed(node.children)]
    while todo:
        step, x, state, extra = todo.pop()
        if step == "out":
            tag = x.tag
            if extra is not None:
                page.indent, page.marker = extra, ""
            if tag in BLOCKS:
                page.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and page.indent) else 1)
            continue
        pre, visible, svg, chain = state
        if isinstance(x, str):
            if visible and not svg:
                page.lines(x) if pre else page.text(x)
            continue
        tag = x.tag
        shown, own = sheet.look(x, chain, svg)
        if not shown:
            continue
        visible = visible if own is None else own
        if tag == "br":
            page.gap, page.space = (page.gap + 1 if page.parts else page.gap), False
            continue
        if tag == "hr":
            page.block(1)
            continue
        below = _link(x, chain)
        if tag == "table":
            page.block(2)
            _table(x, sheet, page, (False, visible, svg, below))
            page.block(2)
            continue
        if tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu") and page.indent
            page.block(2 if tag in SPACED and not nested else 1)
        children, back = x.children, None
        if tag == "details" and "open" not in below[1]:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("ul", "ol", "menu"):
            start = _number(below[1].get("start", ""), 1) if tag == "ol" else 0
            inner = (pre, visible, svg, below)
            back, work = page.indent, []
            for c in children:
                if isinstance(c, Node) and c.tag == "li" and sheet.look(c, below, svg)[0]:
                    if tag == "ol":
                        start = _number(c.attributes().get("value", ""), start) if c.attrs else start
                    work.append(("item", c, inner, f"{start}. " if tag == "ol" else "- "))
                    start += 1
                else:
                    work.append(("in", c, inner, None))
            todo.append(("out", x, state, back))
            todo.extend(reversed(work))
            continue
        if step == "item":
            back = page.indent
            page.marker, page.indent = extra if visible else "", _deeper(page.indent, len(extra))
        elif tag in ("blockquote", "dd"):
            back, page.indent = page.indent, _deeper(page.indent, 2)
        elif tag in ("td", "th"):
            page.block(1)
        inside = pre or tag in ("pre", "textarea", "xmp")
        if inside and not pre and children and isinstance(children[0], str) and children[0][:1] == "\n":
            children = [children[0][1:], *children[1:]]
        if svg and tag in SVG_TEXT or tag in APART or tag in ("svg", "math"):
            page.space = True
        inner = (inside, visible, tag == "svg" or svg and tag not in SVG_TEXT, below)
        todo.append(("out", x, state, back))
        if tag in APART:
            children = [y for c in children for y in (c, " ")]
        todo.extend(("in", c, inner, None) for c in reversed(children))


def _table(table: Node, sheet: Sheet, page: Page, state: tuple) -> None:
    """Rows of cells in aligned columns; a cell of over WRAP characters that others follow is wrapped in its column.

    Columns in which no cell begins take no room. A column is as wide as its longest word, unless
    that padding would outgrow the table by far; then words are broken.
    """
    rows: list[tuple[Node, tuple, tuple]] = []
    loose: list = []
    todo = [(c, state) for c in reversed(table.children)]
    while todo:
        x, around = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append((x, around))
            continue
        _, visible, svg, chain = around
        shown, own = sheet.look(x, chain, svg)
        if shown:
            inner = (False, visible if own is None else own, svg, _link(x, chain))
            if x.tag in ("tbody", "thead", "tfoot"):
                todo.extend((c, inner) for c in reversed(x.children))
            elif x.tag == "tr":
                rows.append((x, inner, around))
            elif x.tag in ("td", "th"):
                if not rows or rows[-1][0].attrs != "implied":
                    rows.append((Node("tr", "implied"), around, around))
                rows[-1][0].children.append(x)
            elif x.tag not in ("col", "colgroup"):
                loose.append((x, around))
    if loose:
        for x, around in loose:
            _alone(x, sheet, page, around)
        page.block(1)
    grid: list[dict[int, str]] = []
    hang: list[list[int]] = []  # first column, one behind the last, rows to come
    group = None
    for r, state, part in rows:
        if part is not group:
            hang, group = [], part
        line: dict[int, str] = {}
        at, k, begun = 0, 0, []
        for c in r.children:
            if isinstance(c, str) or c.tag not in ("td", "th"):
                if isinstance(c, Node) or c.strip():
                    _alone(c, sheet, page, state)
                    page.block(1)
                continue
            shown, own = sheet.look(c, state[3], state[2])
            if not shown:
                continue
            while k < len(hang) and hang[k][0] <= at:
                at = max(at, hang[k][1])
                k += 1
            below = _link(c, state[3])
            a, cell = below[1], Page()
            render(c, sheet, cell, (False, state[1] if own is None else own, state[2], below))
            wide = min(max(_number(a.get("colspan", ""), 1), 1), MAX_COLSPAN)
            deep = min(max(_number(a.get("rowspan", ""), 1), 0), MAX_ROWSPAN) or MAX_ROWSPAN
            line[at] = " ".join(str(cell).split())
            if deep > 1:
                begun.append([at, at + wide, deep])
            at += wide
        hang = sorted([a, b, n - 1] for a, b, n in hang + begun if n > 1)
        grid.append(line)
    columns = {c: k for k, c in enumerate(sorted({c for line in grid for c in line}))}
    table_rows: list[list[str]] = []
    width, followed = [0] * len(columns), {}
    for line in grid:
        cells = [""] * (max((columns[c] for c, t in line.items() if t), default=-1) + 1)
        for c, t in line.items():
            if t:
                k = columns[c]
                cells[k] = t
                width[k] = max(width[k], min(len(t), WRAP))
                if len(t) > WRAP and k < len(cells) - 1:
                    followed.setdefault(k, []).append(t)
        table_rows.append(cells)
    budget = 4 * sum(len(t) for line in grid for t in line.values()) + (1 << 16)
    for k in sorted(followed):
        before, lengths = sum(width[:k]) + 3 * k, [len(t) for t in followed[k]]
        cost = lambda w, before=before, lengths=lengths: sum(-(-n // w) for n in lengths) * before + len(grid) * w
        width[k] = max(WRAP, max(len(w) for t in followed[k] for w in t.split(" ")))
        if cost(width[k]) > budget:
            options = [WRAP << i for i in range(max(lengths).bit_length())]
            width[k] = next((w for w in options if cost(w) <= budget), None) or min(options, key=cost)
    for cells in table_rows:
        wrapped = {k: _wrap(t, width[k]) for k, t in enumerate(cells[:-1]) if len(t) > width[k]}
        for i in range(max(map(len, wrapped.values()), default=1)):
            if i:
                cells = [wrapped[k][i] if k in wrapped and i < len(wrapped[k]) else "" for k in range(max(k for k, t in wrapped.items() if i < len(t)) + 1)]
            else:
                cells = [wrapped[k][0] if k in wrapped else t for k, t in enumerate(cells)]
            shown = " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=False)).rstrip(" ")
            page.block(1)
            if shown:
                page.start()
                page.parts.append(shown)
            page.block(1)


def _wrap(text: str, width: int) -> list[str]:
    """Lines of at most width characters; only longer words are broken."""
    lines, line, used = [], [], 0
    for word in text.split(" "):
        while len(word) > width:
            if line:
                lines.append(" ".join(line))
                line, used = [], 0
            lines.append(word[:width])
            word = word[width:]
        if not word:
            continue
        if line and used + 1 + len(word) > width:
            lines.append(" ".join(line))
            line, used = [], 0
        used += len(word) + bool(line)
        line.append(word)
    return [*lines, " ".join(line)] if line else lines


def _alone(x: Node | str, sheet: Sheet, page: Page, state: tuple) -> None:
    around = Node("div")
    around.children = [x]
    render(around, sheet, page, state)


def visible_text(source: str) -> str:
    # A table in a table takes a few frames of the interpreter's own stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * source.lower().count("<table")))
    root, styles = parse(source)
    sheet, page = Sheet(styles), Page()
    shown, visible = sheet.look(root, None)
    if shown:
        render(root, sheet, page, (False, visible is not False, False, _link(root, None)))
    return str(page)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars): the visible text of each page, whole.

    Null or empty HTML gives an empty text. Malformed HTML never fails: stray end tags are ignored,
    open elements end with the page. Elements of any depth keep their visibility and layout, but the
    indentation stops at MAX_INDENT columns. Cells of over WRAP characters are wrapped, so aligned
    tables stay in proportion to their
    input. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = [visible_text(t) if t else "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, text string, n_chars long")
