"""HTML to text as laid out: a tree builder with implied tags, visibility rules, block spacing, lists and tables.

Tags are read one after the other. The tree builder closes elements that a start tag ends by rule (a
paragraph before a block, a list item before the next, a cell before the next cell or row), ignores end tags
that match nothing, and closes all that is open inside the one it ends. An element is not displayed by nature, by the
hidden attribute, or by a declaration of display in its style or in a style element; visibility is inherited and may be
taken back inside. Style elements count with their rules for a tag, class or id, a compound of these, and compounds joined
as descendants or children, outside at-rules. Of a select element the selected option is shown, of an input field its value,
of closed details their summary; what is only kept from assistive readers (aria-hidden) is seen like anything else. The renderer collapses white space outside pre, puts blocks on lines of their own
and paragraphs apart, marks list items by depth and number, and pads table cells, spans included, so that columns align;
a table inside a cell keeps its lines there.
It keeps its own stack: pages may nest to any depth.

Defined results: null or empty pages give an empty text; unclosed, misnested or cut tags are repaired by the
rules above; a tag whose quotes never close ends at the next '>'; repeated rows each return a row; a null page_id keeps
its row; an empty table returns no rows; columns other than page_id and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import small_batches

#: Comments, tags with attributes whose quoted values may hold '>', declarations. Nothing is tried twice.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?][^>]*>", re.S
)
#: The same without quotes, used from the first tag on that does not close.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SPACE = re.compile(r"[ \t\r\n\f]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript title desc defs metadata annotation annotation-xml iframe object datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Input fields that show no value.
MUTE = frozenset("hidden checkbox radio color range file image password".split())
#: What a head may hold; any other start tag ends it, as does text.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Blocks set apart by an empty line, and other blocks.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
BLOCK = APART | frozenset(
    "html body address article aside div dd details dialog dt fieldset figcaption footer form header hr li main nav "
    "section summary tr caption thead tbody tfoot legend center".split()
)
#: Start tag -> open elements it ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: No implied or explicit end tag of an outer element reaches through these.
WALLS = frozenset("table td th".split())
#: The widest span of columns that a cell may have.
SPAN = 1000


class Node:
    """An element. shown is None where visibility is inherited; gone elements and all they hold are not displayed."""

    __slots__ = ("tag", "children", "attributes", "gone", "shown", "holds")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.children, self.attributes = tag, [], attributes or {}
        self.gone, self.shown = tag in UNSEEN, None
        #: Whether a table lies inside.
        self.holds = False


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        value = value[1:-1] if value[:1] in "\"'" else value
        found.setdefault(name.lower(), entities.unescape(value).strip())
    return found


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """Property -> (important, value) of the declaration that prevails."""
    out: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"(?s)/\*.*?\*/", " ", style.lower()).split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if bool(mark) >= out.get(name.strip(), (False, ""))[0]:
            out[name.strip()] = bool(mark), value.strip()
    return out


def _without_at_rules(css: str) -> str:
    out, at = [], 0
    while (start := css.find("@", at)) >= 0:
        out.append(css[at:start])
        end, brace = css.find(";", start), css.find("{", start)
        if brace < 0 or 0 <= end < brace:
            at = end + 1 if end >= 0 else len(css)
            continue
        depth, at = 1, brace + 1
        while depth and at < len(css):
            depth += {"{": 1, "}": -1}.get(css[at], 0)
            at += 1
    return "".join(out) + css[at:]


#: A selector: from the outermost compound to that of the element itself (whether it is a child of the one before, tag or
#: '', names).
Selector = list[tuple[bool, str, frozenset[str]]]


def _selector(said: str) -> Selector | None:
    out: Selector = []
    child = False
    for part in re.sub(r"\s*>\s*", " > ", said.strip()).split():
        if part == ">":
            child = True
            continue
        m = _SELECTOR.fullmatch(part)
        if not m or not m[0] or (child and not out):
            return None
        out.append((child, "" if m[1] in (None, "*") else m[1].lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))))
        child = False
    return None if child else out or None


def style_rules(css: str) -> list[tuple[Selector, tuple, dict]]:
    """(selector, specificity, declarations) of the rules that hide or show."""
    css, out = _without_at_rules(re.sub(r"(?s)/\*.*?\*/", " ", css)), []
    for order, (selectors, body) in enumerate(re.findall(r"([^{}]+)\{([^{}]*)\}", css)):
        said = {k: v for k, v in _declared(body).items() if k in ("display", "visibility")}
        for selector in map(_selector, selectors.split(",") if said else ()):
            if selector:
                names = [x for _, _, some in selector for x in some]
                weight = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), sum(bool(tag) for _, tag, _ in selector), order)
                out.append((selector, weight, said))
    return out


def _names(node: Node) -> set[str]:
    said = node.attributes
    return {f".{x}" for x in said.get("class", "").split()} | ({f"#{said['id']}"} if "id" in said else set())


def _hide(root: Node) -> None:
    """Decide of every element whether it is displayed and what it says of visibility."""
    todo, sheets = [root], []
    every: list[Node] = []
    above: dict[int, Node] = {}
    while todo:
        node = todo.pop()
        every.append(node)
        if node.tag == "style":
            sheets += [x for x in node.children if isinstance(x, str)]
        below = [x for x in reversed(node.children) if isinstance(x, Node)]
        above |= {id(x): node for x in below}
        todo += below
    for node in every:
        up = above.get(id(node)) if node.tag == "table" else None
        while up is not None and not up.holds:
            up.holds, up = True, above.get(id(up))
    rules = style_rules("\n".join(sheets)) if sheets else []
    nested = any(len(selector) > 1 for selector, _, _ in rules)
    named = {id(x): _names(x) for x in every} if nested else {}

    def fits(node: Node, part: tuple, names: set[str]) -> bool:
        return part[1] in ("", node.tag) and part[2] <= names

    def inside(node: Node, selector: Selector, last: int) -> bool:
        """Whether the elements around node meet the compounds up to the last one."""
        if last < 0:
            return True
        near, up = selector[last + 1][0], above.get(id(node))
        while up is not None:
            if fits(up, selector[last], named[id(up)]) and inside(up, selector, last - 1):
                return True
            up = None if near else above.get(id(up))
        return False

    for node in every:
        said = node.attributes
        if node.tag == "details" and "open" not in said:
            node.children = [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]
        if not said and not rules:
            continue
        names = _names(node)
        best: dict[str, tuple] = {}
        found = [(weight, body) for selector, weight, body in rules if fits(node, selector[-1], names) and inside(node, selector, len(selector) - 2)]
        if "style" in said:
            found.append(((9**9,), _declared(said["style"])))
        for weight, body in found:
            for name, (important, value) in body.items():
                best[name] = max(best.get(name, ((False, ()), "")), ((important, weight), value), key=lambda x: x[0])
        if "display" in best:
            node.gone |= best["display"][1] == "none"
        else:
            node.gone |= "hidden" in said
        if "visibility" in best:
            node.shown = {"hidden": False, "collapse": False, "visible": True}.get(best["visibility"][1])


def parse(page: str) -> Node:
    """The tree of a page: nodes and strings."""
    root = Node("")
    open_: list[Node] = [root]
    at, end, pattern = 0, len(page), _TAG

    def text(start: int, stop: int) -> None:
        if stop > start:
            said = page[start:stop]
            if open_[-1].tag == "head" and said.strip(" \t\r\n\f"):
                open_.pop()
            open_[-1].children.append(entities.unescape(said) if "&" in said else said)

    begun = 0
    while at < end:
        start = page.find("<", at)
        if start < 0 or page.find(">", start) < 0 and not page.startswith("<!--", start):
            break
        m = pattern.match(page, start)
        if not m and page[start + 1 : start + 2].isalpha() | page.startswith("</", start):
            pattern = _PLAIN
            m = pattern.match(page, start)
        if not m:
            at = start + 1
            continue
        text(begun, start)
        at = begun = m.end()
        closing, tag, rest = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if closing:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if open_[-1].tag == "head" and tag not in HEAD:
            open_.pop()
        _imply(open_, tag)
        node = Node(tag, _attributes(rest) if rest else None)
        open_[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            said = page[at : close.start() if close else end]
            if tag == "style":
                node.children.append(said)
            elif tag == "textarea":
                node.children.append(entities.unescape(said))
            at = begun = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/"):
            open_.append(node)
    text(begun, end)
    _hide(root)
    return root


def _imply(open_: list[Node], tag: str) -> None:
    """Close what the start of tag ends by rule."""
    if tag in BLOCK and tag not in ("html", "body"):
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag == "p":
                del open_[i:]
                break
            if open_[i].tag in BLOCK:
                break
    ends, walls = ENDS.get(tag, ((), ()))
    last = None
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in walls:
            break
        if open_[i].tag in ends:
            last = i
    if last is not None:
        del open_[last:]


class Layout:
    """Lines of text, built from inline runs and gaps between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            *full, rest = s.split("\n")
            for line in full:
                self.run.append(line)
                self.line(keep=True)
            self.run.append(rest)
        else:
            self.run.append(_SPACE.sub(" ", s))

    def line(self, keep: bool = False) -> None:
        """End the line that is being filled."""
        s = "".join(self.run).rstrip() if keep else _SPACE.sub(" ", "".join(self.run)).strip(" ")
        self.run = []
        if s or keep:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(s)

    def block(self, apart: bool, pre: bool = False) -> None:
        if any(self.run):
            self.line(keep=pre and bool("".join(self.run).strip()))
        self.gap = max(self.gap, int(apart))

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines


#: A step of the renderer: it yields the steps it waits for, and the stack of steps is kept by _run, not by Python.
Step = Generator["Step", list, list]


def _run(step: Step) -> list:
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _render(children: list, out: Layout, pre: bool, shown: bool) -> Step:
    for x in children:
        if isinstance(x, str):
            if shown:
                out.text(x, pre)
            continue
        if x.gone:
            continue
        seen = shown if x.shown is None else x.shown
        if x.tag == "br":
            if seen:
                out.line(keep=True)
        elif x.tag == "hr":
            out.block(False)
        elif x.tag in ("ul", "ol"):
            out.block(True)
            out.add((yield _list(x, pre, seen)))
            out.block(True)
        elif x.tag == "table":
            out.block(True)
            out.add((yield _table(x, seen)))
            out.block(True)
        elif x.tag == "input":
            if seen and x.attributes.get("type", "text").lower() not in MUTE:
                out.text(f" {x.attributes.get('value', '')} ", pre)
        elif x.tag == "select":
            yield _render(_chosen(x), out, pre, seen)
        elif x.tag in BLOCK:
            keep = pre or x.tag == "pre"
            out.block(x.tag in APART, pre)
            yield _render(x.children, out, keep, seen)
            out.block(x.tag in APART, keep)
        else:
            yield _render(x.children, out, pre, seen)
    return []


def _lines(children: list, pre: bool, shown: bool) -> Step:
    part = Layout()
    yield _render(children, part, pre, shown)
    part.block(False, pre)
    return part.lines


def _chosen(select: Node) -> list:
    """What a select element shows: its selected options or else the first; all of them in a list."""
    options, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and x.tag == "option":
            options.append(x)
        elif isinstance(x, Node):
            todo += reversed(x.children)
    if "multiple" in select.attributes or select.attributes.get("size", "1") not in ("", "0", "1"):
        return [y for x in options for y in (x, " ")]
    marked = [x for x in options if "selected" in x.attributes]
    return marked[-1:] or options[:1]


def _list(node: Node, pre: bool, shown: bool) -> Step:
    out, number = [], 0
    for x in node.children:
        if isinstance(x, Node) and x.tag == "li" and not x.gone:
            seen = shown if x.shown is None else x.shown
            number += 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            body = [s for s in (yield _lines(x.children, pre, seen)) if s]
            if not body and not seen:
                continue
            body = body or [""]
            out.append((mark + body[0]).rstrip())
            out += [" " * len(mark) + s for s in body[1:]]
        else:
            out += yield _lines([x], pre, shown)
    return out


def _rows(node: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
    for x in node.children:
        if isinstance(x, Node) and not x.gone:
            seen = shown if x.shown is None else x.shown
            if x.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(x, seen)
            else:
                yield x, seen


def _stray(node: Node) -> Iterator[str]:
    """Strings that lie in a table or its sections, outside rows."""
    for x in node.children:
        if isinstance(x, str):
            yield x
        elif x.tag in ("thead", "tbody", "tfoot") and not x.gone:
            yield from _stray(x)


def _span(cell: Node, name: str) -> int:
    said = cell.attributes.get(name, "")
    return min(max(int(said), 1), SPAN) if said.isascii() and said.isdigit() and len(said) < 9 else 1


def _table(node: Node, shown: bool) -> Step:
    """Captions and stray content first, then rows with their cells padded to the width of the columns they span."""
    out, grid = (yield _lines(list(_stray(node)), False, shown)), []
    below: dict[int, int] = {}  # column -> rows it is still taken by a cell from above
    for row, seen in _rows(node, shown):
        if row.tag != "tr":
            out += yield _lines([row], False, shown)
            continue
        stray = [x for x in row.children if not (isinstance(x, Node) and x.tag in ("td", "th"))]
        out += yield _lines(stray, False, seen)
        cells, column = [], 0
        taken, below = below, {c: left - 1 for c, left in below.items() if left > 1}
        for x in row.children:
            if not (isinstance(x, Node) and x.tag in ("td", "th")) or x.gone:
                continue
            while column in taken:
                column += 1
            lines = yield _lines(x.children, False, seen if x.shown is None else x.shown)
            wide, high = _span(x, "colspan"), _span(x, "rowspan")
            lines = [s for s in lines if s]
            # A table inside a cell keeps its lines; other blocks in a cell share one.
            cells.append((column, wide, lines if x.holds and lines else [" ".join(lines)]))
            if high > 1:
                below |= {c: high - 1 for c in range(column, column + wide)}
            column += wide
        grid.append(cells)
    widths = [0] * max((c + w for row in grid for c, w, _ in row), default=0)
    for c, w, lines in (x for row in grid for x in row if x[1] == 1):
        widths[c] = max(widths[c], *map(len, lines))
    for c, w, lines in (x for row in grid for x in row if x[1] > 1):
        widths[c + w - 1] += max(0, max(map(len, lines)) - sum(widths[c : c + w]) - 3 * (w - 1))
    for row in grid:
        for k in range(max((len(lines) for _, _, lines in row if any(lines)), default=0)):
            parts, at = [], 0
            for c, w, lines in row:
                parts += [" " * widths[i] for i in range(at, c)]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(widths[c : c + w]) + 3 * (w - 1)))
                at = c + w
            out.append(" | ".join(parts).rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page as it is laid out."""
    return "\n".join(_run(_lines(parse(page or "").children, False, True))).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
