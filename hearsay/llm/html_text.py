"""Visible text of HTML, laid out: a tree builder with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import textops as tx

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
UNSEEN = frozenset("head script style template noscript title iframe object svg math canvas audio video datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: Most columns and rows that a cell spans (fixed values of the HTML standard, sections on colspan and rowspan).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Levels of tables within tables that are laid out, and of lists that are indented; deeper ones are blocks, or stand at the last indent.
DEEPEST, INDENTS = 500, 100
#: Kinds of input whose value shows as text.
_SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "reset", "button"))
#: Elements that can stand in a head; any other start tag, or text, ends it.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Open elements that a start tag closes, and those that stop the search for them.
_ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}
_P, _P_WALLS, _CELLS = ("p",), ("table", "td", "th", "button"), ("td", "th", "table")
_LISTS = ("ul", "ol", "menu", "dir")
_CLOSES = {"li": (("li",), _LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), ("table",))}
_CLOSES |= {k: _CLOSES["tbody"] for k in ("thead", "tfoot")}
#: Where a tag, a comment or a declaration begins; the latter two are matched whole.
_OPEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->)?|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.DOTALL)
#: What follows a tag's name: its end, or an attribute with its value. No step goes back, so a tag is read in one pass.
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>)|([\"'])))?+)")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?:^|[;{\s])display\s*:\s*([a-z-]+)", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*([a-z]+)", re.IGNORECASE)
_STYLE = re.compile(r"<style\b[^>]*+>((?:(?!</style).)*+)", re.IGNORECASE | re.DOTALL)
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_AT_RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\}?)")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*+)?((?:[.#][\w-]++)*+)\Z")
_PART = re.compile(r"([.#])([\w-]+)")
_NOTES = re.compile(r"/\*(?:(?!\*/).)*+(?:\*/)?", re.DOTALL)


def _effects(style: str) -> tuple[bool | None, bool | None]:
    """Whether declarations say that an element has a box, and that it is visible; None where they don't say. The last one counts."""
    if not style:
        return None, None
    box, seen = _DISPLAY.findall(style), _VISIBILITY.findall(style)
    return box[-1].lower() != "none" if box else None, seen[-1].lower() not in ("hidden", "collapse") if seen else None


class Rules:
    """What a page's own style sheets say of display and visibility, for selectors of one element by tag, classes and id.

    Selectors that need other elements, states or media are not followed.
    """

    def __init__(self, source: str) -> None:
        self.by: dict[str, list] = {}
        order = 0
        for sheet in _STYLE.findall(source):
            for selectors, body in _RULE.findall(_AT_RULE.sub("", _NOTES.sub("", sheet))):
                effect = _effects(body)
                if effect == (None, None):
                    continue
                for selector in selectors.split(","):
                    m = _SELECTOR.match(selector.strip())
                    if not m or not m[0]:
                        continue
                    order += 1
                    parts = _PART.findall(m[2])
                    ids, classes = {v for k, v in parts if k == "#"}, {v for k, v in parts if k == "."}
                    tag = (m[1] or "").lower()
                    key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
                    self.by.setdefault(key, []).append(((len(ids), len(classes), bool(tag)), order, tag, ids, classes, effect))

    def of(self, tag: str, attrs: dict[str, str]) -> tuple[bool | None, bool | None]:
        if not self.by:
            return None, None
        own, classes = attrs.get("id", ""), set(attrs.get("class", "").split())
        found = [r for key in (tag, f"#{own}", *(f".{c}" for c in classes)) for r in self.by.get(key, ()) if (not r[2] or r[2] == tag) and r[3] <= {own} and r[4] <= classes]
        box = seen = None
        for *_, effect in sorted(found, key=lambda r: r[:2]):
            box, seen = (old if new is None else new for old, new in zip((box, seen), effect, strict=True))
        return box, seen


class Node:
    """An element: its tag, whether it has a box and is visible, and its children, nodes or strings."""

    __slots__ = ("tag", "shown", "seen", "children", "span", "down", "lines", "attrs")

    def __init__(self, tag: str, shown: bool = True, span: int = 1, down: int = 1, seen: bool = True, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.shown, self.seen, self.children, self.span, self.down, self.lines, self.attrs = tag, shown, seen, [], span, down, None, attrs or {}


def _spanned(value: str, most: int) -> int:
    """A number of columns or rows as an attribute says; 1 where it says none."""
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 20 else 1


class _Open:
    """The open elements, and where in them each tag stands, so that no search walks them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.where = [root], {}

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.where[self.stack.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of some tags; 0 if none is open."""
        last = 0
        for tag in tags:
            if (at := self.where.get(tag)) and at[-1] > last:
                last = at[-1]
        return last

    def close(self, ends: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Close the innermost of ends, and those of ends right around it, unless one of walls stands in between."""
        last = self.last(ends)
        if last and last > self.last(walls):
            while last > 1 and self.stack[last - 1].tag in ends:
                last -= 1
            self.cut(last)


def _attributes(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """The attributes of a tag whose name ends at `at`, whether it closes itself, and where it ends; None if the page ends first."""
    attrs: dict[str, str] = {}
    while m := _ATTR.match(source, at):
        if m[1]:
            return attrs, source[m.end() - 2] == "/", m.end()
        if m[6]:  # a quote that never closes
            return None
        attrs.setdefault(m[2].lower(), html.unescape(m[3] or m[4] or m[5] or ""))
        at = m.end()
    return None


def build(source: str) -> Node:
    """The tree of a page. Start tags imply the end tags that HTML lets authors leave out; an end tag without its start is ignored.

    A tag that the page's end cuts off is no text, as in browsers. Every step takes a time that
    doesn't grow with what is open or what follows, so a page takes a time in proportion to its length.
    """
    root, rules = Node("body"), Rules(source)
    held = _Open(root)
    stack, at = held.stack, 0

    def say(text: str) -> None:
        top = stack[-1]
        if top.seen and not (top.tag == "details" and "open" not in top.attrs):
            top.children.append(text)

    while at < len(source):
        m = _OPEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            if text.strip(" \t\n\r\f") and stack[-1].tag == "head":
                held.cut(len(stack) - 1)
            say(html.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        read = ({}, False, at + 1) if source.startswith(">", at) else _attributes(source, at)
        if read is None:
            break
        attrs, itself, at = read
        tag = m[2].lower()
        # what ends a head also ends a noscript in it; what a template holds stays there
        in_head = stack[-1].tag == "head" or len(stack) == 3 and stack[1].tag == "head" and stack[2].tag == "noscript"
        if in_head and (tag in ("body", "html", "br") if m[1] else tag not in _IN_HEAD and tag != "html"):
            held.cut(1)
        if m[1]:
            depth = held.last((tag,))
            # an end tag within a cell doesn't reach out of its table
            if depth and (depth >= held.last(_CELLS) or tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")):
                held.cut(depth)
            elif tag == "p":
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            held.close(_P, _P_WALLS)
        if tag in _CLOSES:
            held.close(*_CLOSES[tag])
        top = stack[-1]
        box, seen = rules.of(tag, attrs)
        kept, span, down = None, 1, 1
        if attrs:
            box, seen = ((own if own is not None else of) for own, of in zip(_effects(attrs.get("style", "")), (box, seen), strict=True))
            kept = {k: attrs[k] for k in ("open", "selected", "multiple", "size", "label") if k in attrs}
            # a rowspan of nought reaches to the table's end
            span, down = max(_spanned(attrs.get("colspan", ""), MOST_COLUMNS), 1), _spanned(attrs.get("rowspan", ""), MOST_ROWS) or MOST_ROWS
        shown = tag not in UNSEEN and (box if box is not None else "hidden" not in attrs)
        if top.tag == "details" and "open" not in top.attrs and (tag != "summary" or any(not isinstance(c, str) and c.tag == "summary" for c in top.children)):
            shown = False
        node = Node(tag, shown, span, down, top.seen if seen is None else seen, kept)
        top.children.append(node)
        if node.seen and shown and (said := attrs.get("alt") if tag == "img" else attrs.get("value") if tag == "input" and attrs.get("type", "").lower() in _SHOWN_INPUTS else None):
            node.children.append(said)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            if tag == "textarea" and node.seen:
                node.children.append(html.unescape(source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
        elif tag not in VOID and not (itself and tag in ("svg", "math")):
            held.push(node)
    return root


class _Laid:
    """Lines laid out, to be read once from the first on.

    They are parts, (text, width) or (other laid lines, columns they move right), so a table within
    a table moves as one part and no line of it is touched until it meets a line of another cell.
    """

    __slots__ = ("open", "left", "wide", "blank")

    def __init__(self, parts: list[tuple[str | _Laid, int]]) -> None:
        self.left, self.wide, self.blank = 0, 0, False
        for what, n in parts:
            if isinstance(what, str):
                self.left, self.wide, self.blank = self.left + 1, max(self.wide, n), self.blank or not what
            else:
                self.left, self.wide, self.blank = self.left + what.left, max(self.wide, what.wide + n), self.blank or what.blank
        # parts begun and not ended, the inner ones last, each with the columns that it moves
        self.open = [(parts[::-1], 0)] if parts else []

    def __len__(self) -> int:
        return self.left

    def take(self) -> tuple[str, int]:
        """The next line and its width; there has to be one."""
        while True:
            parts, right = self.open[-1]
            what, n = parts.pop()
            if not parts:
                self.open.pop()
            if isinstance(what, str):
                self.left -= 1
                return " " * right + what, right + n
            self.open += [(inner, right + n + more) for inner, more in what.open]

    def rest(self) -> Iterator[tuple[str, int]]:
        while self.left:
            yield self.take()


class _Page:
    """Lines of output, or tables' laid out lines among them; a break or a blank line takes effect before the next text."""

    def __init__(self) -> None:
        self.lines, self.now, self.gap, self.mark = [], [], 0, ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if not self.now:
            s = s.lstrip(" ")
        elif s[:1] == " " and self.now[-1][-1] == " ":
            s = s[1:]
        if not s:
            return
        if not self.now:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            if self.mark:
                self.now.append(self.mark)
            self.mark = ""
        self.now.append(s)

    def end(self, gap: int = 1) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.gap = max(self.gap, gap)

    def whole(self, lines: _Laid | list[str]) -> None:
        self.end(2)
        if lines:
            if self.lines:
                self.lines.append("")
            if isinstance(lines, _Laid):
                self.lines += [(self.mark + lines.take()[0]).rstrip(" "), lines] if self.mark else [lines]
            else:
                self.lines += [(self.mark + lines[0]).rstrip(" "), *lines[1:]]
            self.mark, self.gap = "", 2


def _wide(s: str) -> int:
    """The columns that a text takes: two for wide characters, none for marks on others."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def render(root: Node) -> list[str]:
    """The lines of a tree. Inner tables are laid out before those around them, so depth takes no recursion."""
    tables, work = [], [(root, 0)]
    while work:
        x, depth = work.pop()
        if not isinstance(x, str) and x.shown:
            if x.tag == "table":
                depth += 1
                if depth <= DEEPEST:
                    tables.append(x)
            if depth > DEEPEST and x.tag in _CELLS:
                x.tag = "cell"
            work += [(c, depth) for c in x.children]
    for table in reversed(tables):
        table.lines = _table(table)
    out = []
    for x in _flow(root):
        if isinstance(x, str):
            out.append(x)
        else:
            out += (line for line, _ in x.rest())
    return out


def _flow(node: Node) -> list[str | _Laid]:
    """The lines of a tree whose tables are laid out, walked without recursion."""
    page, counters, depth = _Page(), [], 0
    work: list = [(node, False)]
    while work:
        x, leaving = work.pop()
        if isinstance(x, str):
            page.text(x)
            continue
        if not x.shown:
            continue
        tag = x.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                depth -= 1
                counters.pop()
            page.end(2 if tag in SPACED and not (counters and tag in ("ul", "ol")) else 1)
            continue
        if tag == "br":
            if page.now:
                page.end()
            else:
                page.gap = 2
            continue
        if tag == "hr":
            page.end(2)
            continue
        if tag == "table":
            page.whole(x.lines)
            continue
        if tag == "select":
            page.text(" ".join(_chosen(x)))
            continue
        if tag == "cell":
            page.text(" ")
        if tag in ("pre", "textarea"):
            page.whole([line.rstrip() for line in _plain(x).strip("\n").split("\n")])
            continue
        if tag in BLOCK:
            page.end(2 if tag in SPACED and not (counters and tag in ("ul", "ol")) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                depth += 1
                counters.append(0 if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    counters[-1] += 1
                    mark = f"{counters[-1]}. "
                page.mark = "  " * min(max(depth - 1, 0), INDENTS) + mark
            work.append((x, True))
        work += [(c, False) for c in reversed(x.children)]
    page.end()
    return page.lines


def _chosen(select: Node) -> list[str]:
    """The entries that a list shows: all of an open one, else the one chosen last, or the first."""
    entries, work = [], list(reversed(select.children))
    while work:
        x = work.pop()
        if not isinstance(x, str) and x.shown:
            if x.tag == "option":
                entries.append(x)
            else:
                work += reversed(x.children)
    said = [x.attrs.get("label") or _SPACES.sub(" ", _plain(x)).strip(" ") for x in entries]
    if "multiple" in select.attrs or _spanned(select.attrs.get("size", ""), MOST_ROWS) > 1:
        return said
    return [next((t for t, x in zip(reversed(said), reversed(entries), strict=True) if "selected" in x.attrs), said[0])] if said else []


def _plain(node: Node) -> str:
    out, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.shown:
            if x.tag == "br":
                out.append("\n")
            work += reversed(x.children)
    return "".join(out)


def _table(table: Node) -> _Laid:
    """Rows with cells padded to the columns' widths; a cell of several lines takes several lines; captions and stray text above.

    A cell that spans rows keeps its columns free in the rows below. Columns that no cell begins
    at take no room, and only cells of one column set a width. Where one cell of a row has lines
    left, they go on as one part, so each line is joined to others at most once and moved never.
    """
    above, rows = [], []

    def filled(lines: list[str | _Laid]) -> list[tuple[str | _Laid, int]]:
        """Lines as parts, without the blank ones, which only captions have within a table."""
        out = []
        for x in lines:
            if isinstance(x, str):
                if x:
                    out.append((x, _wide(x)))
            elif x.blank:
                out += [part for part in x.rest() if part[0]]
            elif x:
                out.append((x, 0))
        return out

    def cell(x: Node) -> tuple[_Laid, int, int]:
        return _Laid(filled(_flow(x)) or [("", 0)]), x.span, x.down

    work = list(reversed(table.children))
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                above += filled([_SPACES.sub(" ", x).strip(" ")])
        elif not x.shown:
            continue
        elif x.tag in ("tbody", "thead", "tfoot"):
            work += reversed(x.children)
        elif x.tag == "tr":
            row = []
            for c in x.children:
                if isinstance(c, str) or c.tag not in ("td", "th"):
                    above += filled([_SPACES.sub(" ", c).strip(" ")] if isinstance(c, str) else _flow(c))
                elif c.shown:
                    row.append(cell(c))
            rows.append(row)
        elif x.tag in ("td", "th"):
            rows.append([cell(x)])
        else:
            above += [(line, _wide(line) if isinstance(line, str) else 0) for line in _flow(x)]
    placed, held = [], []
    for row in rows:
        at, own, k = 0, [], 0
        for lines, span, down in row:
            # both go from left to right
            while k < len(held) and (held[k][1] <= at or held[k][0] < at + span):
                at = max(at, held[k][1])
                k += 1
            own.append((at, at + span, down if at < MOST_COLUMNS else 1, lines))
            at += span
        below = [(a, b, n - 1) for a, b, n in held if n > 1] + [(a, b, n - 1) for a, b, n, _ in own if n > 1]
        held = sorted(below) if len(below) > len(held) or len(own) > 1 else below
        placed.append(own)
    column = {at: i for i, at in enumerate(sorted({c[0] for row in placed for c in row}))}
    width = [0] * len(column)
    for row in placed:
        for at, stop, _, lines in row:
            if stop - at == 1:
                width[column[at]] = max(width[column[at]], lines.wide)
    place = [0, *itertools.accumulate(w + 2 for w in width)]
    out = above
    for row in placed:
        # beyond the most columns cells are set apart, not aligned, or a page could be laid out to its square
        left = [(place[column[at]] if column[at] < MOST_COLUMNS else None, lines) for at, _, _, lines in row]
        while len(left) > 1:
            line, wide = [], 0
            for start, lines in left:
                text, n = lines.take()
                gap = start - wide if start is not None else 2 * bool(line)
                line.append(" " * gap + text)
                wide += max(gap, 0) + n
            text = "".join(line)
            if kept := text.rstrip(" "):
                out.append((kept, wide - len(text) + len(kept)))
            left = [x for x in left if x[1]]
        out += [(lines, start or 0) for start, lines in left if not lines.blank]
    return _Laid(out)


def visible_text(source: str | None) -> str:
    """All visible text of a page; null or empty gives an empty text."""
    return "\n".join(render(build(source))) if source else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each page, rendered whole: block elements start lines, paragraphs and the like are set off by a blank line, list items have marks, table cells are aligned.

    Left out is what has no box or is not visible by attribute, inline style or the page's own
    style rules for single elements; a visible element within one that is merely not visible
    shows. So do values of text fields and buttons, the chosen entry of a closed list, all
    entries of an open one, and of closed details the summary. Style sheets of other files,
    selectors over several elements and scripts are not followed.

    A null page has an empty text; ids may be null or repeat. Broken markup never fails: what opens
    no tag is text, and a tag that the page's end cuts off is not. A page of any length or depth
    takes time and memory in proportion to its length (tests: a megabyte of unclosed tags, nested
    lists, blocks, tables and spans) and that of its text, where lines to the right of others begin
    with spaces: cells of tables within DEEPEST others follow each other on a line, lists are
    indented INDENTS levels at most, and columns beyond MOST_COLUMNS are not aligned. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([visible_text(s) for s in batch.column(1)[part].to_pylist()], pa.string())], ["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, text string")
