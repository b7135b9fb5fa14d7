"""Visible text of HTML pages, rendered with regard to layout.

Markup becomes a stream of opened and closed elements (end tags that may be left out are implied: a paragraph ends where a block
begins, a list item, row, cell, option or term where the next begins; end tags that match nothing in reach do nothing), of which
elements that are not shown drop out with all they hold: scripts, styles, heads, templates, what is `hidden`, has `display:none` or
stands in closed details (but for the summary). Text with `visibility:hidden` is left out until something inside is visible again.

The rest is laid out as lines: white space collapses but in preformatted text, blocks begin on lines of their own, paragraphs,
headings, lists and tables are set off by a blank line, items have a bullet or their number and are indented by depth, and a
table's cells stand at their columns, two blanks apart, below each other where they span rows. Nothing visible is dropped,
navigation, notes, the text of drawings and formulas and the values of text fields included.

Open elements are looked up by name, not by walking the stack, and every element is closed once, so that a page takes time in
proportion to its length however deep or broken its markup is. Three bounds concern layout alone: indentation stops at MOST_INDENT
columns, tables inside more than MOST_TABLES others have their cells one after the other on a row's line, and a page's tables have
PADDING blanks for each of its characters (and a thousand more) to align their cells with; where a line needs more than are left,
its cells stand two blanks apart. So the text is at most so many times as long as the page. Not followed: rules of style sheets,
and what stands in place of an object, a sound or a film.

Defined results: null and empty pages give the empty text; markup that is never closed runs to the page's end, and so does a tag
that never ends; numbers in attributes are read as HTML does (leading digits, no more than 1000 columns for a cell), and what is no
number counts as not given; repeated rows get a row each; an empty table gives an empty result; other columns are carried in one
struct, so that clashing names do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_name = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_value = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
#: Comments and declarations, or a tag: its slash, its name, its attributes. Every character is read once.
_markup = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)"
    rf"((?:[ \t\n\f\r/]++|{_name}(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:{_value})?+)?+)*+)(?:>|\Z)",
    re.S,
)
_attribute = re.compile(rf"({_name})(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+({_value})?+)?+")
_space = re.compile(r"[ \t\n\f\r]+")
_number = re.compile(r"[ \t\n\f\r]*([+-]?)0*([0-9]+)")
_zeros, _beyond = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")

MOST_INDENT, MOST_TABLES, MOST_COLUMNS, PADDING = 60, 16, 1000, 8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("rp script style head title template noscript iframe noembed noframes object audio video canvas datalist meta link base param source track area col colgroup progress meter".split())
#: Parts of drawings and formulas that are not shown where they stand.
UNSEEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PRE = frozenset("pre textarea listing xmp plaintext".split())
SET_OFF = HEADINGS | frozenset("p ul ol dl table blockquote pre listing xmp plaintext figure".split())
OF_TABLE = frozenset("td th tr caption thead tbody tfoot".split())
BLOCK = SET_OFF | OF_TABLE | frozenset("html body div article section nav aside header footer main address li dt dd form fieldset legend details summary figcaption center hr optgroup option select dialog menu search hgroup".split())
#: What an opening tag closes before it, and the elements beyond which it doesn't reach.
_lists = frozenset("ul ol menu dl table td th caption button section article aside nav main header footer blockquote details fieldset form figure".split())
_cells, _groups = frozenset(["td", "th", "caption"]), frozenset(["thead", "tbody", "tfoot"])
CLOSES = {
    "li": ({"li"}, _lists), "dt": ({"dt", "dd"}, _lists), "dd": ({"dt", "dd"}, _lists),
    "td": (_cells, {"table", "tr"}), "th": (_cells, {"table", "tr"}), "caption": (_cells, {"table", "tr"}), "tr": (_cells | {"tr"}, {"table"}),
    "tbody": (OF_TABLE, {"table"}), "thead": (OF_TABLE, {"table"}), "tfoot": (OF_TABLE, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
#: Blocks that end an open paragraph, and the elements beyond which they don't reach.
ENDS_P = BLOCK - OF_TABLE - {"html", "body", "option", "optgroup", "select", "legend"}
P_BOUND = frozenset("td th caption table button html body".split())
#: How far an end tag reaches; where nothing else is said, to the cell, or, for what is no block, to the innermost block.
END_BOUND = {"table": (), "td": ("table",), "th": ("table",), "tr": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "li": ("ul", "ol", "td", "th", "table")}
IN_CELL = ("td", "th", "caption", "table")
IN_HEAD = frozenset("base link meta script style title template noscript head".split())
_raw_end = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*+>?", re.I) for name in RAW}
#: Types of input that show no text of theirs.
NO_TEXT = frozenset("hidden password checkbox radio file image color range".split())


def _unescaped(text: str) -> str:
    if "&#" in text:  # numbers too long for the library stand for no character anyhow
        text = _beyond.sub("&#1114112", _zeros.sub("&#", text))
    return unescape(text) if "&" in text else text


def number(text: str | None) -> int | None:
    """The whole number at the text's beginning, bounded by a billion; None if there is none."""
    if text is None or not (m := _number.match(text)):
        return None
    n = 10**9 if len(m[2]) > 9 else int(m[2])
    return -n if m[1] == "-" else n


class _Stack:
    """Open elements, the innermost last, and where each name stands in it."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, name: str) -> None:
        self.places[name].append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def last(self, names) -> int:
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def first_above(self, names, bound: int) -> int | None:
        """The outermost element of these names inside the bound."""
        found = [at[i] for n in names if (at := self.places.get(n)) and (i := bisect_right(at, bound)) < len(at)]
        return min(found, default=None)

    def cut(self, depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(self.names) > depth:
            name = self.names.pop()
            self.places[name].pop()
            if self.blocks and self.blocks[-1] == len(self.names):
                self.blocks.pop()
            yield "close", name, {}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): _unescaped(v[1:].removesuffix(v[0]) if v[:1] in ("'", '"') else v) for k, v in reversed(_attribute.findall(text))}


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open", name, attributes), ("close", name, {}) and ("text", text, {}) in order, with implied ends."""
    stack, at, size = _Stack(), 0, len(html)
    while at < size:
        m = _markup.search(html, at)
        if text := html[at : m.start() if m else size]:
            if stack.names and stack.names[-1] == "head":
                if text.strip(" \t\n\f\r"):
                    yield from stack.cut(len(stack.names) - 1)
                    yield "text", _unescaped(text), {}
            else:
                yield "text", _unescaped(text), {}
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br" or (name == "p" and stack.last(("p",)) <= stack.last(P_BOUND)):
                yield from (("open", name, {}), ("close", name, {}))
            elif name not in VOID and name not in ("html", "body"):
                same = HEADINGS if name in HEADINGS else (name,)
                bound = stack.last(END_BOUND.get(name, IN_CELL)) if name in BLOCK else (stack.blocks[-1] if stack.blocks else -1)
                if (place := stack.last(same)) > bound:
                    yield from stack.cut(place)
            continue
        if stack.names and stack.names[-1] == "head" and name not in IN_HEAD:
            yield from stack.cut(len(stack.names) - 1)
        if name in ("html", "body", "head") and (stack.places["body"] or stack.places[name]):
            continue
        if name in CLOSES:
            names, bound = CLOSES[name]
            if (place := stack.first_above(names, stack.last(bound))) is not None:
                yield from stack.cut(place)
        if name in ENDS_P and (place := stack.first_above(("p",), stack.last(P_BOUND))) is not None:
            yield from stack.cut(place)
        yield "open", name, _attributes(m[3]) if "=" in m[3] or m[3].strip(" /\t\n\f\r") else {}
        if name in VOID or (m[3].endswith("/") and (stack.places["svg"] or stack.places["math"] or name in ("svg", "math"))):
            yield "close", name, {}
        elif name in RAW:
            end = _raw_end[name].search(html, at)
            inside = html[at : end.start() if end else size]
            if name in ("textarea", "xmp"):
                yield "text", _unescaped(inside) if name == "textarea" else inside, {}
            yield "close", name, {}
            at = end.end() if end else size
        elif name == "plaintext":
            yield from (("text", html[at:], {}), ("close", name, {}))
            break
        else:
            stack.push(name)
    yield from stack.cut(0)


class Flow:
    """Lines of a page, or of one cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.spaced = True
        self.indent = 0
        self.mark = ""

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.end_line(always=True)
                self._put(x)
            return
        text = _space.sub(" ", text)
        if self.spaced:
            text = text.lstrip(" ")
        if text:
            self._put(text)
            self.spaced = text.endswith(" ")

    def _put(self, text: str) -> None:
        if text:
            self.line.append(text)
            self.spaced = False

    def end_line(self, always: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        if text or always:
            if self.blank and self.lines and text:
                self.lines.append("")
            self.blank = self.blank and not text
            mark = self.mark if text else ""
            start = " " * min(self.indent - len(mark), MOST_INDENT) + mark
            if text:
                self.mark = ""
            self.lines.append((start + text).rstrip())
        self.line, self.spaced = [], True

    def set_off(self) -> None:
        self.end_line()
        self.blank = True

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Groups of rows of cells: (lines, columns, rows; 0 rows: to the group's end)."""

    def __init__(self) -> None:
        self.groups: list[list[list[tuple[list[str], int, int]]]] = [[]]
        self.caption: list[str] = []

    def _placed(self) -> list[list[tuple[int, int, int, list[str]]]]:
        """For each row the cells that begin there: first column, end column, last row, lines."""
        out: list[list[tuple[int, int, int, list[str]]]] = []
        for rows in self.groups:
            down: list[tuple[int, int, int]] = []  # columns taken from above: first, end, last row
            final = len(out) + len(rows) - 1
            for row in rows:
                here, column, i = [], 0, 0
                for lines, wide, tall in row:
                    while i < len(down) and down[i][0] < column + wide:
                        column, i = max(column, down[i][1]), i + 1
                    last = min(len(out) + tall - 1, final) if tall else final
                    here.append((column, column + wide, last, lines))
                    column += wide
                taken = sorted([x for x in down if x[2] > len(out)] + [(a, b, last) for a, b, last, _ in here if last > len(out)])
                down = []
                for a, b, last in taken:
                    if down and down[-1][1] == a and down[-1][2] == last:
                        down[-1] = (down[-1][0], b, last)
                    else:
                        down.append((a, b, last))
                out.append(here)
        return out

    def lines(self, room: list[int]) -> list[str]:
        """room: the blanks that may still be spent on alignment; what they don't suffice for stands two blanks apart."""
        rows = self._placed()
        # only columns where a cell begins or ends count
        bounds = {c: i for i, c in enumerate(sorted({c for row in rows for cell in row for c in cell[:2]}))}
        cells = sorted((bounds[b], bounds[a], max(map(len, lines), default=0)) for row in rows for a, b, _, lines in row)
        start = [0] * len(bounds)  # where each column begins; those without text take no room
        done = 0
        for end, first, width in cells:
            while done < end:
                done += 1
                start[done] = start[done - 1]
            if width:
                start[end] = max(start[end], start[first] + width + 2)
        while done < len(bounds) - 1:
            done += 1
            start[done] = start[done - 1]
        out, open_cells = list(self.caption), []
        for r, row in enumerate(rows):
            open_cells = sorted([*open_cells, *((start[bounds[a]], last, lines, [0]) for a, _, last, lines in row)], key=lambda x: x[0])
            height = max((len(lines) - at[0] for _, last, lines, at in open_cells if last == r), default=0)
            height = max(height, *(min(1, len(lines) - at[0]) for _, _, lines, at in open_cells), 0) if open_cells else 0
            for _ in range(height):
                parts, width = [], 0
                for where, _, lines, at in open_cells:
                    if at[0] < len(lines):
                        blanks = max(0, where - width)
                        if blanks > 2 and blanks > room[0]:
                            blanks = 2 if parts else 0
                        room[0] -= blanks
                        parts.append(" " * blanks + lines[at[0]])
                        width += blanks + len(lines[at[0]])
                        at[0] += 1
                if line := "".join(parts).rstrip():
                    out.append(line)
            open_cells = [x for x in open_cells if x[1] > r and x[3][0] < len(x[2])]
        return out


def _style(a: dict[str, str]) -> dict[str, str]:
    pairs = (x.partition(":") for x in a.get("style", "").lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs}


def _shown(name: str, a: dict[str, str], style: dict[str, str], foreign: bool) -> bool:
    if name in UNSEEN or (foreign and name in UNSEEN_FOREIGN) or "hidden" in a or "popover" in a or style.get("display") == "none":
        return False
    return not (name == "input" and a.get("type", "").lower() == "hidden" or name == "dialog" and "open" not in a)


def ordinal(n: int, kind: str) -> str:
    """A list number as letters or Roman numerals, where its kind (the attribute type) and range allow."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(97 + digit) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // value), n % value
        return out if kind == "i" else out.upper()
    return str(n)


def render(html: str | None) -> str:
    """The visible text of a page."""
    html = (html or "").replace("\r\n", "\n").replace("\r", "\n")
    room = [PADDING * (len(html) + 1000)]
    flows: list[Flow] = [Flow()]
    tables: list[Table | None] = []  # None: cells one after the other
    lists: list[list] = []  # kind, number, type
    opened: list[tuple[str, bool, bool, int]] = []  # name, whether text is visible in it, whether it is closed details, indent or cell
    skip = kept = foreign = 0
    begins = False  # right after the start of preformatted text
    for kind, name, a in events(html):
        flow = flows[-1]
        if kind == "text":
            fresh, begins = begins, False
            if skip or (opened and (not opened[-1][1] or opened[-1][2])):
                continue
            if fresh and name[:1] == "\n":
                name = name[1:]
            if tables and opened and opened[-1][0] in ("table", "tr", "tbody", "thead", "tfoot") and not name.strip(" \t\n\f\r"):
                continue
            flow.text(name, kept > 0)
        elif kind == "open":
            style = _style(a) if "style" in a else {}
            if skip or (opened and opened[-1][2] and name != "summary") or not _shown(name, a, style, foreign > 0):
                skip += 1
                continue
            visibility = style.get("visibility", "")
            visible = visibility not in ("hidden", "collapse") and (visibility == "visible" or not opened or opened[-1][1])
            if name in ("svg", "math"):
                foreign += 1
            if name in SET_OFF and not (name in ("ul", "ol") and lists):
                flow.set_off()
            elif (name in BLOCK and name not in OF_TABLE) or (foreign and name == "text"):
                flow.end_line()
            undo = 0
            if name == "br":
                flow.end_line(always=True)
            elif name == "hr" and visible:
                flow.text("---", False)
                flow.end_line()
            elif name in PRE:
                kept, begins = kept + 1, True
            elif name in ("ul", "ol"):
                begin = number(a.get("start"))
                lists.append([name, 0 if begin is None else begin - 1, a.get("type", "")])
            elif name == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = number(a.get("value"))
                    lists[-1][1] = lists[-1][1] + 1 if value is None else value
                    mark = f"{ordinal(lists[-1][1], a.get('type', lists[-1][2]))}. "
                undo = len(mark)
                flow.indent += undo
                flow.mark = mark
            elif name in ("dd", "blockquote"):
                undo = 2
                flow.indent += undo
            elif name == "table":
                tables.append(Table() if len(tables) < MOST_TABLES else None)
            elif name in ("thead", "tbody", "tfoot") and tables and tables[-1]:
                tables[-1].groups.append([])
            elif name == "tr" and tables:
                if tables[-1]:
                    tables[-1].groups[-1].append([])
                else:
                    flow.end_line()
            elif name in ("td", "th", "caption"):
                if tables and tables[-1]:
                    undo = -1
                    flows.append(Flow())
                    if name != "caption":
                        rows = tables[-1].groups[-1]
                        if not rows:
                            rows.append([])
                        wide, tall = number(a.get("colspan")) or 1, number(a.get("rowspan"))
                        rows[-1].append((flows[-1].lines, min(wide, MOST_COLUMNS) if wide > 0 else 1, 1 if tall is None or tall < 0 else tall))
                else:
                    flow.text("  " if tables else " ", False)
            elif name == "input" and visible and a.get("type", "").lower() not in NO_TEXT:
                flow.text(a.get("value") or a.get("placeholder", ""), False)
            elif name == "optgroup" and visible:
                flow.text(a.get("label", ""), False)
                flow.end_line()
            opened.append((name, visible, name == "details" and "open" not in a, undo))
        elif skip:
            skip -= 1
        else:
            _, _, _, undo = opened.pop()
            if name in ("svg", "math"):
                foreign -= 1
            if undo < 0:
                lines = flows.pop().finish()
                if name == "caption":
                    tables[-1].caption += lines
                continue
            if name == "table":
                if (table := tables.pop()) is not None:
                    flow.set_off()  # from text beside the cells, which comes first
                    for x in table.lines(room):
                        flow.text(x, True)
                        flow.end_line()
            elif name in ("ul", "ol"):
                flow.end_line()
                lists.pop()
                flow.blank = flow.blank or not lists
            elif undo:
                flow.end_line()
                flow.mark = ""
                flow.indent -= undo
            elif name in PRE:
                kept -= 1
            if name in SET_OFF and name not in ("ul", "ol"):
                flow.set_off()
            elif name in BLOCK and name not in OF_TABLE:
                flow.end_line()
    return "\n".join(flows[0].finish()).strip("\n")


def visible_text(df: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """Columns row (a struct of the columns `carry`) and text."""
    rows = df.select(F.struct(*carry).alias("row"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([render(x) for x in batch.column("html").to_pylist()], pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, schema)
