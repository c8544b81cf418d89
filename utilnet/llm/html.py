"""Text of web pages as a reader sees it: layout-aware rendering.

The standard tokenizer's events drive a tree builder that keeps the open elements, ends those
that a new tag implies to be ended, and ignores end tags that end nothing. Every open element
knows whether it is visible and how it is laid out, and visible text flows into lines: blocks
start lines and keep their distance, lists are marked and indented, preformatted text keeps its
white space, and the cells of a table are rendered on their own and aligned in columns. Nothing
recurses, so depth is bounded by memory alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table hr figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html "
    "legend li main nav option section summary tbody td tfoot th thead tr search optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title iframe audio video canvas datalist noframes noembed "
                   "annotation annotation-xml".split())
#: Drawings show the text of these elements only, and nothing of what they define or describe.
DRAWN = frozenset({"text", "foreignobject"})
DEFINED = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
FOREIGN = frozenset({"svg", "math"})
#: A start tag ends these open elements, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
CELL_SCOPE = frozenset({"td", "th", "table", "caption"})
TABLE_TAGS = frozenset("table tr td th thead tbody tfoot caption".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_STYLED = re.compile(r"<style\b.*?\bnone\b", re.I | re.S)
_QUOTED = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_EDGE = re.compile(r"[{};]")
_COMPOUND = re.compile(r"(?:\*|[a-z][\w-]*)?(?:[.#][\w-]+)*\Z", re.I)
_PART = re.compile(r"[.#]?[\w-]+|\*")


def on_screen(media: str) -> bool:
    """Whether a media list holds for any screen; what depends on its features does not."""
    for one in media.lower().split(","):
        words = one.split()
        if words[:1] == ["only"]:
            words = words[1:]
        if words in ([], ["all"], ["screen"]) or len(words) == 2 and words[0] == "not" and words[1] not in ("all", "screen"):
            return True
    return False


def display(body: str) -> tuple[bool, bool] | None:
    """(important, none) of the last display declaration that counts."""
    found = None
    for part in body.split(";"):
        name, _, value = part.partition(":")
        if name.strip().lower() != "display":
            continue
        value, _, mark = value.strip().lower().partition("!")
        important = mark.strip() == "important"
        if re.fullmatch(r"[a-z][a-z -]*", value.strip()) and (found is None or important >= found[0]):
            found = (important, value.strip() == "none")
    return found


class Rules:
    """Display rules of the sheets that hold on a screen.

    Selectors are tags, classes and ids, joined as descendants and children; rules with other
    selectors, and those inside conditions other than plain media, do not apply.
    """

    def __init__(self) -> None:
        self.steps: dict[str, list[tuple[int, int, frozenset[str], bool]]] = {}
        self.ends: list[tuple[int, tuple, bool]] = []  # last step, weight, none

    def read(self, css: str) -> None:
        css = _QUOTED.sub(lambda m: " " if m.group()[0] == "/" else "''", css).replace("<!--", " ").replace("-->", " ")
        inside, at, selectors, body = ["list"], 0, "", []
        for m in [*_EDGE.finditer(css), None]:
            part, edge = (css[at:m.start()], m.group()) if m else (css[at:], "")
            at = m.end() if m else len(css)
            if edge == "{":
                head = part.strip()
                if inside[-1] != "list":
                    inside.append("skip")
                elif head.startswith("@"):
                    name, _, condition = head[1:].replace("(", " (", 1).partition(" ")
                    holds = name.lower() == "layer" or name.lower() == "media" and on_screen(condition)
                    inside.append("list" if holds else "skip")
                else:
                    inside.append("rule")
                    selectors, body = head, []
                continue
            if inside[-1] == "rule":
                body.append(part)
            if edge != ";":
                if inside[-1] == "rule":
                    self._add(selectors, ";".join(body))
                if len(inside) > 1:
                    inside.pop()

    def _add(self, selectors: str, body: str) -> None:
        found = display(body)
        if found is None:
            return
        for selector in selectors.split(","):
            words = re.sub(r"\s*>\s*", " > ", selector).split()
            chain, child = [], False
            for word in words:
                if word == ">":
                    child = True
                elif _COMPOUND.match(word):
                    chain.append((frozenset(p if p[0] in ".#" else p.lower() for p in _PART.findall(word)), child))
                    child = False
                else:
                    chain = []
                    break
            if not chain or child or chain[0][1]:
                continue
            parts = [p for names, _ in chain for p in names if p != "*"]
            weight = (found[0], sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts),
                      sum(p[0] not in "#." for p in parts), len(self.ends))
            for k, (names, direct) in enumerate(chain):
                self.steps.setdefault(min(names), []).append((len(self.ends), k, names, direct))
            self.ends.append((len(chain) - 1, weight, found[1]))

    def match(self, names: set[str], above: "Element", e: "Element") -> tuple[bool, bool] | None:
        """(important, none) of the rule that wins for an element; notes how far rules got with it."""
        best, met = None, set()
        for name in names:
            for rule, k, wanted, direct in self.steps.get(name, ()):
                if wanted <= names and (not k or (rule, k - 1) in (above.met if direct else above.under)):
                    last, weight, none = self.ends[rule]
                    if k < last:
                        met.add((rule, k))
                    elif best is None or weight > best[0]:
                        best = (weight, none)
        e.met = frozenset(met)
        e.under = above.under | met if met - above.under else above.under
        return best and (best[0][0], best[1])


class Sheets(HTMLParser):
    """Reads the style elements of a page ahead of its text, since later sheets hold for all of it."""

    def __init__(self) -> None:
        super().__init__()
        self.rules = Rules()
        self.css: list[str] | None = None
        self.inert: dict[str, int] = {"template": 0, "noscript": 0}

    def handle_starttag(self, tag: str, attrs) -> None:
        given = dict(attrs)
        if tag in self.inert:
            self.inert[tag] += 1
        elif tag == "style" and not any(self.inert.values()):
            kind = (given.get("type") or "text/css").strip().lower()
            if kind == "text/css" and on_screen(given.get("media") or ""):
                self.css = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inert:
            self.inert[tag] = max(0, self.inert[tag] - 1)
        elif tag == "style":
            self.finish()

    def handle_data(self, data: str) -> None:
        if self.css is not None:
            self.css.append(data)

    def finish(self) -> None:
        if self.css is not None:
            self.rules.read("".join(self.css))
            self.css = None


class Flow:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # 1: a blank line is due before the next line
        self.space = False
        self.indent = ""
        self.marker = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.end_line(keep=True)
                self._add(line)
            return
        words = _SPACE.sub(" ", data)
        if words.startswith(" ") and self.now:
            self.space = True
        core = words.strip(" ")
        if core:
            self._add((" " if self.space and self.now else "") + core)
            self.space = words.endswith(" ")

    def _add(self, part: str) -> None:
        if not part:
            return
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            indent = self.indent
            if self.marker:
                indent = indent[:max(0, len(indent) - len(self.marker))] + self.marker
                self.marker = ""
            self.now.append(indent)
        self.now.append(part)

    def end_line(self, keep: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.hanging: list[tuple[int, int, int]] = []  # first row below, first and next column of cells that reach down
        self.taken: list[tuple[int, int]] = []  # columns of this row that cells above fill, merged

    def row(self) -> None:
        self.rows.append([])
        y = len(self.rows) - 1
        self.hanging = [h for h in self.hanging if h[0] > y]
        self.taken = []
        for _, begin, end in sorted(self.hanging, key=lambda h: h[1]):
            if self.taken and begin <= self.taken[-1][1]:
                self.taken[-1] = (self.taken[-1][0], max(end, self.taken[-1][1]))
            else:
                self.taken.append((begin, end))

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        cells = self.rows[-1]
        x = cells[-1][0] + cells[-1][1] if cells else 0
        k = bisect.bisect_right(self.taken, x, key=lambda t: t[0]) - 1
        if k >= 0 and x < self.taken[k][1]:
            x = self.taken[k][1]
        if down > 1:
            self.hanging.append((len(self.rows) - 1 + down, x, x + across))
        cells.append((x, across, lines))

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for cells in self.rows:
            for x, across, lines in cells:
                if across == 1:
                    width[x] = max(width.get(x, 0), *(len(line) for line in lines), 0)
        for cells in self.rows:
            for x, across, lines in cells:
                if across > 1:  # a wide cell stretches its last column
                    have = sum(w for c, w in width.items() if x <= c < x + across) if len(width) < across else sum(
                        width.get(x + k, 0) for k in range(across))
                    have += 2 * (across - 1)
                    last = x + across - 1
                    width[last] = width.get(last, 0) + max(0, max((len(line) for line in lines), default=0) - have)
        begin, at, most = {}, 0, max(width, default=-1)
        for x in sorted({*width, *(x for cells in self.rows for x, _, _ in cells if x <= most)}):
            begin[x] = at
            at += width.get(x, 0) + 2 if width.get(x, 0) else 0
        out = []
        for cells in self.rows:
            for k in range(max((len(lines) for _, _, lines in cells), default=0)):
                line = ""
                for x, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(begin.get(x, 0)) + lines[k]
                out.append(line.rstrip())
        return out


class Element:
    __slots__ = ("tag", "seen", "shown", "pre", "count", "flow", "table", "indent", "span", "met", "under")

    def __init__(self, tag, seen, shown, pre):
        self.tag, self.seen, self.shown, self.pre = tag, seen, shown, pre
        self.count = 0
        self.flow = self.table = self.indent = None
        self.span = (1, 1)
        self.met = self.under = frozenset()


def _number(value: str | None, default: int, most: int = 1000) -> int:
    digits = value.lstrip("0") if value and value.isdecimal() else ""
    if len(digits) > 9:
        return most
    return min(most, int(digits)) or default if digits else default


class Renderer(HTMLParser):
    def __init__(self, rules: Rules) -> None:
        super().__init__(convert_charrefs=True)
        self.flow = Flow()
        self.open = [Element("", True, True, False)]
        self.rules = rules
        self.opened: dict[str, int] = {}

    # tree building

    def _has(self, tags, stop) -> int:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                return k
            if tag in stop:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS:
            tags, stop = ENDS[tag]
            k = self._has(tags, stop)
            if k:
                self._close(k)
        elif tag in BLOCKS and self.opened.get("p"):
            k = self._has({"p"}, CELL_SCOPE)
            if k:
                self._close(k)
        if tag in ("td", "th") and self.opened.get("table") and not self._has({"tr"}, {"table"}):
            self.handle_starttag("tr", [])  # implied
        given = dict(attrs)
        if tag == "br":
            if self.open[-1].seen and self.open[-1].shown:
                self.flow.end_line(keep=True)
            return
        if tag == "hr":
            self.flow.block(True)
            return
        if tag in VOID:
            return
        self._start(tag, given)

    def _start(self, tag: str, given: dict[str, str | None]) -> None:
        above = self.open[-1]
        style = given.get("style") or ""
        names = {"*", tag, *("." + c for c in (given.get("class") or "").split())}
        if given.get("id"):
            names.add("#" + given["id"])
        drawn = bool(self.opened.get("svg")) and tag != "svg"
        e = Element("details!" if tag == "details" and "open" not in given else tag, above.seen, above.shown,
                    above.pre or tag in ("pre", "textarea", "listing"))
        ruled = self.rules.match(names, above, e) if self.rules.ends else None
        own = display(style) if style else None
        if own is None or ruled and ruled[0] > own[0]:
            own = ruled
        if own is None:  # what the page says itself comes before the defaults
            own = (False, "hidden" in given or (tag == "dialog" and "open" not in given)
                   or ((drawn or tag == "svg") and given.get("display") == "none"))
        hidden = tag in UNSEEN or own[1] or (drawn and tag in DEFINED) or (above.tag == "details!" and tag != "summary")
        e.seen = above.seen and not hidden
        found = _VISIBILITY.search(style)
        if found:
            e.shown = found.group(1).lower() == "visible"
        self.open.append(e)
        self.opened[e.tag] = self.opened.get(e.tag, 0) + 1
        if not e.seen:
            return
        if drawn and (tag == "text" or tag == "tspan" and ("x" in given or "y" in given)):
            self.flow.end_line()
        elif above.tag in ("mfrac", "mtr", "mtable"):
            self.flow.space = True
        if tag in BLOCKS and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            nested = tag in ("ul", "ol", "menu") and self._has({"li"}, {"table"})
            self.flow.block(tag in SPACED and not nested)
        if tag in ("ul", "ol", "menu", "dd", "blockquote"):
            e.indent = self.flow.indent
            self.flow.indent += "   " if tag == "ol" else "  " if tag in ("ul", "menu") else "    "
            e.count = _number(given.get("start"), 1, 10**6) - 1
        elif tag == "li":
            k = self._has({"ul", "ol", "menu"}, {"table"})
            if k and self.open[k].tag == "ol":
                self.open[k].count = _number(given.get("value"), self.open[k].count + 1, 10**6)
                self.flow.marker = f"{self.open[k].count}. "
            else:
                self.flow.marker = "- "
        elif tag == "table":
            e.table = Table()
        elif tag == "tr":
            k = self._has({"table"}, ())
            if k and self.open[k].table:
                self.open[k].table.row()
        elif tag in ("td", "th", "caption"):
            e.flow, self.flow = self.flow, Flow()
            e.span = (_number(given.get("colspan"), 1), _number(given.get("rowspan"), 1))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        # a slash closes nothing but void elements, and elements of drawings and formulas
        k = self._has(FOREIGN | {"foreignobject"}, ())
        if k and self.open[-1].tag == tag and (self.open[k].tag in FOREIGN or k == len(self.open) - 1):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        names = {tag, "details!"} if tag == "details" else {tag}
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            names = {"h1", "h2", "h3", "h4", "h5", "h6"}
        k = self._has(names, {"table"} if tag in TABLE_TAGS and tag != "table" else () if tag == "table" else CELL_SCOPE)
        if k:
            self._close(k)
        elif tag == "p":
            self.flow.block(True)

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            self._end(self.open.pop())

    def _end(self, e: Element) -> None:
        self.opened[e.tag] -= 1
        if not e.seen:
            return
        tag = e.tag.rstrip("!")
        if tag == "text" and self.opened.get("svg"):
            self.flow.end_line()
        if e.flow is not None:
            lines, self.flow = self.flow.done(), e.flow
            if tag == "caption":
                self._lines(lines)
                return
            k = self._has({"table"}, ())
            if k and self.open[k].table:
                self.open[k].table.cell(lines, *e.span)
            else:
                self._lines(lines)
            return
        if e.table is not None:
            self._lines(e.table.lines())
        if e.indent is not None:
            self.flow.end_line()
            self.flow.indent = e.indent
        if tag == "li":
            self.flow.end_line()
            self.flow.marker = ""
        if tag in BLOCKS and tag not in TABLE_TAGS or tag == "table":
            nested = tag in ("ul", "ol", "menu") and self._has({"li"}, {"table"})
            self.flow.block(tag in SPACED and not nested)

    def _lines(self, lines: list[str]) -> None:
        self.flow.end_line()
        for line in lines:
            if line:
                self.flow.text(line, True)
            self.flow.end_line(keep=True)

    # text

    def handle_data(self, data: str) -> None:
        e = self.open[-1]
        if not e.seen or not e.shown or e.tag == "details!":
            return
        if e.tag in ("table", "tr", "tbody", "thead", "tfoot"):  # text outside cells stands before the table
            if not data.strip():
                return
        if self.opened.get("svg") and self.open[self._has(DRAWN | {"svg"}, ())].tag == "svg":
            return
        self.flow.text(data, e.pre)


def rules_of(page: str) -> Rules:
    """The display rules of a page's own sheets."""
    sheets = Sheets()
    if _STYLED.search(page):
        sheets.feed(page)
        sheets.close()
        sheets.finish()
    return sheets.rules


def render(page: str | None) -> str:
    """All visible text of a page, laid out. Null and empty pages have none."""
    if not page:
        return ""
    r = Renderer(rules_of(page))
    r.feed(page)
    r.close()
    r._close(1)
    lines = r.flow.done()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with ``text``: every row, a column named text is replaced."""
    base = pages.drop("text")
    names = [c for c in base.columns if c != "html"]
    out = base.select(*names, F.lit("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [render(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())],
                                             names=[*names, "text"])

    return base.mapInArrow(run, out.schema)
