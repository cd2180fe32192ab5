"""HTML to text by layout.

A tree builder keeps the open elements, closes and opens those that the rules of HTML imply (paragraphs before blocks, list items,
table rows and cells), and marks what isn't shown. An element that makes a box lays its lines out when it closes and hands them to the box
around it, so deep pages need no recursion: paragraphs and headings keep an empty line, blocks a line of their own, lists their marks and
indents, preformatted text its white space, tables aligned cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("blockquote dl fieldset figure form hr ol p pre table ul".split()) | HEADINGS
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog div dt figcaption footer header hgroup html legend li main menu nav "
                            "optgroup option search section summary tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
UNSEEN = frozenset("audio canvas datalist head iframe noembed noframes noscript object rp script style svg template title video".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")
#: Beyond this a column of a table isn't padded.
WIDEST = 80
#: What an opening tag closes if open, and up to where it looks.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
         "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
         "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
         "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"})}


class Box:
    """Lines laid out so far, and text of the line under way."""

    def __init__(self, tag: str, pre: bool, alone: bool = False):
        self.alone = alone  # a table row outside any table
        self.tag, self.pre, self.lines, self.text, self.gap, self.rows, self.count = tag, pre, [], [], 0, [], 0

    def flush(self) -> None:
        """Lay the text under way out."""
        text, self.text = "".join(self.text), []
        if self.pre:
            lines = [x.rstrip() for x in text.strip("\n").split("\n")] if text.strip("\n") else []
        else:
            lines = [_WHITE.sub(" ", x).strip(" ") for x in text.split("\v")]
            while lines and not lines[-1]:
                lines.pop()
        if any(lines):
            self.put(lines, 0)

    def put(self, lines: list[str], gap: int) -> None:
        if self.alone and self.rows:
            # Text after the cells of a row without a table: the cells come first.
            cells, self.rows = self.rows, []
            self.put(_cells(cells), 0)
        if lines:
            if self.lines and max(self.gap, gap):
                self.lines.append("")
            self.lines += lines
            self.gap = gap
        elif gap:
            self.gap = gap


def _table(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of cells (lines, columns spanned), one below the other, cells aligned."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = min(WIDEST, max(widths.get(at, 0), *map(len, lines), 0))
            at += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                wide = sum(widths.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(min(wide, WIDEST * span)))
                at += span
            out.append(" | ".join(parts).rstrip())
    return out


def _cells(row: list[tuple[list[str], int]]) -> list[str]:
    """The cells of a row without a table: side by side, or one below the other if any has several lines."""
    if all(len(lines) < 2 for lines, _ in row):
        line = " | ".join(lines[0] if lines else "" for lines, _ in row).rstrip()
        return [line] if any(lines for lines, _ in row) else []
    return [x for lines, _ in row for x in lines]


class Layout(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: tag, whether it and all around it are shown, its box or None.
        self.open: list[tuple[str, bool, Box | None]] = [("", True, Box("", False))]
        self.boxes = [self.open[0][2]]
        self.tally: dict[str, int] = {}

    def _holds(self, tags: set[str], until: set[str]) -> bool:
        """Whether one of the tags is open inside the innermost of `until`."""
        if not any(self.tally.get(t) for t in tags):
            return False
        for tag, _, _ in reversed(self.open):
            if tag in tags:
                return True
            if tag in until:
                return False
        return False

    def _push(self, tag: str, shown: bool) -> None:
        box = None
        if tag in BLOCKS and shown:
            self.boxes[-1].flush()
            box = Box(tag, tag == "pre" or self.boxes[-1].pre, tag == "tr" and not self.tally.get("table"))
            self.boxes.append(box)
        self.open.append((tag, shown, box))
        self.tally[tag] = self.tally.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, shown, box = self.open.pop()
        self.tally[tag] -= 1
        if box is None:
            return
        box.flush()
        self.boxes.pop()
        around, lines = self.boxes[-1], box.lines
        if tag == "li":
            around.count += 1
            mark = f"{around.count}. " if around.tag == "ol" else "- "
            lines = [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)]
        elif tag in ("blockquote", "dd"):
            lines = ["  " + x if x else x for x in lines]
        elif tag in ("td", "th") and around.tag == "tr":
            around.rows.append((lines, box.count or 1))
            return
        elif box.alone:
            box.put([], 0)
            lines = box.lines
        elif tag == "tr" and (table := next((b for b in reversed(self.boxes) if b.tag == "table"), None)):
            if box.rows:
                table.rows.append(box.rows)
        elif tag == "table" and box.rows:
            lines = lines + _table(box.rows)
        around.put(lines, int(tag in SPACED))

    def _close(self, tags: set[str]) -> None:
        while len(self.open) > 1:
            tag = self.open[-1][0]
            self._pop()
            if tag in tags:
                return

    def _leave_head(self) -> None:
        while self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if (tag == "body" or tag in CLOSES_P) and self.tally.get("head"):
            self._close({"head"})
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in CLOSES_P and self._holds({"p"}, {"table", "td", "th", "button"}):
            self._close({"p"})
        if tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self._pop()
        if tag in _ENDS:
            closes, until = _ENDS[tag]
            while self._holds(closes, until):
                self._close(closes)
            if tag in ("td", "th") and self._holds({"table"}, set()) and not self._holds({"tr"}, {"table"}):
                self._push("tr", self.open[-1][1])
        given = dict(attrs)
        shown = self.open[-1][1] and tag not in UNSEEN and "hidden" not in given and not _HIDING.search(given.get("style") or "")
        if tag in VOID:
            if tag == "br" and shown:
                self.boxes[-1].text.append("\n" if self.boxes[-1].pre else "\v")
            elif tag == "hr" and shown:
                self.boxes[-1].flush()
                self.boxes[-1].put([], 1)
            return
        self._push(tag, shown)
        box = self.open[-1][2]
        if box and tag in ("td", "th") and re.fullmatch("[1-9][0-9]{0,2}", given.get("colspan") or ""):
            box.count = int(given["colspan"])
        if box and tag == "ol" and re.fullmatch("-?[0-9]{1,9}", given.get("start") or ""):
            box.count = int(given["start"]) - 1

    def handle_endtag(self, tag: str) -> None:
        wall = set() if tag in ("table", "body", "html") else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th"}
        if self._holds({tag}, wall):
            self._close({tag})
        elif tag == "p" and self.open[-1][1]:
            self.boxes[-1].flush()
            self.boxes[-1].put([], 1)

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._leave_head()
        if self.open[-1][1]:
            # Characters that stand for line ends here are none in a text.
            self.boxes[-1].text.append(data.replace("\v", " "))

    def result(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._pop()
        self.boxes[0].flush()
        return "\n".join(self.boxes[0].lines)


def render(html: str) -> str:
    layout = Layout()
    layout.feed(html)
    return layout.result()


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id and the visible text.

    Only page_id and html are read. A null html has a null text, an empty or wholly hidden one an empty text. Elements left open close at the
    end. Rows that share a page_id have a row each; an empty table gives no rows. Pages are independent: nothing is shuffled.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [None if x is None else render(x) for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), pa.array(text, pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(
        task, "page_id long, text string")
