"""Tables as text: OTSL tokens, HTML grids, repeated headers, and tables that continue on the next page.

Each function is plain Python over one value; the ``*_udf`` columns apply them to Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OTSL = re.compile(r"<(nl|fcel|ecel|lcel|ucel|xcel)>", re.IGNORECASE)
_IMAGE = re.compile(r'<img\s+src="data:image/[^"]*"\s*/?>', re.IGNORECASE)
#: Elements that count as content of a cell even without text.
OBJECTS = frozenset("img svg math eq table figure object embed canvas".split())
HEADER_ROWS = 5


def escape_cell(text: str) -> str:
    """Escaped text; images with inline data stay as they are."""
    out, at = [], 0
    for m in _IMAGE.finditer(text):
        out += [_escape(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _escape(text[at:])])


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


@dataclass
class Span:
    """A cell of a table under construction; covered places of the grid refer to the cell that covers them."""

    text: str = ""
    cols: int = 1
    rows: int = 1


def otsl_html(value: str) -> str:
    """OTSL to an HTML table: fcel and ecel open cells, lcel, ucel and xcel widen the cell to the left, above, or both."""
    pieces = OTSL.split(value)
    if not any(f"<{t}>" in value for t in ("nl", "fcel", "ecel", "lcel", "ucel", "xcel")):
        return value
    grid: list[list[tuple[Span | None, bool]]] = [[]]  # owner, and whether this place is the owner's own

    def owner(row: int, col: int) -> Span | None:
        return grid[row][col][0] if 0 <= row and 0 <= col < len(grid[row]) else None

    filling: Span | None = None
    for k in range(0, len(pieces), 2):
        text = pieces[k].strip()
        if filling is not None:
            filling.text += text
        elif text and not grid[-1] and k + 1 < len(pieces):
            grid[-1].append((Span(text), True))
        filling = None
        if k + 1 == len(pieces):
            break
        token, here = pieces[k + 1].lower(), grid[-1]
        if token == "nl":
            grid.append([])
        elif token in ("fcel", "ecel"):
            here.append((Span(), True))
            filling = here[-1][0] if token == "fcel" else None
        else:
            left, up = owner(len(grid) - 1, len(here) - 1), owner(len(grid) - 2, len(here)) if len(grid) > 1 else None
            cell = left if token == "lcel" else up if token == "ucel" else up or left
            if cell is not None:
                if token == "lcel" or token == "xcel" and up is None:
                    cell.cols += 1
                elif token == "ucel" or token == "xcel" and left is None:
                    cell.rows += 1
            here.append((cell, False))
    rows = [r for r in grid if r]
    if not rows:
        return value
    attr = lambda name, n: f' {name}="{n}"' if n > 1 else ""
    cells = lambda r: "".join(f"<td{attr('colspan', c.cols)}{attr('rowspan', c.rows)}>{escape_cell(c.text)}</td>" for c, own in r if own)
    return "<table>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows) + "</table>"


@dataclass
class Cell:
    tag: str
    attrs: list[tuple[str, str | None]]
    content: str
    cols: int = 1
    rows: int = 1

    @property
    def text(self) -> str:
        return unescape(re.sub(r"<[^>]*>", "", self.content))

    @property
    def has_content(self) -> bool:
        return bool(self.text.strip()) or any(t.lower() in OBJECTS for t in re.findall(r"<([a-zA-Z]+)", self.content))

    def html(self) -> str:
        spans = [(n, str(v)) for n, v in (("colspan", self.cols), ("rowspan", self.rows)) if v > 1]
        own = [(k, v) for k, v in self.attrs if k not in ("colspan", "rowspan")] + spans
        return f"<{self.tag}" + "".join(f' {k}="{_escape(v or "")}"' for k, v in own) + f">{self.content}</{self.tag}>"


class Malformed(ValueError):
    """Not one table with balanced tags."""


class _Reader(HTMLParser):
    """One table, not nested, into rows of cells; keeps the source of cells as it is."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows: list[list[Cell]] = []
        self.stack: list[str] = []
        self.cell: Cell | None = None
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            if self.tables > 1:
                raise Malformed("nested or second table")
        elif not self.stack:
            raise Malformed("content outside the table")
        if tag in ("td", "th") and self.cell is None:
            span = {n: dict(attrs).get(n) for n in ("colspan", "rowspan")}
            if not self.rows or any(v is not None and not re.fullmatch("[1-9][0-9]*", v.strip()) for v in span.values()):
                raise Malformed("a cell outside rows, or a bad span")
            self.cell = Cell(tag, attrs, "", int(span["colspan"] or 1), int(span["rowspan"] or 1))
        elif self.cell is not None:
            self.cell.content += self.get_starttag_text()
        elif tag == "tr":
            self.rows.append([])
        if tag not in ("br", "img", "hr", "col", "input"):
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        if self.cell is not None:
            self.cell.content += self.get_starttag_text()

    def handle_endtag(self, tag):
        if not self.stack or self.stack.pop() != tag:
            raise Malformed("unbalanced tags")
        if self.cell is not None and tag == self.cell.tag and "td" not in self.stack and "th" not in self.stack:
            self.rows[-1].append(self.cell)
            self.cell = None
        elif self.cell is not None:
            self.cell.content += f"</{tag}>"

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.content += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def parse(html: str) -> list[list[Cell]] | None:
    """The rows of a table; null if it is not one well-formed table."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (Malformed, AssertionError):
        return None
    return reader.rows if reader.tables == 1 and not reader.stack else None


def serialise(rows: list[list[Cell]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(c.html() for c in r) + "</tr>" for r in rows) + "</table>"


@dataclass
class Grid:
    """Where the cells of a table stand: places[(row, column)] = (row, number) of the cell that covers it."""

    rows: list[list[Cell]]
    places: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    starts: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self):
        for r, row in enumerate(self.rows):
            col = 0
            for k, cell in enumerate(row):
                while (r, col) in self.places:
                    col += 1
                self.starts[r, k] = col
                self.places.update({(r + i, col + j): (r, k) for i in range(cell.rows) for j in range(cell.cols)})
                col += cell.cols

    def effective(self, r: int) -> int:
        """Columns up to the last one that is covered in a row."""
        return max((c + 1 for (i, c) in self.places if i == r), default=0)

    def actual(self, r: int) -> int:
        return sum(c.cols for c in self.rows[r])

    @property
    def total(self) -> int:
        return max((c + 1 for _, c in self.places), default=0)

    def segments(self, r: int) -> int:
        """Runs of columns of one row that one cell covers."""
        owners = [self.places.get((r, c)) for c in range(self.total)]
        return sum(o is not None and (k == 0 or owners[k - 1] != o) for k, o in enumerate(owners))

    @property
    def tail(self) -> set[int]:
        """Columns that cells still cover below the last row."""
        return {c for r, c in self.places if r >= len(self.rows)}


def _plain(cell: Cell) -> str:
    half = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in cell.text)
    return "".join(half.split())


def header_rows(previous: Grid, current: Grid) -> int:
    """How many leading rows of the current table repeat the previous one's, cells that reach below included."""

    def same(r: int, strict: bool) -> bool:
        a, b = previous.rows[r], current.rows[r]
        if [_plain(c) for c in a] != [_plain(c) for c in b]:
            return False
        if strict:
            return [(c.cols, c.rows) for c in a] == [(c.cols, c.rows) for c in b] and previous.effective(r) == current.effective(r)
        return previous.segments(r) == current.segments(r)

    count = 0
    for strict in (True, False):
        if not count:
            for r in range(min(len(previous.rows), len(current.rows), HEADER_ROWS)):
                if not same(r, strict):
                    break
                count += 1
    r = 0
    while r < min(count, len(current.rows)):
        count = min(max([count, *(r + c.rows for c in current.rows[r])]), len(current.rows))
        r += 1
    return count


def compatible(previous: Grid, current: Grid) -> bool:
    """Equal widths, or the last row of the one fits the first data row of the other."""
    if previous.total == current.total:
        return True
    first = header_rows(previous, current)
    last = max((r for r, row in enumerate(previous.rows) if row), default=None)
    if last is None or first >= min(len(current.rows), HEADER_ROWS + 1):
        return False
    return previous.effective(last) == current.effective(first) or previous.actual(last) == current.actual(first) or previous.segments(last) == current.segments(first)


def _widened(rows: list[list[Cell]], grid: Grid, start: int, like: list[Cell], match: list[Cell], total: int) -> list[list[Cell]]:
    """Rows with as many cells as ``like``, widened to a total: by its spans if they look like ``match``, else at the last cell."""
    out = []
    for r, row in enumerate(rows):
        short = r >= start and row and len(row) == len(like) and grid.effective(r) < total and sum(c.cols for c in row) < total
        if not short:
            out.append(row)
        elif [c.cols for c in row] == [c.cols for c in match]:
            out.append([replace(c, cols=k.cols if k.cols > 1 else c.cols) for c, k in zip(row, like, strict=True)])
        else:
            out.append([*row[:-1], replace(row[-1], cols=row[-1].cols + total - grid.effective(r))])
    return out


def columns(grid: Grid, r: int, taken: set[int] = frozenset()) -> dict[int, int]:
    """The cell of a row that stands in each column; taken: columns that cells above the table reach into."""
    if not taken:
        return {c: k for k, cell in enumerate(grid.rows[r]) for c in range(grid.starts[r, k], grid.starts[r, k] + cell.cols)}
    out, at = {}, 0
    for k, cell in enumerate(grid.rows[r]):
        while at in taken:
            at += 1
        out.update(dict.fromkeys(range(at, at + cell.cols), k))
        at += cell.cols
    return out


def _without_row(rows: list[list[Cell]]) -> list[list[Cell]]:
    """Rows after the first one, which goes: its empty cells that reach below stand in the next row, a row shorter."""
    grid, rest = Grid(rows), [list(r) for r in rows[1:]]
    if rest:
        row = sorted([(grid.starts[1, k], c) for k, c in enumerate(rest[0])] + [(grid.starts[0, k], replace(c, rows=c.rows - 1)) for k, c in enumerate(rows[0]) if c.rows > 1 and not c.has_content], key=lambda x: x[0])
        rest[0] = [c for _, c in row]
    return rest


def joined_cells(before: list[list[Cell]], after: list[list[Cell]], flags: list) -> tuple[list[list[Cell]], list[list[Cell]]]:
    """The rows above and below a page's end, where flagged columns go on: the upper cell takes the lower one's content.

    A lower row that is left without content goes."""
    if not before or not after:
        return before, after
    grid = Grid(before)
    upper = columns(grid, len(before) - 1)
    lower = columns(Grid(after), 0, {c for r, c in grid.places if r == len(before)})
    pairs = sorted({(upper[c], lower[c]) for c, flag in enumerate(flags) if flag in (1, True) and c in upper and c in lower})
    last, first = list(before[-1]), list(after[0])
    for a, b in pairs:
        last[a] = replace(last[a], content=last[a].content + after[0][b].content)
    for _, b in pairs:
        first[b] = replace(first[b], content="")
    rest = [first, *after[1:]] if any(c.has_content for c in first) else _without_row([first, *after[1:]])
    return [*before[:-1], last], rest


def merge(previous_html: str, current_html: str, previous_width: int, current_width: int, flags: list | None = None) -> str | None:
    """One table of two that continue each other; null if they do not.

    Their widths on the page differ by less than a tenth, their columns fit; the repeated header goes.  flags: for each
    column whether the cell at the page's end goes on in the next table."""
    if min(previous_width, current_width) <= 0 or abs(previous_width - current_width) * 10 >= min(previous_width, current_width):
        return None
    before, after = parse(previous_html), parse(current_html)
    if before is None or after is None:
        return None
    a, b = Grid(before), Grid(after)
    if not compatible(a, b):
        return None
    header = header_rows(a, b)
    if before and header < len(after):
        if a.total > b.total:
            after = _widened(after, b, header, before[-1], after[header], a.total)
        elif b.total > a.total:
            before = _widened(before, a, 0, after[header], before[-1], b.total)
    rest = after[header:]
    if flags:
        before, rest = joined_cells(before, rest, flags)
    return serialise(before + rest)


def shape(html: str) -> tuple[int, int, int, int] | None:
    """(rows, total columns, columns of the last row, columns that reach below)."""
    rows = parse(html)
    if rows is None:
        return None
    g = Grid(rows)
    return len(rows), g.total, g.effective(len(rows) - 1) if rows else 0, len(g.tail)


@F.pandas_udf(T.StringType())
def otsl_html_udf(values: pd.Series) -> pd.Series:
    return values.map(otsl_html, na_action="ignore")


@F.pandas_udf(T.StringType())
def merge_udf(previous: pd.Series, current: pd.Series, previous_width: pd.Series, current_width: pd.Series) -> pd.Series:
    return pd.Series([merge(*x) for x in zip(previous, current, previous_width, current_width, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def merge_cells_udf(previous: pd.Series, current: pd.Series, previous_width: pd.Series, current_width: pd.Series, flags: pd.Series) -> pd.Series:
    rows = zip(previous, current, previous_width, current_width, flags, strict=True)
    return pd.Series([merge(*x[:4], None if x[4] is None else list(x[4])) for x in rows], dtype="object")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("row", "cell", "first", "last", "depth")])))
def cells_udf(values: pd.Series) -> pd.Series:
    """Each cell of a table with the columns it covers and the rows it reaches down."""

    def one(html: str | None) -> list | None:
        rows = parse(html) if html is not None else None
        grid = Grid(rows) if rows is not None else None
        return None if grid is None else [(r, k, grid.starts[r, k], grid.starts[r, k] + c.cols - 1, c.rows) for r, row in enumerate(rows) for k, c in enumerate(row)]

    return values.map(one)


def column_sources(frame, keys: list[str], html: str):
    """(keys..., row, column, cell): which cell of a row stands in each column of a table; a row that one reaches from above has none there."""
    cells = frame.select(*keys, F.explode(cells_udf(html)).alias("c")).select(*keys, "c.*")
    return cells.select(*keys, "row", F.explode(F.sequence("first", "last")).alias("column"), "cell")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("rows", "columns", "last", "tail")]))
def shape_udf(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shape(x) or (None,) * 4 for x in values], columns=["rows", "columns", "last", "tail"]).astype("Int32")


@F.pandas_udf(T.IntegerType())
def header_rows_udf(previous: pd.Series, current: pd.Series) -> pd.Series:
    pairs = ((parse(a), parse(b)) for a, b in zip(previous, current, strict=True))
    return pd.Series([None if a is None or b is None else header_rows(Grid(a), Grid(b)) for a, b in pairs], dtype="Int32")


@F.pandas_udf(T.StringType())
def unescape_udf(values: pd.Series) -> pd.Series:
    """All character references, as HTML5 recovers them."""
    return values.map(unescape, na_action="ignore")
