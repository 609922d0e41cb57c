"""Text tables: cells, separator lines, alignment, fitting, rendering, and the converter from text to HTML and back."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import escape_html, u_trim
from pagewright.names import CLASS_PREFIX

# What stands for a pipe, the lines of box tables, cells of separator lines, classes of alignment.
PIPES = "｜︱│┃"
#: A corner, lines and crossings, a corner.
BORDER = re.compile(r"^\s*[┌├└┏┠┗+][─━\-┬┼┴┯┿┷+]*[┐┤┘┓┫┛+]\s*$")
ANY_PIPE = re.compile(f"[|{PIPES}]")
SEPARATOR_CELL = "^:?[-—－]+:?$"
ALIGN = {"both": f"{CLASS_PREFIX}align-center", "left": f"{CLASS_PREFIX}align-left", "right": f"{CLASS_PREFIX}align-right"}


def split_cells(line: Column) -> Column:
    """Cells between pipes; an escaped pipe is text; empty cells at bordered ends go."""
    s = u_trim(line)
    parts = F.split(F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"(?<!\\)\|$", ""), r"(?<!\\)\|")
    return F.transform(parts, lambda p: u_trim(F.replace(p, F.lit("\\|"), F.lit("|"))))


def is_separator(line: Column) -> Column:
    return line.rlike(r"(?<!\\)\|") & F.forall(split_cells(line), lambda c: c.rlike(SEPARATOR_CELL))


def align_class(cell: Column) -> Column:
    left, right = F.startswith(cell, F.lit(":")), F.endswith(cell, F.lit(":"))
    return F.when(left & right, ALIGN["both"]).when(left, ALIGN["left"]).when(right, ALIGN["right"])


def fit(cells: Column, width: Column) -> Column:
    """Exactly ``width`` cells: padded, or the overflow joined to the last."""
    n = F.size(cells)
    short = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - n, F.lit(0))))
    long = F.concat(F.slice(cells, F.lit(1), F.greatest(width - 1, F.lit(0))), F.array(F.array_join(F.slice(cells, width, F.greatest(n - width + 1, F.lit(0))), "")))
    return F.when(n <= width, short).otherwise(long)


def render_table(header: Column, rows: Column, aligns: Column) -> Column:
    def row(cells, tag):
        return F.array_join(F.transform(cells, lambda c, i: F.concat(F.lit(f"<{tag}"), F.coalesce(F.concat(F.lit(' class="'), F.get(aligns, i), F.lit('"')), F.lit("")), F.lit(">"), escape_html(c), F.lit(f"</{tag}>"))), "")

    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), row(r, "td"), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table><thead><tr>"), row(header, "th"), F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>"))


#: Tables by the kinds of their lines: P row, S separator, B border, _ blank, t text with two columns, x other.
MARKED = re.compile("P_*S(?:_*[PS])+")
UNMARKED = re.compile("P(?:_*[PS])+")
BOXED = re.compile("B[BPS]+")
SPACED = re.compile("t{2,}")
#: A page without any of these holds no table, unless columns may be parted by spaces.
NEEDED = f"[|{PIPES}]"
CONVERTED = "struct<text:string,chunks:array<struct<start:int,end:int,html:string>>>"


def _cells(line: str) -> list[str]:
    body = re.sub(r"^\s*\||(?<!\\)\|\s*$", "", line)
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", body.strip())]


def _columns(line: str) -> list[str]:
    return [c for c in re.split(r"\t+|[ \u3000]{2,}", line.strip()) if c]


def unglued(line: str) -> list[str] | None:
    """The rows of a line in which ``||`` glues rows of the same number of cells, two at least."""
    text = line.translate({ord(c): "|" for c in PIPES}).strip()
    parts = [x.strip() for x in re.split(r"\|{2,}", text) if x.strip()] if text.startswith("|") else []
    rows = ["| " * (k > 0) + x + " |" * (k < len(parts) - 1) for k, x in enumerate(parts)]
    sizes = {len(_cells(r)) for r in rows}
    return rows if len(rows) > 1 and len(sizes) == 1 and min(sizes) > 1 else None


def _kind(line: str, spaced: bool) -> str:
    """The kind of a line whose pipes are plain."""
    if re.search(r"(?<!\\)\|", line):
        return "S" if all(re.match(SEPARATOR_CELL, c) for c in _cells(line)) else "P"
    if BORDER.match(line):
        return "B"
    if not line.strip():
        return "_"
    return "t" if spaced and "<" not in line and len(_columns(line)) > 1 else "x"


def _markup(rows: list[list[str]], width: int, aligns: list) -> str:
    """The first row as the header; short rows are padded, the overflow of long ones goes to the last cell."""

    def shown(row, tag):
        full = row + [""] * (width - len(row)) if len(row) <= width else [*row[: width - 1], "".join(row[width - 1 :])]
        named = [f' class="{c}"' if c else "" for c in [*aligns, *[None] * width][:width]]
        return "<tr>" + "".join(f"<{tag}{n}>{html.escape(c, quote=False)}</{tag}>" for n, c in zip(named, full)) + "</tr>"

    return f"<table><thead>{shown(rows[0], 'th')}</thead><tbody>{''.join(shown(r, 'td') for r in rows[1:])}</tbody></table>"


def _marks(cells: list[str]) -> list:
    return [ALIGN["both"] if c[0] == ":" == c[-1] else ALIGN["left"] if c[0] == ":" else ALIGN["right"] if c[-1] == ":" else None for c in cells]


def page_tables(text: str, spaced: bool = False, need_separator: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its tables as HTML, and for each its first and next source line and its HTML.

    Lines are told by kind first; a table is then a pattern of kinds.
    """
    lines, origin, loose = [], [], not need_separator
    source = text.split("\n")
    for k, line in enumerate(source):
        rows = unglued(line) if ANY_PIPE.search(line) else None
        loose |= rows is not None
        lines += rows or [line]
        origin += [k] * len(rows or [line])
    plain = [x.translate({ord(c): "|" for c in PIPES}) for x in lines]
    kinds = "".join(_kind(x, spaced) for x in plain)
    out, chunks, at = [], [], 0
    while at < len(lines):
        found = None if "<table" in lines[at] else _table_at(kinds, plain, at, loose)
        if not found:
            out.append(lines[at])
            at += 1
            continue
        parts, end = found
        out += parts
        chunks.append((origin[at], origin[end - 1] + 1, "\n".join(parts)))
        at = end
    return ("\n".join(out), chunks) if chunks else (text, [])


def _table_at(kinds: str, lines: list[str], at: int, loose: bool) -> tuple[list[str], int] | None:
    """The HTML of a table that begins at a line, and the line after it."""
    if m := BOXED.match(kinds, at):
        rows = [_cells(lines[i]) for i in range(*m.span()) if kinds[i] in "PS"]
        if m[0].endswith("B") and len(rows) > 1:
            return [_markup(rows, max(map(len, rows)), [])], m.end()
    if m := MARKED.match(kinds, at) or (UNMARKED.match(kinds, at) if loose else None):
        places = [i for i in range(*m.span()) if kinds[i] in "PS"]
        rows = [_cells(lines[i]) for i in places]
        if not MARKED.match(kinds, at):
            return [_markup(rows, max(map(len, rows)), [])], m.end()
        marks = rows.pop(1)
        caption = not lines[at].strip().startswith("|") and len(rows[0]) == len(marks) + 1
        before = [f"<p>{html.escape(rows[0].pop(0), quote=False)}</p>"] if caption else []
        return [*before, _markup(rows, len(marks), _marks(marks))], m.end()
    if m := SPACED.match(kinds, at):
        rows = [_columns(lines[i]) for i in range(*m.span())]
        return [_markup(rows, max(map(len, rows)), [])], m.end()
    return None


def convert_tables(df: DataFrame, text: str, spaced: bool = False, need_separator: bool = True) -> DataFrame:
    """Adds converted, a struct of the text with tables as HTML and the converted chunks.

    An operator on Arrow batches, not an expression, so that columns before and after it may be of any kind. Only pages
    that hold something table-like are parsed.
    """
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        chunk = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("html", pa.string())])
        kind = pa.struct([("text", pa.string()), ("chunks", pa.list_(chunk))])
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            likely = pc.match_substring_regex(texts, NEEDED).to_pylist() if not spaced else [True] * len(texts)
            rows = []
            for x, parsed in zip(texts.to_pylist(), likely):
                out, chunks = page_tables(x, spaced, need_separator) if parsed else (x, [])
                rows.append({"text": out, "chunks": [{"start": a, "end": b, "html": h} for a, b, h in chunks]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "converted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("converted", T._parse_datatype_string(CONVERTED))]))


class _FirstTable(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.aligns, self.depth, self.cell, self.done = [], [], 0, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.depth != 1 or self.done:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.cell = []
            if len(self.rows) == 1:
                cls = dict(attrs).get("class") or ""
                self.aligns.append(":-:" if "center" in cls else ":--" if "left" in cls else "--:" if "right" in cls else "---")
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.depth == 1 and self.cell is not None:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip().replace("|", "\\|"))
            self.cell = None
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done |= self.depth == 0

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)


def table_to_pipes(markup: str) -> str | None:
    """The first table of some HTML as a pipe table; null without one."""
    p = _FirstTable()
    p.feed(markup or "")
    p.close()
    rows = [r for r in p.rows if r]
    if not rows:
        return None
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line((p.aligns + ["---"] * width)[:width]), *map(line, rows[1:])])
