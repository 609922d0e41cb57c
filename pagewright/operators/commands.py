"""The editor's command line over the lines of a page: scripts, ranges, and the commands that change lines.

A script is commands parted by ``;``, ``；`` or newlines; brackets at the start of a command group some, and what a group
leaves selected is the range of what follows it. A command is ``[range]name [argument]``; a range is ``7``, ``7,10`` or
``7-10``, by line from 1. Names are the Chinese ones, the English ones and their abbreviations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the commands that change lines, and of the formats that they can give.
NAMES = {
    "merge": ("合并", "merge", "mg"), "delete": ("删除", "delete", "del"), "clear": ("清空", "clear", "clr"),
    "replace": ("替换", "replace", "rp"), "format": ("格式", "format", "fmt"), "wrap": ("包围", "wrap", "wr"),
    "select": ("选", "select", "se"), "line": ("行", "line", "ln"),
}
FORMATS = {
    "bold": ("加粗", "粗体", "bold", "b"), "italic": ("斜体", "italic", "i"), "sup": ("上标", "sup"), "sub": ("下标", "sub"),
    "p": ("正文", "p"), **{f"heading{n}": (f"标题{n}", f"h{n}") for n in range(1, 7)},
}
TAGS = {"bold": "strong", "italic": "em", "sup": "sup", "sub": "sub", "p": "p", **{f"heading{n}": f"h{n}" for n in range(1, 7)}}
PAIRS = {"方括号": "[]", "方头括号": "【】", "六角括号": "〔〕", "书名号": "《》", "尖括号": "〈〉", "圆括号": "（）", "双引号": "“”", "单引号": "‘’", "直角引号": "「」"}
_BY_NAME = {n: (c, "") for c, names in NAMES.items() for n in names} | {n: ("format", f) for f, names in FORMATS.items() for n in names}
_COMMAND = re.compile(r"\s*(?:(\d+)(?:\s*[,，-]\s*(\d+))?)?\s*(%s)(?![A-Za-z0-9])\s*(.*)" % "|".join(sorted(map(re.escape, _BY_NAME), key=len, reverse=True)), re.S)
_SUBSTITUTE = re.compile(r":?(?:(%)|(\d+)(?:,(\d+))?)?s/((?:[^/\\]|\\.)*)/((?:[^/\\]|\\.)*)/?([gi]*)")


@dataclass
class Command:
    name: str
    first: int | None = None
    last: int | None = None
    argument: str = ""


def parse(script: str) -> list:
    """Commands and, for groups, lists of them. A command that cannot be read raises ValueError."""
    out, at = [], 0
    while at < len(script):
        if script[at] in ";；\n \t":
            at += 1
        elif script[at] in "(（":
            depth, end = 0, at
            while end < len(script):
                depth += (script[end] in "(（") - (script[end] in ")）")
                end += 1
                if not depth:
                    break
            if depth:
                raise ValueError("a bracket is not closed")
            out.append(parse(script[at + 1 : end - 1]))
            at = end
        else:
            end = next((i for i in range(at, len(script)) if script[i] in ";；\n"), len(script))
            out.append(_one(script[at:end]))
            at = end
    return out


def _one(text: str) -> Command:
    m = _COMMAND.fullmatch(text.strip())
    if not m:
        raise ValueError(f"no such command: {text.strip()}")
    first = int(m[1]) if m[1] else None
    last = int(m[2]) if m[2] else first
    if first is not None and last < first:
        first, last = last, first
    name, preset = _BY_NAME[m[3]]
    argument = m[4].strip()
    if name == "format" and not preset:
        if _BY_NAME.get(argument, ("", ""))[0] != "format" or not _BY_NAME[argument][1]:
            raise ValueError(f"no such format: {argument}")
        preset = _BY_NAME[argument][1]
    return Command(name, first, last, preset or argument)


def run(lines: list[str], script: str) -> list[str]:
    """The lines of a page after a script; a range beyond the page raises ValueError."""
    out = list(lines)
    _run(out, parse(script), (1, len(out)) if out else (1, 0))
    return out


def _run(lines: list[str], commands: list, range_: tuple[int, int]) -> tuple[int, int]:
    for c in commands:
        if isinstance(c, list):
            range_ = _run(lines, c, range_)
            continue
        a, b = (c.first, c.last) if c.first is not None else range_
        if c.name in ("select", "line"):
            a = b = int(c.argument.split()[0])
        if not 1 <= a <= b <= len(lines):
            raise ValueError(f"no lines {a} to {b}")
        range_ = _change(lines, c, a, b)
    return range_


def _change(lines: list[str], c: Command, a: int, b: int) -> tuple[int, int]:
    """Apply a command to lines a to b; gives the range that it leaves selected."""
    some = lines[a - 1 : b]
    if c.name == "merge":
        if a == b:
            raise ValueError("two lines at least are merged")
        lines[a - 1 : b] = ["".join(x.strip() for x in some)]
        return a, a
    if c.name == "delete":
        del lines[a - 1 : b]
        return (min(a, len(lines)), min(a, len(lines))) if lines else (1, 0)
    if c.name == "clear":
        some = [""] * len(some)
    elif c.name == "replace":
        some = [c.argument] * len(some)
    elif c.name == "wrap":
        pair = PAIRS.get(c.argument, c.argument)
        if len(pair) != 2:
            raise ValueError(f"no such pair: {c.argument}")
        some = [pair[0] + some[0], *some[1:]]
        some[-1] += pair[1]
    elif c.name == "format":
        some = [f"<{TAGS[c.argument]}>{x}</{TAGS[c.argument]}>" for x in some]
    lines[a - 1 : b] = some
    return a, b


def run_scripts(df: DataFrame, text: str, script: str) -> DataFrame:
    """Adds edited, a struct of the text after its row's script, and error where the script does not fit the page."""
    from pyspark.sql import types as T

    texts, scripts = df.columns.index(text), df.columns.index(script)

    def edit(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for x, s in zip(batch.column(texts).to_pylist(), batch.column(scripts).to_pylist()):
                try:
                    rows.append({"text": "\n".join(run((x or "").split("\n"), s or "")), "error": None})
                except ValueError as e:
                    rows.append({"text": x, "error": str(e)})
            kind = pa.struct([("text", pa.string()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "edited"])

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    return df.mapInArrow(edit, T.StructType([*df.schema.fields, T.StructField("edited", kind)]))


def page_range(spec: Column, current: Column, last: Column) -> Column:
    """First and last page (a struct) of ``N``, ``N-M``, ``+X`` (X pages from the current one), 当前, 全部 or nothing."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    number = lambda p, g: F.regexp_extract(s, p, g).try_cast("int")
    pair = lambda a, b: F.struct(F.greatest(F.least(a, b), F.lit(1)).alias("first"), F.least(F.greatest(a, b), last).alias("last"))
    span = r"^(\d{1,9})\s*[-,]\s*(\d{1,9})$"
    return (
        F.when(s.isin("", "当前"), pair(current, current)).when(s == "全部", pair(F.lit(1), last))
        .when(s.rlike(r"^\+\d{1,9}$"), pair(current, current + number(r"^\+(\d+)$", 1) - 1))
        .when(s.rlike(span), pair(number(span, 1), number(span, 2)))
        .when(s.rlike(r"^\d{1,9}$"), pair(number(r"^(\d+)$", 1), number(r"^(\d+)$", 1)))
    )


def substituted(pages: DataFrame, command: str) -> DataFrame:
    """Pages (page and text) after ``:10,20s/a/b/``: a range of pages, ``%`` or none for all; flags g and i.

    The pattern is plain text, a backslash quotes a slash. Without g only the first place of each page changes.
    """
    m = _SUBSTITUTE.fullmatch(command.strip())
    if not m:
        raise ValueError(f"not a substitution: {command}")
    plain = lambda x: re.sub(r"\\(.)", r"\1", x)
    find, to = f"\\Q{plain(m[4])}\\E", plain(m[5]).replace("\\", "\\\\").replace("$", "\\$")
    find = ("(?i)" if "i" in m[6] else "") + find
    changed = F.regexp_replace("text", find if "g" in m[6] else f"(?s)^(.*?){find}", to if "g" in m[6] else f"$1{to}")
    if m[2]:
        a, b = sorted((int(m[2]), int(m[3] or m[2])))
        changed = F.when(F.col("page").between(a, b), changed).otherwise(F.col("text"))
    return pages.withColumn("text", changed)
