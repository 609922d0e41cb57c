"""How many pages a PDF has, from its bytes: objects, compressed object streams and the tree of pages."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column

NUMBERED = re.compile(rb"(?<![0-9])([0-9]{1,10})\s+[0-9]{1,5}\s+obj\b")
REFERENCE = re.compile(rb"([0-9]+)\s+[0-9]+\s+R\b")


def _stream(body: bytes) -> bytes:
    """The data of a stream object, inflated where it says so."""
    m = re.search(rb"stream\r?\n", body)
    data = body[m.end() :] if m else b""
    if b"/FlateDecode" not in body[: m.start() if m else 0]:
        return data
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


def _number(body: bytes, name: bytes) -> int:
    m = re.search(rb"/" + name + rb"\s+([0-9]+)", body)
    return int(m[1]) if m else 0


def objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those in compressed streams too; of several with one number the last counts, as in an update."""
    marks = list(NUMBERED.finditer(data))
    found = {}
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(data)]):
        found[int(m[1])] = data[m.end() : end]
    for body in [b for b in found.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
        inner = _stream(body)
        first, n = _number(body, b"First"), _number(body, b"N")
        pairs = [int(x) for x in inner[:first].split()[: 2 * n]]
        for number, at, end in zip(pairs[::2], pairs[1::2], [*pairs[3::2], len(inner) - first]):
            found.setdefault(number, inner[first + at : first + end])
    return found


def page_count(data: bytes | None) -> int | None:
    """The pages below the catalog's tree, each once; where it has no tree, the page objects; null for what is no PDF."""
    if not data or b"%PDF-" not in data[:1024]:
        return None
    found = objects(data)
    dictionary = lambda body: body.split(b"stream", 1)[0]
    is_kind = lambda body, kind: re.search(rb"/Type\s*/" + kind + rb"(?![A-Za-z])", dictionary(body))
    roots = [int(m[1]) for m in re.finditer(rb"/Root\s+([0-9]+)\s+[0-9]+\s+R", data)] + [n for n, b in found.items() if is_kind(b, b"Catalog")]
    top = next((int(m[1]) for r in roots[::-1] if r in found and (m := re.search(rb"/Pages\s+([0-9]+)\s+[0-9]+\s+R", found[r]))), None)
    if top not in found:
        return sum(1 for b in found.values() if is_kind(b, b"Page")) or None
    pages, seen, open_ = 0, set(), [top]
    while open_:
        node = open_.pop()
        if node in seen or node not in found:
            continue
        seen.add(node)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", found[node], re.S)
        if kids:
            open_ += [int(m[1]) for m in REFERENCE.finditer(kids[1])]
        else:
            pages += 1
    return pages


def page_counts(content: Column) -> Column:
    """``page_count`` of files, in Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def run(v):
        import pyarrow as pa

        return pa.array([page_count(x) for x in v.to_pylist()], pa.int32())

    return run(content)
