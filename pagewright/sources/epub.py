"""EPUB files as rows: metadata and spine bodies read in Arrow batches, and books written as bytes."""

from __future__ import annotations

import base64
import html
import io
import itertools
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame

OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
# Kinds of images by their endings, and the largest that is put into a text.
IMAGE_KINDS = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp"}
MOST_IMAGE = 20 << 20
SKIPPED = re.compile(r"^(nav|toc|contents)", re.IGNORECASE)
META = "struct<title:string,author:string,description:string,language:string,cover:string>"
BOOK = f"path string, meta {META}, spine array<struct<n:int,href:string,body:string>>, error string"


def _package(z: zipfile.ZipFile):
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = root.find(f".//{CONTAINER}rootfile").get("full-path")
    return opf, ElementTree.fromstring(z.read(opf))


def _manifest(package, opf: str) -> dict[str, tuple[str, str, str]]:
    base = posixpath.dirname(opf)
    return {i.get("id"): (posixpath.normpath(posixpath.join(base, unquote(i.get("href", "")))), i.get("media-type", ""), i.get("properties") or "") for i in package.iter(f"{OPF}item")}


def read_meta(data: bytes) -> dict:
    """Title, author, description, language and cover path; the cover is the marked item, else meta's, else the first image."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf, package = _package(z)
        items = _manifest(package, opf)
        first = lambda name: next((e.text.strip() for e in package.iter(f"{DC}{name}") if e.text and e.text.strip()), None)
        named = next((m.get("content") for m in package.iter(f"{OPF}meta") if m.get("name") == "cover"), None)
        cover = next((p for p, _, props in items.values() if "cover-image" in props.split()), None)
        cover = cover or (items[named][0] if named in items else None) or next((p for p, kind, _ in items.values() if kind.startswith("image/")), None)
    return {"title": first("title"), "author": first("creator"), "description": first("description"), "language": first("language"), "cover": cover}


def _reference(src: str, folder: str, names: set[str]) -> str | None:
    """The member of the archive that a reference of a document in ``folder`` means."""
    if src.startswith(("data:", "http://", "https://", "//")):
        return None
    path = unquote(re.split("[?#]", src, maxsplit=1)[0])
    tries = [posixpath.normpath(posixpath.join(folder, path)), path.lstrip("/")] if path else []
    return next((t for t in tries if t in names), None)


def with_images(body: str, folder: str, read, names: set[str]) -> str:
    """A body with its images in it, as data; images that are not there or larger than ``MOST_IMAGE`` bytes go."""

    def image(m):
        given = {k.lower(): v.strip("\"'") for k, v in re.findall(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", m[1])}
        member = _reference(html.unescape(given.get("src", "")), folder, names)
        data = read(member) if member else b""
        if not 0 < len(data) <= MOST_IMAGE:
            return ""
        kind = IMAGE_KINDS.get(posixpath.splitext(member)[1].lower(), "application/octet-stream")
        rest = "".join(f' {k}="{v}"' for k, v in given.items() if k not in ("src", "srcset"))
        return f'<img src="data:{kind};base64,{base64.b64encode(data).decode()}"{rest}/>'

    return re.sub(r"""(?i)<img\b((?:[^>"']|"[^"]*"|'[^']*')*?)/?>""", image, body)


def read_spine(data: bytes) -> list[tuple[str, str]]:
    """href and body of each document in reading order, without navigation; all documents where no reference resolves.

    Scripts, links to style sheets and comments go, images are put in; entities stay as they are written.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf, package = _package(z)
        items = _manifest(package, opf)
        docs = [p for p, kind, _ in items.values() if "html" in kind]
        refs = [items[r.get("idref")] for r in package.iter(f"{OPF}itemref") if r.get("idref") in items]
        order = [p for p, kind, props in refs if "html" in kind and "nav" not in props.split()] or docs
        names = set(z.namelist())
        out = []
        for path in order:
            if SKIPPED.match(posixpath.basename(path)) or path not in names:
                continue
            text = z.read(path).decode("utf-8", "replace")
            m = re.search(r"(?is)<body[^>]*>(.*)</body\s*>", text)
            body = re.sub(r"(?is)<!--.*?-->|<script\b[^>]*/>|<script\b.*?</script\s*>|<link\b[^>]*>", "", m.group(1) if m else text)
            body = with_images(body, posixpath.dirname(path), z.read, names)
            out.append((path, re.sub(r"(?i)<(br|hr)\b([^>]*?)\s*/?>", r"<\1\2/>", body).strip()))
    return out


def books(files: DataFrame) -> DataFrame:
    """A row for each EPUB of (path, content); what can't be read has an error and no spine."""

    import pyarrow as pa

    text = pa.string()
    meta = pa.struct([(n, text) for n in ("title", "author", "description", "language", "cover")])
    schema = pa.schema([("path", text), ("meta", meta), ("spine", pa.list_(pa.struct([("n", pa.int32()), ("href", text), ("body", text)]))), ("error", text)])

    def read(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    row = {"path": path, "meta": read_meta(data), "spine": [{"n": i, "href": h, "body": b} for i, (h, b) in enumerate(read_spine(data))], "error": None}
                except Exception as e:  # a broken book is a row
                    row = {"path": path, "meta": None, "spine": [], "error": type(e).__name__}
                yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(read, BOOK)


def write_book(title: str, author: str, language: str, chapters: list[tuple[str, str]], cover: bytes | None = None) -> bytes:
    """An EPUB of (title, body) chapters: the mimetype first and stored, then container, package, navigation and texts."""
    from hashlib import sha1

    e = lambda s: html.escape(s or "", quote=True)
    ident = sha1(f"{title}|{author}".encode()).hexdigest()
    ids = range(1, len(chapters) + 1)
    page = lambda t, b: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{e(t)}</title></head><body>{b}</body></html>'
    pic = '<item id="cover" href="Images/cover.png" media-type="image/png" properties="cover-image"/>' if cover else ""
    package = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier><dc:title>{e(title)}</dc:title><dc:creator>{e(author)}</dc:creator><dc:language>{e(language)}</dc:language></metadata>'
        + f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{pic}' + "".join(f'<item id="c{i}" href="Text/content_{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids) + '</manifest><spine toc="ncx">' + "".join(f'<itemref idref="c{i}"/>' for i in ids) + "</spine></package>"
    )
    nav = page("Contents", '<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>' + "".join(f'<li><a href="Text/content_{i}.xhtml">{e(t)}</a></li>' for i, (t, _) in zip(ids, chapters)) + "</ol></nav>")
    ncx = '<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>' + "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{e(t)}</text></navLabel><content src="Text/content_{i}.xhtml"/></navPoint>' for i, (t, _) in zip(ids, chapters)) + "</navMap></ncx>"
    files = {"META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "OEBPS/content.opf": package, "OEBPS/nav.xhtml": nav, "OEBPS/toc.ncx": ncx}
    files |= {f"OEBPS/Text/content_{i}.xhtml": page(t, b) for i, (t, b) in zip(ids, chapters)}
    out = io.BytesIO()
    fixed = (2000, 1, 1, 0, 0, 0)  # the same book has the same bytes
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", fixed), "application/epub+zip", zipfile.ZIP_STORED)
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, fixed), text, zipfile.ZIP_DEFLATED)
        if cover:
            z.writestr(zipfile.ZipInfo("OEBPS/Images/cover.png", fixed), cover, zipfile.ZIP_STORED)
    return out.getvalue()


def _with_cover(package, opf: str, names: list[str], kind: str) -> str:
    """Declare a cover in a package; the member that holds it: the one that did so far, or a new one."""
    base, items = posixpath.dirname(opf), list(package.iter(f"{OPF}item"))
    place = lambda item: posixpath.normpath(posixpath.join(base, unquote(item.get("href", ""))))
    named = next((m.get("content") for m in package.iter(f"{OPF}meta") if (m.get("name") or "").lower() == "cover"), None)
    tests = (lambda i: "cover-image" in (i.get("properties") or "").split(), lambda i: i.get("id") == named, lambda i: (i.get("media-type") or "").startswith("image/"))
    item = next((i for test in tests for i in items if test(i)), None)
    if item is None:
        taken = {place(i) for i in items} | set(names)
        ending = next(e for e, k in IMAGE_KINDS.items() if k == kind)
        tries = (f"Images/cover{n and f'_{n}' or ''}{ending}" for n in itertools.count())
        href = next(t for t in tries if posixpath.normpath(posixpath.join(base, t)) not in taken)
        item = ElementTree.SubElement(package.find(f"{OPF}manifest"), f"{OPF}item", {"id": "cover-image", "href": href})
        if named is None:
            ElementTree.SubElement(package.find(f"{OPF}metadata"), f"{OPF}meta", {"name": "cover", "content": "cover-image"})
    item.set("media-type", kind)
    item.set("properties", " ".join(dict.fromkeys([*(item.get("properties") or "").split(), "cover-image"])))
    return place(item)


def update_meta(data: bytes, cover: bytes | None = None, cover_kind: str = "image/png", **fields: str | None) -> bytes:
    """The book with the given fields (title, author, description, language) set and the cover put in or replaced.

    All other members keep their bytes and order; the mimetype comes first and is stored.
    """
    names = {"title": "title", "author": "creator", "description": "description", "language": "language"}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        opf, package = _package(z)
        meta = package.find(f"{OPF}metadata")
        for k, v in fields.items():
            if v is None:
                continue
            found = meta.find(f"{DC}{names[k]}")
            (found if found is not None else ElementTree.SubElement(meta, f"{DC}{names[k]}")).text = v
        infos = [i for i in z.infolist() if not i.is_dir()]
        changed = {} if cover is None else {_with_cover(package, opf, z.namelist(), cover_kind): cover}
        changed[opf] = ElementTree.tostring(package, encoding="utf-8", xml_declaration=True)
        mark = next((i for i in infos if i.filename == "mimetype"), zipfile.ZipInfo("mimetype", (2000, 1, 1, 0, 0, 0)))
        w.writestr(mark, "application/epub+zip", zipfile.ZIP_STORED)
        for info in infos:
            if info.filename != "mimetype":
                w.writestr(info, changed.pop(info.filename, None) or z.read(info.filename), info.compress_type)
        for name, content in changed.items():
            w.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content, zipfile.ZIP_STORED)
    return out.getvalue()


def cover_bytes(data: bytes) -> bytes | None:
    """The image that a book's metadata names as its cover."""
    path = read_meta(data)["cover"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(path) if path in z.namelist() else None


def edited_books(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """path and content of the books that edited articles (path, n, title, text) are saved as.

    A book goes beside the one that it comes from, as ``name_编辑.epub``, or with the first free number where that is among
    the existing paths (column path). Articles begin with their title as a heading, their text is cleaned; the first title
    names the book, or the file does.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    from pagewright.functions.text import escape_html, u_trim
    from pagewright.operators.tree import cleaned

    @arrow_udf("string")
    def clean(v):
        import pyarrow as pa

        return pa.array([cleaned(x or "") for x in v.to_pylist()], pa.string())

    stem = F.regexp_replace("path", r"(?i)\.epub$", "")
    title = F.coalesce("title", F.lit(""))
    text = F.concat(F.lit("<h1>"), escape_html(title), F.lit("</h1>\n"), clean("text"))
    rows = articles.select(stem.alias("stem"), "n", title.alias("title"), text.alias("text"))
    first = rows.groupBy("stem").agg(F.min_by(u_trim(F.col("title")), "n").alias("first"))
    named = rows.join(first, "stem").select("stem", "n", "title", "text", F.when(F.col("first") != "", F.col("first")).otherwise(F.regexp_extract("stem", "[^/]*$", 0)).alias("name"), F.lit("").alias("author"), F.lit("zh-CN").alias("language"))
    packed = pack_books(named, "stem")
    saved = r"^(.*)_编辑(?: \(([0-9]{1,9})\))?\.epub$"
    numbers = existing.where(F.col("path").rlike(saved)).select(F.regexp_extract("path", saved, 1).alias("stem"), F.coalesce(F.regexp_extract("path", saved, 2).try_cast("int"), F.lit(0)).alias("k"))
    taken = numbers.groupBy("stem").agg(F.collect_set("k").alias("taken"))
    free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken")), F.lit(0))
    number = F.when(free > 0, F.concat(F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise("")
    return packed.join(taken, "stem", "left").select(F.concat("stem", F.lit("_编辑"), number, F.lit(".epub")).alias("path"), "content")


def pack_books(chapters: DataFrame, key: str) -> DataFrame:
    """key and content: an EPUB of each book's rows (n, title, text and the book's name, author, language, maybe cover)."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def build(name, author, language, cover, parts):
        import pyarrow as pa

        rows = zip(*[c.to_pylist() for c in (name, author, language, cover, parts)])
        return pa.array([write_book(a, b, c, [(p["title"], p["text"]) for p in ps], d) for a, b, c, d, ps in rows], pa.binary())

    cover = F.min("cover") if "cover" in chapters.columns else F.lit(None).cast("binary")
    by = chapters.groupBy(key).agg(cover.alias("cover"), F.min("name").alias("name"), F.min("author").alias("author"), F.min("language").alias("language"), F.array_sort(F.collect_list(F.struct("n", "title", "text"))).alias("parts"))
    return by.select(key, build("name", "author", "language", "cover", "parts").alias("content"))


def merge_pages(spine_rows: DataFrame, order: list[str]) -> DataFrame:
    """Pages of several books one after another, numbered from 1 over all."""
    from pagewright.operators.pages import with_global_number

    return with_global_number(spine_rows, order, "page")
