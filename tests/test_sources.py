"""PDF page counts, page images and EPUB edits on bytes."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from pagewright.sources import epub, pdf, png


def pdf_of(parts):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in parts)


def test_pdf_pages():
    leaf = b"<</Type /Page /Parent 2 0 R>>"
    nested = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Count 99/Kids[3 0 R 4 0 R]>>"), (3, leaf), (4, b"<</Type/Pages/Kids [5 0 R\n6 0 R 4 0 R]>>"), (5, leaf), (6, leaf), (7, leaf)]
    assert pdf.page_count(pdf_of(nested) + b"trailer<</Root 1 0 R>>") == 3
    update = b"2 0 obj\n<</Type/Pages/Kids[3 0 R]>>\nendobj\ntrailer<</Root 1 0 R>>"
    assert pdf.page_count(pdf_of(nested) + update) == 1
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R 5 0 R]>>"), (3, leaf), (5, leaf)]
    heads, bodies = [], b""
    for n, b in inner:
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += b + b" "
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + bodies)
    stream = b"<</Type/ObjStm/N 4/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(head), len(packed), packed)
    assert pdf.page_count(pdf_of([(9, stream)]) + b"10 0 obj\n<</Type/XRef/Root 1 0 R>>stream\nx\nendstream endobj") == 2
    assert pdf.page_count(b"no pdf") is None and pdf.page_count(None) is None and pdf.page_count(b"%PDF-1.4") is None
    assert pdf.page_count(pdf_of([(3, leaf), (4, leaf)])) == 2


def written(rows, kind, filters):
    """A PNG whose rows have the filters given."""
    h, w, n = rows.shape
    out, above = b"", [0] * (w * n)
    for y in range(h):
        line, f = rows[y].ravel().tolist(), filters[y % len(filters)]
        left = lambda i: line[i - n] if i >= n else 0  # noqa: B023, E731
        corner = lambda i: above[i - n] if i >= n else 0  # noqa: B023, E731

        def guess(i):
            a, b, c = left(i), above[i], corner(i)  # noqa: B023
            p = a + b - c
            return [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][f]  # noqa: B023

        out += bytes([f]) + bytes((x - guess(i)) % 256 for i, x in enumerate(line))
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(out)
    return png.MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(kind, n):
    rows = np.random.default_rng(kind).integers(0, 256, (11, 7, n), dtype=np.uint8)
    grey = png.decode(written(rows, kind, [0, 1, 2, 3, 4]))
    want = rows[..., 0] if n < 3 else np.rint(rows[..., 0] * 0.299 + rows[..., 1] * 0.587 + rows[..., 2] * 0.114)
    assert np.array_equal(grey, want.astype(np.uint8)) and np.array_equal(png.decode(png.encode(grey)), grey)
    with pytest.raises(ValueError):
        png.decode(b"no png")


def plain(grey, binarize):
    """The same steps, place by place."""
    h, w = grey.shape
    at = lambda g, y, x: g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    turned = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    g = [[sorted(at(grey.tolist(), y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1))[4] for x in range(w)] for y in range(h)]

    def means(g, radius, sigma, place):
        weigh = [np.exp(-(k**2) / (2 * sigma**2)) for k in range(-radius, radius + 1)]
        total = sum(weigh) ** 2
        span = range(-radius, radius + 1)
        return [[round(sum(weigh[a + radius] * weigh[b + radius] * place(g, y + a, x + b) for a in span for b in span) / total, 6) for x in range(w)] for y in range(h)]

    m = means(g, 9, 3.0, lambda g, y, x: g[turned(y, h)][turned(x, w)])
    g = [[min(max(int(np.rint(1.5 * g[y][x] - 0.5 * np.rint(m[y][x]))), 0), 255) for x in range(w)] for y in range(h)]
    if binarize:
        m = means(g, 15, 5.0, at)
        g = [[255 if g[y][x] > np.rint(m[y][x]) - 15 else 0 for x in range(w)] for y in range(h)]
    return np.array(g, np.uint8)


@pytest.mark.parametrize("binarize", [False, True])
def test_preprocess(binarize):
    grey = np.random.default_rng(5).integers(0, 256, (22, 20), dtype=np.uint8)
    grey[5:12, 4:9] = 10
    got = png.decode(png.preprocessed(png.encode(grey), binarize=binarize)).astype(int)
    want = plain(grey, binarize).astype(int)
    assert (np.abs(got - want) > (0 if binarize else 1)).sum() <= 2  # a mean that lies between two values may round either way


def book(cover=None):
    return epub.write_book("T", "A", "en", [("One", '<p>&nbsp;<img src="../Images/cover.png" alt="&amp;"/><IMG SRC=\'x.png\'><img src="http://e/x.png"></p><script/>'), ("Two", "y")], cover)


def members(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_images_of_books():
    assert epub.read_spine(book(b"pix"))[0][1] == '<p>&nbsp;<img src="data:image/png;base64,cGl4" alt="&amp;"/></p>' and epub.read_spine(book())[0][1] == "<p>&nbsp;</p>"
    big = b"x" * (epub.MOST_IMAGE + 1)
    assert epub.read_spine(book(big))[0][1] == "<p>&nbsp;</p>"


@pytest.mark.parametrize("had", [None, b"old"])
def test_covers(had):
    before = book(had)
    after = epub.update_meta(before, b"\xff\xd8new", "image/jpeg", title="N")
    assert epub.cover_bytes(after) == b"\xff\xd8new" and epub.read_meta(after)["title"] == "N" and epub.read_meta(after)["author"] == "A"
    place = epub.read_meta(after)["cover"]
    assert place == ("OEBPS/Images/cover.png" if had else "OEBPS/Images/cover.jpg")
    same = {n: d for n, d in members(before).items() if n not in (place, "OEBPS/content.opf")}
    assert {n: d for n, d in members(after).items() if n in same} == same
    again = epub.update_meta(after, b"third")
    assert epub.cover_bytes(again) == b"third" and epub.read_meta(again)["cover"] == place and len(members(again)) == len(members(after))
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_edited_books(spark):
    rows = [("d/a.epub", 2, "B", "<p>y</p>"), ("d/a.epub", 1, " <x> ", "z<script>q</script>"), ("d/b.EPUB", 1, None, None)]
    there = [("d/a_编辑.epub",), ("d/a_编辑 (2).epub",), ("d/a.epub",), ("e/b_编辑.epub",)]
    out = epub.edited_books(spark.createDataFrame(rows, "path string, n int, title string, text string"), spark.createDataFrame(there, "path string")).collect()
    got = {x.path: (epub.read_meta(x.content)["title"], [b for _, b in epub.read_spine(x.content)]) for x in out}
    assert got == {"d/a_编辑 (1).epub": ("<x>", ["<h1> &lt;x&gt; </h1>\n<p>z</p>", "<h1>B</h1>\n<p>y</p>"]), "d/b_编辑.epub": ("b", ["<h1></h1>"])}
