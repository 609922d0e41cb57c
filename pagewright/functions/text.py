"""Scalar text functions as native column expressions; a null text counts as empty.

Texts are split on newlines only, white space is Unicode's unless said otherwise, and lengths are code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for both Java's and RE2's classes.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"

# Line and bracket patterns of scanned pages.
BBOX = r"(?i)^([a-z_]+)[WS]*\[[WS]*(-?[0-9]+)[WS]*,[WS]*(-?[0-9]+)[WS]*,[WS]*(-?[0-9]+)[WS]*,[WS]*(-?[0-9]+)[WS]*\][WS]*(.*)$".replace("WS", WS)
BBOX_HINT = r"\[[^\]\n]{7,}\]"
BBOX_DROPPED = ("page_number", "figure", "image")
PAGE_NUMBER = r"^[WS]*(?:第[WS]*[0-9一二三四五六七八九十百千]+[WS]*页|[-—―·][WS]*[0-9]{1,3}[WS]*[-—―·]|[0-9]{1,3}[WS]*/[WS]*[0-9]{1,3}|[0-9]{1,3})[WS]*$".replace("WS", WS)
SOUP = r"[\[\]{}()（）【】［］〔〕〈〉《》「」『』\\^~`|·" + WS + "]{0,8}"
JUNK = r"[\\^~`|·{}]+"
JUNK_NOTE = SOUP + JUNK + SOUP + r"([0-9]{1,3})" + SOUP + JUNK + SOUP
BRACKETS = ((r"\$+[WS]*([〔【［\[(（])".replace("WS", WS), "{1}"), (r"([〕】］\])）])[WS]*\$+".replace("WS", WS), "{1}"), (JUNK_NOTE, "〔{1}〕"), ("【([^【】]*)】", "〔{1}〕"), (r"\[([^\[\]\n]{1,32})\]", "〔{1}〕"), ("［([^［］]*)］", "〔{1}〕"))
HEADING_END = r"[。！？!?…，、；：]$"
DIGITS_ONLY = r"^[0-9WS·\-—–]+$".replace("WS", WS)
HALF_FULL = ((",", "，"), (";", "；"), (":", "："), ("?", "？"), ("!", "！"), ("(", "（"), (")", "）"))
SYMBOL_MAP = (("[", "【"), ("]", "】"), ("--", "——"), ("~", "～"))
DIGIT_MAP = (("。", "."), ("，", ","), ("、", ","), ("：", ":"), ("；", ";"), ("．", "."))
INVISIBLE = r"\x{a0}\x{3000}\x{2000}-\x{200a}\x{202f}\x{205f}\x{feff}\x{ad}\x{180e}\x{200b}-\x{200f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2060}\x{85}"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Not a character; stands in texts only while they are worked on.
STOP = "\ufdd0"
#: Items of a block of a running aggregate.
BLOCK = 128


def blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` items."""
    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda i: F.slice(items, i, F.lit(BLOCK)))


def running(items: Column, zero: Column, step) -> Column:
    """What an aggregate holds after each item: out[i] = step(out[i - 1], items[i]).

    Appending to an array copies it; blocks keep what is copied short, so the work grows as the array.
    """

    def block(done, some):
        start = F.array(F.element_at(F.element_at(done, -1), -1))
        return F.concat(done, F.array(F.aggregate(some, start, lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))))

    done = F.aggregate(blocks(items), F.array(F.array(zero)), block)
    return F.flatten(F.transform(done, lambda a: F.slice(a, F.lit(2), F.size(a))))


def u_trim(c: Column) -> Column:
    # A run is tried from its start alone, and as a whole.
    return F.regexp_replace(c, f"^[{WS}]++|(?<![{WS}])[{WS}]++$", "")


def has_content(c: Column) -> Column:
    """Whether a text holds more than white space."""
    return c.rlike(f"[^{WS}]")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def strip_think(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), "(?is)<thinking>.*?</thinking>", "")


def _bbox(c: Column, shown) -> Column:
    def shown_as(t, line):
        label, content = F.lower(F.regexp_extract(t, BBOX, 1)), u_trim(F.regexp_extract(t, BBOX, 6))
        return F.when(~t.rlike(BBOX), line).when((content == "") | label.isin(*BBOX_DROPPED), F.lit(None)).otherwise(shown(label, content))

    converted = lambda x: join_lines(F.array_compact(F.transform(lines(x), lambda line: let(u_trim(line), lambda t: shown_as(t, line)))))
    # A cheap test first: most pages hold no layout line at all.
    return let(c, lambda x: F.when(x.rlike(BBOX_HINT) & F.exists(lines(x), lambda line: u_trim(line).rlike(BBOX)), converted(x)).otherwise(x))


def bbox_to_html(c: Column) -> Column:
    """Layout lines ``label [x1,y1,x2,y2] text`` as headings (title) and paragraphs."""
    return _bbox(text_or_empty(c), lambda label, t: F.when(label == "title", F.concat(F.lit("<h2>"), escape_html(t), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), escape_html(t), F.lit("</p>"))))


def bbox_to_plain(c: Column) -> Column:
    return _bbox(text_or_empty(c), lambda label, t: t)


def strip_page_numbers(c: Column) -> Column:
    """Blank the first and the last line with content where it is a page number."""
    def numbered(a):
        ends = F.array_compact(F.transform(a, lambda x, i: F.when(has_content(x), i)))
        return let(F.struct(F.array_min(ends).alias("first"), F.array_max(ends).alias("last")), lambda e: join_lines(F.transform(a, lambda x, i: F.when(((i == e["first"]) | (i == e["last"])) & x.rlike(PAGE_NUMBER), "").otherwise(x))))

    return let(lines(text_or_empty(c)), numbered)


def unify_brackets(c: Column) -> Column:
    out = text_or_empty(c)
    # A look for the characters that a pattern needs spares most texts the pattern.
    for (pattern, to), needs in zip(BRACKETS, (r"\$", r"\$", r"[\\^~`|·{}]", "【", r"\[", "［")):
        out = let(out, _where(needs, pattern, to.replace("{1}", "$1")))
    return out


def _where(needs: str, pattern: str, to: str):
    return lambda x: F.when(x.rlike(needs), F.regexp_replace(x, pattern, to)).otherwise(x)


def _heading(s: Column) -> Column:
    return (F.length(s) >= 1) & (F.length(s) <= 30) & ~s.rlike(HEADING_END) & s.rlike(rf"[{HAN}\p{{L}}]") & ~s.rlike(DIGITS_ONLY)


def is_heading(line: Column) -> Column:
    return let(u_trim(line), _heading)


def detect_headings(c: Column) -> Column:
    """Short lines without an end mark as headings, the rest as paragraphs; pages without a heading stay."""

    def tagged(line):
        tag = lambda s, name: F.concat(F.lit(f"<{name}>"), escape_html(s), F.lit(f"</{name}>"))
        shown = lambda s: F.struct(F.when(F.contains(s, F.lit("<")) | (s == ""), line).when(_heading(s), tag(s, "h1")).otherwise(tag(s, "p")).alias("t"), (~F.contains(s, F.lit("<")) & _heading(s)).alias("h"))
        return let(u_trim(line), shown)

    page = lambda text: let(F.transform(lines(text), tagged), lambda a: F.when(F.exists(a, lambda x: x["h"]), join_lines(F.transform(a, lambda x: x["t"]))).otherwise(text))
    return let(text_or_empty(c), page)


def normalize_whitespace(c: Column) -> Column:
    return u_trim(F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[ \x{3000}\t]+", " "), r"[\r\n]+", "\n"))


def split_paragraphs(c: Column) -> Column:
    parts = F.split(F.regexp_replace(text_or_empty(c), r"^[ \t\x{3000}]+", ""), r"\n[ \t\x{3000}]*")
    return F.filter(parts, has_content)


def ellipsis(c: Column) -> Column:
    """In each line the first run of dots becomes one ellipsis, later runs go."""
    dots = r"(?:\.{3,}|…+)"

    def one(line):
        pieces = F.split(line, dots)
        return F.when(F.size(pieces) > 1, F.concat(F.get(pieces, F.lit(0)), F.lit("……"), F.array_join(F.slice(pieces, 2, F.size(pieces)), ""))).otherwise(line)

    return join_lines(F.transform(lines(text_or_empty(c)), one))


def _pairs(c: Column, pattern: str, quote: str, left: str, right: str) -> Column:
    def curly(x):
        pieces = F.regexp_extract_all(x, F.lit(rf"(?s){pattern}|[^{quote}]+|."), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when((F.length(p) > 1) & F.startswith(p, F.lit(quote)) & p.rlike(f"[{HAN}]"), F.concat(F.lit(left), F.substring(p, F.lit(2), F.length(p) - 2), F.lit(right))).otherwise(p)), "")

    return let(c, lambda x: F.when(F.contains(x, F.lit(quote)), curly(x)).otherwise(x))


def quotes(c: Column) -> Column:
    """Straight quotes around Chinese text become curly."""
    out = _pairs(text_or_empty(c), r'(?<![A-Za-z0-9])"[^"\n]*"', '"', "“", "”")
    return _pairs(out, r"(?<![A-Za-z0-9])'[^'\n]*?'(?![A-Za-z0-9])", "'", "‘", "’")


def in_chinese(c: Column) -> Column:
    """Holds Chinese characters, or no Latin letter."""
    return text_or_empty(c).rlike(f"[{HAN}]") | ~text_or_empty(c).rlike("[A-Za-z]")


def half_to_full(c: Column) -> Column:
    """ASCII punctuation of a Chinese page in full width, but for numbers, times, addresses, entities and the like."""
    out = F.translate(text_or_empty(c), "()", "（）")
    d = r"\p{Nd}"
    steps = (
        (rf"(?<!{d}),|,(?!{d})", "，"),
        (rf"(?<!&[A-Za-z0-9#]{{1,16}})(?:(?<!{d});|;(?!{d}))", "；"),
        (rf"(?:(?<!{d}):|:(?!{d}))(?!//)", "："),
        (r"\?(?![A-Za-z0-9_#]+=[A-Za-z0-9%._~/?#&-])", "？"),
        (r"!(?!==?)", "！"),
        (rf"(?<!\.)\.(?!\.)(?!(?<={d}\.){d})(?!(?<=[A-Za-z]\.)[A-Za-z0-9])(?!(?<=[A-Za-z0-9]\.)[ \t]+[A-Za-z0-9])(?<!\.[A-Za-z]{{1,4}}\.)(?!(?<=(?<![A-Za-z])[A-Z][a-z]{{0,2}}\.)[ \t])(?!(?<=(?<!\S)\.){d})", "。"),
    )
    # Texts without a mark are spared its pattern.
    for mark, (pattern, to) in zip(",;:?!.", steps):
        out = let(out, _holding(mark, pattern, to))
    return out


def _holding(mark: str, pattern: str, to: str):
    return lambda x: F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, to)).otherwise(x)


def _beside(out: Column, pairs, chinese: bool) -> Column:
    near = f"[{HAN}]" if chinese else "[A-Za-z0-9]"
    for src, dst in pairs:
        q, t = re.escape(src), dst.replace("\\", "\\\\").replace("$", "\\$")
        places = f"(?<={near}){q}|{q}(?={near})" if chinese else f"(?<={near}){q}(?={near})|^{q}(?={near})|(?<={near}){q}$"
        out = let(out, _holding(src, places, t))
    return out


def punctuation_base(c: Column) -> Column:
    return let(text_or_empty(c), _punctuation)


def _punctuation(text: Column) -> Column:
    out = _beside(text, HALF_FULL, True)
    out = F.regexp_replace(F.regexp_replace(out, rf"(?<=[{HAN}])\.(?!\.)", "。"), rf"\.(?=[{HAN}])", "。")
    out = F.regexp_replace(_beside(out, [(f, h) for h, f in HALF_FULL], False), "(?<=[A-Za-z0-9])。(?=[A-Za-z0-9])", ".")
    return F.when(in_chinese(text), half_to_full(text)).otherwise(out)


def symbols_core(c: Column, pairs=SYMBOL_MAP) -> Column:
    out = _beside(_beside(text_or_empty(c), pairs, True), [(f, h) for h, f in pairs], False)
    return _beside(out, [("……", "...")], False)


def symbols_extended(c: Column, pairs=SYMBOL_MAP) -> Column:
    return symbols_core(ellipsis(quotes(c)), pairs)


def punctuation_extended(c: Column) -> Column:
    return symbols_core(punctuation_base(quotes(ellipsis(c))))


def digit_punctuation(c: Column, pairs=DIGIT_MAP) -> Column:
    """Chinese marks between single letters or digits, or that end a number, in ASCII."""
    alnum, letter, gap = "[0-9０-９A-Za-zＡ-Ｚａ-ｚ]", "[A-Za-zＡ-Ｚａ-ｚ]", r"[ \t\x{3000}]*"
    mapping: dict[str, str] = {}
    for src, dst in pairs:
        if len(src) == 1:
            mapping.setdefault(src, dst)
    if not mapping:
        return text_or_empty(c)
    marks = "(" + "|".join(map(re.escape, mapping)) + ")"

    # All marks of a place in one pass, which sets a stop before each; stops and marks are then told together.
    def placed(x):
        for pattern in (rf"(?<!{letter})({alnum}){gap}{marks}{gap}(?={alnum}(?!{letter}))", rf"([0-9０-９]){gap}{marks}{gap}(?=[{WS}]|$)"):
            x = F.regexp_replace(x, pattern, f"$1{STOP}$2")
        for src, dst in mapping.items():
            x = F.replace(x, F.lit(STOP + src), F.lit(dst))
        return x

    return let(text_or_empty(c), lambda x: F.when(x.rlike(marks), placed(F.replace(x, F.lit(STOP), F.lit("")))).otherwise(x))


def digit_spaces(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"(?<=[0-9０-９])[ \t\x{3000}]+(?=[0-9０-９])", "")


def alnum_spaces(c: Column) -> Column:
    """Spaced digits join; runs of three or more single letters join, and of two where both are A-Z."""
    one, gap = "[A-Za-zＡ-Ｚａ-ｚ]", r"[ \t\x{3000}]"
    run = rf"(?<=^|{gap}){one}(?:{gap}{one})+(?={gap}|$)"

    def merged(text):
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s){run}|."), F.lit(0))
        joined = F.transform(pieces, lambda p: F.when((F.length(p) >= 5) | p.rlike(rf"^[A-Z]{gap}[A-Z]$"), F.regexp_replace(p, gap, "")).otherwise(p))
        return F.when(text.rlike(run), F.array_join(joined, "")).otherwise(text)

    return let(digit_spaces(c), merged)


def inline_spaces(c: Column, keep_word_gap: bool = True, keep_newlines: bool = True) -> Column:
    """Remove blanks and invisible characters, keeping one space between ASCII letters and digits."""
    gone = f"[ \\t{INVISIBLE}]+" if keep_newlines else f"[{WS}{INVISIBLE}]+"
    text, hold = text_or_empty(c), ""
    if not keep_word_gap:
        return F.regexp_replace(text, gone, "")
    held = F.regexp_replace(text, f"(?<=[A-Za-z0-9]){gone}(?=[A-Za-z0-9])", hold)
    return F.translate(F.regexp_replace(held, gone, ""), hold, " ")


CJK_MARKS = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def join_fragments(a: Column, b: Column) -> Column:
    """Two pieces of a paragraph: a space only where a letter or digit meets the seam."""
    x, y = F.regexp_replace(text_or_empty(a), f"[{WS}]+$", ""), F.regexp_replace(text_or_empty(b), f"^[{WS}]+", "")
    tail, head = F.right(x, F.lit(1)), F.left(y, F.lit(1))
    chinese = tail.rlike(CJK_MARKS) & head.rlike(CJK_MARKS)
    latin = tail.rlike("[A-Za-z0-9]") | head.rlike("[A-Za-z0-9]")
    return F.when(x == "", y).when(y == "", x).when(~chinese & latin, F.concat(x, F.lit(" "), y)).otherwise(F.concat(x, y))


def cer_form(c: Column, drop_punctuation: bool = False) -> Column:
    out = F.regexp_replace(text_or_empty(c), f"[{WS}]", "")
    return F.regexp_replace(out, r"[\p{P}]", "") if drop_punctuation else out


def character_error_rate(reference: Column, other: Column) -> Column:
    r, h = cer_form(reference), cer_form(other)
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def frequency_boost(n: Column) -> Column:
    return F.least(F.lit(0.15), F.log10(n + 1.0) / 40)


def format_duration(seconds: Column) -> Column:
    n = F.bround(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    div = lambda x, d: F.floor(x / d)
    return (
        F.when(n.isNull() | (n < 0), "-").when(n < 60, F.concat(n.cast("string"), F.lit("秒")))
        .when(n < 3600, F.concat(div(n, 60).cast("string"), F.lit("分"), two(n % 60), F.lit("秒")))
        .otherwise(F.concat(div(n, 3600).cast("string"), F.lit("小时"), two(div(n % 3600, 60)), F.lit("分")))
    )


def format_clock(epoch: Column) -> Column:
    return F.when(epoch.isNull() | (epoch <= 0), "-").otherwise(F.date_format(epoch.cast("long").cast("timestamp"), "HH:mm"))


DPI_LEVELS = (100, 150, 200, 300, 600)


def resolve_dpi(c: Column, default: int = 200) -> Column:
    s = u_trim(text_or_empty(c))
    n = F.when(s.rlike("^-?[0-9]{1,9}$"), s.cast("int"))
    level = F.when(s.rlike("^[0-4]$"), F.get(F.array(*[F.lit(x) for x in DPI_LEVELS]), n))
    return F.coalesce(level, F.when((n >= 36) & (n <= 1200), n), F.lit(default))


def parse_bool(c: Column) -> Column:
    s = F.lower(u_trim(c))
    return F.when(s.isin("true", "1", "on", "yes"), True).when(s.isin("false", "0", "off", "no"), False)


def page_of(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"([0-9]+)(?:\.[^.]*)?$", 1).try_cast("long"), F.lit(0).cast("long"))


def natural_key(name: Column) -> Column:
    """A key that sorts numbers inside names by value: each has its number of digits, in ten places, before it."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.regexp_replace(p, "^0+(?=[0-9])", "")).otherwise(p))
    return F.array_join(F.transform(digits, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(p).cast("string"), 10, "0"), p)).otherwise(p)), "")


def sanitize_filename(c: Column) -> Column:
    """Percent-encode all but ``A-Za-z0-9-_.``."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("~"), F.lit("%7E"))


def uuid5(name: Column) -> Column:
    """Version-5 UUID in the URL namespace (a fixed value of the standard)."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def display_width(c: Column) -> Column:
    """Columns on a console: East Asian wide characters take two."""
    wide = r"[\x{2192}\x{1100}-\x{115f}\x{2329}-\x{232a}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe10}-\x{fe19}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]"
    return F.length(c) + F.regexp_count(c, F.lit(wide))
