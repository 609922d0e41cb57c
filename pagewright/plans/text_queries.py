"""Queries of the text functions over documents, whose texts are wrapped so that each function has work to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.plans.registry import query, table

WS = t.WS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def sql_html(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def on_documents(name: str, wrap, f, sql_wrap: str, sql_out: str | None, kind: str = "out"):
    """``wrap()`` makes the input from a document's columns, ``sql_wrap`` is its SQL and ``sql_out`` that of ``f`` over x."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", wrap().alias("x")).select("doc_id", f(F.col("x")).alias(kind))

    sql = None if sql_out is None else f"SELECT doc_id, {sql_out} AS {kind} FROM (SELECT doc_id, {sql_wrap} AS x FROM documents)"
    query(name, sql)(run)




def id_():
    return F.col("doc_id").cast("string")


def text():
    return F.col("text")


def cat(*a):
    """Columns need a session, so they are made when a query runs, not when this module is read."""
    return lambda: F.concat(*[F.lit(x) if isinstance(x, str) else x() for x in a])

on_documents(
    "txt_strip_think",
    cat("<thinking>", id_, "\n</THINKING>", text, "<Thinking>x</thinking>"),
    t.strip_think,
    "'<thinking>' || doc_id || chr(10) || '</THINKING>' || text || '<Thinking>x</thinking>'",
    "regexp_replace(x, '(?is)<thinking>.*?</thinking>', '', 'g')",
)

_BOX_WRAP = cat("title [1, 2, 3, 4] A & ", id_, "\ntext[5,6,7,8] <b>\n", text, "\npage_number [1,2,3,4] 7\nother [1,2,3,4]")
_BOX_SQL = "'title [1, 2, 3, 4] A & ' || doc_id || chr(10) || 'text[5,6,7,8] <b>' || chr(10) || text || chr(10) || 'page_number [1,2,3,4] 7' || chr(10) || 'other [1,2,3,4]'"


def _sql_bbox(shown: str) -> str:
    line = sql_trim("l")
    label, content = f"lower(regexp_extract({line}, {_q(t.BBOX)}, 1))", sql_trim(f"regexp_extract({line}, {_q(t.BBOX)}, 6)")
    drop = f"({content} = '' OR {label} IN ('page_number', 'figure', 'image'))"
    one = f"CASE WHEN NOT regexp_matches({line}, {_q(t.BBOX)}) THEN l ELSE {shown.format(label=label, content=content, html=sql_html(content))} END"
    return f"array_to_string([{one} for l in string_split(x, chr(10)) if NOT (regexp_matches({line}, {_q(t.BBOX)}) AND {drop})], chr(10))"


on_documents(
    "txt_bbox_to_html",
    _BOX_WRAP,
    t.bbox_to_html,
    _BOX_SQL,
    _sql_bbox("CASE WHEN {label} = 'title' THEN '<h2>' || {html} || '</h2>' ELSE '<p>' || {html} || '</p>' END"),
)
on_documents("txt_bbox_to_plain", _BOX_WRAP, t.bbox_to_plain, _BOX_SQL, _sql_bbox("{content}"))

on_documents(
    "txt_strip_page_numbers", cat("\n", lambda: (F.col("doc_id") % 1300).cast("string"), "\n", text, "\n- 4 -\n"), t.strip_page_numbers, "chr(10) || (doc_id % 1300) || chr(10) || text || chr(10) || '- 4 -' || chr(10)",
    f"(SELECT array_to_string([CASE WHEN (i = k[1] OR i = k[-1]) AND regexp_matches(l[i], {_q(t.PAGE_NUMBER)}) THEN '' ELSE l[i] END for i in range(1, len(l) + 1)], chr(10)) FROM (SELECT l, [i for i in range(1, len(l) + 1) if {sql_trim('l[i]')} <> ''] AS k FROM (SELECT string_split(x, chr(10)) AS l)))",
)


def _sql_brackets() -> str:
    out = "x"
    for pattern, to in t.BRACKETS:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(to.replace('{1}', chr(92) + '1'))}, 'g')"
    return out


on_documents(
    "txt_brackets",
    cat("【", id_, "】 $[a]$ （^{12}】 ", text, " [", lambda: F.col("lang"), "]"),
    t.unify_brackets,
    "'【' || doc_id || '】 $[a]$ （^{12}】 ' || text || ' [' || lang || ']'",
    _sql_brackets(),
)

_s = sql_trim("l")
_HEAD = f"(length({_s}) BETWEEN 1 AND 30 AND NOT regexp_matches({_s}, {_q(t.HEADING_END)}) AND regexp_matches({_s}, {_q(f'[{t.HAN}' + chr(92) + 'p{L}]')}) AND NOT regexp_matches({_s}, {_q(t.DIGITS_ONLY)}))"
_PLAIN = f"(NOT contains(l, '<') AND {_s} <> '')"
on_documents(
    "txt_detect_headings", cat(lambda: F.when(F.col("doc_id") % 2 == 0, F.lit("Chapter & one\n")).otherwise(F.lit("1 - 2\n<b>x</b>\n")), text), t.detect_headings, "CASE WHEN doc_id % 2 = 0 THEN 'Chapter & one' || chr(10) ELSE '1 - 2' || chr(10) || '<b>x</b>' || chr(10) END || text",
    f"CASE WHEN len([l for l in string_split(x, chr(10)) if {_PLAIN} AND {_HEAD}]) = 0 THEN x ELSE array_to_string([CASE WHEN NOT {_PLAIN} THEN l WHEN {_HEAD} THEN '<h1>' || {sql_html(_s)} || '</h1>' ELSE '<p>' || {sql_html(_s)} || '</p>' END for l in string_split(x, chr(10))], chr(10)) END",
)
on_documents(
    "flt_heading_line",
    text,
    lambda x: F.size(F.filter(t.lines(x), t.is_heading)).cast("long"),
    "text",
    f"len([l for l in string_split(x, chr(10)) if {_HEAD}])",
)
on_documents(
    "txt_ws_normalize",
    cat(" \t", text, "　 x\r\n\n", text, " \n"),
    t.normalize_whitespace,
    "' ' || chr(9) || text || '　 x' || chr(13) || chr(10) || chr(10) || text || ' ' || chr(10)",
    sql_trim("regexp_replace(regexp_replace(x, '[ \\x{3000}\\t]+', ' ', 'g'), '[\\r\\n]+', chr(10), 'g')"),
)
on_documents(
    "txt_split_paragraphs",
    cat(" 　", text, "\n　\n", text),
    lambda x: F.array_join(t.split_paragraphs(x), "|"),
    "' 　' || text || chr(10) || '　' || chr(10) || text",
    f"array_to_string([l for l in regexp_split_to_array(regexp_replace(x, '^[ \\t\\x{{3000}}]+', ''), '\\n[ \\t\\x{{3000}}]*') if {_s} "
    f"<> ''], '|')",
)
on_documents(
    "txt_ellipsis",
    cat("a...", text, "…b....c\nd"),
    t.ellipsis,
    "'a...' || text || '…b....c' || chr(10) || 'd'",
    "array_to_string([CASE WHEN regexp_matches(l, '\\.{3,}|…+') THEN regexp_extract(l, '^(.*?)(\\.{3,}|…+)', 1) || '……' || "
    "regexp_replace(substr(l, length(regexp_extract(l, '^(.*?)(\\.{3,}|…+)', 0)) + 1), '\\.{3,}|…+', '', 'g') ELSE l END for l in "
    "string_split(x, chr(10))], chr(10))",
)
on_documents(
    "txt_ctx_cjk",
    cat(lambda: F.when(F.col("doc_id") % 3 == 0, "中").otherwise(""), text),
    t.in_chinese,
    "CASE WHEN doc_id % 3 = 0 THEN '中' ELSE '' END || text",
    f"regexp_matches(x, '[{t.HAN}]') OR NOT regexp_matches(x, '[A-Za-z]')",
)
on_documents(
    "txt_norm_cer",
    text,
    lambda x: F.length(t.cer_form(x, True)).cast("long"),
    "text",
    f"length(regexp_replace(regexp_replace(x, '[{WS}]', '', 'g'), '[\\p{{P}}]', '', 'g'))",
)

_MIXED = cat("他说abc, 共 1。 条(", id_, ") 3.14; H，W \"引\" 'x' ", text, " 1 2 3 A B C [x]--中~ e.g. 12:30…… https://a?b=1")
for _name, _f in (
    ("txt_quotes", t.quotes), ("txt_half_to_full", t.half_to_full), ("txt_punct_base", t.punctuation_base), ("txt_symbols_core", t.symbols_core), ("txt_symbols_ext", t.symbols_extended), ("txt_punct_ext", t.punctuation_extended), ("txt_digit_punct", t.digit_punctuation), ("txt_alnum_spaces", t.alnum_spaces),
    ("txt_inline_spaces", lambda x: t.inline_spaces(x, True, False)), ("txt_export_ws", lambda x: t.inline_spaces(x, True, True)),
):
    on_documents(_name, _MIXED, _f, "", None)


@query(
    "txt_join_fragments",
    f"""SELECT doc_id, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN NOT (regexp_matches(right(a, 1), {_q(t.CJK_MARKS)}) AND regexp_matches(left(b, 1), {_q(t.CJK_MARKS)})) AND (regexp_matches(right(a, 1), '[A-Za-z0-9]') OR regexp_matches(left(b, 1), '[A-Za-z0-9]')) THEN a || ' ' || b ELSE a || b END AS out
FROM (SELECT doc_id, regexp_replace(text, '[{WS}]+$', '') AS a, regexp_replace(CASE doc_id % 3 WHEN 0 THEN ' 中文' WHEN 1 THEN '' ELSE ' tail' END, '^[{WS}]+', '') AS b FROM documents)""",
)
def _join_fragments(spark, sf_dir):
    b = F.when(F.col("doc_id") % 3 == 0, " 中文").when(F.col("doc_id") % 3 == 1, "").otherwise(" tail")
    return table(spark, sf_dir, "documents").select("doc_id", t.join_fragments(text(), b).alias("out"))


_PAIRS = "SELECT a.c_custkey AS k, a.c_name AS x, coalesce(b.c_name, '') || ' 7' AS y FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1"


def _pairs(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("x"))
    b = a.select((F.col("k") - 1).alias("j"), F.col("x").alias("z"))
    return a.join(b, F.col("k") == F.col("j"), "left").select("k", "x", F.concat(F.coalesce("z", F.lit("")), F.lit(" 7")).alias("y"))


_CER = lambda c: f"regexp_replace({c}, '[{WS}]', '', 'g')"


@query("txt_edit_distance", f"SELECT k, levenshtein(x, y)::BIGINT AS out FROM ({_PAIRS})")
def _edit(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", F.levenshtein("x", "y").cast("long").alias("out"))


@query("txt_cer", f"SELECT k, round(levenshtein({_CER('x')}, {_CER('y')}) / length({_CER('x')})::DOUBLE, 6) AS out FROM ({_PAIRS})")
def _cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", F.round(t.character_error_rate(F.col("x"), F.col("y")), 6).alias("out"))


@query("txt_similarity", f"SELECT k, round(1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE, 6) AS out FROM ({_PAIRS})")
def _similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", F.round(t.similarity(F.col("x"), F.col("y")), 6).alias("out"))


on_documents(
    "txt_freq_boost",
    lambda: F.col("n_chars"),
    lambda x: F.round(t.frequency_boost(x), 6),
    "n_chars",
    "round(least(0.15, log10(x + 1.0) / 40), 6)",
)
on_documents(
    "txt_format_duration",
    lambda: F.col("n_chars") * 1.5,
    t.format_duration,
    "n_chars * 1.5",
    "(SELECT CASE WHEN n < 60 THEN n || '秒' WHEN n < 3600 THEN (n // 60) || '分' || lpad((n % 60)::VARCHAR, 2, '0') || '秒' ELSE (n // "
    "3600) || '小时' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') || '分' END FROM (SELECT round_even(x, 0)::BIGINT AS n))",
)
on_documents(
    "txt_format_clock",
    lambda: F.col("n_chars") * 1000 - 100000,
    t.format_clock,
    "n_chars * 1000 - 100000",
    "CASE WHEN x <= 0 THEN '-' ELSE lpad((x // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((x // 60 % 60)::VARCHAR, 2, '0') END",
)
on_documents(
    "txt_resolve_dpi",
    lambda: F.when(F.col("doc_id") % 7 == 0, " 3").when(F.col("doc_id") % 7 == 1, "x").otherwise((F.col("doc_id") % 1400 - 20).cast("string")),
    t.resolve_dpi,
    "CASE doc_id % 7 WHEN 0 THEN ' 3' WHEN 1 THEN 'x' ELSE (doc_id % 1400 - 20)::VARCHAR END",
    "CASE WHEN regexp_full_match(trim(x), '[0-4]') THEN [100, 150, 200, 300, 600][trim(x)::INT + 1] WHEN try_cast(trim(x) AS INT) "
    "BETWEEN 36 AND 1200 THEN trim(x)::INT ELSE 200 END",
)
on_documents(
    "txt_parse_bool",
    lambda: F.element_at(F.array(*[F.lit(x) for x in ("On", " no", "1", "maybe", "FALSE")]), (F.col("doc_id") % 5 + 1).cast("int")),
    t.parse_bool,
    "['On', ' no', '1', 'maybe', 'FALSE'][doc_id % 5 + 1]",
    "CASE WHEN lower(trim(x)) IN ('true', '1', 'on', 'yes') THEN true WHEN lower(trim(x)) IN ('false', '0', 'off', 'no') THEN false END",
)
on_documents("txt_page_of", cat("p2_", id_, ".png"), t.page_of, "'p2_' || doc_id || '.png'", "regexp_extract(x, '([0-9]+)(?:\\.[^.]*)?$', 1)::BIGINT")
on_documents(
    "txt_natural_key",
    cat("Img", id_, "b007"),
    t.natural_key,
    "'Img' || doc_id || 'b007'",
    "'img' || lpad(length(doc_id::VARCHAR)::VARCHAR, 10, '0') || doc_id || 'b' || lpad('1', 10, '0') || '7'",
)
on_documents(
    "txt_sanitize_filename",
    cat("a b*~", lambda: F.col("lang"), "é/_", id_),
    t.sanitize_filename,
    "'a b*~' || lang || 'é/_' || doc_id",
    "'a%20b%2A%7E' || regexp_extract(x, '~(.*)é', 1) || '%C3%A9%2F_' || doc_id",
)
_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(x))"
on_documents(
    "txt_uuid5", cat(lambda: F.col("lang"), "|", id_), t.uuid5, "lang || '|' || doc_id",
    "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
    f" FROM (SELECT {_SHA} AS h))",
)
on_documents("ut_display_width", cat("中→ｱ", text), lambda x: t.display_width(x).cast("long"), "'中→ｱ' || text", "length(x) + 2")
