"""Queries of the rule language, of marks and commands, and of cleaning rules that are known from documentation only.

Rules format whole documents: a document's text is one paragraph of a page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import commands, markers
from pagewright.operators import rules as r
from pagewright.operators.tree import cleaned
from pagewright.plans.registry import batch_udf, query, table
from pagewright.plans.text_queries import sql_html, sql_trim

_E = sql_html("coalesce(text, '')")


def _docs(s, d):
    return table(s, d, "documents")


def _page(text: str = "text"):
    return F.concat(F.lit("<p>"), t.escape_html(t.text_or_empty(F.col(text))), F.lit("</p>"))


def _rule(**c):
    return [{"id": "1", "mode": "all", "conditions": [c]}]


def _formats(name: str, html_sql: str, rules: list[dict], page=_page):
    """A query of the documents' pages after some rules, and the SQL of the HTML."""

    def run(s, d):
        pages = _docs(s, d).select("doc_id", page().alias("html"))
        return r.format_pages(pages, "html", rules).select("doc_id", "formatted.html")

    query(name, f"SELECT doc_id, {html_sql} AS html FROM documents")(run)


def _dirty():
    """A document's page with what does not belong on one: handlers, unknown classes, styles, scripts, links and bare text."""
    head = F.concat(F.lit('<p onclick="x()" style="color:red" class="page-note other page-align-left">'), t.escape_html(t.text_or_empty(F.col("text"))))
    head = F.concat(head, F.lit('<span style="position:fixed;COLOR:Red;font-size:7.5px" class="page-wavy none">s</span><br><img alt="no source"/></p>\n'))
    return F.concat(
        head, F.lit("<script>var a = '<p>b</p>';</script><style>p{}</style>bare &lt; "), F.col("lang"), F.lit('<a href="javascript:x()">gone<b>too</b></a><i>'), F.col("source"),
        F.lit('</i><img src="a.png" style="width:50%;top:0" class="page-img-left x"><div data-ind="first" data-pl="x" data-lh="1.5">z</div>'),
    )


_CLEANED = (
    f"'<p class=\"page-note page-align-left\">' || {_E} || '<span class=\"page-wavy\" style=\"font-size:8px;color:Red\">s</span><br/></p><p>' || chr(10) || 'bare &lt; ' || lang || '</p><p><em>' || source || "
    "'</em></p><p><img class=\"page-img-left\" src=\"a.png\" style=\"width:50%\"/></p><div data-ind=\"first\" data-lh=\"1.5\">z</div>'"
)
_formats("html_parse", _CLEANED, _rule(type="contains", pattern="", formats=["none"]), _dirty)


@query("html_parse_pages")
def _parse_pages(s, d):
    """What stands in the body of each raw page, cleaned."""
    body = F.regexp_replace("html", r"(?is)^.*?<body\b[^>]*>|</body\s*>.*$", "")
    return table(s, d, "pages").select("page_id", _cleaned(F.coalesce(body, F.lit(""))).alias("html"))


@batch_udf("string")
def _cleaned(v):
    import pyarrow as pa

    return pa.array([cleaned(x) for x in v.to_pylist()], pa.string())


_formats("rule_inline_ops", f"'<p>' || replace({_E}, 'en', '<strong>en</strong>') || '</p>'", _rule(type="contains", pattern="en", formats=["bold"]))
_formats(
    "rule_block_ops",
    f"CASE WHEN contains(text, 'en') THEN '<h2 class=\"page-align-center\">' || {_E} || '</h2>' ELSE '<p>' || {_E} || '</p>' END",
    _rule(type="regex", pattern="en", formats=["heading2", "heading3", "align_center"]),
)
_FIRST = "regexp_extract(coalesce(text, ''), '^[^ \\n]+')"
_formats(
    "rule_target",
    f"(SELECT '<p>' || {sql_html('a')} || CASE WHEN b = '' THEN '' WHEN a = '' THEN {sql_html('b')} ELSE '<em>' || {sql_html('b')} || '</em>' END || '</p>' "
    f"FROM (SELECT {_FIRST} AS a, substr(coalesce(text, ''), length({_FIRST}) + 1) AS b))",
    _rule(type="regex", pattern=r"^[^ \n]+", target="after", formats=["italic"]),
)
_formats(
    "rule_group",
    f"'<p>' || regexp_replace({_E}, '([aeiou])(n)', '<em>\\1</em><strong>\\2</strong>', 'g') || '</p>'",
    _rule(type="regex", pattern="([aeiou])(n)", group_formats=[["italic"], ["bold"]]),
)
_formats(
    "rule_match",
    f"""(SELECT '<p>' || CASE WHEN p = 0 THEN x ELSE substr(x, 1, p - 1) || '<span class="page-note">en</span>' || CASE WHEN q = 0 THEN rest ELSE substr(rest, 1, q - 1) || '<span class="page-sup">en</span>' || substr(rest, q + 2) END END || '</p>'
 FROM (SELECT x, p, rest, strpos(rest, 'en') AS q FROM (SELECT x, strpos(x, 'en') AS p, substr(x, strpos(x, 'en') + 2) AS rest FROM (SELECT {_E} AS x))))""",
    _rule(type="regex", pattern="en", match_formats=[["note"], ["sup"]]),
)
_formats(
    "rule_pattern",
    f"'<p>' || replace({_E}, 'er', '<span class=\"page-underline\">er</span>') || '</p>'",
    _rule(type="regex", pattern="e(?:r)", formats=["underline"]),
)
_formats(
    "rule_entry",
    f"CASE WHEN coalesce(text, '') = '' THEN '<p></p>' ELSE '<p class=\"\" data-ind=\"first\" data-indv=\"2\">' || {_E} || '</p>' END",
    _rule(formats=["first_indent", "indent"]),
)
_formats(
    "rule_apply",
    f"CASE WHEN coalesce(text, '') = '' THEN '<p></p><p>two ' || source || '</p>' ELSE '<p>' || {_E} || ' two ' || source || '</p>' END",
    [{"id": "1", "conditions": [{"type": "contains", "pattern": "\u4e00", "formats": ["bold"]}, {"formats": ["merge"]}, {"formats": ["italic"]}]}],
    lambda: F.concat(_page(), F.lit("<p>two "), F.col("source"), F.lit("</p>")),
)


@query("rule_eval", "SELECT doc_id, starts_with(coalesce(text, ''), 'S') AS fires FROM documents")
def _fires(s, d):
    pages = r.format_pages(_docs(s, d).select("doc_id", _page().alias("html")), "html", _rule(type="prefix", pattern="S", formats=["bold"]))
    return pages.select("doc_id", F.contains("formatted.html", F.lit("<strong>")).alias("fires"))


query("rule_match_ranges", "SELECT doc_id, len([i for i in range(1, length(text)) if substr(text, i, 2) = 'ee'])::INT AS n FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", F.size(r.contains_ranges(F.col("text"), "ee")).alias("n"))
)
_OPS = ["p", "heading1", "remove", "bold", "sup", "sub", "indent", "flush"]
_PAIR = "[" + ", ".join(f"'{o}'" for o in _OPS) + "]"


@query(
    "rule_conflict",
    f"SELECT doc_id, a, b, a <> b AND (a = 'remove' OR b = 'remove' OR (a IN ('p', 'heading1') AND b IN ('p', 'heading1')) OR (a IN ('sup', 'sub') AND b IN ('sup', 'sub')) OR (a IN ('indent', 'flush') "
    f"AND b IN ('indent', 'flush'))) AS yes FROM (SELECT doc_id, {_PAIR}[doc_id % {len(_OPS)} + 1] AS a, {_PAIR}[length(coalesce(text, '')) % {len(_OPS)} + 1] AS b FROM documents)",
)
def _conflicts(s, d):
    """Two operations for each document, by its number and by the length of its text."""
    pick = lambda n: F.element_at(F.array(*[F.lit(o) for o in _OPS]), (n % len(_OPS) + 1).cast("int"))
    pairs = _docs(s, d).select("doc_id", pick(F.col("doc_id")).alias("a"), pick(F.length(t.text_or_empty(F.col("text")))).alias("b"))
    return pairs.withColumn("yes", r.conflict(F.col("a"), F.col("b")))


query(
    "rule_replace",
    "SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z])\\.', '\\1', 'g'), '(?i)the', '$', 'g') AS text FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            r.replace_rules(F.col("text"), [{"pattern": r"([a-z])\.", "keep_groups": [1]}, {"pattern": "the", "flags": "gi", "replacement": "$"}, {"pattern": "x", "enabled": False}]).alias("text"),
        )
    )
)
#: Styles of documents by doc_id, a number between the two parts, and what is left of them.
_STYLES = [
    ("COLOR: Red; position:fixed; font-size:9px; text-align : Center;font-size:", "px", "'text-align:center;font-size:' || greatest(8, least(72, doc_id % 100)) || 'px;color:Red'"),
    ("color:#ABCDEF;font-size:", ".6 PX", "'font-size:' || greatest(8, least(72, doc_id % 100 + 1)) || 'px;color:#abcdef'"),
    ("font-family: \"黑体\",  SimHei, sans-serif;top:", "px", "'font-family:黑体, SimHei, sans-serif'"),
    ("text-align:justify;font-size:12pt;color:#12;width:", "", "''"),
    ("color:red;font-family:Arial;color:#", "", "'color:red'"),
    ("font-family:'serif';text-align:left;text-align:", "", "'text-align:left;font-family:serif'"),
]
_STYLED = " ".join(f"WHEN {i} THEN {sql}" for i, (*_, sql) in enumerate(_STYLES))


@query("html_char_style", f"SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE CASE doc_id % {len(_STYLES)} {_STYLED} END END AS style FROM documents")
def _char_style(s, d):
    n = len(_STYLES)
    part = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _STYLES]), (F.col("doc_id") % n + 1).cast("int"))
    style = F.when(F.col("text").isNotNull(), F.concat(part(0), (F.col("doc_id") % 100).cast("string"), part(1)))
    return _docs(s, d).select("doc_id", r.char_style(style).alias("style"))


@query("flt_protected_block", "SELECT doc_id, doc_id % 2 = 1 AND coalesce(text, '') <> '' AS changed FROM documents")
def _protected(s, d):
    pages = _docs(s, d).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace(_page(), F.lit("<p>"), F.lit('<p class="page-caption">'))).otherwise(_page()).alias("html")
    )
    return r.format_pages(pages, "html", _rule(formats=["heading1"])).select("doc_id", F.contains("formatted.html", F.lit("<h1")).alias("changed"))


_NO_TABLES = "regexp_replace(html, '(?is)<table\\b.*?(?:</table\\s*>|\\z)', '', 'g')"


@query(
    "flt_outside_tables",
    f"SELECT page_id, len(regexp_extract_all({_NO_TABLES}, '(?i)<p\\b'))::INT AS hits, length({_NO_TABLES})::INT AS chars FROM pages",
)
def _outside(s, d):
    pages = table(s, d, "pages").select("page_id", r.outside_tables(F.col("html")).alias("html"))
    return pages.select("page_id", F.regexp_count("html", F.lit(r"(?i)<p\b")).alias("hits"), F.length("html").alias("chars"))


_PARTS = f"""SELECT doc_id, i, p[i] AS x FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, [l for l in regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '\\. ', chr(10), 'g'), '^[ \\t\\x{{3000}}]+', ''), '\\n[ \\t\\x{{3000}}]*') if {sql_trim('l')} <> ''] AS p FROM documents))"""
_MERGED = f"""SELECT doc_id, n::BIGINT AS n, string_agg(x, '' ORDER BY i) AS text FROM (SELECT *, sum(CASE WHEN prev IS NULL OR regexp_matches(prev, '[。！？!?.：:；;…]$') OR regexp_matches(x, '^([0-9]+[.、)）]|[-•·*]|[　 ]{{2}}|[“「『（(])') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n
 FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM ({_PARTS}))) GROUP BY 1, 2"""


@query("cl_merge_paras", _MERGED)
def _merge(s, d):
    rows = _docs(s, d).select("doc_id", F.posexplode(t.split_paragraphs(F.regexp_replace("text", r"\. ", "\n"))).alias("n", "text"))
    return r.merged_paragraphs(rows, "doc_id", "n", "text")


query(
    "pr_page_errors",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'half_width,repeat' ELSE 'mixed' END || CASE WHEN (length(text) - length(replace(text, "
    "'\"', ''))) % 2 = 1 THEN ',quotes' ELSE '' END AS kinds FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            F.array_join(r.page_errors(F.concat(F.when(F.col("lang") == "en", "中,国国国 ").otherwise("中ab文 "), "text")), ",").alias("kinds"),
        )
    )
)
query("cl_page", None)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            t.inline_spaces(t.digit_punctuation(t.punctuation_extended(F.concat(F.lit("中文, 1。2 “x” "), "text"))), True, True).alias("text"),
        )
    )
)
query(
    "cl_correction_format",
    "SELECT doc_id, regexp_replace(regexp_replace('# ' || source || ' **b** $x$', '^#+ *', ''), '\\*\\*|\\$', '', 'g') AS out FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            r.replace_rules(F.concat(F.lit("# "), "source", F.lit(" **b** $x$")), [{"pattern": "^#+ *", "replacement": ""}, {"pattern": r"\*\*|\$", "replacement": ""}]).alias("out"),
        )
    )
)



_MARKED = """SELECT book, article, string_agg(x, chr(10) ORDER BY turn) AS body, NULL::VARCHAR AS error FROM (
 SELECT conv_id AS book, turn, coalesce(text, '') AS x, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS article FROM conversations) WHERE trim(x) <> '' GROUP BY 1, 2"""


@query("mk_apply", _MARKED)
def _markers(s, d):
    """Each user's turn begins an article."""
    html = F.concat(F.when(F.col("role") == "user", markers.ARTICLE).otherwise(""), t.text_or_empty(F.col("text")))
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), F.lit(1).alias("n"), html.alias("html"))
    return markers.apply_markers(rows)


@query("join_nonoverlap", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'ren|ner'))::INT AS kept FROM documents")
def _nonoverlap(s, d):
    """Places of two words in order of their starts; one is kept if it overlaps none that was kept before."""
    places = lambda w: F.transform(r.contains_ranges(F.col("text"), w), lambda i: F.struct(i.alias("start"), (i + 3).alias("end")))
    given = _docs(s, d).select("doc_id", F.coalesce(F.array_sort(F.concat(places("ren"), places("ner"))), F.array().cast("array<struct<start:int,end:int>>")).alias("given"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return given.select("doc_id", F.size(r.nonoverlapping(F.col("given"), none)).alias("kept"))


@query("pr_reocr_diff", "SELECT doc_id, doc_id % 2 = 1 AND contains(coalesce(text, ''), 'e') AS differs FROM documents")
def _reocr(s, d):
    """Half of the documents are read again with other white space, half with another letter."""
    again = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("\n")))).otherwise(F.replace("text", F.lit("e"), F.lit("c")))
    return _docs(s, d).select("doc_id", r.reads_differently(F.col("text"), again).alias("differs"))


_FIRST_TWO = f"{sql_trim('l[1]')} || {sql_trim('l[2]')}"


@query(
    "cmd_lang",
    f"""SELECT doc_id, CASE WHEN len(l) < 2 THEN coalesce(text, '') ELSE array_to_string(['<strong>' || {_FIRST_TWO} || '</strong>'] || l[3:], chr(10)) END AS text,
 CASE WHEN len(l) < 2 THEN 'no lines 1 to 2' END AS error FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""",
)
def _commands(s, d):
    pages = _docs(s, d).select("doc_id", t.text_or_empty(F.col("text")).alias("text"), F.lit("（1,2合并）加粗").alias("script"))
    return commands.run_scripts(pages, "text", "script").select("doc_id", "edited.text", "edited.error")


@query(
    "cmd_substitute",
    "SELECT conv_id AS book, turn AS page, CASE WHEN turn BETWEEN 1 AND 3 THEN replace(text, 'en', 'EN') ELSE text END AS text FROM "
    "conversations",
)
def _substitute(s, d):
    pages = table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    return commands.substituted(pages, ":1,3s/en/EN/g")


@query(
    "cmd_page_range",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 5 END AS first, CASE doc_id % 4 WHEN 0 THEN 7 WHEN "
    "1 THEN 8 WHEN 2 THEN 9 ELSE 5 END AS last FROM documents",
)
def _page_range(s, d):
    spec = F.element_at(F.array(*[F.lit(x) for x in ("+3", "8-2", "全部", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(s, d).select("doc_id", commands.page_range(spec, F.lit(5), F.lit(9)).alias("p")).select("doc_id", "p.first", "p.last")


@batch_udf("string")
def _other_format(v):
    import pyarrow as pa

    return pa.array([r.replace_format(x or "", "bold", "italic") for x in v.to_pylist()], pa.string())


query("fmt_find_replace", f"SELECT doc_id, '<p>' || replace({_E}, 'en', '<em>en</em>') || '</p>' AS html FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", _other_format(F.replace(_page(), F.lit("en"), F.lit("<strong>en</strong>"))).alias("html"))
)


@batch_udf("string")
def _translated(v):
    import pyarrow as pa

    return pa.array([r.translate_regex(x) for x in v.to_pylist()], pa.string())


@batch_udf("boolean")
def _safe(v):
    import pyarrow as pa

    return pa.array([r.regex_is_safe(x) for x in v.to_pylist()], pa.bool_())


def _form(forms):
    """A pattern for each document, made of its source."""
    n = len(forms)
    return F.element_at(F.array(*[F.concat(F.lit(a), F.col("source"), F.lit(b)) for a, b in forms]), (F.col("doc_id") % n + 1).cast("int"))


query(
    "rule_parse_regex",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '(?i)' || source WHEN 1 THEN '(?P<n>' || source || ')(?P=n)' ELSE source || '\\Z' END "
    "AS p FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", _translated(_form([("/", "/gi"), ("(?<n>", ")\\k<n>"), ("", "\\z")])).alias("p"))
    )
)
query("flt_regex_safe", "SELECT doc_id, doc_id % 6 IN (0, 3, 5) AS ok FROM documents")(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            _safe(_form([("", "+"), ("((", "+))+"), ("((a+)", "?)*"), ("(", ")+c"), ("(a|", "*)*"), ("(.*)+", "")])).alias("ok"),
        )
    )
)


@batch_udf("string")
def _stored(v):
    import json

    import pyarrow as pa

    return pa.array([json.dumps(r.normal_rules(json.loads(x)), sort_keys=True) for x in v.to_pylist()], pa.string())


@query("ut_format_rules_store", "SELECT doc_id, 'rule 1' AS name, source AS pattern, 'match' AS target, 1 AS kept FROM documents")
def _rules_store(s, d):
    raw = F.concat(F.lit('[{"id":3,"conditions":[{"pattern":"'), F.col("source"), F.lit('","target":"x","formats":["bold","h1"]}]}]'))
    rule = "array<struct<name:string,conditions:array<struct<pattern:string,target:string,formats:array<string>>>>>"
    stored = _docs(s, d).select("doc_id", F.from_json(_stored(raw), rule).alias("j")).select("doc_id", F.get("j", F.lit(0)).alias("j"))
    c = F.get("j.conditions", F.lit(0))
    return stored.select("doc_id", "j.name", c["pattern"].alias("pattern"), c["target"].alias("target"), F.size(c["formats"]).alias("kept"))
