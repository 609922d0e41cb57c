"""Queries over page rows. Conversations stand for books (conv_id) of pages (turn)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import intervals
from pagewright.operators import pages as p
from pagewright.operators import scans
from pagewright.plans.registry import query, table
from pagewright.plans.text_queries import _q, sql_trim

_SPEC_SQL = "SELECT doc_id, '1-3, ' || (doc_id % 40 + 1) || ',9-7,x,2-' AS spec FROM documents"
_PAGES_SQL = """list_sort(list_distinct([n for n in flatten([CASE WHEN regexp_full_match(trim(e), '[0-9]+') THEN [trim(e)::INT] WHEN regexp_full_match(trim(e), '[0-9]+ *- *[0-9]+') THEN range(least(trim(split_part(e, '-', 1))::INT, trim(split_part(e, '-', 2))::INT), greatest(trim(split_part(e, '-', 1))::INT, trim(split_part(e, '-', 2))::INT) + 1) ELSE [] END for e in string_split(spec, ',')]) if n >= 1]))"""


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("1-3, "), (F.col("doc_id") % 40 + 1).cast("string"), F.lit(",9-7,x,2-")).alias("spec"))


@query("flt_page_spec_exclude", f"SELECT doc_id, unnest({_PAGES_SQL}) AS page FROM ({_SPEC_SQL})")
def _exclude(spark, sf_dir):
    return _specs(spark, sf_dir).select("doc_id", F.explode(p.page_numbers(F.col("spec"))).alias("page"))


@query(
    "flt_page_spec_include",
    f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE array_to_string({_PAGES_SQL}, ' ') END AS "
    f"pages FROM ({_SPEC_SQL})",
)
def _include(spark, sf_dir):
    spec = F.when(F.col("doc_id") % 4 == 0, " ALL ").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "x,-").otherwise(F.col("spec"))
    return _specs(spark, sf_dir).select("doc_id", F.array_join(p.included_pages(spec).cast("array<string>"), " ").alias("pages"))


@query("flt_exclude_resolve", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN doc_id::VARCHAR ELSE '7' END AS spec FROM documents")
def _resolve(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 1, "  ").when(F.col("doc_id") % 3 == 2, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", p.exclusion(given, F.lit("7")).alias("spec"))


@query("set_page_union", f"SELECT DISTINCT n AS page FROM (SELECT unnest({_PAGES_SQL}) AS n FROM ({_SPEC_SQL}))")
def _page_union(spark, sf_dir):
    return _exclude(spark, sf_dir).select("page").distinct()


@query("set_page_intersect", f"SELECT DISTINCT n AS page FROM (SELECT unnest({_PAGES_SQL}) AS n FROM ({_SPEC_SQL})) WHERE n BETWEEN 1 AND 20")
def _page_intersect(spark, sf_dir):
    return _exclude(spark, sf_dir).select("page").intersect(spark.range(1, 21).select(F.col("id").cast("int").alias("page")))


def _books(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "role", "text")


@query("flt_valid_rows", "SELECT conv_id AS book, turn AS page FROM conversations WHERE turn % 3 <> 1 AND text IS NOT NULL")
def _valid(spark, sf_dir):
    rows = _books(spark, sf_dir).withColumn("page", F.when(F.col("page") % 3 != 1, F.col("page")))
    return rows.where(F.col("page").isNotNull() & F.col("text").isNotNull()).select("book", "page")


@query("flt_blank", "SELECT conv_id AS book, turn AS page FROM conversations WHERE turn % 2 = 1")
def _blank(spark, sf_dir):
    rows = _books(spark, sf_dir).withColumn("text", F.when(F.col("page") % 2 == 1, F.col("text")).otherwise(" 　\n"))
    return rows.where(t.u_trim(F.col("text")) != "").select("book", "page")


for _kind, _c, _sql in (
    ("contains", lambda x: F.contains(x, F.lit("the")), "contains(text, 'the')"), ("prefix", lambda x: F.startswith(x, F.lit("E")), "starts_with(text, 'E')"),
    ("suffix", lambda x: F.endswith(x, F.lit("n.")), "ends_with(text, 'n.')"), ("regex", lambda x: x.rlike("[0-9]{2}"), "regexp_matches(text, '[0-9]{2}')"),
):
    query(f"flt_cond_{_kind}", f"SELECT doc_id FROM documents WHERE {_sql}")(lambda spark, sf_dir, c=_c: table(spark, sf_dir, "documents").where(c(F.col("text"))).select("doc_id"))


@query("join_resume_todo", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 1")
def _todo(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return p.pages_to_do(d, d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 1"), ["doc_id"])


@query(
    "join_resume_merge",
    "SELECT conv_id AS book, turn AS page, CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 2 = 0 THEN 'new ' || text ELSE text END AS text "
    "FROM conversations WHERE turn % 3 <> 1 OR turn % 2 = 0",
)
def _merge(spark, sf_dir):
    b = _books(spark, sf_dir).drop("role")
    return p.merge_results(b.where("page % 3 <> 1"), b.where("page % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")), b.where("page % 4 = 3"), ["book", "page"])


@query("join_cached_parse", "SELECT conv_id AS book, turn AS page, text FROM conversations WHERE turn % 3 <> 0 AND turn <> 5")
def _cached(spark, sf_dir):
    entry = F.struct(F.when(F.col("page") % 3 == 0, "error").otherwise("done").alias("status"), F.when(F.col("page") == 5, "").otherwise(F.col("text")).alias("result"))
    rows = _books(spark, sf_dir).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), entry))).alias("pages"))
    return p.finished_pages(rows.withColumn("pages", F.map_concat("pages", F.create_map(F.lit("x1"), F.struct(F.lit("done").alias("status"), F.lit("z").alias("result"))))))


query("src_progress_json", "SELECT conv_id AS book, turn AS page, text FROM conversations WHERE turn % 3 <> 0 AND turn <> 5")(
    lambda spark, sf_dir: p.finished_pages(
        _progress_json(spark, sf_dir).select("book", F.from_json("json", "pages map<string,struct<status:string,result:string>>").alias("j")).select("book", "j.pages"),
    )
)


def _progress_json(spark, sf_dir):
    entry = F.struct(F.when(F.col("page") % 3 == 0, "error").otherwise("done").alias("status"), F.when(F.col("page") == 5, "").otherwise(F.col("text")).alias("result"))
    rows = _books(spark, sf_dir).groupBy("book").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), entry))).alias("pages"))).alias("json"))
    return rows.unionByName(spark.createDataFrame([(-1, "{broken")], "book long, json string"))


@query("agg_body", "SELECT conv_id AS book, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def _body(spark, sf_dir):
    return p.joined_text(_books(spark, sf_dir), "book", "page", "text", "\n")


@query(
    "agg_body_merged",
    "SELECT conv_id AS book, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id",
)
def _body2(spark, sf_dir):
    return p.joined_text(_books(spark, sf_dir).withColumn("text", F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(" ")), "book", "page", "text", "\n\n", True)


@query(
    "agg_progress_counts",
    "SELECT conv_id AS book, count(*) AS total, count(*) FILTER (turn % 3 <> 0) AS done, count(*) FILTER (turn % 3 = 0) AS failed FROM "
    "conversations GROUP BY conv_id",
)
def _counts(spark, sf_dir):
    return _books(spark, sf_dir).groupBy("book").agg(F.count("*").alias("total"), F.count_if(F.col("page") % 3 != 0).alias("done"), F.count_if(F.col("page") % 3 == 0).alias("failed"))


@query("agg_error_count", "SELECT conv_id AS book, count(CASE WHEN role = 'user' THEN 1 END) AS errors FROM conversations GROUP BY conv_id")
def _errors(spark, sf_dir):
    return _books(spark, sf_dir).groupBy("book").agg(F.count_if(F.when(F.col("role") == "user", "e").isNotNull()).alias("errors"))


@query(
    "agg_clean_report",
    f"SELECT source, count(*) AS total, count(*) FILTER (c <> text) AS changed, sum(length(c) - length(text))::BIGINT AS delta FROM "
    f"(SELECT source, text, "
    f"{sql_trim('regexp_replace(regexp_replace(text, ' + _q('[ ' + chr(92) + 't]+') + ', ' + _q(' ') + ', ' + _q('g') + '), ' + _q('[' + chr(92) + 'r' + chr(92) + 'n]+') + ', ' + _q(' ') + ', ' + _q('g') + ')')} "
    f"AS c FROM documents) GROUP BY source",
)
def _report(spark, sf_dir):
    c = t.u_trim(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"[\r\n]+", " "))
    d = table(spark, sf_dir, "documents").select("source", "text", c.alias("c"))
    return d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("c") != F.col("text")).alias("changed"), F.sum(F.length("c") - F.length("text")).cast("long").alias("delta"))


@query(
    "agg_stage_timing",
    "SELECT event_type AS stage, round(sum(value), 4) AS seconds, round(sum(value) / count(DISTINCT user_id), 4) AS per_page, "
    "round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type",
)
def _timing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.sum("value").alias("s"), F.count_distinct("user_id").alias("n"))
    total = by.agg(F.sum("s").alias("all"))
    return by.crossJoin(F.broadcast(total)).select(F.col("event_type").alias("stage"), F.round("s", 4).alias("seconds"), F.round(F.col("s") / F.col("n"), 4).alias("per_page"), F.round(F.col("s") / F.col("all"), 6).alias("share"))


@query(
    "agg_bench",
    "SELECT lang, round(avg(n_chars), 4) AS mean_chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines, median(n_chars) FILTER "
    "(n_chars > 0) AS median_chars FROM documents GROUP BY lang",
)
def _bench(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"), F.percentile(F.when(F.col("n_chars") > 0, F.col("n_chars")), 0.5).alias("median_chars"))


@query("agg_match_count", "SELECT doc_id, len(regexp_extract_all(text, 'th|en'))::BIGINT AS matches FROM documents")
def _matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("th|en")).cast("long").alias("matches"))


@query(
    "agg_tag_balance",
    "SELECT page_id, length(html) - length(replace(html, '<', '')) AS opened, length(html) - length(replace(html, '>', '')) AS closed, "
    "len(regexp_extract_all(html, '&[A-Za-z0-9#]+;')) AS entities FROM pages",
)
def _balance(spark, sf_dir):
    n = lambda x: F.regexp_count("html", F.lit(x)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<").alias("opened"), n(">").alias("closed"), n("&[A-Za-z0-9#]+;").alias("entities"))


@query(
    "agg_link_map",
    "SELECT page_id, href, href IN (SELECT url FROM pages) AS found FROM (SELECT page_id, unnest(regexp_extract_all(html, "
    "'href=\"([^\"]*)\"', 1)) AS href FROM (SELECT page_id, html || '<a href=\"' || url || '\"><a href=\"#x\">' AS html FROM pages))",
)
def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    html = F.concat("html", F.lit('<a href="'), "url", F.lit('"><a href="#x">'))
    links = pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.join(pages.select(F.col("url").alias("href"), F.lit(True).alias("known")).distinct(), "href", "left").select("page_id", "href", F.coalesce("known", F.lit(False)).alias("found"))


@query(
    "agg_img_dedup",
    "SELECT img, dense_rank() OVER (ORDER BY first_doc, img) AS n FROM (SELECT 'data:' || (doc_id % 50) AS img, min(doc_id) AS "
    "first_doc FROM documents GROUP BY 1)",
)
def _images(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select(F.concat(F.lit("data:"), (F.col("doc_id") % 50).cast("string")).alias("img"), "doc_id").groupBy("img").agg(F.min("doc_id").alias("f"))
    return p.with_global_number(first, ["f", "img"], "n").select("img", "n")


@query("win_version_no", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS version FROM events")
def _versions(spark, sf_dir):
    return p.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").drop("ts")


query(
    "src_history",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS v "
    "FROM events) WHERE v = 1",
)(
    lambda spark, sf_dir: (
        _versions(spark, sf_dir).where("version = 1").select("user_id", "event_id")
    )
)
query("ut_history_sort", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events")(
    lambda spark, sf_dir: (
        p.newest(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
        .select("event_id", F.col("version").alias("n"))
    )
)
query(
    "win_keep_n",
    "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, "
    "event_id) AS n FROM events) WHERE n <= 30",
)(
    lambda spark, sf_dir: (
        p.newest(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").where("version <= 30")
        .select("event_type", "event_id")
    )
)


@query(
    "win_first_last_line",
    f"SELECT doc_id, k[1] AS first, k[-1] AS last FROM (SELECT doc_id, [i for i in range(1, len(l) + 1) if {sql_trim('l[i]')} <> ''] AS "
    f"k FROM (SELECT doc_id, string_split(chr(10) || text || chr(10), chr(10)) AS l FROM documents))",
)
def _ends(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), "text", F.lit("\n")), "\n")).alias("i", "line"))
    n = F.when(t.u_trim(F.col("line")) != "", F.col("i") + 1)
    return rows.groupBy("doc_id").agg(F.min(n).cast("long").alias("first"), F.max(n).cast("long").alias("last"))


@query(
    "win_running_offset",
    "SELECT conv_id AS book, turn AS page, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations",
)
def _offsets(spark, sf_dir):
    w = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return _books(spark, sf_dir).select("book", "page", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("start"))


query(
    "win_heading_counter",
    "SELECT conv_id AS book, turn AS page, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations",
)(
    lambda spark, sf_dir: (
        _books(spark, sf_dir)
        .select("book", "page", F.count_if(F.col("role") == "user").over(Window.partitionBy("book").orderBy("page")).alias("n"))
    )
)
query(
    "win_chapter_fill",
    "SELECT conv_id AS book, turn AS page, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS "
    "chapter FROM conversations",
)(
    lambda spark, sf_dir: (
        _books(spark, sf_dir)
        .select(
            "book",
            "page",
            F.last(F.when(F.col("role") == "user", F.col("page")), True).over(Window.partitionBy("book").orderBy("page")).alias("chapter"),
        )
    )
)
query(
    "win_title_dedup",
    "SELECT conv_id AS book, turn AS page FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM "
    "conversations) WHERE n = 1",
)(
    lambda spark, sf_dir: (
        _books(spark, sf_dir)
        .withColumn("n", F.row_number().over(Window.partitionBy("book", "role").orderBy("page")))
        .where("n = 1")
        .select("book", "page")
    )
)
query(
    "win_waves",
    "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY w IS NULL, w, CASE WHEN w IS NOT NULL THEN n_chars END, doc_id) - 1) // 4 AS wave FROM (SELECT doc_id, "
    "source, n_chars, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 END AS w FROM documents)",
)(
    lambda spark, sf_dir: (
        p.waves(
            table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7).alias("w")),
            "source",
            "w",
            "n_chars",
            "doc_id",
            4,
        )
        .select("doc_id", "wave")
    )
)
query(
    "win_even_sample",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) "
    "OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 7 OR list_contains([floor(k * (n / 7.0::DOUBLE))::BIGINT for k in range(7)], i)",
)(
    lambda spark, sf_dir: p.even_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7)
)
_EMA = """SELECT user_id, list_reduce(list({'s': event_type, 't': epoch_us(ts) / 1e6, 'd': event_id::DOUBLE, 'r': 0.0::DOUBLE} ORDER BY ts, event_id), lambda a, x:
 {'s': x.s, 't': x.t, 'd': x.d, 'r': CASE WHEN x.s IS DISTINCT FROM a.s THEN 0 WHEN x.t > a.t AND x.d > a.d THEN CASE WHEN a.r <= 0 THEN (x.d - a.d) / (x.t - a.t) ELSE 0.3::DOUBLE * ((x.d - a.d) / (x.t - a.t)) + 0.7::DOUBLE * a.r END ELSE a.r END}).r AS rate
 FROM events GROUP BY user_id"""
query("win_ema_rate", _EMA)(
    lambda spark, sf_dir: scans.final_rate(
        table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("t"), F.col("event_id").alias("d")),
        "user_id",
        "event_type",
        "d",
        "t",
    )
)

query("sort_pages", "SELECT conv_id AS book, turn AS page FROM conversations ORDER BY 1, 2")(
    lambda spark, sf_dir: (
        _books(spark, sf_dir).select("book", "page").orderBy("book", "page")
    )
)
@query(
    "sort_natural",
    "SELECT name, row_number() OVER (ORDER BY n) AS place FROM (SELECT 'p' || c_custkey || '.png' AS name, c_custkey AS n FROM customer)",
)
def _natural(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("name"))
    return p.with_global_number(names.withColumn("k", t.natural_key(F.col("name"))), ["k"], "place").select("name", "place")


query(
    "limit_preview",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) "
    "WHERE n <= 20",
)(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents")
        .select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))
        .where("n <= 20")
        .drop("n")
    )
)
@query(
    "set_union_pages",
    "SELECT row_number() OVER (ORDER BY b, k) AS page, text FROM (SELECT 1 AS b, item_id AS k, text FROM benchmark UNION ALL SELECT 2, "
    "r_regionkey, r_name FROM region)",
)
def _union_pages(spark, sf_dir):
    first = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("b"), F.col("item_id").cast("long").alias("k"), "text")
    second = table(spark, sf_dir, "region").select(F.lit(2).alias("b"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("text"))
    return p.with_global_number(first.unionByName(second), ["b", "k"], "page").select("page", "text")


query("set_dedupe_sources", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    )
)
query(
    "join_toc_href",
    "SELECT d.doc_id, m.id FROM (SELECT doc_id, 'c' || (doc_id % 120) || '.xhtml' AS f FROM documents) d LEFT JOIN (SELECT 'c' || "
    "(page_id % 100) || '.xhtml' AS f, min(page_id) AS id FROM pages GROUP BY 1) m USING (f)",
)(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.concat(F.lit("t/c"), (F.col("doc_id") % 120).cast("string"), F.lit(".xhtml#h1")).alias("href"))
        .select("doc_id", F.substring_index(F.substring_index("href", "#", 1), "/", -1).alias("f"))
        .join(
            table(spark, sf_dir, "pages").groupBy(F.concat(F.lit("c"), (F.col("page_id") % 100).cast("string"), F.lit(".xhtml")).alias("f")).agg(F.min("page_id").alias("id")),
            "f",
            "left",
        )
        .select("doc_id", "id")
    )
)
_RANGES = "SELECT doc_id, doc_id % b.n AS book, (doc_id * 97) % 3000 AS lo, (doc_id * 97) % 3000 + (doc_id % 11) * 150 AS hi FROM documents, (SELECT max(conv_id) + 1 AS n FROM conversations) b"


@query(
    "join_span_nodes",
    f"SELECT r.doc_id, a.conv_id AS book, a.turn AS page, greatest(r.lo, a.e - a.n) - (a.e - a.n) AS first, least(r.hi, a.e) - (a.e - a.n) AS last FROM (SELECT conv_id, turn, length(text) AS n, "
    f"sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS e FROM conversations) a JOIN ({_RANGES}) r ON a.conv_id = r.book AND a.e > r.lo AND a.e - a.n < r.hi AND r.lo < r.hi AND a.n > 0",
)
def _span_nodes(spark, sf_dir):
    """A table of ranges of books' texts, one for each document, and the part of each page that they touch."""
    w = Window.partitionBy("book").orderBy("page")
    pages = _books(spark, sf_dir).select("book", "page", F.length("text").alias("n"), F.sum(F.length("text")).over(w).cast("long").alias("end"))
    pages = pages.select("book", "page", (F.col("end") - F.col("n")).alias("start"), "end")
    n = table(spark, sf_dir, "conversations").agg(F.max("conv_id") + 1).first()[0]
    at = (F.col("doc_id") * 97) % 3000
    ranges = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("book"), at.alias("start"), (at + F.col("doc_id") % 11 * 150).alias("end"))
    met = intervals.overlapping(pages, ranges, "book", 512)
    first, last = F.greatest("right_start", "start") - F.col("start"), F.least("right_end", "end") - F.col("start")
    return met.select(F.col("right_doc_id").alias("doc_id"), "book", "page", first.alias("first"), last.alias("last"))


query(
    "ut_batch_books",
    "SELECT conv_id AS book, CASE WHEN count(*) FILTER (turn = 3) = 0 THEN 'no page 3' END AS error, sum(length(text))::BIGINT AS "
    "chars FROM conversations GROUP BY conv_id",
)(
    lambda spark, sf_dir: (
        _books(spark, sf_dir).groupBy("book")
        .agg(F.when(F.count_if(F.col("page") == 3) == 0, "no page 3").alias("error"), F.sum(F.length("text")).cast("long").alias("chars"))
    )
)
query(
    "ut_model_match",
    "SELECT c_custkey, lower(replace('M' || chr(92) || c_name, chr(92), '/')) AS path, lower(c_name) AS base FROM customer",
)(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.lower(F.replace(F.concat(F.lit("M\\"), "c_name"), F.lit("\\"), F.lit("/"))).alias("path"))
        .withColumn("base", F.substring_index("path", "/", -1))
    )
)
query(
    "ut_model_key",
    "SELECT lower(source) AS k, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS model FROM (SELECT CASE WHEN doc_id % 2 = "
    "0 AND source = 'src1' THEN upper(source) ELSE source END AS source FROM documents) GROUP BY 1",
)(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents")
        .select(
            F.when((F.col("doc_id") % 2 == 0) & (F.col("source") == "src1"), F.upper("source")).otherwise(F.col("source")).alias("source"),
        )
        .groupBy(F.lower("source").alias("k"))
        .agg(F.when(F.count_distinct("source") == 1, F.min("source")).alias("model"))
    )
)
query(
    "ut_bench_matrix",
    "SELECT DISTINCT d.dpi, m.preset FROM (SELECT unnest([100, 150, 200, 300, 600, 200]) AS dpi) d, (SELECT DISTINCT lang AS preset "
    "FROM documents) m WHERE d.dpi <= 300",
)(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents").select(F.col("lang").alias("preset")).distinct()
        .withColumn("dpi", F.explode(F.array(*[F.lit(x) for x in (100, 150, 200, 300, 600, 200)])))
        .where("dpi <= 300")
        .dropDuplicates()
    )
)
query("ut_clean_defaults", "SELECT doc_id, doc_id % 3 = 1 AS ws FROM documents")(
    lambda spark, sf_dir: (
        table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            F.coalesce(t.parse_bool(F.when(F.col("doc_id") % 3 == 1, "true").when(F.col("doc_id") % 3 == 2, "7")), F.lit(False)).alias("ws"),
        )
    )
)
