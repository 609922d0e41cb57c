"""Queries of sinks that write and are read back, of live pages, and of word lists that are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import lexicon as x
from pagewright.operators import pages, rules
from pagewright.plans.lexicon_queries import _WORDS, _words
from pagewright.plans.registry import batch_udf, query, table
from pagewright.sources import files, sinks
from pagewright.streaming import progress


def _docs(s, d):
    return table(s, d, "documents")


def _talks(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), "role", "text")


_TXT = "CASE WHEN turn = 1 THEN '[图片]' ELSE repeat('　', CASE role WHEN 'user' THEN 2 ELSE 8 END) || coalesce(text, '') END"


@query(
    "sink_txt",
    f"SELECT lpad(conv_id::VARCHAR, 9, '0') AS book, string_agg({_TXT}, chr(10) || chr(10) ORDER BY turn, text) || repeat(chr(10), (conv_id % 3)::INT) AS body FROM conversations GROUP BY conv_id",
)
def _txt(s, d):
    """Books whose ids begin with zeros and whose texts end in none, one or two line ends."""
    blocks = _talks(s, d).withColumns({"kind": F.when(F.col("n") == 1, "image").otherwise("p"), "indent": F.when(F.col("role") == "user", 2).otherwise(9)})
    path = sinks.store_path(s, "texts")
    books = sinks.books_of(blocks, sinks.text_block(F.col("kind"), F.col("text"), F.col("indent")))
    books = books.select(F.lpad(F.col("book").cast("string"), 9, "0").alias("book"), F.concat("body", F.repeat(F.lit("\n"), (F.col("book") % 3).cast("int"))).alias("body"))
    sinks.write_texts(books, path)
    return sinks.read_texts(s, path)


_MD = "CASE WHEN turn = 1 THEN '## ' || text WHEN role = 'user' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END"


@query(
    "sink_md",
    f"SELECT conv_id::VARCHAR AS book, string_agg({_MD}, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id",
)
def _md(s, d):
    kind = F.when(F.col("n") == 1, "heading").when(F.col("role") == "user", "quote").otherwise("p")
    blocks = _talks(s, d).withColumn("kind", kind)
    path = sinks.store_path(s, "markdown")
    sinks.write_texts(sinks.books_of(blocks, sinks.markdown_block(F.col("kind"), F.col("text"), F.lit(2))), path)
    return sinks.read_texts(s, path)


def _page_rows(s, d, status, seq):
    rows = _talks(s, d).select(F.col("book").cast("string").alias("pdf"), F.col("n").cast("int").alias("page"), "text")
    return rows.select("pdf", "page", F.lit(9).alias("total"), status.alias("status"), F.col("text").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(seq).cast("long").alias("seq"))


@query(
    "sink_checkpoint",
    "SELECT conv_id::VARCHAR AS pdf, turn::INT AS page, CASE WHEN turn % 3 = 0 THEN 'done' WHEN turn % 2 = 0 THEN 'error' ELSE 'done' "
    "END AS status, text AS result FROM conversations",
)
def _checkpoint(s, d):
    """Pages are saved, and a third of them again, after which they are done."""
    path = sinks.store_path(s, "pages")
    sinks.save_pages(s, path, _page_rows(s, d, F.when(F.col("page") % 2 == 0, "error").otherwise("done"), 1))
    sinks.save_pages(s, path, _page_rows(s, d, F.lit("done"), 2).where("page % 3 = 0"))
    return sinks.read_store(s, path, sinks.PAGES).select("pdf", "page", "status", "result")


@query(
    "st_checkpoint_resume",
    "SELECT conv_id::VARCHAR AS pdf, turn::INT AS page FROM conversations WHERE turn % 2 = 0 OR conv_id % 5 = 0 OR coalesce(text, '') = '' "
    "UNION ALL SELECT conv_id::VARCHAR, 0 FROM conversations GROUP BY conv_id",
)
def _resume(s, d):
    """Of the pages wanted, those still to do: pages with an error, and one that was never read."""
    path = sinks.store_path(s, "pages")
    rows = _page_rows(s, d, F.when(F.col("page") % 2 == 0, "error").otherwise("done"), 1)
    sinks.save_pages(s, path, rows)
    wanted = rows.select("pdf", "page", "total").union(rows.select("pdf", F.lit(0).alias("page"), "total").distinct())
    # Of a book that has another number of pages now, nothing counts as done.
    wanted = wanted.withColumn("total", F.when(F.col("pdf").cast("long") % 5 == 0, 10).otherwise(F.col("total")))
    return sinks.resume_pages(s, path, wanted)[1].select("pdf", "page")


@query(
    "sink_user_dict",
    "SELECT 'fix' AS kind, 'w' || (doc_id % 50) AS wrong, arg_max(source, doc_id) AS fixed FROM documents GROUP BY 2 UNION ALL SELECT "
    "DISTINCT 'ignore', lang, NULL FROM documents",
)
def _user_dict(s, d):
    """Fixes and words to ignore, saved twice, which changes nothing."""
    docs = _docs(s, d)
    fixes = docs.select(F.lit("fix").alias("kind"), F.concat(F.lit("w"), (F.col("doc_id") % 50).cast("string")).alias("wrong"), F.col("source").alias("fixed"), F.col("doc_id").alias("seq"))
    ignored = docs.select(F.lit("ignore").alias("kind"), F.col("lang").alias("wrong"), F.lit(None).cast("string").alias("fixed"), F.lit(0).cast("long").alias("seq"))
    path = sinks.store_path(s, "dictionary")
    for _ in range(2):
        sinks.save_dictionary(s, path, fixes.union(ignored))
    both = sinks.read_dictionary(s, path)
    words = both[1].select(F.lit("ignore").alias("kind"), F.col("word").alias("wrong"), F.lit(None).cast("string").alias("fixed"))
    return both[0].select(F.lit("fix").alias("kind"), "wrong", "fixed").union(words)


@query(
    "sink_bench_report",
    "SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang UNION ALL SELECT unnest(['| lang | pages "
    "|', '|---|---|'])",
)
def _report(s, d):
    path = sinks.store_path(s, "report")
    sinks.write_report(_docs(s, d).groupBy("lang").agg(F.count("*").alias("pages")), path, ["lang"])
    return sinks.read_report(s, path).select(F.col("value").alias("line"))


@query(
    "sink_task_log",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM "
    "documents) WHERE n <= 30",
)
def _task_log(s, d):
    return pages.pruned_log(_docs(s, d).select("source", "doc_id"), "source", "doc_id")


@query(
    "src_bench_sources",
    "SELECT source AS dir, 200 AS dpi, count(*) FILTER (doc_id % 3 > 0) AS pages FROM documents GROUP BY source HAVING count(*) FILTER "
    "(doc_id % 3 > 0) >= 2",
)
def _bench_sources(s, d):
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").otherwise(".PNG"))
    return files.bench_sources(_docs(s, d).select(F.col("source").alias("dir"), F.lit(200).alias("dpi"), name.alias("name")))


@query("join_live_pages", "SELECT user_id AS book, event_id AS page, event_id % 7 + 1 AS version FROM events WHERE event_id % 7 >= 3")
def _live(s, d):
    """Pages that are open at version 3, and rows of two versions each that come in."""
    e = table(s, d, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("page"), F.col("event_type").alias("text"))
    live = e.select("book", "page", "text", F.explode(F.array(F.col("page") % 7, F.col("page") % 7 + 1)).alias("version"))
    return pages.newest_of_open(e.select("book", "page", F.lit(3).alias("version")), live).select("book", "page", "version")


@query("st_live_follow", "SELECT conv_id AS book, turn AS page, coalesce(text, '') || '!' AS text, 2 AS version FROM conversations")
def _follow(s, d):
    """Result files of two versions are followed by a stream, whose batches go to a store that is then read."""
    rows = _talks(s, d).select("book", F.col("n").alias("page"), t.text_or_empty(F.col("text")).alias("text"))
    folder, store, state = (sinks.store_path(s, n) for n in ("results", "live", "state"))
    rows.withColumn("version", F.lit(1)).write.json(folder)
    rows.select("book", "page", F.concat("text", F.lit("!")).alias("text"), F.lit(2).alias("version")).write.mode("append").json(folder)

    def upsert(df, _):
        kept = df.select(F.col("book").cast("string").alias("pdf"), F.col("page").cast("int").alias("page"), F.lit(9).alias("total"), F.lit("done").alias("status"), F.col("text").alias("result"), F.lit(None).cast("string").alias("error"), F.col("version").cast("long").alias("seq"))
        sinks.save_pages(s, store, kept)

    progress.follow_pages(s, folder, "book long, page long, text string, version int", upsert, state, seconds=None).awaitTermination()
    found = sinks.read_store(s, store, sinks.PAGES)
    return found.select(F.col("pdf").cast("long").alias("book"), F.col("page").cast("long").alias("page"), F.col("result").alias("text"), F.col("seq").cast("int").alias("version"))


@query("st_throttle")
def _throttle(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).cast("string").alias("job"), F.col("event_id").alias("seq"), (F.col("event_id") * 0.05).alias("now"))
    return pages.throttled(e)


query(
    "ut_workers",
    "SELECT doc_id, CASE WHEN doc_id % 90 BETWEEN 1 AND 64 THEN doc_id % 90 WHEN n_chars % 100 BETWEEN 1 AND 64 THEN n_chars % 100 "
    "ELSE 3 END::INT AS n FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", pages.worker_count(F.col("doc_id") % 90, F.col("n_chars") % 100).alias("n"))
    )
)
query(
    "ut_truncation",
    "SELECT doc_id, CASE WHEN n_chars >= 3000 THEN 'limit' WHEN n_chars + doc_id >= 2000 THEN 'context' END AS cause FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", pages.truncation_cause(F.col("n_chars"), F.col("doc_id"), F.lit(3000), F.lit(2000)).alias("cause"))
    )
)


@query("flt_is_ignored", "SELECT doc_id, source IN (SELECT source FROM documents WHERE doc_id IN (3, 5)) AS ignored FROM documents")
def _ignored(s, d):
    listed = _docs(s, d).where("doc_id in (3, 5)").select(F.col("source").alias("word"))
    return x.marked_ignored(_docs(s, d).select("doc_id", "source"), listed, "source").select("doc_id", "ignored")


@query(
    "topk_single_chars",
    "SELECT c AS word, n AS freq FROM (SELECT c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c) AS k FROM (SELECT "
    "unnest(string_split(text, '')) AS c FROM documents) WHERE regexp_matches(c, '[a-z]') GROUP BY c) WHERE k <= 10",
)
def _single_chars(s, d):
    chars = _docs(s, d).select(F.explode(F.split("text", "")).alias("word")).where(F.col("word").rlike("^[a-z]$"))
    return x.frequent_characters(chars.groupBy("word").agg(F.count("*").alias("freq")), 10)


_SOUNDS = "(SELECT unnest(['S', 'S', 'T', 'T', 'Q', 'Q', 'D', 'L']) AS ch, unnest(['T', 'Q', 'S', 'Q', 'S', 'T', 'L', 'D']) AS alt)"


@query("join_homophone", f"SELECT doc_id, lower(alt) AS alt, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents) JOIN {_SOUNDS} ON c = lower(ch) GROUP BY ALL")
def _homophones(s, d):
    """How often each character of each text could be another one that sounds like it."""
    pairs = x.pairs_from_lines(s.createDataFrame([("s t q",), ("# a b",), ("d  l",)], "value string"))
    held = _docs(s, d).select("doc_id", F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    return x.homophones_of(held, pairs, "c").groupBy("doc_id", "alt").agg(F.sum("n").alias("n"))


_AT = "SELECT doc_id, l[i - 1] AS a, l[i] AS c, l[i + 1] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), '') AS l FROM documents))"


@query(
    "join_ctx_word",
    f"SELECT doc_id, count(*) FILTER (c <> '') AS places, count(*) FILTER ((a || c) IN (SELECT word FROM ({_WORDS})) OR (c || b) IN (SELECT word FROM ({_WORDS}))) AS boosted FROM ({_AT}) GROUP BY doc_id",
)
def _context(s, d):
    """Every place of every text: whether its character makes a word with the one before or after it."""
    chars = F.filter(F.split(F.lower(t.text_or_empty(F.col("text"))), ""), lambda c: c != "")
    docs = _docs(s, d).select("doc_id", F.inline(F.array(F.struct(chars.alias("l")))))
    each = F.transform("l", lambda c, i: F.struct(F.coalesce(F.when(i > 0, F.get("l", i - 1)), F.lit("")).alias("before"), c.alias("candidate"), F.coalesce(F.get("l", i + 1), F.lit("")).alias("after")))
    rows = docs.select("doc_id", F.explode_outer(each).alias("x")).select("doc_id", "x.before", "x.candidate", "x.after")
    boosted = x.context_boost(rows, _words(s, d))
    return boosted.groupBy("doc_id").agg(F.count("candidate").alias("places"), F.count_if(F.col("boost") > 0).alias("boosted"))


#: Letters stand for Chinese characters here, so that the documents can be cut into words of a lexicon.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HAN = "".join(chr(0x4E00 + i) for i in range(26))
_RUNS = "(SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS runs FROM documents)"
_TOKENS = f"""WITH RECURSIVE w AS (SELECT DISTINCT x FROM (SELECT unnest(runs) AS x FROM {_RUNS})),
lex AS (SELECT x FROM w WHERE length(x) BETWEEN 2 AND 4),
step AS (SELECT x, 1 AS p, 0 AS size FROM w UNION ALL
 SELECT x, p + size, CASE WHEN substr(x, p + size, 4) IN (FROM lex) AND p + size + 3 <= length(x) THEN 4 WHEN substr(x, p + size, 3) IN (FROM lex) AND p + size + 2 <= length(x) THEN 3
  WHEN substr(x, p + size, 2) IN (FROM lex) AND p + size + 1 <= length(x) THEN 2 ELSE 1 END FROM step WHERE p + size <= length(x)),
per AS (SELECT x, count(*) FILTER (size > 0) AS n, count(*) FILTER (size > 1) AS long, sum(CASE WHEN size > 0 THEN p * size ELSE 0 END) AS digest FROM step GROUP BY x)
SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens, coalesce(sum(long), 0)::BIGINT AS n_words, coalesce(sum(digest), 0)::BIGINT AS digest
FROM (SELECT doc_id, unnest(runs) AS x FROM {_RUNS}) JOIN per USING (x) GROUP BY doc_id"""


@query("pr_tokenize", _TOKENS)
def _tokenize(s, d):
    """All documents, their letters as Chinese characters, cut by a lexicon of all short words that come in them.

    The digest tells where tokens begin within their run of characters, and how long they are.
    """
    han = F.translate(F.lower(t.text_or_empty(F.col("text"))), _LETTERS, _HAN)
    docs = _docs(s, d).select("doc_id", han.alias("text"))
    runs = F.regexp_extract_all("text", F.lit("[\u4e00-\u4e19]+"), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(F.filter(runs, lambda w: F.length(w).between(2, 4)))).alias("word")).distinct()
    cut = x.token_lists(docs, "doc_id", "text", words).where(F.size("tokens") > 0)

    def step(a, token):
        # A run goes on where a token begins at the end of the one before.
        run = F.when(a["end"] == token["start"], a["run"]).otherwise(token["start"])
        digest = a["digest"] + (token["start"] - run + 1) * (token["end"] - token["start"])
        return F.struct(token["end"].alias("end"), run.alias("run"), digest.alias("digest"))

    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("digest"))
    long = F.size(F.filter("tokens", lambda token: token["end"] - token["start"] > 1))
    each = cut.select("doc_id", F.size("tokens").alias("n"), long.alias("long"), F.aggregate("tokens", zero, step, lambda a: a["digest"]).alias("digest"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("long").alias("n_words"), F.sum("digest").alias("digest"))


@query(
    "pr_auto_fix",
    "SELECT doc_id AS id, replace(text, 'ren', 'RE') AS text, (length(text) - length(replace(text, 'ren', 'RE')))::BIGINT AS n_fixed "
    "FROM documents WHERE text IS NOT NULL",
)
def _auto_fix(s, d):
    """An adopted fix is sure enough to be applied, another candidate is not."""
    texts = _docs(s, d).where("text is not null").select(F.col("doc_id").alias("id"), "text")
    spans = lambda w: texts.select("id", F.explode(rules.contains_ranges(F.col("text"), w)).alias("start"), F.lit(w).alias("wrong"))
    found = spans("ren").union(spans("ner")).withColumn("end", F.col("start") + 3)
    best = s.createDataFrame([("ren", "RE", 1.2, 1), ("ner", "N", 0.5, 1), ("ner", "M", 0.9, 2)], "wrong string, word string, score double, rank int")
    return x.auto_fixed(texts, found, best)
