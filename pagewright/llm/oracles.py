"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

_WORD = r"[\x20\x09-\x0D]+"


def _words(x: str) -> str:
    return f"[y for y in regexp_split_to_array({x}, '{_WORD}') if y <> '']"


LINE_FREQUENCY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS host FROM documents),
w AS (SELECT doc_id, {_words('t')} AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM d),
norm AS (SELECT *, CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN translate(lower(trim(regexp_replace(x, '{_WORD}', ' ', 'g'))), '123456789', '000000000') END AS k FROM lines),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
freq AS (SELECT a.host, a.k, min(a.doc_id) AS first FROM norm a JOIN hosts h ON a.host IS NOT DISTINCT FROM h.host WHERE a.k IS NOT NULL GROUP BY a.host, a.k, h.n HAVING count(DISTINCT a.t) > least(greatest(0.01 * h.n, 5), 100)),
cut AS (SELECT a.doc_id, count(*) FILTER (f.k IS NOT NULL AND a.doc_id IS DISTINCT FROM f.first) AS removed, sum(CASE WHEN f.k IS NOT NULL AND a.doc_id IS DISTINCT FROM f.first THEN 0 ELSE len({_words('a.x')}) END)::BIGINT AS left_words FROM norm a LEFT JOIN freq f ON a.k = f.k AND a.host IS NOT DISTINCT FROM f.host GROUP BY a.doc_id),
b AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '{_WORD}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 (SELECT len(l) - len(list_distinct(l)) FROM (SELECT [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, cut.removed, cut.left_words
 FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed > 0 AND (left_words < 20 OR left_words < n_words * 0.3)) AS kept, removed AS n_removed_lines, left_words
FROM b
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for a, b in (("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("|>", "|\\>")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


REPLY_TREES = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_escaped('role')}) + length(role) - length(replace(role, chr(10), '')) + length({_escaped('text')}) + 24 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, {_words('t')} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS bit,
 list_sum([1 << (ascii(f) - 65) for f in string_split(filter_order[:step - 1], '') if f <> ''])::BIGINT AS b FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(b, 0) | bit) = 0), 0)::BIGINT AS kept,
 coalesce(sum(n) FILTER (mask & coalesce(b, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (mask & coalesce(b, 0) <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (mask & coalesce(b, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
 coalesce(sum(toxic) FILTER (mask & coalesce(b, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

WAND_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item_id, text, t, count(*) AS qtf FROM (SELECT item_id, text, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, t),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
i AS (SELECT p.r, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // words))) AS impact FROM p JOIN f USING (t) JOIN d USING (r), s),
x AS (SELECT item_id, text, r, sum(qtf * impact)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY item_id, text, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM x JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
