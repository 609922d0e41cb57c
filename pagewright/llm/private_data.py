"""Personal data: fixed patterns, and contexts learned from what these find.

Only DataFrame functions are used. The base patterns give spans of kinds ``email``, ``ip``, ``card`` and ``phone``: the seed
entities. Everything that could be an identifier is a slot: strings with an at sign (also written ``[at]``), groups of
digits, and letter-digit strings, with ``DIGITS`` digits or more unless there is an at sign. A slot that a base span touches is
a seed mention, any other a candidate; mentions with the same letters, digits and signs are one instance.

The lexical patterns of a mention are the one and the two words before it and after it (letters only, small, at most 24
characters, at most 4 other characters of the same line apart). Patterns and instances are a bipartite graph, scored in
rounds in thousandths. A pattern's confidence is the sum of its mentions' instance scores over all places in all texts
where its words stand, whatever is beside them, plus 2; it is accepted from ``least`` on, if ``support`` different
instances of a score of ``sure`` or more hold it. Seeds score 1000; any other instance combines its best accepted pattern
before and its best after it as independent evidence. Instances that reach ``sure`` support patterns in the next round;
scores never fall, so rounds end when none has grown, or after ``rounds``. All mentions of the instances that reach ``sure`` are spans of kind
``pattern``, wherever they stand, unless a base span touches them.

Patterns that could be accepted at all have ``support`` different instances and enough mentions for ``least``; only these
take part in rounds. Up to ``most_listed`` of the words asked for are sent to the tasks that count them, beyond that counts
and words meet in a shuffled join; both give the same rows. What a graph holds is a row per pattern and instance, counted
before it is shuffled.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; texts of any length are read
whole, and the work along a text grows as its length; rows with null or repeated ids are documents like any other, and copies
add no instance; ties in start follow the order email, ip, card, phone, pattern; an empty table gives no rows; other columns
pass through, whatever their names, but ``private_spans`` takes the place of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import let, running
from pagewright.llm.common import discard, materialise, numbered, read_table
from pagewright.llm.secret_scan import _spans

KINDS = ("email", "ip", "card", "phone", "pattern")
# The base patterns, written so that each run of characters is tried from its start alone and as a whole.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

LETTER = "A-Za-z" + chr(0x80) + "-" + chr(0x10FFFF)
AT = r"(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)"
DOT = r"(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)"
SLOT = "|".join(
    [
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+",
        r"(?<![A-Za-z0-9])\+?[0-9]++(?:[\x20().-]{1,3}+[0-9]++){0,7}+(?![A-Za-z0-9_@])",
        r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]++(?:[_./:-][A-Za-z0-9]++)*+",
    ]
)
DIGITS = 5
#: Characters beside a mention in which its context lies: two words and two gaps.
REACH = 66
BEFORE = rf"[^{LETTER}](?:([{LETTER}]{{1,24}})[^{LETTER}\n]{{1,4}})?([{LETTER}]{{1,24}})[^{LETTER}\n]{{0,4}}\z"
AFTER = rf"\A[^{LETTER}\n]{{0,4}}([{LETTER}]{{1,24}})(?:[^{LETTER}\n]{{1,4}}([{LETTER}]{{1,24}}))?[^{LETTER}]"


def _luhn(digits: Column) -> Column:
    # A digit is its place in the list; the empty string after the last one counts as 0.
    digit = lambda c: F.instr(F.lit("0123456789"), c) - 1
    value = lambda c, i: let(digit(c), lambda d: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)"), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _base(text: Column) -> Column:
    """The base spans of a text, sorted structs of start, kind (number) and end."""
    digits = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    kept = {
        EMAIL: lambda s: F.lit(True),
        IP: lambda s: F.forall(F.split(s["match"], r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255")))),
        CARD: lambda s: let(digits(s), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)),
        PHONE: lambda s: F.length(digits(s)).between(9, 15),
    }
    kind = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    found = [F.transform(F.filter(_spans(text, p), ok), kind(k)) for k, (p, ok) in enumerate(kept.items())]
    return F.sort_array(F.concat(*found))


def _slots(text: Column) -> Column:
    """start, end, value (a hash) and patterns of each slot; a pattern is its side (0 before, 1 after) and the hash of its words."""
    kind = "array<struct<start:int,end:int,value:bigint,patterns:array<struct<side:int,gram:bigint>>>>"

    def step(last, x):
        begin = last["end"] + F.length(x["piece"])
        return F.struct(
            begin.alias("start"), (begin + F.length(x["match"])).alias("end"), x["match"].alias("match"),
            F.lower(F.right(F.concat(F.lit(" "), x["piece"]), F.lit(REACH))).alias("before"), F.lower(F.left(F.concat(x["next"], F.lit(" ")), F.lit(REACH))).alias("after"),
        )

    def patterns(x):
        w = F.struct(*[F.regexp_extract(x[side], p, k).alias(n) for n, side, p, k in (("l1", "before", BEFORE, 2), ("l2", "before", BEFORE, 1), ("r1", "after", AFTER, 1), ("r2", "after", AFTER, 2))])
        one = lambda side, *words: F.when(F.least(*[F.length(v) for v in words], F.lit(1)) > 0, F.struct(F.lit(side).alias("side"), F.xxhash64(*words).alias("gram")))
        return let(w, lambda c: F.array_compact(F.array(one(0, c["l1"]), one(0, c["l2"], c["l1"]), one(1, c["r1"]), one(1, c["r1"], c["r2"]))))

    def instance(x):
        return x["match"].rlike(AT) | (F.regexp_count(x["match"], F.lit("[0-9]")) >= DIGITS)

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), *[F.lit("").alias(n) for n in ("match", "before", "after")])
    parts = F.struct(F.regexp_extract_all(text, F.lit(SLOT), F.lit(0)).alias("found"), F.split(text, SLOT).alias("pieces"))
    rows = let(parts, lambda p: running(F.transform(p["found"], lambda m, i: F.struct(F.get(p["pieces"], i).alias("piece"), m.alias("match"), F.get(p["pieces"], i + 1).alias("next"))), zero, step))
    value = lambda x: F.xxhash64(F.lower(F.regexp_replace(x["match"], r"[\x20()-]", "")))
    done = F.transform(F.filter(rows, instance), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value"), patterns(x).alias("patterns")))
    return F.when(text.rlike(SLOT), done.cast(kind)).otherwise(F.array().cast(kind))


def _marked(slots: Column, base: Column) -> Column:
    """The slots, which are in order and apart, with ``seed``: whether a base span overlaps them.

    In order of starts, a base span that overlaps a slot is one before it that ends beyond its start, or the next one,
    which starts before its end.
    """
    mark = lambda s, of, value, patterns: F.struct(s["start"].alias("start"), F.lit(of).alias("of"), s["end"].alias("end"), value.alias("value"), patterns.alias("patterns"))
    nothing = F.lit(None).cast("array<struct<side:int,gram:bigint>>")
    both = F.array_sort(F.concat(F.transform(base, lambda b: mark(b, 0, F.lit(None).cast("bigint"), nothing)), F.transform(slots, lambda s: mark(s, 1, s["value"], s["patterns"]))))
    slot = lambda x, seed: F.struct(*[x[n].alias(n) for n in ("start", "end", "value", "patterns")], seed.alias("seed"))

    def flagged(all_):
        reach = running(all_, F.lit(0), lambda most, x: F.greatest(most, F.when(x["of"] == 0, x["end"]).otherwise(0)))
        after = F.transform(all_, lambda x, i: F.coalesce((F.get(all_, i + 1)["of"] == 0) & (F.get(all_, i + 1)["start"] < x["end"]), F.lit(False)))
        met = F.arrays_zip(all_.alias("x"), reach.alias("reach"), after.alias("after"))
        return F.transform(F.filter(met, lambda m: m["x"]["of"] == 1), lambda m: slot(m["x"], (m["reach"] > m["x"]["start"]) | m["after"]))

    plain = F.transform(slots, lambda s: slot(s, F.lit(False)))
    return F.when((F.size(base) == 0) | (F.size(slots) == 0), plain).otherwise(let(both, flagged))


def _grams(text: Column) -> Column:
    """Hashes of all words (letters only, small) of a text and of all pairs of words that follow each other."""
    words = F.array_remove(F.split(F.lower(text), f"[^{LETTER}]+"), "")
    return let(words, lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))))


def _scanned(df: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """The columns ``kept`` with a number of the row, base spans and slots, as a written table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(*kept, text.alias("__t"))
    rows = rows.select(*kept, _base(F.col("__t")).alias("__base"), _slots(F.col("__t")).alias("__slots"))
    # Generators keep the arrays from being worked out anew for each use of them.
    rows = rows.select(*kept, F.inline(F.array(F.struct("__base", "__slots"))))
    rows = rows.select(*kept, "__base", _marked(F.col("__slots"), F.col("__base")).alias("__slots"), F.monotonically_increasing_id().alias("__row"))
    return materialise(rows, "mentions")


def _graph(mentions: DataFrame, texts: DataFrame, text_col: str, support: int, least: int, most_listed: int) -> tuple[DataFrame, DataFrame]:
    """Instances with their scores, and a row for each pattern that could be accepted and each of its instances."""
    each = mentions.select(F.explode("__slots").alias("s")).select("s.value", "s.seed", F.explode_outer("s.patterns").alias("p"))
    pairs = each.groupBy("p.side", "p.gram", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    pairs = materialise(pairs, "pairs")
    open_ = pairs.where("side IS NOT NULL").groupBy("side", "gram").agg(F.count("*").alias("instances"), F.sum("n").alias("held")).where(F.col("instances") >= support)
    open_ = materialise(open_, "patterns")
    asked = open_.select("gram").distinct()
    # Enough for the cost of a broadcast to be that of a small table, whatever the corpus.
    small = open_.count() <= most_listed
    grams = texts.select(F.explode(_grams(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("gram"))
    if small:
        grams = grams.join(F.broadcast(asked), "gram", "left_semi")
    places = grams.groupBy("gram").agg(F.count("*").alias("places"))
    if not small:
        places = places.join(asked, "gram", "left_semi")
    strong = open_.join(places, "gram").where(F.col("held") * 1000 >= (F.col("places") + 2) * least)
    edges = materialise(pairs.select("side", "gram", "value", "n").join(strong.select("side", "gram", "places"), ["side", "gram"]), "edges")
    scores = materialise(pairs.groupBy("value").agg(F.max("seed").alias("seed")).where("seed").select("value", F.lit(1000).cast("long").alias("score")), "scores")
    discard(pairs, open_)
    return scores, edges


def _rounds(scores: DataFrame, edges: DataFrame, support: int, least: int, sure: int, rounds: int) -> DataFrame:
    """Scores of seeds and of all instances that accepted patterns hold, after the last round."""
    seeds, known = scores, -1
    if edges.isEmpty():
        return seeds
    for _ in range(rounds):
        held = edges.join(scores, "value", "left").withColumn("score", F.coalesce("score", F.lit(0)))
        judged = held.groupBy("side", "gram").agg(
            F.expr("sum(n * score) div (max(places) + 2)").alias("confidence"), F.count_if(F.col("score") >= sure).alias("sure")
        )
        accepted = judged.where((F.col("confidence") >= least) & (F.col("sure") >= support)).select("side", "gram", "confidence")
        best = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("confidence"))), F.lit(0))
        found = edges.join(accepted, ["side", "gram"]).groupBy("value").agg(best(0).alias("l"), best(1).alias("r"))
        found = found.select("value", F.expr("1000 - ((1000 - l) * (1000 - r)) div 1000").alias("score"))
        after = materialise(found.join(seeds, "value", "left_anti").unionByName(seeds), "scores")
        if scores is not seeds:
            discard(scores)
        scores = after
        now = scores.agg(F.sum("score")).first()[0]
        if now == known:
            break
        known = now
    discard(seeds)
    return scores


def extract(
    df: DataFrame, support: int = 3, least: int = 500, sure: int = 700, rounds: int = 8, most_listed: int = 500_000,
    text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all, if none are named) and ``private_spans``, sorted structs of start, kind (name) and end."""
    inner, names = numbered(df)
    kept = [names[c] for c in (df.columns if carry is None else carry) if c != "private_spans"]
    mentions = _scanned(inner, names[text_col], kept)
    scores, edges = _graph(mentions, inner, names[text_col], support, least, most_listed)
    scores = _rounds(scores, edges, support, least, sure, rounds)
    sure_ones = scores.where(F.col("score") >= sure).select("value")
    open_ = mentions.select("__row", F.explode("__slots").alias("s")).where("NOT s.seed").select("__row", "s.start", "s.end", "s.value")
    more = open_.join(sure_ones, "value").groupBy(F.col("__row").alias("__of")).agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("__more"))
    more = materialise(more, "found")
    discard(scores, edges)
    out = mentions.join(more, F.col("__row") == F.col("__of"), "left")
    all_ = F.sort_array(F.concat("__base", F.coalesce("__more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    named = F.transform(all_, lambda s: F.struct(s["start"].alias("start"), F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("kind"), s["end"].alias("end")))
    old = {v: k for k, v in names.items()}
    return out.select(*[F.col(c).alias(old[c]) for c in kept], F.inline(F.array(F.struct(named.alias("private_spans")))))


def listing(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"] != "pattern") if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = extract(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    s = F.col("private_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listing(s, True), 256).alias("base_sha256"), listing(s).alias("spans"))
