"""Word lists, greedy tokens, ranked corrections and text differences."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagewright.functions.text import HAN, frequency_boost, let, running, similarity, u_trim


def words_from_lines(lines: DataFrame, value: str = "value", order: str = "n") -> DataFrame:
    """word and freq of ``word freq [tag]`` lines; a bad count is 1, the last of a word's lines counts."""
    parts = F.split(u_trim(F.col(value)), r"\s+")
    rows = lines.where(u_trim(F.col(value)) != "").select(F.get(parts, F.lit(0)).alias("word"), F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), F.lit(1)).alias("freq"), order)
    return rows.groupBy("word").agg(F.max_by("freq", order).alias("freq"))


def pairs_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """ch and alt: all pairs of different characters that share a line; lines that begin with # are comments."""
    group = F.array_distinct(F.filter(F.split(u_trim(F.col(value)), r"\s+"), lambda x: x != ""))
    rows = lines.where(~F.startswith(u_trim(F.col(value)), F.lit("#"))).select(group.alias("g")).where(F.size("g") >= 2)
    return rows.select(F.explode("g").alias("ch"), "g").select("ch", F.explode("g").alias("alt")).where("ch <> alt").distinct()


def known_words(tokens: DataFrame, words: DataFrame, fixes: DataFrame, ignored: DataFrame) -> DataFrame:
    """Tokens in the lexicon or adopted as fixes, but for those to ignore."""
    lexicon = words.select("word").union(fixes.select(F.col("fixed").alias("word"))).distinct()
    return tokens.join(lexicon, "word", "left_semi").join(ignored, "word", "left_anti")


#: Characters of a piece of a text.
PIECE = 64


def _listed(entries: DataFrame, most: int):
    """A table of up to ``most`` rows as a small one on the driver, None if it has more."""
    held = entries.limit(most + 1).toArrow()
    return held if held.num_rows <= most else None


def _chosen(texts: DataFrame, key: str, text: str, entries: DataFrame, first: str, most: int, singles: bool, most_listed: int) -> DataFrame:
    """key, text and found: for each text the entries (word, to) chosen from the left, the longest at each place.

    A place is a character of the class ``first``; what was chosen covers the places inside it. Up to ``most_listed``
    entries are sent to the tasks, which read each text once and shuffle nothing; of more see ``_met``.
    """
    listed = entries.select(F.col("word").alias("entry"), "to").where(F.col("entry").isNotNull()).dropDuplicates(["entry"])
    given = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = _listed(listed, most_listed)
    return _met(given, listed, first, most, singles) if held is None else _read(given, held, first, most, singles)


#: What is chosen in a text.
FOUND = ArrayType(StructType([StructField("at", IntegerType()), StructField("less", IntegerType()), StructField("word", StringType()), StructField("to", StringType())]))
#: Characters of the texts that one batch of what is chosen is of.
BATCH_CHARS = 1 << 20


def _read(given: DataFrame, held, first: str, most: int, singles: bool) -> DataFrame:
    """What is chosen, by entries that every task has."""
    entries = given.sparkSession.sparkContext.broadcast({w: to for w, to in zip(held["entry"].to_pylist(), held["to"].to_pylist()) if len(w) <= most})
    start = "[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), first) + "]"

    def read(batches):
        import pyarrow as pa

        known, place = entries.value, re.compile(start)
        kind = pa.struct([("at", pa.int32()), ("less", pa.int32()), ("word", pa.string()), ("to", pa.string())])

        def chosen(text, out):
            at = 0
            while m := place.search(text, at):
                at = m.start()
                for size in range(min(most, len(text) - at), 0, -1):
                    word = text[at : at + size]
                    if word in known:
                        break
                else:
                    if not singles:
                        at += 1
                        continue
                for c, x in zip(out, (at, -size, word, known.get(word))):
                    c.append(x)
                at += size

        def table(some, ends, out):
            found = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(out, kind)], fields=list(kind))
            return pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["key", "text", "found"])

        for batch in batches:
            begin, ends, out, chars = 0, [0], ([], [], [], []), 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                chosen(text, out)
                ends.append(len(out[0]))
                chars += len(text)
                if chars > BATCH_CHARS or i + 1 == batch.num_rows:
                    yield table(batch.slice(begin, i + 1 - begin), ends, out)
                    begin, ends, out, chars = i + 1, [0], ([], [], [], []), 0

    return given.mapInArrow(read, StructType([*given.schema.fields, StructField("found", FOUND)]))


def _met(given: DataFrame, listed: DataFrame, first: str, most: int, singles: bool) -> DataFrame:
    """What is chosen, by any number of entries: all strings of up to ``most`` characters that begin at a place meet them
    in one join, and what fits is gathered per text, sorted by place and length, and read once."""
    listed = listed.select("entry", F.struct(F.col("to")).alias("held"))
    # Rows alike in key and text give the same, so two hashes of both name a row.
    row = F.struct(F.xxhash64(F.col("key").isNull(), "key", "text").alias("a"), F.xxhash64("text", "key", F.lit(1)).alias("b"))
    given = given.withColumn("row", row)

    # Texts are cut into pieces, each with the characters after it that a string may reach into, so that what follows is
    # code for single rows and no place is looked for from the start of a long text.
    piece = max(PIECE, most)
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{piece}}}"), F.lit(0))
    whole = lambda c: F.transform(c, lambda x, i: F.concat(x, F.left(F.coalesce(F.get(c, i + 1), F.lit("")), F.lit(most - 1))))
    rows = given.select("row", F.posexplode(let(cut, whole)).alias("i", "piece"))
    rows = rows.select("row", "i", "piece", F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(piece)))).alias("p"))
    rows = rows.where(F.substring("piece", F.col("p"), F.lit(1)).rlike(f"[{first}]"))
    fits = F.sequence(F.lit(1), F.least(F.lit(most), F.length("piece") - F.col("p") + 1))
    rows = rows.select("row", "i", "piece", "p", F.explode(fits).alias("size"))
    pieces = rows.select("row", (F.col("i") * piece + F.col("p") - 1).alias("at"), "size", F.substring("piece", F.col("p"), F.col("size")).alias("word"))
    met = pieces.join(listed, F.col("word") == F.col("entry"), "left")
    kept = met.where(F.col("held").isNotNull() | ((F.col("size") == 1) & F.lit(singles)))
    gathered = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "word", F.col("held.to").alias("to")))).alias("fits"))
    taken = running(F.col("fits"), F.lit(0), lambda end, x: F.when(x["at"] >= end, x["at"] - x["less"]).otherwise(end))
    # An entry is chosen where it is the one that moved the end on.
    ends = gathered.select(F.col("row").alias("of"), "fits", taken.alias("ends"))
    moved = lambda fits, ends: F.filter(F.transform(fits, lambda x, i: F.when(x["at"] >= F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)), x)), lambda x: x.isNotNull())
    chosen = let(F.struct("fits", "ends"), lambda v: moved(v["fits"], v["ends"]))
    return given.join(ends.select("of", chosen.alias("found")), F.col("row") == F.col("of"), "left").drop("of")


def token_lists(texts: DataFrame, key: str, text: str, words: DataFrame, most: int = 4, first: str = HAN, most_listed: int = 1_000_000) -> DataFrame:
    """key and tokens (word, start, end) of every row: longest words of a lexicon from the left over Chinese characters, others one by one.

    ``words`` has a column word; of words longer than ``most`` characters none is found. Every row is a text of its own.
    """
    lexicon = words.select("word", F.lit(None).cast("string").alias("to")).where(F.col("word") != "")
    found = _chosen(texts, key, text, lexicon, first, most, True, most_listed)
    token = lambda t: F.struct(t["word"].alias("word"), t["at"].alias("start"), (t["at"] - t["less"]).alias("end"))
    return found.select(F.col("key").alias(key), F.transform("found", token).alias("tokens"))


def tokens(texts: DataFrame, key: str, text: str, words: DataFrame, most: int = 4, first: str = HAN, most_listed: int = 1_000_000) -> DataFrame:
    """The tokens of ``token_lists`` as rows: key, word, start and end."""
    return token_lists(texts, key, text, words, most, first, most_listed).select(key, F.inline("tokens"))


def converted(texts: DataFrame, key: str, text: str, table: DataFrame, most: int = 8, first: str = HAN, most_listed: int = 1_000_000) -> DataFrame:
    """key and text: phrases and characters of a table (word, to) replaced, the longest at each place, from the left."""
    found = _chosen(texts, key, text, table, first, most, False, most_listed)

    def step(a, x):
        return F.struct((x["at"] - x["less"]).alias("at"), F.struct(a["at"].alias("begin"), x["at"].alias("end"), x["to"].alias("to")).alias("piece"))

    start = F.struct(F.lit(0).alias("at"), F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit("").alias("to")).alias("piece"))
    pieces = running(F.col("found"), start, step)

    def joined(v):
        gap = lambda p: F.array_join(F.slice(v["chars"], p["begin"] + 1, p["end"] - p["begin"]), "")
        tail = F.array_join(F.slice(v["chars"], F.element_at(v["pieces"], -1)["at"] + 1, F.size(v["chars"])), "")
        return F.concat(F.array_join(F.transform(v["pieces"], lambda s: F.concat(gap(s["piece"]), s["piece"]["to"])), ""), tail)

    chars = F.filter(F.split("text", "(?s)(?<=.)(?=.)"), lambda c: c != "")
    out = F.when(F.size("found") > 0, let(F.struct(chars.alias("chars"), pieces.alias("pieces")), joined)).otherwise(F.col("text"))
    return found.select(F.col("key").alias(key), out.alias(text))


def candidates(wrong: DataFrame, words: DataFrame, homophones: DataFrame, fixes: DataFrame, least: float = 0.4, near: float = 0.3, top: int = 5, singles: int = 200) -> DataFrame:
    """word, score and rank of the best corrections of each distinct ``wrong``; ties go by frequency, then word.

    Scores have six decimals, and those alike in these are ties.
    Words of several characters meet those that begin alike or with a homophone; single characters meet their
    homophones and the most frequent ones. A fix that was adopted is the only candidate.
    """
    asked = wrong.select("wrong").distinct()
    fixed = asked.join(fixes, "wrong").where("fixed <> wrong").join(words.select(F.col("word").alias("fixed")), "fixed", "left_semi").select("wrong", F.col("fixed").alias("word"), F.lit(1.2).alias("score"), F.lit(1).alias("rank"))
    open_ = asked.join(fixed, "wrong", "left_anti")
    long = open_.where(F.length("wrong") > 1).withColumn("first", F.left("wrong", F.lit(1)))
    alike = long.select("wrong", "first").union(long.join(homophones, F.col("first") == F.col("ch")).select("wrong", F.col("alt").alias("first")))
    # Blocks of one first character and one length; the distance is not worked out beyond what is near enough.
    sized = alike.withColumn("size", F.explode(F.sequence(F.length("wrong") - 1, F.length("wrong") + 1)))
    blocks = words.select("word", "freq", F.left("word", F.lit(1)).alias("first"), F.length("word").alias("size"))
    most = F.greatest(F.length("wrong"), F.length("word"))
    apart = F.call_function("levenshtein", F.col("wrong"), F.col("word"), F.floor((1 - near) * most + 1e-9).cast("int"))
    close = sized.join(blocks, ["first", "size"]).where(F.col("word") != F.col("wrong")).withColumn("apart", apart).where("apart >= 0")
    close = close.withColumn("sim", 1 - F.col("apart") / most).where(F.col("sim") >= near)
    close = close.select("wrong", "word", (0.2 * F.col("sim") + frequency_boost(F.col("freq"))).alias("score"), "freq")
    one = open_.where(F.length("wrong") == 1)
    same = homophones_of(one, homophones, "wrong").join(words, F.col("alt") == F.col("word")).select("wrong", "word", F.lit(0.3).alias("score"), "freq")
    frequent = frequent_characters(words, singles)
    often = one.crossJoin(F.broadcast(frequent)).where("wrong <> word").select("wrong", "word", (0.2 + frequency_boost(F.col("freq"))).alias("score"), "freq")
    best = close.union(same).union(often).groupBy("wrong", "word").agg(F.least(F.lit(1.2), F.max("score")).alias("score"), F.max("freq").alias("freq"))
    best = best.where(F.round("score", 9) >= least).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("wrong").orderBy(F.desc("score"), F.desc("freq"), "word")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("wrong", "word", "score", "rank").union(fixed)


def context_boost(rows: DataFrame, words: DataFrame, candidate: str = "candidate", before: str = "before", after: str = "after", most_listed: int = 1_000_000) -> DataFrame:
    """Adds boost: 0.15 where the candidate makes a word of the lexicon with the character before it or after it.

    A lexicon of up to ``most_listed`` words is sent to the tasks and no row is shuffled; to a larger one rows are dealt.
    """
    lexicon = words.select("word").distinct()
    held = _listed(lexicon, most_listed)
    if held is not None:
        lexicon = F.broadcast(rows.sparkSession.createDataFrame(held, "word string"))
    ahead = lexicon.select(F.col("word").alias("ahead"), F.lit(True).alias("is_ahead"))
    behind = lexicon.select(F.col("word").alias("behind"), F.lit(True).alias("is_behind"))
    joined = rows.withColumns(
        {
            "with_before": F.when(F.col(before) != "", F.concat(F.right(before, F.lit(1)), F.col(candidate))),
            "with_after": F.when(F.col(after) != "", F.concat(F.col(candidate), F.left(after, F.lit(1)))),
        }
    )
    joined = joined.join(ahead, F.col("with_before") == F.col("ahead"), "left").join(behind, F.col("with_after") == F.col("behind"), "left")
    boost = F.when(F.col("is_ahead") | F.col("is_behind"), 0.15).otherwise(0.0)
    return joined.select(*[rows[c] for c in rows.columns], boost.alias("boost"))


def homophones_of(rows: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Rows with each character that sounds like the one in ``column`` (alt), by a join with the pairs ch and alt."""
    sounds = pairs.select(F.col("ch").alias("sound"), "alt").distinct()
    return rows.join(sounds, F.col(column) == F.col("sound")).drop("sound")


def marked_ignored(rows: DataFrame, ignored: DataFrame, column: str) -> DataFrame:
    """Adds ignored: whether a row's word is in the list of words to ignore."""
    listed = ignored.select(F.col("word").alias("listed")).distinct()
    return rows.join(listed, F.col(column) == F.col("listed"), "left").withColumn("ignored", F.col("listed").isNotNull()).drop("listed")


def frequent_characters(words: DataFrame, top: int = 200) -> DataFrame:
    """The most frequent words of one character."""
    return words.where(F.length("word") == 1).orderBy(F.desc("freq"), "word").limit(top).select("word", "freq")


def auto_fixed(texts: DataFrame, spans: DataFrame, best: DataFrame, least: float = 0.85) -> DataFrame:
    """id, text, n_fixed: texts with the spans replaced whose best candidate reaches ``least``.

    ``texts``: id and text. ``spans``: id, start, end (code points) and wrong. ``best``: wrong, word, score and rank. A
    span that overlaps one that starts before it stays.
    """
    sure = best.where((F.col("rank") == 1) & (F.col("score") >= least)).select("wrong", F.col("word").alias("fixed"))
    edits = spans.join(sure, "wrong").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "fixed"))).alias("edits"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a, e):
        gap = F.substring(F.col("text"), a["at"] + 1, e["start"] - a["at"])
        done = F.struct(e["end"].cast("int").alias("at"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(gap, e["fixed"])).alias("out"))
        return F.when(e["start"] >= a["at"], done).otherwise(a)

    end = lambda a: F.struct(F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))).alias("text"), a["n"].alias("n"))
    rows = texts.join(edits, "id", "left").withColumn("r", F.when(F.col("edits").isNotNull(), F.aggregate("edits", zero, step, end)))
    return rows.select("id", F.coalesce("r.text", "text").alias("text"), F.coalesce("r.n", F.lit(0)).cast("long").alias("n_fixed"))


def differences(original: str, corrected: str) -> list[dict]:
    """Replaced and deleted spans of the original, with what replaces them."""
    ops = difflib.SequenceMatcher(None, original, corrected).get_opcodes()
    return [{"start": a, "end": b, "wrong": original[a:b], "candidates": [corrected[c:d]] if tag == "replace" else []} for tag, a, b, c, d in ops if tag in ("replace", "delete")]
