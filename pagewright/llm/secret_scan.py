"""Secret scans: fixed patterns, and a battery of randomness tests on token-like strings.

Only DataFrame functions are used. The base patterns give spans of kinds ``assign``, ``access`` and ``hex``. The
battery looks at every maximal run of 20 or more characters ``A-Za-z0-9+/_=-`` that no base span touches, infers its
encoding from the characters it has (decimal, hexadecimal, base 32, base 36 in lower or upper case, else base 64) and asks:

* is the alphabet used evenly (chi-squared, Wilson-Hilferty normal form),
* do high and low symbols alternate as by chance (runs test about the middle of the alphabet),
* are neighbours uncorrelated (lag-1 serial correlation).

A string stays a candidate while none of the three rejects chance at ``|z| <= 3.3``. Whether it is a secret is then
decided against text: the likelihood of evenly drawn symbols over that of ordinary tokens, which rarely change
between lower case, upper case, digits and signs. This ratio is an e-value, so it grows with length, and the e-value
form of the Benjamini-Hochberg rule over a text's candidates bounds the share of false finds by ``alpha``: short
strings and texts full of candidates need more evidence. Accepted runs are spans of kind ``random``.

What runs along a text's spans is a running aggregate built in blocks (``running``), so the work grows as the text and
the number of its spans.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; texts of any length are
scanned whole; rows with null or repeated ids are scanned like any other; ties in start follow the order assign, access,
hex, random; an empty table gives no rows; other columns pass through, whatever their names, but ``secret_spans`` takes
the place of a column of that name. The stage keeps such a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import blocks, let, running
from pagewright.llm.common import numbered, read_table, restored

# The base patterns.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABETS = {
    "decimal": ("[0-9]+", "0123456789"),
    "hex": ("[0-9a-fA-F]+", "0123456789abcdef"),
    "base32": ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36lower": ("[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "base36upper": ("[A-Z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "base64": (".+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Highest |z| at which a test does not reject chance.
MOST_Z = 3.3
#: Chance that an ordinary token goes on in the same class of characters, and the sizes of the classes.
STAY = 0.85
CLASS_SIZES = {"l": 26, "u": 26, "d": 10, "s": 4}


def _spans(text: Column, pattern: str) -> Column:
    """start, end and match of each leftmost non-overlapping match, from the pieces between the matches."""

    def step(last, x):
        begin = last["end"] + F.length(x["piece"])
        return F.struct(begin.alias("start"), (begin + F.length(x["match"])).alias("end"), x["match"].alias("match"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), let(pairs, lambda p: running(p, zero, step))).otherwise(none)


def _untouched(candidates: Column, base: Column) -> Column:
    """The candidates, which are in order and apart, that no base span overlaps.

    In order of their starts, a base span that overlaps a candidate is one before it that ends beyond its start, or the
    next one, which starts before its end.
    """
    mark = lambda s, kind, match: F.struct(s["start"].alias("start"), kind.alias("of"), s["end"].alias("end"), match.alias("match"))
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda b: mark(b, F.lit(0), F.lit(None).cast("string"))),
            F.transform(candidates, lambda c: mark(c, F.lit(1), c["match"])),
        )
    )

    def chosen(all_):
        reach = running(all_, F.lit(0), lambda most, x: F.greatest(most, F.when(x["of"] == 0, x["end"]).otherwise(F.lit(0))))
        met = F.zip_with(all_, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach")))

        def free(m):
            return F.filter(
                m,
                lambda y, i: (y["x"]["of"] == 1) & (y["reach"] <= y["x"]["start"])
                & ~F.coalesce((F.get(m, i + 1)["x"]["of"] == 0) & (F.get(m, i + 1)["x"]["start"] < y["x"]["end"]), F.lit(False)),
            )

        return F.transform(let(met, free), lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["match"].alias("match")))

    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(let(both, chosen))


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")))


def _statistics(token: Column) -> Column:
    """encoding, n, the three z and the log e-value of a token (a struct)."""
    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    which = F.lit("base64")
    for name in ("base36lower", "base36upper", "base32", "hex", "decimal"):
        which = F.when(body.rlike(f"^{ALPHABETS[name][0]}$"), F.lit(name)).otherwise(which)
    return F.struct(which.alias("enc"), body.alias("body"))


def _codes(enc: Column, body: Column) -> Column:
    alphabet = F.element_at(F.create_map(*[F.lit(x) for n, (_, a) in ALPHABETS.items() for x in (n, a)]), enc)
    return F.transform(F.split(F.when(enc == "hex", F.lower(body)).otherwise(body), ""), lambda c: F.instr(alphabet, c) - 1)


def _battery(x: Column) -> Column:
    """Adds the test results to a struct of start, end, enc, body and codes."""
    n = F.size(x["codes"]).cast("double")
    k = F.element_at(F.create_map(*[F.lit(v) for name, (_, a) in ALPHABETS.items() for v in (name, float(len(a)))]), x["enc"])
    expected = n / k
    counts = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda v: F.size(F.filter(x["codes"], lambda c: c == v)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c - expected) * (c - expected) / expected)
    df = k - 1
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform(x["codes"], lambda c: (c >= k / 2).cast("int"))
    pairs = F.zip_with(F.slice(x["codes"], F.lit(1), F.size(x["codes"]) - 1), F.slice(x["codes"], F.lit(2), F.size(x["codes"]) - 1), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    ones = F.aggregate(high, F.lit(0), lambda a, c: a + c).cast("double")
    zeros = n - ones
    runs = F.aggregate(pairs, F.lit(1), lambda a, p: a + ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("int")).cast("double")
    mean = 1 + 2 * ones * zeros / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(99.0))
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    z_serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle)) / spread / F.sqrt(n - 1)
    classes = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["body"], "[+/]", "\u0001"), "[0-9]", "\u0002"), "[A-Z]", "\u0003"), "[a-z]", "\u0004"), "")
    sizes = F.create_map(*[F.lit(v) for c, s in zip("\x04\x03\x02\x01", CLASS_SIZES.values()) for v in (c, math.log(s))])
    moves = F.zip_with(F.slice(classes, F.lit(1), F.size(classes) - 1), F.slice(classes, F.lit(2), F.size(classes) - 1), lambda a, b: F.when(a == b, F.lit(math.log(STAY))).otherwise(F.lit(math.log((1 - STAY) / 3))))
    text = F.aggregate(moves, F.lit(math.log(0.25)), lambda a, m: a + m) - F.aggregate(classes, F.lit(0.0), lambda a, c: a + F.element_at(sizes, c))
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"),
        (F.greatest(z_chi, F.abs(z_runs), F.abs(z_serial)) <= MOST_Z).alias("chance"), (-n * F.log(k) - text).alias("log_e"),
    )


def scan(df: DataFrame, alpha: float = 1e-3, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``secret_spans``, an array of structs start, kind (name) and end, sorted."""
    inner, names = numbered(df)
    out = _scanned_rows(inner, names[text_col], alpha)
    return out.select(*[F.col(new).alias(old) for old, new in names.items() if old != "secret_spans"], "secret_spans")


def _scanned_rows(df: DataFrame, text_col: str, alpha: float = 1e-3) -> DataFrame:
    """The columns of ``df``, whose names must not be used here, with ``secret_spans``."""
    out = df.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns(
        {
            "__a": F.filter(_spans(F.col("__t"), ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6),
            "__k": _spans(F.col("__t"), ACCESS),
            "__h": _spans(F.col("__t"), HEX),
            "__c": _spans(F.col("__t"), TOKEN),
        }
    )
    out = out.withColumn("__b", F.concat(_kind(F.col("__a"), 0), _kind(F.col("__k"), 1), _kind(F.col("__h"), 2)))
    out = out.withColumn("__u", _untouched(F.col("__c"), F.col("__b")))
    out = out.withColumn("__f", F.transform("__u", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _statistics(c["match"]).alias("x"))))
    out = out.withColumn("__g", F.transform("__f", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["x"]["enc"].alias("enc"), c["x"]["body"].alias("body"), _codes(c["x"]["enc"], c["x"]["body"]).alias("codes"))))
    tested = F.when(F.size("__g") > 0, F.transform(F.filter("__g", lambda c: F.size(c["codes"]) > 2), _battery))
    out = out.withColumn("__r", tested)
    # e-BH over all candidates of the text, those that a test has rejected with an e-value of nothing.
    m = F.size("__r").cast("double")
    ranked = F.sort_array(F.transform(F.filter("__r", lambda c: c["chance"]), lambda c: c["log_e"]), False)
    out = out.withColumn("__e", F.when(F.size("__r") > 0, ranked))
    passed = F.filter("__e", lambda e, i: e + F.log(i + 1.0) - F.log(m) >= -math.log(alpha))
    least = F.array_min(passed)
    out = out.withColumn("__m", least)
    random = F.coalesce(F.filter("__r", lambda c: c["chance"] & (c["log_e"] >= F.col("__m"))), F.array().cast("array<struct<start:int,end:int,chance:boolean,log_e:double>>"))
    both = F.sort_array(F.concat(F.col("__b"), _kind(random, 3)))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    # A generator keeps later filters from being moved below the arrays.
    return out.select(*df.columns, F.inline(F.array(F.struct(spans.alias("secret_spans")))))


def listing(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"] != "random") if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mask.

    A stretch of the text is cut out for each block of spans, and pieces out of that, so that no piece is looked for
    from the start of a long text.
    """
    t = F.coalesce(text, F.lit(""))

    def pieces(placed):
        return F.transform(blocks(placed), lambda some: let(_stretch(some), lambda s: F.array_join(F.transform(some, lambda x: piece(s, x)), "")))

    def _stretch(some):
        begin, end = F.element_at(some, 1)["at"], F.element_at(some, -1)["to"]
        return F.struct(begin.alias("begin"), F.substring(t, begin + 1, end - begin).alias("text"))

    def piece(s, x):
        gap = F.substring(s["text"], x["at"] - s["begin"] + 1, x["start"] - x["at"])
        return F.when(x["start"] >= x["at"], F.concat(gap, F.lit(mask))).otherwise(F.lit(""))

    # Up to where spans have reached before (at) and with each span (to); one that starts before that adds no mask.
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct(a["to"].alias("at"), s["start"].alias("start"), F.greatest(a["to"], s["end"]).alias("to"))
    done = let(running(spans, zero, step), lambda p: F.concat(F.array_join(pieces(p), ""), F.substring(t, F.element_at(p, -1)["to"] + 1, F.length(t))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listing(s, True), 256).alias("base_sha256"), listing(s).alias("spans"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    inner, names = numbered(docs)
    out = _scanned_rows(inner, names["text"]).withColumn("masked", redact(F.col(names["text"]).cast("string"), F.col("secret_spans")))
    instead = {"text": F.col("masked")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        instead["n_chars"] = F.when(F.size("secret_spans") > 0, F.length("masked").cast(kind)).otherwise(F.col(names["n_chars"]))
    return restored(out, names, **instead)
