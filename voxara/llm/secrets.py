"""Secret scan with a randomness test battery (operator 3), in DataFrame functions only.

Three fixed kinds of spans are found by pattern. Besides, every long run of
token characters is a candidate. Its encoding is inferred from the characters
it holds (hex, base32, base64), and four tests ask whether it looks drawn at
random from that alphabet: chi-squared over the alphabet's symbols and over
four parts of it, a runs test over these parts, and the serial correlation of
neighbouring characters. Fisher's rule combines them into one p-value.

False discoveries are tokens that aren't random and are kept. How often the
battery lets such a token pass is measured, for each class of length, on a
fixed set of tokens made by rule: syllables, names with numbers, repeated
motifs, few symbols. A class keeps the candidates above the lowest cut of p at
which the false ones so expected are no more than ``fdr`` of what is kept; a
candidate that the battery rejects outright is never kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import stored, texts

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: A candidate run of the method.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Classes of length for each doubling of the length, and bins of p.
CLASSES, BINS = 4, 50
#: Tokens of each class that are known not to be random, and their greatest length: longer ones pass less often still.
NULL_ROWS, NULL_LENGTH = 600, 2048


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: Matches of a run.
_RUN = 64


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value): leftmost non-overlapping matches, in code points, end exclusive."""
    kind = "array<struct<start:int,end:int,value:string>>"
    # Spans within a run of matches are counted from its start; arrays that grow are as short as a run, or have a number a run.
    within = lambda run: F.aggregate(
        run,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["value"].alias("value")))).alias("spans"),
        ),
    )
    starts = lambda runs: F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
    placed = lambda runs: _let(starts(runs), lambda at: F.flatten(F.transform(runs, lambda r, n: F.transform(r["spans"], lambda x: F.struct((x["start"] + F.get(at, n)).alias("start"), (x["end"] + F.get(at, n)).alias("end"), x["value"].alias("value"))))))
    zipped = lambda parts, found, values: F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _RUN).cast("int")), lambda n: within(F.slice(all_, n * _RUN + 1, F.lit(_RUN))))
    places = lambda parts, found, values: _let(zipped(parts, found, values), lambda all_: _let(cut(all_), placed))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = places(F.split(text, pattern, -1), whole, value)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _labelled(spans: Column, kind: str, order: int, least: int) -> Column:
    held = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal, by the logistic approximation."""
    return _let(F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0)), lambda z: 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z)))


def _chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of a chi-squared value, by Wilson and Hilferty."""
    return _upper_tail((F.cbrt(F.greatest(x, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def _equals(value: int):
    return lambda x: F.when(x == value, 1).otherwise(0)


def randomness_p(token: Column) -> Column:
    """Combined p-value of the battery: near 0 where the token isn't random over its inferred alphabet."""
    stripped = F.rtrim(F.regexp_replace(token, "=+$", ""))
    # Parts of each alphabet and their shares; the encoding is the smallest alphabet that holds the token.
    encoding = lambda t: F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(0)).when(t.rlike("^[A-Z2-7]+$"), F.lit(1)).otherwise(F.lit(2))
    code = lambda c: F.ascii(c)
    symbols = F.array(F.lit(16.0), F.lit(32.0), F.lit(64.0))
    part = lambda c, e: (
        F.when(e == 0, F.when(code(c) < 53, 0).when(code(c) < 58, 1).when(F.lower(c) < "d", 2).otherwise(3))
        .when(e == 1, F.when(code(c) < 65, 0).when(code(c) < 74, 1).when(code(c) < 83, 2).otherwise(3))
        .otherwise(F.when((code(c) >= 97) & (code(c) < 110), 0).when(code(c) >= 110, 1).when((code(c) >= 65) & (code(c) < 91), 2).otherwise(3))
    )
    # Sizes of the parts: hex digits 0-4, 5-9, a-c, d-f; base32 2-7, A-I, J-R, S-Z; base64 a-m, n-z, A-Z, the rest.
    share = F.array(F.array(*[F.lit(x / 16) for x in (5, 5, 3, 3)]), F.array(*[F.lit(x / 32) for x in (6, 9, 9, 8)]), F.array(*[F.lit(x / 64) for x in (13, 13, 26, 12)]))

    def battery(bound: Column) -> Column:
        parts, codes, n = bound["parts"], bound["codes"], F.size(bound["parts"]).cast("double")
        count = [F.size(F.array_remove(F.transform(parts, _equals(i)), 0)).cast("double") for i in range(4)]
        chi = reduce(lambda a, b: a + b, [(count[i] - n * F.get(bound["share"], F.lit(i))) ** 2 / (n * F.get(bound["share"], F.lit(i))) for i in range(4)])
        p_parts = _chi_tail(chi, F.lit(3.0))
        # Chi-squared over the symbols, scaled to the variance it has where symbols are rarer than tests of it assume.
        token, k = bound["token"], bound["symbols"]
        squares = F.aggregate(F.array_distinct(bound["chars"]), F.lit(0.0), lambda a, c: a + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), 2))
        x = (k - 1) + (k / n * squares - n - (k - 1)) / F.sqrt(F.greatest(1 - 1 / n, F.lit(0.1)))
        p_chi = _let(_chi_tail(x, k - 1), lambda p: 2 * F.least(p, 1 - p))
        # Runs of equal parts: changes between neighbours against their expectation under the shares.
        change = F.aggregate(F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        differ = 1 - reduce(lambda a, b: a + b, [F.get(bound["share"], F.lit(i)) ** 2 for i in range(4)])
        p_runs = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(change - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1 - differ))))
        # From plain sums, as a lambda would work out the mean anew for every character.
        whole = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
        pairs = F.greatest(F.size(codes) - 1, F.lit(1))
        ends = F.get(codes, F.lit(0)) + F.get(codes, F.size(codes) - 1)
        sums = F.struct(whole(codes).alias("one"), F.aggregate(codes, F.lit(0.0), lambda a, y: a + y * y).alias("two"), whole(F.zip_with(F.slice(codes, 2, pairs), F.slice(codes, 1, pairs), lambda a, b: F.coalesce(a * b, F.lit(0.0)))).alias("lag"), ends.alias("ends"))
        serial = _let(sums, lambda t: F.when(t["two"] > t["one"] * t["one"] / n, (t["lag"] - t["one"] / n * (2 * t["one"] - t["ends"]) + (n - 1) * t["one"] * t["one"] / (n * n)) / (t["two"] - t["one"] * t["one"] / n)).otherwise(F.lit(1.0)))
        p_serial = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(serial + 1 / n) * F.sqrt(n)))
        logs = reduce(lambda a, b: a + b, [F.log(F.greatest(p, F.lit(1e-12))) for p in (p_chi, p_parts, p_runs, p_serial)])
        return _chi_tail(-2 * logs, F.lit(8.0))

    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    # Each step is bound before the next, so that no character's lambda works out a whole token's values anew.
    inferred = lambda t: F.struct(t.alias("token"), encoding(t).alias("encoding"), chars(t).alias("chars"))
    coded = lambda x: F.struct(
        F.transform(x["chars"], lambda c: part(c, x["encoding"])).alias("parts"),
        F.transform(x["chars"], lambda c: code(c).cast("double")).alias("codes"),
        F.get(share, x["encoding"]).alias("share"),
        F.get(symbols, x["encoding"]).alias("symbols"),
        x["token"].alias("token"),
        x["chars"].alias("chars"),
    )
    return _let(stripped, lambda t: _let(inferred(t), lambda x: _let(coded(x), battery)))


def _p_bin(token: Column) -> Column:
    return F.least(F.floor(randomness_p(token) * BINS), F.lit(BINS - 1)).cast("int")


def known_words(spark: SparkSession, classes: list[int]) -> DataFrame:
    """(class, token): NULL_ROWS tokens of each class that aren't random, made by rule from hashes."""
    of = spark.createDataFrame([(c, min(NULL_LENGTH, int(20 * 2 ** ((c + 0.5) / CLASSES)))) for c in classes], "class int, n int").crossJoin(spark.range(NULL_ROWS))
    pick = lambda letters, *key: F.substring(F.lit(letters), F.pmod(F.xxhash64(*key), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    row = F.col("id")
    syllable = lambda i: F.concat(pick("bcdfghjklmnprstvwz", row, i, F.lit(1)), pick("aeiou", row, i, F.lit(2)))
    steps = F.sequence(F.lit(1), F.col("n"))
    syllables = F.array_join(F.transform(steps, syllable), "")
    names = F.array_join(F.transform(steps, lambda i: F.concat(F.initcap(F.concat(syllable(i), syllable(i + 100_000))), F.when(F.pmod(F.xxhash64(row, i), F.lit(3)) == 0, pick("0123456789", row, i, F.lit(3))).otherwise(""))), "")
    few = F.array_join(F.transform(steps, lambda i: pick("anoAB01b", row, i, F.lit(4))), "")
    motif = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", row, i, F.lit(5))), "")
    made = F.get(F.array(syllables, names, few, F.repeat(motif, F.col("n"))), F.pmod(row, F.lit(4)).cast("int"))
    return of.select("class", F.substring(made, F.lit(1), F.col("n")).alias("token"))


def scan(docs: DataFrame) -> DataFrame:
    """Spans of the base kinds and p-values of the candidates, one row per document.

    Null and empty texts have no spans. Returns doc_id, base (array of start,
    order, end, kind) and candidates (array of start, end, class, p_bin).
    """
    text = F.col("text")
    base = F.sort_array(
        F.concat(
            _labelled(match_spans(text, ASSIGN, 2), "assign", 0, ASSIGN_LEAST),
            _labelled(match_spans(text, ACCESS), "access", 1, ACCESS_LEAST),
            # Maximal runs of this length and more are the long ones among all maximal runs.
            _labelled(match_spans(text, f"{HEX[:-1]}{{{HEX_LEAST},}}"), "hex", 2, HEX_LEAST),
        )
    )
    candidates = F.transform(
        match_spans(text, CANDIDATE),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.floor(CLASSES * F.log2(F.length(x["value"]) / F.lit(20.0))).cast("int").alias("class"),
            _p_bin(x["value"]).alias("p_bin"),
        ),
    )
    return texts(docs).select("doc_id", base.alias("base"), candidates.alias("candidates"))


def cuts_by_length(scanned: DataFrame, fdr: float) -> dict[int, int]:
    """Lowest bin of p that is kept in each class of length; a few classes for each doubling of the longest length.

    The share of non-random tokens that pass a cut is that of ``known_words``.
    Their number is judged from the candidates below the cut, never from those
    above it. The first bin is always rejected.
    """
    count = lambda df: df.groupBy("class", "p_bin").agg(F.count("*").alias("n")).collect()
    found = count(scanned.select(F.explode("candidates").alias("c")).select("c.class", "c.p_bin"))
    classes = sorted({r["class"] for r in found})
    if not classes:
        return {}
    null = count(known_words(scanned.sparkSession, classes).select("class", _p_bin(F.col("token")).alias("p_bin")))
    cuts = {}
    for size in classes:
        counts, words = [0] * BINS, [0] * BINS
        for rows, into in ((found, counts), (null, words)):
            for r in rows:
                if r["class"] == size:
                    into[r["p_bin"]] += r["n"]
        for cut in range(1, BINS):
            passing = (sum(words[cut:]) + 1) / (sum(words) + 1)
            above, below = sum(counts[cut:]), sum(counts[:cut])
            if above and passing < 1 and below * passing / (1 - passing) <= fdr * above:
                cuts[size] = cut
                break
    return cuts


def find_secrets(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """All spans of every document: the base kinds, and ``random`` ones by the battery.

    A document with a null or empty text has a row with zero counts and no
    spans; repeated rows each give a row; other columns are ignored.

    Returns doc_id, base and found, arrays of (start, order, end, kind).
    """
    scanned = stored(scan(docs), "secrets")
    cuts = cuts_by_length(scanned, fdr)
    kept = F.lit(False)
    for size, cut in sorted(cuts.items()):
        kept = F.when(F.col("c.class") == size, F.col("c.p_bin") >= cut).otherwise(kept)
    cut_of = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair]) if cuts else F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))
    random = F.transform(
        F.filter("candidates", lambda x: F.coalesce(x["p_bin"] >= F.try_element_at(cut_of, x["class"]), F.lit(False))),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("order"), x["end"].alias("end"), F.lit("random").alias("kind")),
    )
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("found"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts per base kind, digest of the base spans, all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))
