"""Quality rules kept in a bitmask ledger (operator 9), in DataFrame functions only.

Every rule is evaluated once. The ledger holds the measurements and one
integer whose bit k is set where rule k fails; policies are masks over these
bits, so a new policy, or the effect of leaving one rule out, needs no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import SPACE, texts

#: Rules by bit, each a failing condition over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "capitals": "100 * n_capitals > 50 * n_letters",
}
#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
    "v2": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "few_letters"),
}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text."""

    def within(w: Column) -> Column:
        windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

        def covered(g: Column) -> Column:
            ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
            twice = _let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            # Windows in order: each adds the words that the one before didn't cover.
            total = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(total)

        return _let(windows, covered)

    return _let(words, within)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of every document, each rule evaluated once.

    A null text counts as empty: no words, no lines with a word. Repeated rows
    each give a row; columns besides doc_id and text are not looked at.
    """
    text = F.col("text")
    squeezed = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    words = F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    letters = F.regexp_replace(text, r"\P{L}+", "")
    measured = texts(docs).select(
        "doc_id",
        F.struct(
            _let(squeezed, lambda s: F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.translate(s, " ", "")) + 1)).cast("long").alias("n_words"),
            F.length(F.translate(squeezed, " ", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.length(letters).cast("long").alias("n_letters"),
            F.length(F.regexp_replace(letters, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        ).alias("m"),
    )
    flat = measured.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.lines.n_lines", "m.n_repeat_words", "m.n_letters", "m.n_capitals")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return flat.withColumn("failed", bits.cast("long"))


def apply_policy(ledgered: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: whether no rule of the policy fails."""
    return ledgered.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(ledgered: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """What each rule does in each version of the policy.

    The ledger is read once, for how many documents have each combination of
    bits: 256 rows at most. A policy's mask is laid over these, and the bits
    left tell which rules fail a document, alone or with others.

    Returns version, rule, n_documents, n_rejected (by the whole policy),
    n_failed (by the rule) and n_regained (kept if the rule were left out). An
    empty ledger gives no row.
    """
    bits = ledgered.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(mask(POLICIES[v])).alias("policy"), F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for v in versions for r in POLICIES[v]]))
    each = bits.select("failed", "n", rules.alias("r")).select("n", "r.version", "r.rule", F.col("failed").bitwiseAND(F.col("r.policy")).alias("left"), F.col("r.bit").alias("bit"))
    counted = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_documents"), counted(F.col("left") != 0).alias("n_rejected"), counted(F.col("left").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), counted(F.col("left") == F.col("bit")).alias("n_regained")
    )


def digest(ledgered: DataFrame) -> DataFrame:
    """The columns of the query."""
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return apply_policy(ledgered, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
