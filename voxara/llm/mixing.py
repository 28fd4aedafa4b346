"""Mixing sources to target weights by entropy balancing (operator 10), in DataFrame functions only.

Each document gets a rate between 0 and ``most`` copies. Among all rates that
give every source its target of words, entropy balancing picks those nearest
to equal rates; in the convex dual they are tilted exponentially by size,
``most / (1 + exp(-multiplier * size / scale))``, with one multiplier per
source. Newton steps on the dual, each one aggregation over the documents, find
the multipliers of all sources at once.

Rates become copies by a threshold per source: each document has a fixed random
place, its rate is rounded down, and documents are rounded up in the order of
how far their place lies below their rate's fraction, up to the last one that
the target has room for. Thresholds are found by counting words per digit of
the place, so nothing is sorted, and a document's copies follow from its own
row and the few numbers of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.llm.common import drop, stored, times, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
NEWTON_STEPS = 40
#: Places have so many digits of so many bits.
DIGITS, BITS = 2, 16
PLACES = 1 << DIGITS * BITS
#: A source is near its target where it lacks this share of it at most.
NEAR = 1e-3


def _source_key() -> Column:
    """Sorts as the sources do by code point, null last, and is never null."""
    return F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source")))


def _sized(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, with ``size`` and the row's ``place``, a hash of its doc_id, source and text.

    Equal rows have equal places: they are taken alike.
    """
    size = F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long")
    place = F.pmod(F.xxhash64("doc_id", "source", "text", F.col("doc_id").isNull(), F.col("text").isNull()), F.lit(PLACES))
    return docs.select(*[F.col(f"`{n}`") for n in names], size.alias("__size"), place.alias("__place"), _source_key().alias("__key"))


def target_by_source(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """Targets in words: weights repeat over the sources by code point, null last.

    No target exceeds ``most`` times its source's size; the excess is shared
    again by weight among the others until none is above. ``sizes`` has source
    and size. One row per source: source, source_size, target, n_docs, key.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("n_docs")).withColumn("key", _source_key())
    # Windows over one row per source, which is what a mix is set for.
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(W.orderBy("key")) - 1, F.lit(len(weights))))
    cap = F.lit(most) * F.col("source_size")
    weighed = totals.withColumn("weight", weight).withColumn("ratio", cap / F.col("weight"))
    # The sources that reach their cap are the first by cap over weight: those before the first whose share fits.
    order = W.orderBy("ratio", "key")
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = weighed.withColumn("left", left).withColumn("open", F.sum("weight").over(after))
    fits = level.withColumn("first", F.col("left") * F.col("weight") / F.col("open") <= cap).withColumn("rank", F.row_number().over(order))
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.min(F.when(F.col("first"), F.struct("rank", "left", "open"))).over(whole)
    target = F.when(at.isNull() | (F.col("rank") < at["rank"]), cap.cast("double")).otherwise(at["left"] * F.col("weight") / at["open"])
    return fits.select("source", "source_size", target.cast("double").alias("target"), "n_docs", "key")


def _rate(most: int) -> Column:
    """The tilted rate, to nine places so that the last bit of exp() decides nothing."""
    tilt = F.col("multiplier") * F.col("__size") / F.col("scale")
    free = F.round(most / (1 + F.exp(-F.greatest(F.least(tilt, F.lit(500.0)), F.lit(-500.0)))), 9)
    return F.when(F.col("__size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(most))).otherwise(free)


def newton(sizes: DataFrame, targets: DataFrame, most: int = MAX_COPIES, steps: int = NEWTON_STEPS) -> DataFrame:
    """The targets with each source's ``multiplier``, by distributed Newton steps on the dual.

    The dual of a source is convex with gradient sum(rate * size) - target; a
    step aggregates gradient and curvature of all sources, and is halved into
    the bracket known so far where it would leave it.
    """
    full = F.col("target") >= most * F.col("source_size")
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)))
    start = targets.select("*", full.alias("full"), scale.alias("scale"), F.lit(0.0).alias("multiplier"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    at = stored(start.withColumn("done", F.col("full")), "multipliers")
    # Decimal sums don't depend on the order of rows, so reruns take the same steps.
    exact = lambda x: F.sum(x.cast("decimal(28,8)")).cast("double")
    for _ in range(steps):
        if at.where("not done").isEmpty():
            break
        rate = _rate(most)
        size = F.col("__size")
        open_ = sizes.join(at.where("not done").select(F.col("key").alias("__key"), "full", "scale", "multiplier"), "__key")
        sums = open_.groupBy("__key").agg(exact(rate * size).alias("words"), exact(rate * (1 - rate / most) * size * size / F.col("scale")).alias("slope"))
        gap = F.col("words") - F.col("target")
        moved = at.join(sums, F.col("key") == F.col("__key"), "left").select(
            *at.columns,
            (F.col("done") | (F.abs(gap) <= NEAR * F.greatest(F.lit(1.0), F.col("target"))) | (F.col("high") - F.col("low") < 1e-6)).alias("near"),
            F.when(gap > 0, F.least("high", "multiplier")).otherwise(F.col("high")).alias("above"),
            F.when(gap <= 0, F.greatest("low", "multiplier")).otherwise(F.col("low")).alias("below"),
            F.when(F.col("slope") > 0, F.col("multiplier") - gap / F.col("slope")).alias("step"),
        )
        inside = (F.col("step") > F.col("below")) & (F.col("step") < F.col("above"))
        new = F.when(F.col("near"), F.col("multiplier")).when(inside, F.col("step")).otherwise((F.col("below") + F.col("above")) / 2)
        last, at = at, stored(moved.select(*targets.columns, "full", "scale", new.alias("multiplier"), F.col("below").alias("low"), F.col("above").alias("high"), F.col("near").alias("done")), "multipliers")
        drop(last, shuffles=False)
    return at


def _late() -> Column:
    """How late a document is rounded up, in 0 to PLACES - 1: its place less its rate's fraction, halved into the range."""
    part = ((F.col("__rate") - F.floor("__rate")) * PLACES).cast("long")
    return F.shiftright(F.col("__place") - part + F.lit(PLACES), 1)


def _thresholds(rows: DataFrame, room: DataFrame) -> DataFrame:
    """(key, upto, taken) for ``room`` (key, room): the largest ``upto`` so that the words of the source's rows with ``late < upto`` fit.

    ``rows`` has __key, __size and late. One count of words per digit.
    """
    found = room.select("key", F.col("room").cast("double").alias("left"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("taken"))
    for digit in range(DIGITS - 1, -1, -1):
        shift, high = digit * BITS, (digit + 1) * BITS
        at = found.select(F.col("key").alias("__key"), "upto")
        same = F.shiftright("late", high) == F.shiftright("upto", high)
        sums = rows.join(at, "__key").where(same).groupBy("__key", F.shiftright("late", shift).alias("digit")).agg(F.sum("__size").alias("words"))
        upto = sums.withColumn("sum", F.sum("words").over(W.partitionBy("__key").orderBy("digit")))
        # The digit at which the room ends stays open; all digits before it are taken.
        ends = upto.join(found.select(F.col("key").alias("__key"), "left"), "__key").where(F.col("sum") > F.col("left"))
        end = ends.groupBy("__key").agg(F.min(F.struct("digit", F.col("sum") - F.col("words"))).alias("end"))
        all_ = sums.groupBy("__key").agg(F.sum("words").alias("all"))
        next_ = (F.shiftright("upto", high) + 1) * (1 << high)
        joined = found.join(end.withColumnRenamed("__key", "k1"), F.col("key") == F.col("k1"), "left").join(all_.withColumnRenamed("__key", "k2"), F.col("key") == F.col("k2"), "left")
        ended = F.col("end").isNotNull()
        before = F.when(ended, F.col("end.col2")).otherwise(F.coalesce("all", F.lit(0)))
        # Where all of a digit fits, what follows belongs to the digit before, which was found not to fit as a whole.
        step = joined.select("key", (F.col("left") - before).alias("left"), F.when(ended, F.col("end.digit") * (1 << shift)).otherwise(next_).alias("upto"), (F.col("taken") + before).cast("long").alias("taken"))
        found = stored(step, "thresholds")
    return found


def rounded(sizes: DataFrame, at: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """The sources' numbers with ``upto`` and ``fills``, from which ``copies`` gives a document's copies.

    ``upto`` is the threshold of the first rounding. What is left of a target
    then is less than one document; where that is more than NEAR, each of
    ``fills`` gives documents that fit into it another copy up to a threshold of
    its own, until nothing fits.
    """
    sums = sizes.join(at.select(F.col("key").alias("__key"), "full", "scale", "multiplier"), "__key").withColumn("__rate", _rate(most))
    late = stored(sums.select("__key", "__size", "__place", "__rate", _late().alias("late")).where("__size > 0"), "rates")
    floors = late.groupBy("__key").agg(F.sum(F.floor("__rate") * F.col("__size")).alias("words"))
    room = at.where("not full").join(floors, F.col("key") == F.col("__key"), "left").select("key", (F.col("target") - F.coalesce("words", F.lit(0))).alias("room"))
    first = _thresholds(late.where(F.col("__rate") > F.floor("__rate")), room)
    state = at.join(first.select("key", "upto", "left"), "key", "left").withColumn("fills", F.array().cast("array<struct<most:long,upto:long>>"))
    state = stored(state.withColumn("upto", F.coalesce("upto", F.lit(0).cast("long"))), "rounded")
    lacking = (F.col("left") >= 1) & (F.col("left") > NEAR * F.col("target"))
    while not state.where(lacking).isEmpty():
        again = late.join(state.where(lacking).select(F.col("key").alias("__key"), "full", "upto", "fills", "left"), "__key").withColumn("__copies", _copies(most))
        fitting = again.where((F.col("__copies") < most) & (F.col("__size") <= F.floor("left"))).select("__key", "__size", _again(F.size("fills")).alias("late"))
        fit = _thresholds(stored(fitting, "fitting"), state.where(lacking).select("key", F.col("left").alias("room")))
        taken = fit.where("taken > 0").select(F.col("key").alias("k"), F.col("left").alias("new_left"), F.col("upto").alias("new_upto"))
        more = F.concat("fills", F.array(F.struct(F.floor("left").cast("long").alias("most"), F.col("new_upto").alias("upto"))))
        # A source that took nothing has no document that fits: it is done.
        state = stored(
            state.join(taken, F.col("key") == F.col("k"), "left").select(*at.columns, "upto", F.coalesce("new_left", F.lit(0.0)).alias("left"), F.when(F.col("k").isNotNull(), more).otherwise(F.col("fills")).alias("fills")), "rounded"
        )
    drop(late)
    return state


def _again(fill: Column) -> Column:
    """The order of documents in the given fill."""
    return F.pmod(F.xxhash64("__place", "__size", fill), F.lit(PLACES))


def _copies(most: int) -> Column:
    """Copies from the row's __size, __place and __rate, and its source's upto and fills."""
    first = (F.floor("__rate") + ((F.col("__rate") > F.floor("__rate")) & (_late() < F.col("upto"))).cast("long")).cast("int")
    numbered = F.transform("fills", lambda x, i: F.struct(x["most"].alias("most"), x["upto"].alias("upto"), i.alias("i")))
    fill = lambda n, x: n + ((n < most) & (F.col("__size") > 0) & (F.col("__size") <= x["most"]) & (_again(x["i"]) < x["upto"])).cast("int")
    return F.when(F.size("fills") == 0, first).otherwise(F.aggregate(numbered, first, fill))


def _solved(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """All that a document's copies depend on besides its own row: one row per source."""
    targets = target_by_source(sizes.select("source", F.col("__size").alias("size")), weights, share, most)
    at = newton(sizes, targets, most)
    return rounded(sizes, at, most).select(F.col("key").alias("__key"), "source_size", "target", "full", "scale", "multiplier", "upto", "fills")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """Copies of every document so that sources take their shares of the words.

    A null text has size 0; documents of size 0 take nothing. A null source is
    a source of its own, the last. Rows with the same or no doc_id are documents
    of their own; rows equal in doc_id, source and text are taken alike. A
    source takes no more than its target, but for what the steps leave off, and
    less by NEAR of it at most, or by what no document that is left fits into. Reruns agree. An
    empty table gives an empty one.

    Returns doc_id, source, size, source_size, target, rate, copies, taken.
    """
    sizes = stored(_sized(docs, "doc_id", "source"), "sizes")
    solved = _solved(sizes, weights, share, most)
    known = sizes.join(solved, "__key").withColumn("__rate", _rate(most)).withColumn("copies", _copies(most))
    taken = (F.col("copies") * F.col("__size")).cast("long")
    return known.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__rate").alias("rate"), "copies", taken.alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """The rows, with all columns, as often as the mix takes each; as in ``mix``, whatever their doc_id.

    Texts aren't shuffled: a row's copies follow from the row and its source.
    """
    sizes = stored(_sized(docs, "source"), "sizes")
    solved = _solved(sizes, weights, share, most)
    named = [f"__{i}" for i in range(len(docs.columns))]  # names that clash with none of the solution's
    rows = _sized(docs.withColumns({n: F.col(f"`{c}`") for n, c in zip(named, docs.columns, strict=True)}), *named)
    copied = rows.join(solved, "__key").withColumn("__rate", _rate(most)).withColumn("__copies", _copies(most)).where("__copies > 0")
    return times(copied, F.col("__copies"), named).toDF(*docs.columns)


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of the query."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
