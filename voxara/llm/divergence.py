"""Source divergence audit over languages (operator 13).

Identical texts of a lang are collapsed: each distinct text is tokenized once,
with its number of copies in every source. Counts and document frequencies of
terms are added with these multiplicities. Pairs of sources are then compared
over the terms that occur: what a term adds where only one source has it
depends on its count there alone, so counts are grouped; only terms that both
sources have are looked at pair by pair. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxara.llm.common import drop, free_shuffles, lean, own_columns, stored

#: Documents of a lang that must hold a kept term; terms reported for a group; the scale of shares.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Distinct entries that a worker adds up before it hands them on; pairs that it looks at in one piece.
HELD, PIECE = 200_000, 1 << 20

#: A-Z lowered; bytes that belong to no term are blank. Every byte of a character beyond ASCII is above 0x7F.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _collapsed(docs: DataFrame) -> DataFrame:
    """Distinct texts of each lang: lang, text and ``held``, the copies in every source."""
    rows = docs.select("lang", "source", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copies = rows.groupBy("lang", "t1", "t2", "source").agg(F.count("*").alias("n"))
    held = copies.groupBy("lang", "t1", "t2").agg(F.collect_list(F.struct("source", "n")).alias("held"))
    once = rows.groupBy("lang", "t1", "t2").agg(F.first("text").alias("text"))
    return once.join(held, ["lang", "t1", "t2"]).select("lang", "held", "text")


def _counted(collapsed: DataFrame) -> DataFrame:
    """Occurrences and documents of every term: lang, source, term, n, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*k, t, n, d) for k, terms in found.items() for t, (n, d) in terms.items()]
            columns = list(zip(*rows, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, held, text in zip(b.column("lang").to_pylist(), b.column("held").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                terms = Counter(terms_of(text))
                for h in held:
                    own, copies = found.setdefault((lang, h["source"]), {}), h["n"]
                    before = len(own)
                    for t, n in terms.items():
                        got = own.get(t)
                        if got is None:
                            own[t] = [n * copies, copies]
                        else:
                            got[0] += n * copies
                            got[1] += copies
                    size += len(own) - before
                    if size >= HELD:
                        yield out()
                        size = 0
        if found and any(found.values()):
            yield out()

    partial = collapsed.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    # Dealt by term alone, so that the sums over a term's sources need no other shuffle.
    return partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _present(counted: DataFrame, least_docs: int) -> DataFrame:
    """The kept terms' counts in every source, and ``all_n`` in all of them: lang, source, term, n, all_n."""
    term = Window.partitionBy("lang", "term")
    summed = counted.withColumns({"all_n": F.sum("n").over(term), "all_docs": F.sum("docs").over(term)})
    return summed.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n")


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in 1e9, rounded down, and one more; exact for counts beyond 64 bits of product."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, (total + 2 * kept).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both below 2^31, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def _met(terms: DataFrame) -> DataFrame:
    """What terms that two sources hold add to their pair beside the sums over each: low, high (groups), value.

    ``terms`` has a row per term: ``held``, the groups g that have it with the
    share p there and p0, the share of an absent term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}

        def out() -> pa.RecordBatch:
            pairs = list(total)
            got = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["low", "high", "value"])
            total.clear()
            return got

        def add(g: np.ndarray, p: np.ndarray, z: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            """Rows are terms with equally many groups; columns i and j are compared."""
            f = lambda a, b: (a - b) ** 2 // (a + b)
            value = (f(p[:, i], p[:, j]) - f(p[:, i], z[:, j]) - f(z[:, i], p[:, j]) + f(z[:, i], z[:, j])).ravel()
            a, b = g[:, i].ravel(), g[:, j].ravel()
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low))
            low, high, value = low[order], high[order], value[order]
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            for x, y, v in zip(low[first].tolist(), high[first].tolist(), np.add.reduceat(value, first).tolist(), strict=True):
                total[x, y] = total.get((x, y), 0) + v

        for b in batches:
            held = b.column("held")
            ends = held.offsets.to_numpy()
            g, p, z = (c.to_numpy() for c in held.values.flatten())
            lengths = np.diff(ends)
            for n in np.unique(lengths[lengths > 1]).tolist():
                at = ends[:-1][lengths == n][:, None] + np.arange(n)
                i, j = np.triu_indices(n, 1) if n * (n - 1) // 2 <= PIECE else (None, None)
                if i is not None:
                    rows = max(1, PIECE // len(i))
                    for r in range(0, len(at), rows):
                        cut = at[r : r + rows]
                        add(g[cut], p[cut], z[cut], i, j)
                        if len(total) >= HELD:
                            yield out()
                else:  # a term of very many sources: one of them with the rest at a time
                    for row in at:
                        for k in range(n - 1):
                            add(g[row][None], p[row][None], z[row][None], np.full(n - 1 - k, k), np.arange(k + 1, n))
                            if len(total) >= HELD:
                                yield out()
        if total:
            yield out()

    return terms.select("held").mapInArrow(lean(run), "low long, high long, value long").groupBy("low", "high").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How far sources of a lang lie apart, and the terms that mark each.

    Null text, lang and source count as ''. Terms are runs of letters A-Z and
    characters beyond ASCII, A-Z lowered. Groups without terms are compared like
    others; a lang that keeps no term has value 0 for every pair. Sources alone
    in their lang have no pair. Ties go to the smaller item by UTF-8. An empty
    table has an empty result. Only text, lang and source are read.

    Returns lang, source, part (pair or term), item, value, rank.
    """
    blank = own_columns(docs, "text", "lang", "source").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    present = stored(_present(_counted(_collapsed(blank)), least_docs), "counted")
    free_shuffles(docs.sparkSession)  # those of texts and of partial counts are not needed beside the next
    langs = present.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    size = present.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    groups = blank.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.join(size, "lang"), "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "lang_n", "kept"]).withColumn("p0", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))))
    groups = stored(groups.withColumn("g", F.monotonically_increasing_id()), "groups")

    shares = present.join(groups.select("lang", "source", "g", "total", "lang_n", "kept", "p0"), ["lang", "source"])
    shares = stored(shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("kept"))), "shares")
    marks = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    both = _met(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("held")).where(F.size("held") > 1))
    both = both.union(both.select(F.col("high"), F.col("low"), "value"))
    # The terms of one group against the absent share of another, a row for each count.
    levels = shares.groupBy("lang", "g", "p").agg(F.count("*").alias("terms"))
    absent = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("z"))
    alone = levels.join(absent, "lang").where("g <> h").groupBy("g", "h").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("z"))).alias("alone"))
    sides = groups.select("lang", "source", "g", "own", "kept", "p0").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("own").alias("other_own"), F.col("p0").alias("z")), "lang").where("g <> h")
    found = sides.join(alone, ["g", "h"], "left").join(alone.select(F.col("g").alias("h"), F.col("h").alias("g"), F.col("alone").alias("other_alone")), ["g", "h"], "left")
    found = found.join(both.toDF("g", "h", "shared"), ["g", "h"], "left").na.fill(0, ["alone", "other_alone", "shared"])
    neither = (F.col("kept") - F.col("own") - F.col("other_own")) * gap(F.col("p0"), F.col("z"))
    value = F.when(F.col("kept") > 0, F.col("alone") + F.col("other_alone") + F.col("shared") + neither).otherwise(0).cast("long")
    pairs = found.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = stored(pairs.unionByName(marks), "divergence")
    drop(present, groups, shares)
    return out
