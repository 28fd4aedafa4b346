"""Importance resampling towards a target's hashed n-grams, by segments (operator 12).

Separator newlines cut texts into lines. The lines of the whole corpus are
grouped; each distinct line's features are counted once and multiplied by its
occurrences. Runs of words that cross a newline belong to no line: they are
added document by document, where runs are longer than one word. Gains of the
buckets follow from the counts of corpus and target; a document's sum is again
that of its lines, each looked up once, and of its crossing runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import drop, lean, own_columns, stored

#: Words of a run at most; buckets; words that a document must have to be drawn; percent drawn; the draw's seed.
ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words of which the bucket is remembered in a worker, at most.
REMEMBERED = 1 << 18

#: Bytes of a word are kept, A-Z lowered; all others separate words. Every byte of a character beyond ASCII is above 0x7F.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hasher(buckets: int) -> Callable[[bytes], int]:
    known: dict[bytes, int] = {}

    def bucket(feature: bytes) -> int:
        got = known.get(feature)
        if got is None:
            if len(known) >= REMEMBERED:
                known.clear()
            got = known[feature] = zlib.crc32(feature) % buckets
        return got

    return bucket


def _runs(words: list[bytes], order: int) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)] if order > 1 else words


def crossing_runs(lines: list[list[bytes]], order: int) -> list[bytes]:
    """Runs of up to ``order`` words that cross a newline; lines without words don't break a run."""
    words = [w for line in lines for w in line]
    ends = np.cumsum([len(line) for line in lines])
    found, seen = [], set()
    for e in sorted({int(x) for x in ends[:-1]} - {0, len(words)}):
        for n in range(2, order + 1):
            for i in range(max(0, e - n + 1), min(e, len(words) - n + 1)):
                if (i, n) not in seen:  # a run may cross several newlines
                    seen.add((i, n))
                    found.append(b" ".join(words[i : i + n]))
    return found


def _keyed(texts: DataFrame) -> DataFrame:
    """The texts with two hashes."""
    return texts.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _segments(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """Distinct lines with words: l1, l2 (hashes), n (occurrences), n_words and the buckets of all features in the line."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _hasher(buckets)
        for b in batches:
            counts, flat, ends = [], [], [0]
            for line in b.column("line").cast(pa.binary()).to_pylist():
                words = words_of(line)
                flat += map(bucket, _runs(words, order))
                counts.append(len(words))
                ends.append(len(flat))
            features = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            out = pa.RecordBatch.from_arrays([b.column("l1"), b.column("l2"), b.column("n"), pa.array(counts, pa.int64()), features], names=["l1", "l2", "n", "n_words", "buckets"])
            yield out.filter(pa.array(np.array(counts) > 0))

    hashed = lines.select("line", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"), "n")
    return hashed.mapInArrow(lean(run), "l1 long, l2 long, n long, n_words long, buckets array<int>")


def _crossings(keyed: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each text's crossing runs: doc_id, t1, t2 and their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _hasher(buckets)
        for b in batches:
            found = [[bucket(f) for f in crossing_runs([words_of(line) for line in t.split(b"\n")], order)] for t in b.column("text").cast(pa.binary()).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "t1", "t2", "buckets"])
            yield out.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    return keyed.select("doc_id", "t1", "t2", "text").mapInArrow(lean(run), "doc_id long, t1 long, t2 long, buckets array<int>")


def _totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Sum of n over the features of each bucket: one row a bucket comes to the driver."""

    summed = rows.select("n", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, a bucket each."""
    m = float(len(source))
    return np.floor(1000 * np.log((target + 1.0) * (float(source.sum()) + m) / ((source + 1.0) * (float(target.sum()) + m)))).astype(np.int64)


def _gained(rows: DataFrame, gains: np.ndarray, keys: list[str]) -> DataFrame:
    """The keys with n_features and the sum of their gains."""
    kinds = ", ".join(f"{k} long" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("buckets")
            ends = column.offsets.to_numpy()
            running = np.concatenate([[0], np.cumsum(gains[column.flatten().to_numpy()])])
            at = ends - ends[0]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(np.diff(ends).astype(np.int64)), pa.array(running[at[1:]] - running[at[:-1]])], names=[*keys, "features", "gain"])

    return rows.select(*keys, "buckets").mapInArrow(lean(run), f"{kinds}, features long, gain long")


def _floor_mean(total: str, n: str) -> F.Column:
    return F.expr(f"CASE WHEN {n} > 0 THEN ({total} - pmod({total}, {n})) div {n} ELSE 0L END")


def weigh(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features and weight.

    Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lowered. A null
    or empty text, or one without a word, has no features and weight 0. Rows
    equal in doc_id and text get the same values. Only doc_id and text of
    ``docs`` and text of ``target`` are read, whatever other columns are called.
    Features are known by bucket alone; lines and texts by 128 bits of hash.
    """
    blank = F.coalesce(F.col("text"), F.lit("")).alias("text")
    keyed = _keyed(own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), blank))
    segments = stored(_segments(keyed, order, buckets), "segments")
    wanted = own_columns(target, "text").select(F.lit(0).cast("long").alias("doc_id"), blank)
    parts, aims = [segments], [_segments(wanted, order, buckets)]
    if order > 1:
        crossings = stored(_crossings(keyed, order, buckets), "crossings")
        parts.append(crossings.withColumn("n", F.lit(1).cast("long")))
        aims.append(_crossings(_keyed(wanted), order, buckets).withColumn("n", F.lit(1).cast("long")))
    gains = bucket_gains(*[sum((_totals(p, buckets) for p in found), np.zeros(buckets, np.int64)) for found in (parts, aims)])
    lines = _gained(segments, gains, ["l1", "l2", "n_words"])
    # A row per line of each document; the first one counts the document, so that equal rows divide again.
    held = keyed.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    held = held.select("doc_id", "t1", "t2", (F.col("nth") == 0).cast("long").alias("copies"), F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"))
    columns = ["doc_id", "t1", "t2", "copies", "n_words", "features", "gain"]
    found = held.join(lines, ["l1", "l2"], "left").select(*columns)
    if order > 1:
        zero = F.lit(0).cast("long")
        found = found.unionByName(_gained(crossings, gains, ["doc_id", "t1", "t2"]).withColumns({"copies": zero, "n_words": zero}).select(*columns))
    sums = found.groupBy("doc_id", "t1", "t2").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns[3:]])
    each = sums.select("doc_id", F.expr("n_words div copies").alias("n_words"), F.expr("features div copies").alias("n_features"), F.expr("gain div copies").alias("gain"), "copies")
    each = each.withColumn("weight", _floor_mean("gain", "n_features"))
    weighed = stored(each.withColumn("time", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "n_words", "n_features", "weight"), "weighed")
    drop(*([segments, crossings] if order > 1 else [segments]))
    return weighed


def ranks(scored: DataFrame) -> DataFrame:
    """The rows with ``place``, from 1, by falling score and then rising doc_id: numbers within ranges, then the ranges' offsets."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + 1 + b.num_rows))], names=[*b.schema.names, "range", "nth"])
            n += b.num_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    dealt = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, range int, nth long"), "ranges")
    # One row a range.
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    offsets = scored.sparkSession.createDataFrame([(k, s) for (k, _), s in zip(sizes, starts, strict=False)], "range int, start long")
    return dealt.join(offsets, "range").withColumn("place", F.col("start") + F.col("nth")).drop("range", "nth", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight, its score and its rank in the draw; null where it isn't drawn.

    The score is the weight and thousandths of a Gumbel variate made from the
    seed and doc_id, so that the highest scores are a draw without replacement
    in proportion to the weights' exponentials. Of documents with at least
    ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    Documents without a doc_id share the variate of the empty id and come last
    among equal scores. Ranks of rows that repeat a doc_id and score are any
    order of them.

    Returns doc_id, n_features, weight, score, rank.
    """
    weighed = weigh(docs, target, order, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scored")
    drop(weighed, shuffles=False)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = ranks(able).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names).unionByName(rest.select(*names))
