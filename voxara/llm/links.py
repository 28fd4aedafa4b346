"""Groups, pair blocks, bit filters and connected components for the similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import drop, lean, shuffled, stored

#: Rows of one key that are compared in one piece, about.
TILE = 1024


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the keys; several groups to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.ones(b.num_rows, bool)
        for c in columns:
            last &= c == c[-1]
        cut_at = int(b.num_rows - np.argmin(last[::-1])) if not last.all() else 0
        if held and cut_at == 0:
            before = held[-1]
            if all(before.column(k)[-1].as_py() == c[-1] for k, c in zip(keys, columns, strict=True)):
                held.append(b)
                continue
        if held or cut_at:
            yield pa.Table.from_batches([*held, b.slice(0, cut_at)] if cut_at else held)
        held = [b.slice(cut_at)] if cut_at < b.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """First rows of the groups of equal neighbours, and the number of rows."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def shared_keys(rows: DataFrame) -> DataFrame:
    """The distinct (key, id, ...) rows of those keys that two ids or more hold.

    ``rows`` has long columns key and id, maybe more columns that id and key
    determine. One shuffle; a task holds one key's rows only until their second
    id is seen.
    """
    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: pa.RecordBatch | None = None  # the open key's only row so far
        open_key = last_id = None
        for b in batches:
            if not b.num_rows:
                continue
            key, ident = b.column("key").to_numpy(), b.column("id").to_numpy()
            at = bounds(key)
            starts, ends = at[:-1], at[1:]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
            if open_key is not None and key[0] == open_key and ident[0] == last_id:
                new[0] = False
            several = np.add.reduceat(new, starts) > 1
            if open_key is not None and key[0] == open_key:
                if new[starts[0] : ends[0]].any():  # another id than the ones before
                    if first is not None:
                        yield first
                    several[0], first = True, None
                elif first is None:
                    several[0] = True
                # else still one id; its row is held already
            elif open_key is not None:
                first = None
            keep = np.repeat(several, ends - starts) & new
            if keep.any():
                yield b.filter(pa.array(keep))
            # The last key stays open: remember its row if it is alone so far.
            if several[-1]:
                first = None
            elif len(starts) > 1 or key[-1] != open_key:
                first = b.slice(int(starts[-1]), 1)
            open_key, last_id = key[-1], ident[-1]

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "id").mapInArrow(lean(run), schema).select(*names)


def blocks(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows with ``lo`` and ``hi``: every two rows of a key meet in one block (key, lo, hi).

    Keys of more than ``tile`` rows are dealt into tiles by id, and a row goes
    to the blocks of its tile with each other; other keys are one block.
    ``tile_of`` is the row's own tile.
    """
    large = rows.groupBy("key").count().where(F.col("count") > tile).select(F.col("key").alias("key_"), F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = rows.join(large, F.col("key") == F.col("key_"), "left").drop("key_").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = dealt.withColumn("tile_of", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.withColumn("lo", F.least("tile_of", "other")).withColumn("hi", F.greatest("tile_of", "other")).drop("other", "tiles")


def map_blocks(blocked: DataFrame, function: Callable[[dict[str, np.ndarray], int, int], list[np.ndarray]], schema: str, names: list[str]) -> DataFrame:
    """``function(columns, lo, hi)`` on each block; it returns the output columns."""
    kinds = blocked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ("key", "lo", "hi")):
            columns = {c: table.column(c).to_numpy() for c in kinds}
            at = bounds(columns["key"], columns["lo"], columns["hi"])
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    got = function({c: v[a:b] for c, v in columns.items()}, int(columns["lo"][a]), int(columns["hi"][a]))
                    if len(got[0]):
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return blocked.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lean(run), schema)


BLOOM_BITS = 1 << 23


def bit_filter(ids: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bitmap of fixed size (1 MB) in which every id's bit is set; it only spares work."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(place.alias("place")).select(F.floor(F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return (bits[places >> 6] >> (places & 63) & 1).astype(bool)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row per linked id, with the smallest id reachable.

    Alternates large-star and small-star steps on distributed edges until they
    stop changing; the edges are written after each round. Returns id, component.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
        large = both.join(shuffled(near), F.col("u") == F.col("u_")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(shuffled(least.withColumnRenamed("u", "u_")), F.col("u") == F.col("u_")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(kept.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop(last, shuffles=False)
        if now == before or not now["n"]:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
