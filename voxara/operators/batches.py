"""Small groups worked on many at a time: no call, table and message of its own for each of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of the groups of equal neighbours."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a = c.dictionary_encode()
        codes = a.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by the keys, with the first rows of the groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = int(_starts(b, keys)[-1])
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)
        if same and last == 0:
            held.append(b)
            continue
        whole = pa.Table.from_batches([*held, b.slice(0, last)])
        if whole.num_rows:
            yield whole, _starts(whole, keys)
        held = [b.slice(last)]
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _starts(whole, keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys over as many tasks as shuffles have: small rows may be much work, so they aren't put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scattered(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt as by ``spread``, by a hash that no other step deals by, so that Spark doesn't merge this step with one that it makes tasks larger of."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


Work = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def by_groups(df: DataFrame, keys: list[str], work: Work, schema: str, most: int, same: tuple[str, ...] = ()) -> DataFrame:
    """``work(rows, which, first)`` on up to ``most`` whole groups at once.

    ``which`` numbers each row's group and ``first`` has the groups' first rows.
    Groups that go together agree in the columns ``same``, which are keys.
    """
    order = [*same, *[k for k in keys if k not in same]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, order):
            ends = np.append(first[1:], table.num_rows)
            breaks = np.zeros(len(first), bool)
            breaks[0] = True
            if same:
                breaks[np.searchsorted(first, _starts(table, list(same)))] = True
            runs = np.append(np.flatnonzero(breaks), len(first))
            for low, high in zip(runs[:-1], runs[1:], strict=True):
                for a in range(int(low), int(high), most):
                    z = min(a + most, int(high))
                    rows = table.slice(int(first[a]), int(ends[z - 1] - first[a])).combine_chunks()
                    yield from work(rows, np.repeat(np.arange(z - a), (ends - first)[a:z]), first[a:z] - first[a]).to_batches()

    return spread(df, *keys).sortWithinPartitions(*order).mapInArrow(run, schema)
