"""Line dedup by a segment-partition edit join (operator 8).

Lines are in one class if they are equal, whatever their length. Besides, every
distinct line of ``least`` characters or more is split into ``threshold`` + 1
segments. Two lines within the threshold share one segment at
nearly the same place, so a line probes, for each length it may be near to, the
substrings that the multi-match-aware windows allow. Probes and segments meet
in one shuffle on their hash; a signature of character counts drops most other
pairs, and a banded bit-parallel edit distance verifies the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import SPACE, counted_rows, drop, lean, safely_named, stored, times
from voxara.llm.links import BLOOM_BITS, bit_filter, blocks, components, map_blocks, passes, shared_keys

THRESHOLD = 2
#: Shortest line that is joined with others than equal ones: two edits of a shorter one may leave nothing of it.
LEAST = 16
_CLASSES = 15
#: Rows a task holds before it passes them on.
HELD_ROWS = 100_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_hash(line: str) -> int:
    """The same as Spark's xxhash64 of the line."""
    return _signed(xxhash.xxh64_intdigest(line.encode("utf-8"), 42))


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` nearly equal segments, the longer ones last."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def windows(length: int, threshold: int) -> list[tuple[int, int, int, int, int]]:
    """(other length, segment, first start, last start, size) of a line's probes, multi-match-aware."""
    out = []
    for other in range(max(0, length - threshold), length + 1):
        shift = length - other
        for i, (start, size) in enumerate(segments(other, threshold + 1)):
            rest = threshold - i
            first = max(0, start - i, start + shift - rest)
            last = min(length - size, start + i, start + shift + rest)
            if size and first <= last:
                out.append((other, i, first, last, size))
    return out


def keys_of(line: str, threshold: int, plans: dict[int, list]) -> dict[int, bool]:
    """Hashes that the line probes; True for those of its own segments."""
    n = len(line)
    plan = plans.get(n)
    if plan is None:
        plan = plans[n] = windows(n, threshold)
    own = {(i, at) for i, (at, _) in enumerate(segments(n, threshold + 1))}
    digest, found = xxhash.xxh64_intdigest, {}
    for other, i, first, last, size in plan:
        for at in range(first, last + 1):
            key = digest(line[at : at + size].encode("utf-8"), other * 8 + i)
            found[key] = found.get(key, False) or (other == n and (i, at) in own)
    return found


def signature(line: str) -> int:
    """Counts of 15 classes of characters, each modulo 16, in the upper 60 bits."""
    counts = np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % _CLASSES, minlength=_CLASSES)
    sign = 0
    for c in counts.tolist():
        sign = sign << 4 | c & 15
    return sign << 4


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold.

    Bit-parallel over a band: bit p of level e says that j - threshold + p
    characters of ``a`` and j of ``b`` can be matched with e edits.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > threshold:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common prefix, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    if low:
        a, b = a[:-low], b[:-low]
    k, m, n = threshold, len(a), len(b)
    band = (1 << (2 * k + 1)) - 1
    level = [sum(1 << (i + k) for i in range(min(e, m) + 1)) for e in range(k + 1)]
    for j in range(n):
        c, equal = b[j], 0
        for p in range(max(0, k - j), min(2 * k + 1, m - j + k)):
            if a[j - k + p] == c:
                equal |= 1 << p
        inside = ((1 << max(0, min(2 * k + 1, m - j - 1 + k + 1))) - 1) & band & ~((1 << max(0, k - j - 1)) - 1)
        new: list[int] = []
        for e in range(k + 1):
            x = level[e] & equal
            if e:
                x |= level[e - 1] | level[e - 1] >> 1 | new[e - 1] << 1
            new.append(x & inside)
        level = new
        if not level[k]:
            return False
    return any(x >> (m - n + k) & 1 for x in level)


def _eligible(line: Column, shortest: int) -> Column:
    return (F.length(line) >= shortest) & line.rlike(f"[^{SPACE}]")


def _probe_rows(docs: DataFrame, threshold: int, least: int) -> DataFrame:
    """(key, id, sign): each distinct line of a task once; bit 0 of sign marks its own segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans: dict[int, list] = {}
        keys: list[int] = []
        ids: list[int] = []
        signs: list[int] = []

        def flushed() -> pa.RecordBatch:
            out = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(signs, pa.uint64()).view(pa.int64())]
            for held in (keys, ids, signs):
                held.clear()
            return pa.RecordBatch.from_arrays(out, names=["key", "id", "sign"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) < least or (ident := line_hash(line)) in seen:
                        continue
                    seen.add(ident)
                    sign = signature(line)
                    found = keys_of(line, threshold, plans)
                    keys += found
                    ids += [ident] * len(found)
                    signs += [sign | own for own in found.values()]
                if len(keys) > HELD_ROWS:
                    yield flushed()
        if keys:
            yield flushed()

    return docs.select("text").mapInArrow(lean(run), "key long, id long, sign long")


def _near_pairs(threshold: int):
    """Pairs of a block, one with its own segment, whose signatures differ by what the edits allow."""
    shifts = np.arange(4, 64, 4, dtype=np.uint64)

    def pairs(c: dict[str, np.ndarray], lo: int, hi: int) -> list[np.ndarray]:
        sign, ident = c["sign"].view(np.uint64), c["id"]
        own = np.flatnonzero(sign & np.uint64(1))
        counts = (sign[:, None] >> shifts & np.uint64(15)).astype(np.int16)
        found = []
        for i in own:
            differ = np.abs(counts - counts[i])
            near = np.minimum(differ, 16 - differ).sum(1) <= 2 * threshold
            near &= ident != ident[i]
            if lo != hi:
                near &= c["tile_of"] != c["tile_of"][i]
            j = np.flatnonzero(near)
            if len(j):
                found.append((np.full(len(j), ident[i]), ident[j]))
        if not found:
            return [np.empty(0, np.int64), np.empty(0, np.int64)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return [pair[:, 0], pair[:, 1]]

    return pairs


def _lines_of(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(id, line) of the wanted lines."""
    bits = bit_filter(ids, "id")
    split = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.length("line") >= least)
    placed = split.select(F.xxhash64("line").alias("id"), "line").select("id", "line", F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)).cast("int").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hit = passes(bits, b.column("place").to_numpy())
            for i, ident in zip(np.flatnonzero(hit), b.column("id").to_numpy()[hit].tolist(), strict=True):
                if ident in seen:
                    hit[i] = False
                seen.add(ident)
            if hit.any():
                kept = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("line")], names=["id", "line"])

    return placed.mapInArrow(lean(run), "id long, line string").join(ids, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def near_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """All links (a, b) between different lines of ``least`` characters or more, by hash, within the edit threshold.

    Null and empty texts have no line; other columns than text aren't looked at.
    """
    met = stored(shared_keys(_probe_rows(docs, threshold, least)), "segments")
    pairs = stored(map_blocks(blocks(met), _near_pairs(threshold), "a long, b long", ["a", "b"]).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    lines = stored(_lines_of(docs, ids, least), "lines")
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [within(x, y, threshold) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            kept = b.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    near = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(verify), "a long, b long"), "near")
    drop(met, pairs, lines)
    return near


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, shortest: int = 1) -> DataFrame:
    """Lines to remove from every document.

    Equal lines are in one class, and lines of ``least`` characters or more if a
    chain of lines within the edit threshold joins them; the first of each class
    by (doc_id, line number) stays, the others are removed. Lines without a word
    and those of less than ``shortest`` characters always stay. A null text has no line and nothing to remove; nor has a
    document without a doc_id. Rows of the same doc_id are one document whose
    equally numbered lines count as one. A line is known by its 64-bit hash.

    Returns doc_id, n_lines, n_removed, removed (line numbers from 0), one row
    per distinct doc_id that has a line long enough.
    """
    own = docs.where("doc_id is not null").select("doc_id", "text")
    return _removed(near_lines(docs, threshold, least), own, ["doc_id"], shortest)


def _removed(near: DataFrame, docs: DataFrame, by: list[str], shortest: int) -> DataFrame:
    """Lines to remove of each document; ``by`` orders documents, its last column tells them apart and is never null."""
    key = by[-1]
    component = components(near)
    each = docs.where("text is not null").select(*by, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(_eligible(F.col("line"), shortest))
    placed = stored(each.select(*by, "line_no", F.xxhash64("line").alias("id")), "places")
    first = F.min(F.struct(*by, "line_no")).alias("first")
    by_line = placed.groupBy("id").agg(first)  # lines before classes: each distinct line is one row from here on
    kept = by_line.join(component, "id", "left").groupBy(F.coalesce("component", "id").alias("klass")).agg(F.min("first").alias("first")).select(f"first.{key}", "first.line_no", F.lit(True).alias("kept"))
    marked = placed.join(kept, [key, "line_no"], "left")
    return marked.groupBy(key).agg(F.countDistinct("line_no").alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("kept").isNull(), F.col("line_no")))).alias("removed")).select(key, "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def digest(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per document: its lines that count, and the removed ones."""
    all_ = docs.select("doc_id").join(removed, "doc_id", "left")
    return all_.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def without_repeats(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without their removed lines; one left without any word goes. n_chars follows the text."""
    cut = removed.where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed"))
    joined = docs.join(cut, F.col("doc_id") == F.col("__id"), "left")
    return _shortened(joined).select(*docs.columns)


def _shortened(rows: DataFrame) -> DataFrame:
    """Texts without the lines of ``__removed`` (null: none); a row left without any word goes."""
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    out = rows.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(left)).where(F.col("__removed").isNull() | F.col("text").rlike(f"[^{SPACE}]"))
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out


@safely_named
def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, shortest: int = LEAST) -> DataFrame:
    """The documents without repeated lines; every row is a document of its own.

    Rows are in the order of doc_id, those without one last; rows of one doc_id
    are ordered by a hash. Of equal rows, all but one lose every line of
    ``shortest`` characters or more; shorter lines, such as an answer in one
    word, stay where they are. Null and empty texts stay as they are; a row that
    is left without any word goes. An empty table gives an empty one.
    """
    rows = counted_rows(docs).withColumn("__none", F.col("doc_id").isNull())
    found = _removed(near_lines(rows.select(F.col("__row").alias("doc_id"), "text"), threshold, least), rows, ["__none", "doc_id", "__row"], shortest)
    cut = found.where("n_removed > 0").select("__row", F.col("removed").alias("__removed"))
    once = _shortened(rows.join(cut, "__row", "left")).select(*docs.columns)
    places = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(_eligible(x, shortest), i)), lambda i: i.isNotNull())
    again = rows.where("__n > 1").withColumn("__removed", F.when(F.col("text").isNotNull() & (F.size(places) > 0), places))
    return once.unionByName(times(_shortened(again), F.col("__n") - 1, docs.columns))
