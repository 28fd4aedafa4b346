"""Exact Jaccard join over word shingles (operator 7).

Shingle sets with the Jaccard distance are a metric space. Sets of unrelated
documents are all at distance 1 from each other, so the triangle inequality
about pivot documents parts none of them (README has figures); a first cut
deals documents into regions in which pivots can work. Shingles are dealt by
hash into one class more than linked sets can differ in, so linked sets agree
in a whole class: a region is a class together with the shingles it must hold,
and a set stands in the regions of its own classes.

Regions are then joined by pivot documents. First each has one pivot, members
near it are compared with it exactly, and regions whose members are all of one
class of links are done. Large regions among the others are parted into the
Voronoi cells of several pivot documents by exact distance, with copies where a
triangle-inequality window reaches another cell; what is far from all pivots
makes one more cell. Cells are parted again until they are small, or until that
spares little. Leaves compare members of different classes exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import counted_rows, drop, free_shuffles, lean, own_columns, safely_named, shuffled, stored, times
from voxara.llm.links import BLOOM_BITS, bit_filter, blocks, bounds, components, map_blocks, passes, shared_keys

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
#: Bits of a set's parity signature, least and most, and bits a shingle between them (README: 7).
PARITY_BITS, PARITY_MOST, PARITY_SHARE = 512, 8192, 0.6
#: Words of signatures that are compared at once.
AT_ONCE = 1 << 18
#: Largest size over smallest size of the sets that share one number of classes, about.
SPREAD = 1.4
#: Share of sets that may need another deal, about, and deals at most.
ANEW, DEALS = 0.05, 40
#: Members of a region that are compared without further pivots, and pivots of a larger one.
LEAF, PIVOTS = 512, 8
WORD_CACHE = 100_000
#: Texts that a task works on at once.
SLICE = 500

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Hashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words' hashes are remembered."""

    def __init__(self, words: int):
        self.k = words
        self.known = _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        # Bytes split at just the six white-space characters that part words.
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        h = np.array(list(map(self.known.__getitem__, words)), np.uint64)
        k = min(self.k, len(h))
        mixed = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * _M[i % len(_M)]
            mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, as what is made of a text may be larger than the text."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _raw(b: pa.RecordBatch, column: int) -> list[bytes | None]:
    return b.column(column).cast(pa.binary()).to_pylist()


def _set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=7) - (1 << 63)


def _parity(s: np.ndarray) -> bytes:
    """Bit k is the parity of the shingles in class k: signatures differ in no more bits than sets in shingles.

    Large sets have more bits, as sets of more shingles may differ in more; their number is a power of two.
    """
    bits = PARITY_BITS
    while bits < min(PARITY_SHARE * len(s), PARITY_MOST):
        bits *= 2
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Signs:
    """Signatures of several widths. The halves of one, added bit by bit, are the signature of half the width."""

    def __init__(self, parity: list[bytes] | np.ndarray):
        self.words = np.array([len(p) // 8 for p in parity], np.int64)
        #: By width: places of the rows that are as wide or wider, and their signatures at that width.
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wider, folded = np.empty(0, np.int64), np.empty((0, 0), np.uint64)
        for width in np.unique(self.words)[::-1].tolist():
            while folded.shape[1] > width:
                half = folded.shape[1] // 2
                folded = folded[:, :half] ^ folded[:, half:]
            own = np.flatnonzero(self.words == width)
            mine = np.frombuffer(b"".join(parity[i] for i in own), np.uint64).reshape(len(own), width)
            wider, folded = np.append(wider, own), np.concatenate([folded, mine]) if len(wider) else mine
            place = np.full(len(self.words), -1)
            place[wider] = np.arange(len(wider))
            self.at[width] = place, folded

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of bits in which the signatures of rows a differ from those of rows b, at the narrower one's width."""
        found, width = np.empty(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for w, (place, sign) in self.at.items():
            k = np.flatnonzero(width == w)
            for piece in np.split(k, range(AT_ONCE // w, len(k), AT_ONCE // w)):
                found[piece] = np.bitwise_count(sign[place[a[piece]]] ^ sign[place[b[piece]]]).sum(1)
        return found


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("parity", pa.binary())])


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: set size, set hash and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in _slices(batches):
            ns, hashes, signs = [], [], []
            for text in _raw(b, 1):
                s = shingles(text)
                ns.append(len(s))
                hashes.append(_set_hash(s) if len(s) else None)
                signs.append(_parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip((ns, hashes, signs), list(_PROFILE)[1:], strict=True)]], schema=_PROFILE)

    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, id long, parity binary")


class Classes:
    """How many classes of shingles sets of about one size have, so that linked ones agree in a whole class.

    Sizes are cut into steps. Two linked sets, the larger of at most ``top``
    shingles, differ in no more than ``differ`` of them. Of ``differ + 1 + spare``
    classes they agree in ``spare`` + 1 at least, so in one that isn't empty, if
    one of them has no more than ``spare`` empty classes. A set with more empty
    ones is dealt by another hash as well, until a deal leaves no more empty:
    both sets of a pair then take part in the first deal that suits either.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def step(self, n: int) -> int:
        """The step that sets of size n are in."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * SPREAD)))
        return bisect_left(self.tops, n)

    def of_step(self, step: int) -> tuple[int, int]:
        """(classes, spare) of the pairs whose larger set is in the step; no classes where only equal sets link."""
        found = self.known.get(step)
        if found is None:
            top, below = self.tops[step], self.tops[step - 1] if step else 0
            differ = 2 * top * (self.den - self.num) // (self.den + self.num)
            least = -(-(below + 1) * self.num // self.den)
            spare = 0
            while differ and spare <= differ:
                empty = (differ + 1 + spare) * (1 - 1 / (differ + 1 + spare)) ** least
                if sum(math.exp(i * math.log(empty) - empty - math.lgamma(i + 1)) for i in range(spare + 1)) >= 1 - ANEW:
                    break
                spare += 1
            found = self.known[step] = (differ + 1 + spare if differ else 0, spare)
        return found

    def steps(self, n: int) -> range:
        """The steps in which a set of size n may have partners of its size or larger, or be the larger one."""
        return range(self.step(n), self.step(n * self.den // self.num) + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    return x ^ (x >> np.uint64(29))


def region_keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """Keys of the regions that a sorted set of shingle hashes stands in."""
    found = []
    for step in classes.steps(len(s)):
        count, spare = classes.of_step(step)
        if not count:
            continue
        dealt = s
        for deal in range(DEALS):
            # Classes are ranges of the hash, so each is a run of the sorted set.
            of = (dealt >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            found.append(_mixed(np.add.reduceat(_mixed(dealt), start) + (of[start] + np.uint64((step << 40) + (deal << 56))) * _M[2]))
            if count - len(start) <= spare:
                break
            dealt = np.sort(_mixed(dealt * _M[3]))
        else:
            found.append(np.array([step + 1], np.uint64))  # what no deal suits meets in one region
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _regions(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, id): each set in its regions; every set once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, classes, seen = Shingler(words), Classes(num, den), set()
        for b in _slices(batches):
            keys, ids, sizes = [], [], []
            for text in _raw(b, 1):
                s = shingles(text)
                if not len(s) or (ident := _set_hash(s)) in seen:
                    continue
                seen.add(ident)
                keys.append(region_keys(s, classes))
                ids.append(ident)
                sizes.append(len(keys[-1]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes))], names=["key", "id"])

    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), "key long, id long")


def _star(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each region's pivot document, and bounds of every member's distance to it.

    ``near`` says that the exact distance to the pivot is worth computing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, pivot, pivot_n, pivot_sign = None, 0, 0, b""
        for b in batches:
            if not b.num_rows:
                continue
            key, ident, n, parity = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "parity"))
            at = bounds(key)
            of = np.repeat(at[:-1], np.diff(at))
            p, pn, signs = ident[of], n[of], list(parity)
            if key[0] == open_key:
                p[: at[1]], pn[: at[1]], of[: at[1]] = pivot, pivot_n, len(n)
                signs.append(pivot_sign)
            differ = np.maximum(Signs(signs).differ(np.arange(len(n)), of), np.abs(n - pn))
            low = 2 * differ / (n + pn + differ)  # |x - y| >= differ bounds the distance from below
            near = (den - num) * (n + pn) >= (den + num) * differ
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(p), pa.array(low.astype(np.float32)), pa.array(near & (p != ident))], names=["key", "id", "pivot", "low", "near"])
            open_key, pivot, pivot_n, pivot_sign = key[-1], p[-1], pn[-1], signs[of[-1]]

    return rows.repartition(F.col("key")).sortWithinPartitions("key", F.desc("rank"), "id").mapInArrow(lean(run), "key long, id long, pivot long, low float, near boolean")


#: Share of a link's similarity beyond which a member is outside of a pivot's cell.
RADIUS = 0.6


def _near_pivots(rows: DataFrame, pivots: DataFrame, reach: float) -> DataFrame:
    """(key, id, pivot): the pivots of its region that a member's signature doesn't put beyond ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, ident, n = (b.column(c).to_numpy() for c in ("key", "id", "n"))
            of, found = {int(k): b.column("pivots")[int(first)].as_py() for k, first in zip(*np.unique(key, return_index=True), strict=True)}, []
            signs, last = Signs([*b.column("parity").to_pylist(), *(bytes.fromhex(p["sign"]) for pivots in of.values() for p in pivots)]), len(n)
            for k, pivots in of.items():
                at = np.flatnonzero(key == k)
                for p in pivots:
                    differ = np.maximum(signs.differ(at, np.full(len(at), last)), np.abs(n[at] - p["n"]))
                    last += 1
                    near = at[2 * differ <= reach * (n[at] + p["n"] + differ)]
                    found.append((key[near], ident[near], np.full(len(near), p["id"])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["key", "id", "pivot"])

    return rows.select("key", "id", "n", "parity").join(shuffled(pivots), "key").mapInArrow(lean(run), "key long, id long, pivot long")


def _parted(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """One level of the recursion: rows of regions of more than LEAF members, dealt to the Voronoi cells of pivot documents.

    A member's home is the cell of its nearest pivot by exact Jaccard distance,
    if that is within a radius, else the cell of what is far from all pivots.
    Copies go where the triangle inequality allows a partner's home: to cells
    whose pivot is at most two link distances farther than the nearest one and
    within the radius and one, and to the far cell from a link distance below
    the radius on. So linked members meet in the home of either. Distances are
    computed where signatures leave a pivot in reach, others decide nothing.
    Rows get the cell's key and ``from_key``, and are stored.
    """
    eps, slack = 1 - num / den, 1e-9
    radius = RADIUS * (1 - eps)
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(PIVOTS))
    drawn = rows.groupBy("key", salt.alias("salt")).agg(F.min_by(F.struct("id", "n", F.hex("parity").alias("sign")), F.xxhash64("id")).alias("pivot"))
    pivots = drawn.groupBy("key").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    near = stored(_near_pivots(rows, pivots, radius + eps + slack), "near")
    pairs = near.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    exact = _verify(pairs, sets).select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("d"))
    found = near.join(shuffled(exact), ["id", "pivot"]).groupBy("key", "id").agg(F.min("d").alias("home"), F.collect_set(F.struct("pivot", "d")).alias("each"))  # PIVOTS at most
    placed = rows.join(shuffled(found), ["key", "id"], "left")
    reached = F.filter("each", lambda p: (p["d"] <= radius + eps + slack) & (p["d"] <= F.col("home") + 2 * eps + slack))
    cells = F.coalesce(F.transform(reached, lambda p: p["pivot"]), F.array().cast("array<bigint>"))
    far = F.when(F.coalesce(F.col("home") > radius - eps - slack, F.lit(True)), F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    dealt = placed.withColumn("cell", F.explode(F.concat(cells, far)))
    # A hash passes over nulls: the far cell's key is that of the region alone.
    out = stored(dealt.select(F.xxhash64("key", "cell").alias("key"), *[c for c in rows.columns if c != "key"], F.col("key").alias("from_key")), "cells")
    drop(near)
    return out


def voronoi(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, read: list[DataFrame] | None = None) -> DataFrame:
    """Rows (key, id, n, parity, ...) of regions, large ones parted recursively where that spares comparisons.

    ``sets_of`` gives the shingles (id, shingles) of ids, stored; it is asked
    once, for the members of all large regions. A region that pivots part into
    little smaller cells stays whole. The stored tables that the rows are read
    from go to ``read``, to be dropped after them.
    """
    done, left, sets, read = [], rows, None, [] if read is None else read
    while True:
        size = left.groupBy("key").agg(F.count("*").alias("size"))
        large = stored(size.where(F.col("size") > LEAF), "large")
        read.append(large)
        if large.isEmpty():
            break
        done.append(left.join(large, "key", "left_anti"))
        # Written once: each step of the parting reads these rows.
        inner = stored(left.join(large.select("key"), "key"), "inner")
        sets = sets_of(inner.select("id").distinct()) if sets is None else sets
        cells = _parted(inner, sets, num, den)
        each = cells.groupBy("from_key", "key").agg(F.count("*").cast("double").alias("n"))
        gain = each.groupBy("from_key").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        parted = stored(large.join(gain, F.col("key") == F.col("from_key")).where("pairs <= 0.7 * size * size").select("from_key"), "gain")
        done.append(inner.join(parted, F.col("key") == F.col("from_key"), "left_anti"))
        left = cells.join(parted, "from_key", "left_semi").select(*rows.columns)
        read += [inner, cells, parted]
    for d in done:
        left = left.unionByName(d)
    if sets is not None:
        drop(sets)
    return left


def _of_several_classes(rows: DataFrame) -> DataFrame:
    """Rows of the regions whose members aren't all of one class; others have nothing left to join."""
    narrow = rows.repartition(F.col("key"))
    several = narrow.groupBy("key").agg(F.min("klass").alias("a"), F.max("klass").alias("b")).where("a <> b").select("key")
    return narrow.join(shuffled(several), "key")


def _crossing(eps: float, num: int, den: int):
    """Pairs of a block that are of different classes and that no bound parts."""

    def pairs(c: dict[str, np.ndarray], lo: int, hi: int) -> list[np.ndarray]:
        klass = c["klass"]
        none = [np.empty(0, np.int64), np.empty(0, np.int64)]
        if (klass == klass[0]).all():
            return none
        order = np.argsort(c["n"], kind="stable")
        c = {k: v[order] for k, v in c.items()}
        n, found = c["n"], []
        for i in range(len(n) - 1):
            # Sizes ascend: partners end where a size is too large.
            end = int(np.searchsorted(n, den * n[i] // num, "right"))
            j = np.arange(i + 1, end)
            if lo != hi:
                j = j[c["tile_of"][j] != c["tile_of"][i]]
            j = j[c["klass"][j] != c["klass"][i]]
            # Triangle inequality about the pivot.
            j = j[(c["low"][j] - c["high"][i] <= eps) & (c["low"][i] - c["high"][j] <= eps)]
            if len(j):
                found.append((np.full(len(j), i), j))
        if not found:
            return none
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        near = (den - num) * (n[i] + n[j]) >= (den + num) * Signs(c["parity"]).differ(i, j)
        a, b = c["id"][i[near]], c["id"][j[near]]
        return [np.minimum(a, b), np.maximum(a, b)]

    return pairs


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersections of the pairs (a, b)."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    return pairs.join(shuffled(left), "a").join(shuffled(right), "b").select("a", "b", both.alias("both"), F.size("left").cast("long").alias("n_a"), F.size("right").cast("long").alias("n_b"))


def _sets_of(docs: DataFrame, profile: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the wanted set ids, computed again from one document of each."""
    wanted = stored(profile.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(shuffled(ids), "id"), "wanted")
    bits = bit_filter(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in _slices(batches):
            hit = passes(bits, b.column(2).to_numpy())
            found = [s for t in _raw(b.filter(pa.array(hit)), 1) if len(s := shingles(t))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "shingles"])

    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).cast("int").alias("place"))
    # The filter spares work; the join takes out what else passes it. A set that comes twice meets the same pairs again.
    sets = stored(placed.mapInArrow(lean(run), "id long, shingles array<bigint>").join(shuffled(ids), "id", "left_semi"), "sets")
    drop(wanted)
    return sets


def _checked(pairs: DataFrame, docs: DataFrame, profile: DataFrame, words: int) -> DataFrame:
    """Exact intersections of stored pairs (a, b), stored."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = _sets_of(docs, profile, ids, words)
    out = stored(_verify(pairs, sets), "checked")
    drop(sets)
    return out


def jaccard_classes(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """Connected classes of documents whose shingle sets link at Jaccard num/den or more.

    A document with fewer than ``words`` words has its whole word sequence as
    one shingle; a null or empty text, or one of white space, has no shingle
    and links with nothing. Rows that repeat a doc_id are documents of their
    own, and each gets a row. Equal sets are joined once. A set is known by a
    64-bit hash, as is a shingle. A row without a doc_id has a row as well, with
    the smallest doc_id of its class, or null.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable).
    """
    eps = 1 - num / den
    profile = stored(_profile(docs, words), "profile")
    region = stored(shared_keys(_regions(docs, words, num, den)), "regions")
    free_shuffles(docs.sparkSession)  # the widest one is not needed beside the next
    rank = region.groupBy("id").agg(F.count("*").alias("rank"))
    node = stored(profile.where("id is not null").groupBy("id").agg(F.first("n").alias("n"), F.first("parity").alias("parity")).join(shuffled(rank), "id"), "nodes")
    starred = stored(_star(region.join(shuffled(node), "id").select("key", "id", "n", "parity", "rank"), num, den), "starred")
    drop(region)
    first = stored(starred.where("near").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "first")
    checked = _checked(first, docs, profile, words)
    linked = F.expr(f"{den} * both >= {num} * (n_a + n_b - both)")
    classes = components(checked.where(linked).select("a", "b"))

    distance = checked.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("exact"))
    at_pivot = F.col("pivot") == F.col("id")
    windows = (
        starred.join(shuffled(distance), ["pivot", "id"], "left")
        .join(shuffled(classes), "id", "left")
        .select("key", "id", F.when(at_pivot, 0.0).otherwise(F.coalesce("exact", "low")).alias("low"), F.when(at_pivot, 0.0).otherwise(F.coalesce("exact", F.lit(1.0))).alias("high"), F.coalesce("component", "id").alias("klass"))
    )
    # Signatures are wide, so they join only what is left after regions of one class have gone.
    open_ = stored(_of_several_classes(windows).join(shuffled(node.select("id", "n", "parity")), "id").select("key", "id", "n", "parity", "low", "high", "klass"), "open")
    read: list[DataFrame] = []
    cells = voronoi(open_, lambda ids: _sets_of(docs, profile, ids, words), num, den, read)
    crossing = map_blocks(blocks(cells), _crossing(eps + 1e-6, num, den), "a long, b long", ["a", "b"])
    second = stored(crossing.distinct().join(shuffled(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), ["a", "b"], "left_anti"), "crossing")
    drop(starred, node, open_, first, *read)
    late = _checked(second, docs, profile, words)
    linked_all = checked.where(linked).select("a", "b").union(late.where(linked).select("a", "b"))
    component = components(linked_all)
    drop(checked, late, second)

    placed = profile.join(shuffled(component), "id", "left").select("doc_id", "n", F.coalesce("component", "id").alias("klass"))
    smallest = placed.where("klass is not null").groupBy("klass").agg(F.min("doc_id").alias("least"))
    return placed.join(shuffled(smallest), "klass", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


@safely_named
def dedup_documents(docs: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """One row of each class of linked documents, with all columns.

    Every row is a document of its own, whether or not its doc_id is null or
    repeated. The row with the smallest doc_id stays, one without a doc_id only
    if the class has no other; among rows of one doc_id a hash decides. A row
    without shingles links with nothing and stays.
    """
    rows = counted_rows(docs)
    classes = jaccard_classes(rows.select(F.col("__row").alias("doc_id"), "text"), num, den, words)
    named = classes.select(F.col("doc_id").alias("__row"), "n_shingles", "component_id").join(shuffled(rows.select("__row", "doc_id")), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row"), (F.col("n_shingles") == 0).alias("empty"))
    first = named.groupBy("component_id").agg(F.min(order).alias("first")).select("first.__row", F.col("first.empty").alias("__empty"))
    return times(rows.join(shuffled(first), "__row"), F.when(F.col("__empty"), F.col("__n")).otherwise(1), docs.columns)
