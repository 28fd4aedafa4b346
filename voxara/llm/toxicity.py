"""Toxicity by a weighted lexicon (operator 6).

Texts are folded (case, accents, homoglyphs, digits in place of letters) and
an Aho-Corasick automaton finds the lexicon's entries, which begin at a word's
start: whole words, or stems. Weights are log-odds learned from a bounded
sample of labelled documents. Hits within exception phrases don't count: given
ones, and pairs of words that hold an entry but stand in clean documents of the
sample rather than in toxic ones. The sum of weights is normalised by the
text's length.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import lean, own_columns, stored

#: Labelled documents that a lexicon is learned from, at most.
SAMPLE_ROWS = 20_000
#: Clean documents of the sample that a learned exception stands in, at least.
EXCEPTION_ROWS = 4
#: Entries a task counts before it passes them on.
HELD_ENTRIES = 150_000
#: Predicted toxic from this score on.
CUT = 0.3
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "white trash bag", "scum line")

# Letters of other scripts that look like Latin ones, and characters used for letters.
_LOOKALIKES = dict(zip("аеорсухікѕјԁһαοενρτυχι", "aeopcyxiksjdhaoevptuxi", strict=True)) | {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
STEMS = (4, 5, 6, 7)


def _folding() -> dict[int, str]:
    table = {c: "" for c in range(0x300, 0x370)}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        table[c] = base if base.isascii() else chr(c).lower()
    for c in range(0x400, 0x460):
        low = chr(c).lower()
        table[c] = _LOOKALIKES.get(low, low)
    for c in range(0x370, 0x400):
        low = chr(c).lower()
        table[c] = _LOOKALIKES.get(low, low)
    # Letters and digits that are compatible with plain ones: full-width, mathematical, circled, letter-like.
    for c in [*range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA), *range(0x2100, 0x2150), *range(0x2070, 0x20A0)]:
        plain = unicodedata.normalize("NFKC", chr(c)).lower()
        if plain.isascii() and plain.isalnum():
            table[c] = "".join(_LOOKALIKES.get(x, x) for x in plain)
    return table | {ord(k): v for k, v in _LOOKALIKES.items()} | {c: chr(c + 32) for c in range(65, 91)}


_FOLD = _folding()
_WORDS = re.compile(r"[^\W_]+")


def folded_words(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_FOLD))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places in order, in spans that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Lexicon:
    """Entries: a folded word followed by a space, or a stem without one; all begin at a word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Normalised weight that scores CUT.
    middle: float = 1.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "middle": self.middle, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(" " + entry, (len(entry) + 1, w))
            for phrase in self.exceptions:
                a.add_word(" " + " ".join(folded_words(phrase)) + " ", (len(phrase) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str) -> tuple[float, int]:
        """Sum of the strongest hit of each word outside exception phrases, and the number of words."""
        words = folded_words(text)
        if not words or not self.weights:
            return 0.0, len(words)
        flat = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton().iter(flat):
            start = end + 1 - size
            if w is None:
                excepted.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        spans = merged(excepted)
        starts = [a for a, _ in spans]
        outside = lambda s: (k := bisect_right(starts, s)) == 0 or s >= spans[k - 1][1]
        return sum(w for s, w in best.items() if outside(s)), len(words)

    def hits(self, words: list[str]) -> set[int]:
        """Places of the words at which an entry begins."""
        if not words or not self.weights:
            return set()
        starts = {at: i for i, at in enumerate(itertools.accumulate((len(w) + 1 for w in words), initial=0))}
        flat = " " + " ".join(words) + " "
        return {starts[end + 1 - size] for end, (size, w) in self.automaton().iter(flat) if w is not None}

    def normalised(self, text: str) -> float:
        total, n = self.weigh(text)
        return total / math.sqrt(1.0 + n / 100.0)

    def score(self, text: str) -> float:
        """0 to 1; ``middle`` scores CUT, and more weight in fewer words scores higher."""
        x = self.normalised(text)
        return x / (x + self.middle * (1 - CUT) / CUT) if x > 0 else 0.0


def in_training(doc_id: int | None) -> bool:
    """Whether labels of the document may be learned from; one without a doc_id has no label, and isn't held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, text, toxic), chosen by a hash of doc_id."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    chosen = training.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The sample has ``rows`` rows at most, so it may be sent to every task.
    return own_columns(docs, "doc_id", "text").join(F.broadcast(stored(chosen, "labels")), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the bounded sample: log-odds of words and stems, by the documents they stand in.

    Its size is bounded by the sample's. Null texts count as empty; labels that
    are null or of no document are left out, and of several labels of one
    document the highest counts. Without labels of both kinds, or documents,
    the lexicon is empty and scores everything 0.
    """
    sample = stored(labelled_sample(docs, labels, sample_rows), "sample")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["entry", "clean", "toxic"])
            counts.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(folded_words(text))
                for e in {w + " " for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}:
                    counts.setdefault(e, [0, 0])[1 if toxic else 0] += 1
                if len(counts) > HELD_ENTRIES:
                    yield flushed()
        if counts:
            yield flushed()

    counted = sample.select("text", "toxic").mapInArrow(lean(entries), "entry string, clean long, toxic long")
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = max(3, n_toxic // 400)
    strong = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("weight", odds)
    # Clean documents hold an entry of the lexicon at a twentieth of the rate of toxic ones, at most.
    top = strong.where((F.col("toxic") >= least) & (F.col("weight") >= math.log(20))).orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "entry").collect()
    chosen: dict[str, tuple[float, int]] = {}
    for r in sorted(top, key=lambda r: (len(r["entry"]), r["entry"])):
        stems = [r["entry"].rstrip(" ")[:k] for k in STEMS]
        if not any(s in chosen and s != r["entry"] and chosen[s][0] >= r["weight"] - 0.5 for s in stems):
            chosen[r["entry"]] = (r["weight"], r["toxic"])
    found = Lexicon({e: chosen[e][0] for e in sorted(chosen)}, exceptions)
    found = Lexicon(found.weights, (*exceptions, *_learned_exceptions(sample, found, n_clean, n_toxic)))
    found.middle = _middle(sample, found)
    return found


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon, n_clean: int, n_toxic: int) -> list[str]:
    """Pairs of neighbouring words that hold an entry and are commoner among clean documents than among toxic ones."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kinds = [], []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = folded_words(text)
                hits = lexicon.hits(words)
                near = {(i + d, i + d + 1) for i in hits for d in (-1, 0) if i + d >= 0 and i + d + 1 < len(words)}
                phrases = {f"{words[i]} {words[j]}" for i, j in near}
                found += phrases
                kinds += [bool(toxic)] * len(phrases)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(kinds, pa.bool_())], names=["phrase", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(lean(pairs), "phrase string, toxic boolean").groupBy("phrase").agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic"))
    rather = (F.col("clean") >= EXCEPTION_ROWS) & (F.col("clean") * n_toxic > 2 * F.col("toxic") * n_clean)
    return sorted(r["phrase"] for r in counted.where(rather).select("phrase").collect())


def _middle(sample: DataFrame, lexicon: Lexicon, per_unit: int = 20) -> float:
    """The normalised weight that parts the sample best, by F1 over a histogram of bounded length."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [min(2000, math.ceil(per_unit * lexicon.normalised(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), b.column(1).cast(pa.int32())], names=["bin", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(weigh), "bin int, toxic int").groupBy("bin").agg(F.count_if(F.col("toxic") != 0).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).collect()
    total = sum(r["toxic"] for r in rows)
    best, middle = -1.0, 1.0
    hit = false = 0
    for r in sorted(rows, key=lambda r: -r["bin"]):
        hit, false = hit + r["toxic"], false + r["clean"]
        f1 = 2 * hit / (total + hit + false)
        if r["bin"] > 0 and f1 > best + 1e-9:
            best, middle = f1, (r["bin"] - 1) / per_unit
    return max(middle, 1 / per_unit)


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score and prediction of every document from its text alone.

    A null or empty text scores 0. Repeated rows each give a row. Labels,
    language, source and doc_id never enter the score; held_out says whether
    crc32(doc_id) mod 4 is 2. Returns doc_id, held_out, score, predicted, n_words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, scores, sizes = b.column(0).to_pylist(), [], []
            for text in b.column(1).to_pylist():
                total, n = lexicon.weigh(text or "")
                x = total / math.sqrt(1.0 + n / 100.0)
                scores.append(x / (x + lexicon.middle * (1 - CUT) / CUT) if x > 0 else 0.0)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([not in_training(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32()), pa.array(sizes, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_words"])

    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, n_words long")


def remove_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents whose predicted label is 0, with all their columns; one pass, no shuffle.

    Null and empty texts score 0 and stay; every row is decided by its own text.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [lexicon.score(t or "") < CUT for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)
