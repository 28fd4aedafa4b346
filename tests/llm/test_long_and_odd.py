"""Very long texts in linear time, and columns of any name."""

import re
import time

import pytest
from pyspark.sql import functions as F

from voxara.llm import jaccard, lines, secrets, toxicity


def test_spans_of_many_matches(spark):
    pattern = "[0-9a-f]{6,}"
    texts = ["", "no match at all", "zz 0123456789 é漢 abcdef012345", " ".join(f"x{n:06x}é" for n in range(130)), " ".join(f"{n:06x}" for n in range(64)), " ".join(f"{n:06x}" for n in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    start = time.time()
    got = {r.i: [tuple(s) for s in r.spans] for r in df.select("i", secrets.match_spans(F.col("text"), pattern).alias("spans")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}
    assert time.time() - start < 60  # appended one by one, these took minutes


def test_exceptions_of_a_long_text():
    lexicon = toxicity.Lexicon({"scum ": 2.0, "trash ": 1.0}, ("trash can", "can scum"))
    start = time.time()
    assert lexicon.weigh("trash can scum " * 40_000) == (0.0, 120_000)
    assert lexicon.weigh("trash can trash scum " * 30_000) == (30_000 * 3.0, 120_000)
    assert time.time() - start < 5


def test_merged_spans():
    assert toxicity.merged([]) == [] and toxicity.merged([(5, 9), (0, 3), (2, 4), (9, 12), (20, 21)]) == [(0, 4), (5, 12), (20, 21)]


NAMES = ["doc_id", "text", "__row", "__n", "__none", "__removed", "__empty", "a.b", "__0", "__key", "column3", "source", "lang", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark):
    near = "one line that stands in several of the documents of this table as it is and once more so"
    rows = [(1, f"{near}\nalone here with words of its own"), (2, f"{near}\nanother last line that nothing else has"), (3, None), (4, f"{near}\nalone here with words of its own"), (None, "without an id but with a line of some length")]
    rows = [(*r, f"row{i}", f"n{i}", f"none{i}", f"r{i}", f"e{i}", f"ab{i}", f"zero{i}", f"k{i}", f"c{i}", "s", "en", None) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES))


@pytest.mark.parametrize("stage", [lambda d: lines.dedup_lines(d), lambda d: jaccard.dedup_documents(d, num=80, den=100, words=5)])
def test_columns_keep_their_values(odd, stage):
    before = {r["__row"]: r for r in odd.collect()}
    out = stage(odd)
    rows = out.collect()
    assert out.columns == NAMES and 3 <= len(rows) <= 5
    for r in rows:
        assert all(r[n] == before[r["__row"]][n] for n in NAMES if n not in ("text", "n_chars"))
