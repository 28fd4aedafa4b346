"""Operators 11 to 13 against brute force on small fixtures, and edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from voxara.llm import divergence, neighbours, resampling

VECTORS = "vec_id long, embedding array<float>, label int, h1 long, part string, `a.b` int"


# 11. Approximate nearest neighbours
def _search(vectors, every, k):
    """query -> [(distance, id)], over rows (id, vector); equal rows once."""
    rows = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = collections.defaultdict(list)
    for row in rows:
        if row[0] % every == 0:
            gaps = [(math.sqrt(float(((np.array(row[1], float) - np.array(v, float)) ** 2).sum())), i) for i, v in rows if (i, v) != row and len(v) == len(row[1])]
            out[row[0]].append(sorted(gaps)[:k])
    return out


def _vectors(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x)]


def test_small_tables_are_searched_exactly(spark):
    rows = _vectors(150, 5, 4, 1)
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(40)]  # more copies than neighbours
    rows += [(2000, None), (2010, []), (2020, [0.0] * 5), (2030, [1.0, None, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 5), (2050, [float("inf")] + [1.0] * 4), (None, same)]
    rows += [(3000, [1.0, 2.0]), (3001, [1.0, 3.0]), (3005, [0.5, 2.0])]  # another length
    rows += [(20, same), rows[30], rows[30]]  # an id with two vectors; a row three times
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame([(*r, 0, 1, "p", 2) for r in rows], VECTORS), every=10, neighbours=10).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    expected = _search(rows, 10, 10)
    assert set(got) == set(expected) and len(expected[20]) == 2
    for q, lists in expected.items():
        assert sorted((k, round(d, 9), v) for k, d, v in got[q]) == sorted((k + 1, round(d, 9), v) for hits in lists for k, (d, v) in enumerate(hits))


def test_empty_and_lone_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0], 0, 0, "", 0)], VECTORS)).count() == 0


@pytest.mark.parametrize(("clusters", "seed"), [(1, 2), (40, 3)])
def test_learned_partitions_find_neighbours(spark, monkeypatch, clusters, seed):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "TILE", 3)
    monkeypatch.setattr(neighbours, "SAMPLE", 1600)
    rows = _vectors(4000, 16, clusters, seed)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame([(*r, 0, 1, "p", 2) for r in rows], VECTORS), every=50).collect():
        got[r.query_id].add(r.vec_id)
    expected = _search(rows, 50, 10)
    hits = sum(len(got[q] & {v for _, v in e[0]}) for q, e in expected.items())
    assert set(got) == set(expected) and all(len(g) == 10 for g in got.values())
    assert hits / (10 * len(expected)) >= 0.9


def test_parts_are_balanced_and_keep_neighbours():
    x = np.array([v for _, v in _vectors(800, 8, 16, 4)])
    near = neighbours._nearest(x, x, 9)
    near = np.stack([r[r != i][:8] for i, r in enumerate(near)])
    before = neighbours.halved(x, 8)
    after = neighbours.balanced_parts(near, before, 8)
    assert np.bincount(before, minlength=8).tolist() == np.bincount(after, minlength=8).tolist() == [100] * 8
    home = lambda p: (p[near] == p[:, None]).mean()
    assert home(after) >= home(before) > 1 / 8


def test_few_probes_where_vectors_cluster():
    x = np.array([v for _, v in _vectors(4000, 16, 32, 5)])
    router = neighbours.fit(x, 10)
    assert router.scores(x).shape[1] >= 16 and router.probes <= router.scores(x).shape[1] // 4


# 12. Target-distribution importance resampling
DOCS = "doc_id long, text string, lang string, source string, n int, weight int, t1 string, line string, `a.b` int"
TEXTS = ["The cat sat.\nThe cat sat.\nthe dog", None, "", " \n\n--\n", "École été ÉCOLE x1 X1\r\na_b [c]", "one", "the cat sat.\nThe cat sat.\nthe dog", "\nlead\n\ntail\n", "w " * 3000 + "\n" + "v\n" * 500, *["many words stand in this one line so that it can be drawn at last by its own score and no other"] * 3]


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def _resampled(docs, target, order, percent=10, least=20):
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(_features(x, order)[1])
    for x in target:
        t.update(_features(x, order)[1])
    big_s, big_t, rows = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        words, f = _features(x, order)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], place.get(id(r))) for r in rows]


def _documents(spark, texts, ids):
    return spark.createDataFrame([(i, t, "en", "a", 1, 2, "t", "l", 3) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_matches_brute_force(spark, order):
    r = random.Random(order)
    lines = [" ".join(r.choice("the cat Dog été 漢字 x9 Zed one two".split()) for _ in range(r.randint(0, 9))) for _ in range(25)]
    texts = TEXTS + ["\n".join(r.choice(lines) for _ in range(r.randint(1, 12))) for _ in range(60)]
    ids = [*range(len(texts) - 2), None, 3]  # no id; an id twice
    texts[-1] = texts[3]  # the same row twice
    target = ["the cat été", None, lines[0] + "\n" + lines[1], "the\ncat\n\ndog"]
    aim = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resampling.resample(_documents(spark, texts, ids), aim, percent=30, least_words=10, order=order).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(_resampled(list(zip(ids, texts, strict=True)), target, order, 30, 10), key=key)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(_documents(spark, [], []), none).count() == 0
    assert [r.weight for r in resampling.resample(_documents(spark, ["", "a"], [1, 2]), none).orderBy("doc_id").collect()] == [0, math.floor(1000 * math.log(10_001 / 20_000))]


def test_crossing_runs_and_lines_make_all_runs():
    r = random.Random(5)
    for _ in range(300):
        lines = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 6))]
        for order in (1, 2, 4):
            whole = resampling._runs([w for line in lines for w in line], order)
            parts = [f for line in lines for f in resampling._runs(line, order)] + resampling.crossing_runs(lines, order)
            assert sorted(whole) == sorted(parts)


# 13. Source divergence audit
def _audited(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)) for lang, source, text in docs]
    words = [(lang, source, [_lower(w) for w in ws]) for lang, source, ws in words]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(w for g, _, ws in words if g == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        count = {s: collections.Counter(w for g, x, ws in words if (g, x) == (lang, s) for w in ws if w in kept) for s in {d[1] for d in docs if d[0] == lang}}
        every = sum(count.values(), collections.Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(-sum(f(share(c, w), share(count[o], w)) for w in kept), o.encode(), o) for o in count if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            marks = [(-f(share(c, w), share(every, w)), w.encode(), w) for w in kept if c[w] and share(c, w) > share(every, w)]
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(marks)[:top])]
    return sorted(out)


AUDIT = "lang string, source string, text string, term int, n int, g string, `a.b` int"


@pytest.mark.parametrize(("held", "piece"), [(200_000, 1 << 20), (7, 4)])
def test_audit_matches_brute_force(spark, monkeypatch, held, piece):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PIECE", piece)
    r = random.Random(7)
    vocabulary = ["the", "Cat", "été", "ÉTÉ", "漢字", "dog", "x", "zed", "𝒳", "ﬀ", *(f"w{chr(97 + k)}" for k in range(20))]
    docs = [(r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", "é", None]), " ".join(r.choice(vocabulary[: r.randint(3, 30)]) for _ in range(r.randint(0, 30)))) for _ in range(150)]
    docs += [("en", s, "The same CAT\nwords, again; again") for s in "aaabbcz"] + [("en", "a", None), ("en", "empty", ""), ("de", "lone", "ein Wort"), ("it", "p", "rare"), ("it", "q", None)]
    docs += [("en", "long", "the cat " * 20_000)]
    got = divergence.audit(spark.createDataFrame([(*d, 1, 2, "g", 3) for d in docs], AUDIT), least_docs=3, top=4).collect()
    assert sorted(map(tuple, got)) == _audited(docs, 3, 4)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], AUDIT)).count() == 0


def test_shares_of_great_counts(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(9 * 10**15, 10**16, 10**6)], "c long, n long, v long")
    assert big.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 2 * 10**6)


def test_terms_have_the_bytes_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + "漢字 A_b-C ﬀ𝒳"
    assert [t.decode() for t in divergence.terms_of(text.encode())] == [_lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [t.decode() for t in resampling.words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    assert list(itertools.chain(divergence.terms_of(b""), resampling.words_of(b""))) == []
