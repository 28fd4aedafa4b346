"""Joins of tables that grow alike stay off the driver; stored tables and shuffles go when nothing reads them."""

import numpy as np

from voxara.llm import common, divergence, jaccard


def test_joins_of_sets_are_not_broadcast(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "id long, shingles array<bigint>")
    out = jaccard._verify(spark.createDataFrame([(1, 2)], "a long, b long"), sets)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2, 3, 3)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_divergence_frees_shuffles_before_its_next_step(spark, monkeypatch):
    stored, freed = [], []
    monkeypatch.setattr(divergence, "stored", lambda df, name: stored.append(name) or common.stored(df, name))
    monkeypatch.setattr(divergence, "free_shuffles", lambda s: freed.append(stored[-1]), raising=False)
    docs = spark.createDataFrame([(i, "ab cd", "en", f"s{i % 2}") for i in range(24)], "doc_id long, text string, lang string, source string")
    assert divergence.audit(docs).where("part = 'pair'").count() == 2
    assert freed[0] == "counted"


def test_divergence_shuffles_terms_once_to_count_them(spark):
    docs = spark.createDataFrame([(f"ab cd w{i}", "en", f"s{i % 2}") for i in range(24)], "text string, lang string, source string")
    counted = divergence._counted(divergence._collapsed(docs))
    before = counted._jdf.queryExecution().executedPlan().toString().count("Exchange")
    out = divergence._present(counted, 10)
    assert sorted(map(tuple, out.collect())) == [("en", s, t, 12, 24) for s in ("s0", "s1") for t in ("ab", "cd", "w")]
    # All terms of the widest shuffle, not summed over sources by others after it.
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == before


def test_signatures_of_any_widths_bound_the_difference():
    rng, pool = np.random.default_rng(5), np.random.default_rng(6).integers(0, 2**63, 20000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (3, 700, 900, 2500, 2600, 6000, 15000, 20000)]
    signs = jaccard.Signs([jaccard._parity(s) for s in sets])
    assert len(signs.at) == 5
    for i, x in enumerate(sets):
        got = signs.differ(np.full(len(sets), i), np.arange(len(sets)))
        exact = np.array([len(np.setxor1d(x, y)) for y in sets])
        assert got[i] == 0 and (got <= exact).all() and (got % 2 == exact % 2).all()


def test_large_sets_that_are_far_apart_are_not_compared_exactly(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    shared, pairs = words(1500), {}
    texts = [f"{shared} {words(1500)}" for _ in range(6)]  # half of each is shared, so they meet in regions
    texts.append(texts[0] + " and more")

    def counting(df, name):
        out = common.stored(df, name)
        pairs[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
    assert pairs["regions"] > 7 and pairs["first"] == 1 and pairs["crossing"] == 0
