"""Small groups go to their kernels many at a time, with the results of one at a time."""

import numpy as np
from pyspark.sql import functions as F

from voxara.operators import batches, denoise, slabs


def _images(spark, n):
    rng = np.random.default_rng(3)
    rows = [(s, i, j, k, t, float(rng.rayleigh(4))) for s in range(n) for i in range(3) for j in range(3) for k in range(2) for t in range(2) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "subject long, i int, j int, k int, t int, value double").repartition(3)


def test_blocks_of_many_images_go_together(spark):
    out = slabs.by_blocks(_images(spark, 60), {"i": 3, "j": 3, "k": 2, "t": 2}, 1, lambda a, inside: np.full(a.shape, float(a.shape[3])), block=2, pad="constant")
    most = out.groupBy().agg(F.max("value").alias("m"), F.count("*").alias("n")).first()
    assert most.m > 5 and most.n == 60 * 36


def test_slices_go_together_with_the_same_noise(spark):
    img = _images(spark, 40)
    got = {(r.subject, r.k): r.sigma for r in denoise.piesno(img, {"i": 3, "j": 3, "k": 2, "t": 2}).collect()}
    dense = np.zeros((40, 3, 3, 2, 2))
    for r in img.collect():
        dense[r.subject, r.i, r.j, r.k, r.t] = r.value
    assert got == {(s, k): denoise.slice_noise(dense[s, :, :, k].reshape(9, 2)) for s in range(40) for k in range(2)}
    x = np.random.default_rng(4).rayleigh(4, (7, 30, 5))
    assert denoise.slices_noise(x).tolist() == [denoise.slice_noise(s) for s in x]


def test_groups_stay_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(None if g == 5 else f"g{g}", g % 2, n) for g in range(23) for n in range(g + 1)], "name string, side int, n int")
        def work(rows, which, first):
            import pyarrow as pa

            sides = set(rows.column("side").to_pylist())
            return pa.table([rows.column("name").take(pa.array(first)), pa.array(np.bincount(which)), pa.array([len(sides)] * len(first))], names=["name", "n", "sides"])

        got = batches.by_groups(df, ["name", "side"], work, "name string, n long, sides long", 4, ("side",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.name or "", r.n) for r in got) == sorted(("" if g == 5 else f"g{g}", g + 1) for g in range(23)) and {r.sides for r in got} == {1}


def test_discovery_has_no_shrinking_windows(spark):
    from voxara.operators import statistics

    p = spark.range(200).select(F.col("id").alias("feature"), (F.col("id") % 7 / 10.0).alias("p"))
    out = statistics.false_discovery(p)
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(out.collect(), key=lambda r: (r.p, r.feature))
    least, want = 1e9, []
    for k in range(len(rows), 0, -1):
        least = min(least, rows[k - 1].p * len(rows) / k)
        want.append(least)
    np.testing.assert_allclose([r.q_bh for r in rows], want[::-1])


def test_small_matrices_are_dealt_over_all_tasks(spark):
    from voxara.operators import matrices

    m = spark.createDataFrame([(s, i, j, 1.0) for s in range(200) for i in range(3) for j in range(3) if i != j], "subject long, i int, j int, w double")
    for found in (matrices.shortest_paths(m, 3), matrices.communities(m, 3, 5)):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert {r.efficiency for r in matrices.shortest_paths(m, 3).collect()} == {1.0}


def test_smoothing_shuffles_voxels_once(spark):
    from voxara.operators import images

    img = _images(spark, 4).where("t = 0").select("subject", "i", "j", "k", "value")
    out = images.smooth(img, 0.5, (1.0, 1.0, 1.0), {"i": 3, "j": 3, "k": 2})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    w = lambda n: np.array([[np.exp(-2.0 * (a - b) ** 2) if abs(a - b) <= 2 else 0 for b in range(n)] for a in range(n)])
    dense = np.zeros((4, 3, 3, 2))
    for r in img.collect():
        dense[r.subject, r.i, r.j, r.k] = r.value
    ws = [w(n) / w(n).sum(1, keepdims=True) for n in (3, 3, 2)]
    want = np.einsum("sijk,ai,bj,ck->sabc", dense, *ws)
    for r in out.collect():
        assert abs(r.value - want[r.subject, r.i, r.j, r.k]) < 1e-9


def test_neighbours_are_sent_from_tasks_of_their_own(spark):
    from voxara.operators import denoise, images

    img = _images(spark, 4)
    binary = img.where("t = 0").groupBy("subject", "i", "j", "k").agg(F.max("value").alias("value"))
    for out in (images.erode(binary), images.dilate(binary, {"i": 3, "j": 3, "k": 2}), denoise.noise_sigma(img, {"i": 3, "j": 3, "k": 2})):
        assert "hashpartitioning(xxhash64" in out._jdf.queryExecution().executedPlan().toString().replace("Exchange ", "")
