"""kmeans_issue sweeps up to a tenth of the rows."""

import random

import numpy as np

from newsloom.operators import grouping
from newsloom.plans import opinions


def test_more_than_six_clusters(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [100.0 * (i % 8 == d) + rng.random() for d in range(8)], 0) for i in range(96)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = opinions.kmeans_issue(spark, str(tmp_path)).collect()
    assert len(got) == 96
    assert {frozenset(r.vec_id for r in got if r.cluster == c) for c in {r.cluster for r in got}} == {frozenset(range(d, 96, 8)) for d in range(8)}


def test_distributed_sweep(spark):
    rng = random.Random(4)
    rows = [(i, [50.0 * (i % 5 == d) + rng.random() for d in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = grouping.sweep_clusters(df, "k", "v", range(3, 7), task_rows=10).collect()
    assert {frozenset(r.k for r in got if r.cluster == c) for c in {r.cluster for r in got}} == {frozenset(range(d, 60, 5)) for d in range(5)}
    assert sum(r.medoid for r in got) == 5


def test_silhouette_by_sums():
    r = np.random.default_rng(1)
    points, labels = r.standard_normal((40, 3)), np.array([0] * 15 + [1] * 24 + [2])
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    each = []
    for i in range(40):
        own = (labels == labels[i]) & (np.arange(40) != i)
        a = d[i, own].mean() if own.any() else 0
        b = min(d[i, labels == c].mean() for c in range(3) if c != labels[i])
        each.append((b - a) / max(a, b) if own.any() else 0)
    assert abs(grouping.fast_silhouette(points, labels) - np.mean(each)) < 1e-9
