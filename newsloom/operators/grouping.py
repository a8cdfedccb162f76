"""Similar opinions of one speaker, of one article, and similar topics of several days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..sources.tables import written
from .prepare import opinion_length

PAIR_SIMILARITY, PARAPHRASE = 0.8, 0.95
#: Rows that a sweep over numbers of clusters sends to all tasks, and numbers that it tries where the rows are more.
SWEEP_ROWS, LADDER = 20_000, 40


def by_speaker(opinions: DataFrame, key: str = "news_id") -> DataFrame:
    """(key, person, opinions): the opinions of usable length of each speaker of an article, in their order."""
    kept = opinions.where(opinion_length("opinion"))
    return kept.groupBy(key, "person").agg(F.array_sort(F.collect_list(F.struct("ord", "verb", "opinion"))).alias("opinions"))


def similar_pairs(rows: DataFrame, group: str, key: str, vector: str, least: float, inclusive: bool = False) -> DataFrame:
    """(group, a, b, similarity), a < b: pairs of a group's rows with a cosine above ``least``. Groups are the few opinions of an article."""
    a = rows.select(group, F.col(key).alias("a"), F.col(vector).alias("va"))
    b = rows.select(group, F.col(key).alias("b"), F.col(vector).alias("vb"))
    pairs = a.join(b, group).where("a < b").withColumn("similarity", F.round(cosine("va", "vb"), 9)).drop("va", "vb")
    return pairs.where(F.col("similarity") >= least if inclusive else F.col("similarity") > least)


def without_paraphrases(rows: DataFrame, group: str, key: str, vector: str, text: str, least: float = PARAPHRASE) -> DataFrame:
    """Rows that lose no pair of their group: of two with a cosine above ``least`` the shorter goes, of equally long ones the first.
    All pairs are judged on the rows as they came."""
    pairs = similar_pairs(rows, group, key, vector, least)
    sizes = rows.select(group, F.col(key).alias("k"), F.length(text).alias("n"))
    judged = pairs.join(sizes.withColumnsRenamed({"k": "a", "n": "na"}), [group, "a"]).join(sizes.withColumnsRenamed({"k": "b", "n": "nb"}), [group, "b"])
    losers = judged.select(group, F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias(key)).distinct()
    return rows.join(losers, [group, key], "left_anti")


def pair_rule(rows: DataFrame, group: str, key: str, vector: str, text: str, least: float = PAIR_SIMILARITY, literal: bool = False) -> DataFrame:
    """Applies to groups of exactly two rows: alike, the shorter stays (equally long: the first); unlike, both stay.
    literal: alike, the second stays; unlike, none. Other groups pass."""
    two = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(group)
    alike = similar_pairs(rows.join(two, group, "left_semi"), group, key, vector, least)
    sizes = rows.select(group, F.col(key).alias("k"), F.length(text).alias("n"))
    judged = alike.join(sizes.withColumnsRenamed({"k": "a", "n": "na"}), [group, "a"]).join(sizes.withColumnsRenamed({"k": "b", "n": "nb"}), [group, "b"])
    if literal:
        stay = judged.select(group, F.col("b").alias(key))
        return rows.join(two, group, "left_anti").unionByName(rows.join(stay, [group, key], "left_semi"))
    losers = judged.select(group, F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias(key))
    return rows.join(losers, [group, key], "left_anti")


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T, 0)


def k_means(points: np.ndarray, k: int, seed: int = 7, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of a seeded k-means with well-spread starts; every label of 0 to k-1 occurs if there are k different points."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.integers(len(points))]]
    nearest = _squared(points, centres)[:, 0]
    while len(centres) < k:
        total = nearest.sum()
        p = nearest / total if total > 1e-12 else np.full(len(points), 1 / len(points))
        centres = np.vstack([centres, points[rng.choice(len(points), p=p)]])
        nearest = np.minimum(nearest, _squared(points, centres[-1:])[:, 0])
    labels = None
    for _ in range(rounds):
        d = _squared(points, centres)
        new = d.argmin(1)
        for c in np.flatnonzero(np.bincount(new, minlength=k) == 0):
            new[d[np.arange(len(points)), new].argmax()] = c
        if labels is not None and (new == labels).all():
            break
        labels = new
        many = np.bincount(labels, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, points)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return labels, centres


def fast_silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by squared Euclidean distance, from the sums of the clusters; a point alone in its cluster has 0."""
    kinds, labels = np.unique(labels, return_inverse=True)
    many = np.bincount(labels)
    own = np.arange(len(points)), labels
    sums = np.zeros((len(kinds), points.shape[1]))
    np.add.at(sums, labels, points)
    squares = np.bincount(labels, (points**2).sum(1))
    # mean squared distance of each point to all of each cluster
    mean = np.maximum((points**2).sum(1)[:, None] + (squares / many)[None] - 2 * points @ (sums / many[:, None]).T, 0)
    a = mean[own] * many[labels] / np.maximum(many[labels] - 1, 1)
    mean[own] = np.inf
    b = mean.min(1)
    most = np.maximum(a, b)
    return float(np.where((many[labels] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0).mean())


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; a point alone in its cluster has 0."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    out = np.zeros(len(points))
    kinds = np.unique(labels)
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min((d[i, labels == c].mean() for c in kinds if c != labels[i]), default=0.0)
        out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(out.mean())


def cluster_range(n: int) -> range:
    """Numbers of clusters that are tried for n opinions of one speaker, n >= 3."""
    lowest = 2 if n == 3 else n - 2 if n <= 5 else n - 3 if n <= 7 else n - 4
    return range(lowest, n)


def medoid_rows(points: np.ndarray, seed: int = 7) -> list[int]:
    """Rows that stand for the clusters of n >= 3 points: the number of clusters with the best silhouette (the least of equals), nearest rows to the centres."""
    best = None
    for k in cluster_range(len(points)):
        labels, centres = k_means(points, k, seed)
        score = silhouette(points, labels)
        if best is None or score > best[0] + 1e-12:
            best = (score, centres)
    d = ((points[:, None] - best[1][None]) ** 2).sum(2)
    return list(dict.fromkeys(int(i) for i in d.argmin(0)))


def opinion_medoids(rows: DataFrame, group: str, key: str, vector: str, seed: int = 7) -> DataFrame:
    """(group, key): of each speaker's opinions (n >= 3) one for each cluster; smaller groups pass whole. Groups are an article's opinions of one speaker."""
    types = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        if len(pdf) >= 3:
            pdf = pdf.iloc[sorted(medoid_rows(np.array(pdf[vector].tolist(), float), seed))]
        return pdf[[group, key]]

    usable = rows.where(F.col(vector).isNotNull()).select(group, key, vector)
    return usable.groupBy(group).applyInPandas(one, f"{group} {types[group]}, {key} {types[key]}")


def _scored(points, seed: int):
    """Rows (k, score) for numbers of clusters."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf.k, "score": [fast_silhouette(points.value, k_means(points.value, int(k), seed)[0]) for k in pdf.k]})

    return go


def sweep_clusters(rows: DataFrame, key: str, vector: str, ks: range | None = None, seed: int = 7, task_rows: int = SWEEP_ROWS) -> DataFrame:
    """(key, cluster, medoid): k-means over all rows with the number of clusters that has the best silhouette (the least of equals); medoid flags the
    row nearest to each centre (ties: the least key). One row is cluster 0, two rows are 0 and 1. ks: by default 2 up to a tenth of the rows.

    Up to ``task_rows`` rows go to all tasks, which try the numbers side by side. More rows stay where they are: each number is
    then a distributed fit, and of a long range LADDER numbers in even ratios are tried.
    """
    usable = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).dropDuplicates([key])
    n = usable.count()
    kind = dict(rows.dtypes)[key]
    spark = rows.sparkSession
    if n < 3:
        first = [r[0] for r in usable.orderBy(key).select(key).collect()]
        return spark.createDataFrame([(x, i, True) for i, x in enumerate(first)], f"{key} {kind}, cluster int, medoid boolean")
    if ks is None:
        ks = range(2, max(3, n // 10))
    if n > task_rows:
        return _distributed_sweep(usable, key, ks, seed)
    held = usable.orderBy(key).collect()
    points = spark.sparkContext.broadcast(np.array([r.v for r in held]))
    scores = spark.range(0, len(ks), 1, min(len(ks), 4 * spark.sparkContext.defaultParallelism)).select((F.lit(ks.start) + F.col("id") * ks.step).alias("k")).mapInPandas(_scored(points, seed), "k long, score double").collect()
    best = min(scores, key=lambda r: (-round(r.score, 12), r.k)).k
    labels, centres = k_means(points.value, best, seed)
    near = np.round(_squared(points.value, centres), 9)
    medoids = {c: min(np.flatnonzero(labels == c), key=lambda i: (near[i, c], i)) for c in set(labels.tolist())}
    return spark.createDataFrame([(r[0], c, bool(medoids[c] == i)) for i, (r, c) in enumerate(zip(held, labels.tolist()))], f"{key} {kind}, cluster int, medoid boolean")


def _distributed_sweep(usable: DataFrame, key: str, ks: range, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    tried = list(ks) if len(ks) <= LADDER else sorted({int(round(k)) for k in np.geomspace(ks[0], ks[-1], LADDER)})
    features = written(usable).withColumn("features", array_to_vector("v")).persist()
    best = None
    for k in tried:
        model = KMeans(k=k, seed=seed).fit(features)
        labelled = model.transform(features)
        found = labelled.select("prediction").distinct().limit(2).count()
        score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(labelled) if found > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, model)
    centres = usable.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best[1].clusterCenters())], "prediction int, c array<double>")
    near = written(best[1].transform(features).drop("features").join(centres, "prediction"))
    features.unpersist()
    far = near.withColumn("d", F.round(F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 9))
    medoids = far.groupBy("prediction").agg(F.min_by(key, F.struct("d", key)).alias("__m"))
    return far.join(medoids, "prediction").select(key, F.col("prediction").alias("cluster"), (F.col(key) == F.col("__m")).alias("medoid"))
