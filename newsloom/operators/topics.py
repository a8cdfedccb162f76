"""Topics of a day's news: their representatives, entities and tags, and the joins that use them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cosine
from ..sources.tables import written
from . import density

OUTLIER = -1


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            vectors = np.array(batch.column("vec").to_pylist(), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc"), density.packed(vectors, np.float32)], names=["part", "doc", "vec"])


def assign_topics(vectors: DataFrame, radius: float, dense: int = 3, day: str | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """([day,] key, topic): the clusters by density of each day's vectors, numbered from 0 by falling size (ties: the least key), and OUTLIER for the rest.

    radius: the least cosine of neighbours; dense: neighbours, itself included, that make a core. Null keys and vectors
    are left out, a repeated key counts once. All vectors have the length of the first.
    """
    part = F.coalesce(F.xxhash64(day), F.lit(0)) if day else F.lit(0).cast("long")
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).dropDuplicates([key]).withColumn("__part", part)
    keep = [F.col(day)] if day else []
    first = rows.select(F.size(vector)).first()
    if first is None:
        return rows.select(*keep, key, F.lit(OUTLIER).alias("topic"))
    most = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    held = rows.select(F.col("__part").alias("part"), F.col(key).cast("long").alias("doc"), F.col(vector).cast("array<float>").alias("vec"))
    found = density.density_clusters(held.mapInArrow(_as_bytes, "part long, doc long, vec binary"), first[0], most, radius, dense, kind=np.float32)
    placed = written(rows.select(*keep, key, "__part", F.col(key).cast("long").alias("doc")).join(found, "doc", "left"))
    sizes = placed.where("cluster is not null").groupBy("__part", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
    number = (F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("n"), "least")) - 1).cast("int")
    named = sizes.select("__part", "cluster", number.alias("topic"))
    return placed.join(named, ["__part", "cluster"], "left").select(*keep, key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))


def centroids(vectors: DataFrame, topic: str = "label", vector: str = "embedding") -> DataFrame:
    """(topic, centroid)."""
    each = vectors.select(topic, F.posexplode(vector).alias("i", "x")).groupBy(topic, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(vectors: DataFrame, key: str = "vec_id", topic: str = "label", vector: str = "embedding") -> DataFrame:
    """(topic, key, similarity): the row of each topic nearest to its centroid by cosine; ties go to the least key. Outliers have none."""
    scored = vectors.where(F.col(topic) != OUTLIER).join(centroids(vectors, topic, vector), topic).withColumn("similarity", F.round(cosine(vector, "centroid"), 9))
    first = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("similarity"), key))
    return scored.withColumn("__n", first).where("__n = 1").select(topic, key, "similarity")


def flag_by_title(news: DataFrame, representative: DataFrame, topic: str = "topic", key: str = "news_id", title: str = "title") -> DataFrame:
    """Adds representative_docs: every article whose title equals that of its topic's representative, duplicates too."""
    titles = representative.select(topic, key).join(news.select(key, F.col(title).alias("__title")), key).select(topic, "__title")
    return news.join(titles, topic, "left").withColumn("representative_docs", F.coalesce(F.col(title) == F.col("__title"), F.lit(False))).drop("__title")


def representative_rows(flagged: DataFrame, topic: str = "topic", key: str = "news_id") -> DataFrame:
    """(topic, topic_represent_article): of each topic's flagged rows the one with the least key."""
    return flagged.where(F.col("representative_docs") & (F.col(topic) != OUTLIER)).groupBy(topic).agg(F.min(key).alias("topic_represent_article"))


def entity_counts(entities: DataFrame, *topic: str, name: str = "ner", seq: str | None = None, from_zero: bool = False) -> DataFrame:
    """(topic, name, cnt[, first_seen]): how often each entity stands in a topic; outliers don't count. from_zero: one less each."""
    last = topic[-1]
    rows = entities.where(F.col(last).isNotNull() & (F.col(last).cast("string") != str(OUTLIER)))
    extra = [F.min(seq).alias("first_seen")] if seq else []
    return rows.groupBy(*topic, name).agg((F.count(F.lit(1)) - int(from_zero)).alias("cnt"), *extra)


def top_tags(counts: DataFrame, *topic: str, name: str = "ner", k: int = 5) -> DataFrame:
    """(topic, rank, name, cnt): the k most frequent entities of each topic; ties in order of first_seen, if there, then of the name."""
    seen = ["first_seen"] if "first_seen" in counts.columns else []
    rank = F.row_number().over(Window.partitionBy(*topic).orderBy(F.desc("cnt"), *seen, name))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(*topic, "rank", name, "cnt")


def as_map(counts: DataFrame, *topic: str, name: str = "ner") -> DataFrame:
    """(topic, topic_ner_dic): the counts of each topic as a map."""
    return counts.groupBy(*topic).agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("cnt").cast("int")))).alias("topic_ner_dic"))


def with_topic_title(news: DataFrame, topics: DataFrame, topic: str = "topic", outliers: str = "null") -> DataFrame:
    """Adds represent_title, that of the row's topic. outliers: 'null', or 'last_topic' to give outliers the title of the highest topic."""
    titles = topics.select(F.col(topic).alias("__t"), F.col("title").alias("represent_title"))
    joined = news.join(titles, news[topic] == titles["__t"], "left").drop("__t")
    if outliers == "last_topic":
        last = titles.agg(F.max_by("represent_title", "__t").alias("__last"))
        joined = joined.crossJoin(F.broadcast(last))  # one row
        joined = joined.withColumn("represent_title", F.when(F.col(topic) == OUTLIER, F.col("__last")).otherwise(F.col("represent_title"))).drop("__last")
    return joined


def total_by_title(rows: DataFrame, clusters: DataFrame, title: str = "represent_title") -> DataFrame:
    """Adds total_cluster_number by title; of several rows with the title the last (by date and little number) wins, without one it is null."""
    last = clusters.groupBy(F.col("little_cluster_title").alias("__title")).agg(F.max_by("total_cluster_number", F.struct("date", "little_cluster_number")).alias("total_cluster_number"))
    return rows.join(last, rows[title] == last["__title"], "left").drop("__title")


def total_by_number(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds total_cluster_number by (date, little_cluster_number); of several rows the first (by title) wins, without one it is -1."""
    first = clusters.groupBy("date", "little_cluster_number").agg(F.min_by("total_cluster_number", "little_cluster_title").alias("total_cluster_number"))
    return rows.join(first, ["date", "little_cluster_number"], "left").withColumn("total_cluster_number", F.coalesce("total_cluster_number", F.lit(OUTLIER).cast(T.IntegerType())))
