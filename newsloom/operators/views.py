"""What the reader sees: front page, topic lists, article opinions, timelines of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topics import OUTLIER


def front_page(topics: DataFrame, news: DataFrame) -> DataFrame:
    """(date, topic, title, article): the representative article of each topic of a day. topics: (date, topic, topic_represent_article)."""
    rows = news.select("date", F.col("news_id").alias("topic_represent_article"), "title", "article")
    return topics.where(F.col("topic") != OUTLIER).join(rows, ["date", "topic_represent_article"]).select("date", "topic", "title", "article")


def front_page_json(page: DataFrame) -> DataFrame:
    """(date, json): one document a day, topics in their order."""
    item = F.struct("topic", "title", "article", F.col("date").cast("string").alias("date"))
    return page.groupBy("date").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("topic_list"))).alias("json"))


def cluster_list(news: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(date, topic, represent_news_id, represent_title, article_list[, tag]): one row a topic and day; outliers have none.

    news: date, topic, news_id, title, representative_docs. Of several representatives the last counts as such and none is listed.
    tags: (date, topic, rank, ner).
    """
    rows = news.where(F.col("topic").isNotNull() & (F.col("topic") != OUTLIER))
    rep = F.when(F.col("representative_docs"), F.struct("news_id", "title"))
    other = F.when(~F.col("representative_docs"), F.struct("news_id", "title"))
    lists = rows.groupBy("date", "topic").agg(F.max(rep).alias("r"), F.array_sort(F.collect_list(other)).alias("article_list"))
    out = lists.select("date", "topic", F.col("r.news_id").alias("represent_news_id"), F.col("r.title").alias("represent_title"), "article_list")
    if tags is None:
        return out
    tagged = tags.groupBy("date", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ner"))), lambda x: x["ner"]).alias("tag"))
    return out.join(tagged, ["date", "topic"], "left")


def article_opinions(news: DataFrame, opinions: DataFrame) -> DataFrame:
    """(date, news_id, title, opinions): every article with its opinions in their order, an empty list where it has none."""
    item = F.struct("ord", "person", "verb", "opinion", "negative_score", "positive_score")
    lists = opinions.groupBy("news_id").agg(F.array_sort(F.collect_list(item)).alias("opinions"))
    empty = F.array().cast(lists.schema["opinions"].dataType)
    return news.select("date", "news_id", "title").join(lists, "news_id", "left").select("date", "news_id", "title", F.coalesce("opinions", empty).alias("opinions"))


def day_view(rows: DataFrame, date: str, station: str = "now") -> DataFrame:
    """Rows of a day, or of the one before ('last') or after ('next') it; without rows the day has no data."""
    shift = {"last": -1, "now": 0, "next": 1}[station]
    return rows.where(F.col("date").cast("date") == F.date_add(F.lit(date).cast("date"), shift))


def day_of(moment: str):
    """The day of a 'yyyy-MM-dd HH:mm' text."""
    return F.to_date(F.substring(moment, 1, 10))


def person_timeline(store: DataFrame) -> DataFrame:
    """(person, total_cluster_number, place, datetime, news_id, opinion): what each person said on an issue, numbered in the
    order of time, equal times by news_id and opinion; unknown times come last. A row an opinion, so nobody's opinions are gathered."""
    order = Window.partitionBy("person", "total_cluster_number").orderBy(F.asc_nulls_last("datetime"), "news_id", "opinion")
    return store.select("person", "total_cluster_number", F.row_number().over(order).alias("place"), "datetime", "news_id", "opinion")


def person_slices(store: DataFrame) -> DataFrame:
    """(person, total_cluster_number, opinions, first, last): how much a person said on an issue, and when."""
    return store.groupBy("person", "total_cluster_number").agg(F.count(F.lit(1)).alias("opinions"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


def person_on_issue(store: DataFrame, clusters: DataFrame, name: str, date: str, little: int) -> DataFrame:
    """The opinions of one person on the issue that (date, little cluster) belongs to; none if it belongs to no issue."""
    issue = clusters.where((F.col("date") == F.lit(date)) & (F.col("little_cluster_number") == little)).orderBy("little_cluster_title").limit(1).select("total_cluster_number")
    return store.where(F.col("person") == name).join(F.broadcast(issue), "total_cluster_number")  # one row


def numbered(rows: DataFrame, *by: str):
    return (F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - 1).cast("int")
