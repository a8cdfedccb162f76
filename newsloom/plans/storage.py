"""Queries over sources and sinks: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation
from ..sources import files
from ..sources.tables import shared_folder
from .opinions import ORACLE as OPINIONS
from .opinions import SCORES, _evaluated
from .registry import Registry, table

R = Registry()
STORED = "(SELECT DISTINCT news_id, date, title, article FROM article_page)"


def _folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_page", "news_id", "date", "title", "article").distinct()


@R.add(f"SELECT news_id, date, NULLIF(title, '') AS title, NULLIF(article, '') AS article FROM {STORED}")
def csv_scan(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(_stored(spark, sf_dir), path)
    return files.read_csv(spark, path, "news_id int, date string, title string, article string")


@R.add(f"SELECT date, count(*) AS articles, count(NULLIF(title, '')) AS titles, sum(coalesce(length(article), 0)) AS characters FROM {STORED} GROUP BY date")
def directory_scan(spark, sf_dir):
    """A folder of CSV files for each day, read as one table; the day comes from the path of each file."""
    path = _folder(spark)
    _stored(spark, sf_dir).repartition("date").write.partitionBy("date").option("header", True).option("escape", '"').csv(path)
    rows = files.read_csv_folder(spark, path, "news_id int, title string, article string")
    day = F.regexp_extract("file", "date=([^/]*)/", 1)
    return rows.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("articles"), F.count("title").alias("titles"), F.sum(F.coalesce(F.length("article"), F.lit(0))).alias("characters"))


@R.add(f"SELECT news_id, date, title, article FROM {STORED}")
def json_scan(spark, sf_dir):
    path = _folder(spark)
    files.write_documents(_stored(spark, sf_dir).withColumn("day", F.col("date")), path, "day")
    lines = spark.read.schema("news_id int, date string, title string, article string").option("recursiveFileLookup", True).json(path)
    return lines


@R.add("SELECT polarity, word, count(*) AS n FROM lexicon WHERE trim(word) <> '' GROUP BY ALL")
def lexicon_scan(spark, sf_dir):
    """Two UTF-16 files with a word on each line; words that occur twice stay twice."""
    path, words = _folder(spark), table(spark, sf_dir, "lexicon", "polarity", "word")
    for polarity in ("negative", "positive"):
        one = words.where(F.col("polarity") == polarity).select("word").coalesce(1)  # a word list is one file
        one.write.option("encoding", "UTF-16").option("quote", "\u0000").csv(f"{path}/{polarity}")
    read = files.read_lexicon(spark, f"{path}/negative/*.csv", f"{path}/positive/*.csv")
    return read.groupBy("polarity", "word").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def days_written(spark, sf_dir):
    """Events by day; the days are written, and the first half of them a second time, which replaces only these."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "ts").withColumn("day", F.col("ts").cast("date"))
    middle = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")).alias("m"))
    files.write_days(rows.withColumn("event_type", F.concat(F.lit("old "), "event_type")).join(F.broadcast(middle), F.col("day") <= F.col("m")).drop("m"), path, "day")  # one row
    files.write_days(rows, path, "day")
    return spark.read.parquet(path).groupBy(F.col("day").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""SELECT unnest(['precision = ' || "precision", 'recall = ' || recall, 'f1 = ' || f1]) AS line FROM ({OPINIONS['eval_macro']})""")
def evaluation_report(spark, sf_dir):
    path = _folder(spark)
    files.write_report(evaluation.macro(evaluation.scores(*_evaluated(spark, sf_dir))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


BY_FILE = SCORES.replace("SELECT news_id, tp, fp, fn, CASE", "SELECT news_id, news_id % 3 AS file, tp, fp, fn, CASE", 1)


@R.add(
    f"""SELECT 'labels-' || file AS file, count(*) AS articles, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall,
    round(avg(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END), 6) AS f1 FROM {BY_FILE} GROUP BY file"""
)
def labelled_files(spark, sf_dir):
    """Labels of three annotators, each in a file of its own, as Python reprs; the attributions of their articles are scored by file."""
    path = _folder(spark)
    predicted, store = _evaluated(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    span = lambda first, last, text, kind: F.concat(F.lit("{'start': "), (F.col("gold_id") * 1000 + first).cast("string"), F.lit(", 'end': "), (F.col("gold_id") * 1000 + last).cast("string"), F.lit(", 'text': "), quoted(text), F.lit(f", 'labels': ['Text', '{kind}']}}"))
    rows = store.where("person is not null and opinion is not null").withColumn("spans", F.concat_ws(", ", span(0, 900, "opinion", "opinion"), span(1, 4, "person", "person")))
    labels = rows.groupBy("news_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("spans")), ", "), F.lit("]")).alias("label"))  # the labels of one article
    for k in range(3):
        files.write_csv(labels.where(F.col("news_id") % 3 == k).coalesce(1), f"{path}/labels-{k}")  # one annotator's file
    gold = evaluation.gold_triples(files.read_labelled(spark, path)).withColumn("file", F.concat(F.lit("labels-"), (F.col("news_id") % 3).cast("string")))
    return evaluation.scores_by_file(predicted.withColumn("file", F.concat(F.lit("labels-"), (F.col("news_id") % 3).cast("string"))), gold)


@R.add(
    """SELECT idx, CASE idx % 7 WHEN 0 THEN 'use' WHEN 1 THEN 'banned' WHEN 2 THEN 'missing' WHEN 3 THEN 'missing' WHEN 4 THEN 'slow down' ELSE 'error' END AS action,
    CAST(CASE idx % 7 WHEN 1 THEN 600 WHEN 4 THEN CASE WHEN company_id % 2 = 0 THEN 30 ELSE 60 END ELSE 0 END AS DOUBLE) AS wait_seconds FROM (SELECT DISTINCT idx, company_id FROM raw_news)"""
)
def status_policy(spark, sf_dir):
    """What a crawler does after each page, had it come with one of seven response codes."""
    codes = F.array(*map(F.lit, (200, 403, 404, 410, 429, 500, 302)))
    rows = table(spark, sf_dir, "raw_news", "idx", "company_id").distinct().withColumn("status_code", F.element_at(codes, F.col("idx") % 7 + 1))
    waits = table(spark, sf_dir, "outlet", "company_id").select("company_id", F.explode(F.array(F.struct(F.lit("banned").alias("action"), F.lit(600.0).alias("wait_seconds")), F.struct(F.lit("slow down").alias("action"), F.when(F.col("company_id") % 2 == 0, 30.0).otherwise(60.0).alias("wait_seconds")))).alias("w"))
    return files.waiting_seconds(rows, waits.select("company_id", "w.*")).select("idx", "action", "wait_seconds")


LISTED = "(SELECT event_id, ts, strftime(ts, '%m/%d %H:%M') AS listed, '/news/' || strftime(ts, '%Y%m%d') || event_id AS url FROM events)"


@R.add(f"SELECT event_id, CAST(strptime(substr(url, 7, 8), '%Y%m%d') AS DATE) AS day, date_trunc('minute', ts) AS moment FROM {LISTED} WHERE date_trunc('minute', ts) >= TIMESTAMP '2024-01-03' AND date_trunc('minute', ts) < TIMESTAMP '2024-01-20'")
def list_pages(spark, sf_dir):
    """Listed articles of a time range, their days read from links and their times from 'MM/dd HH:mm' with the year known."""
    rows = table(spark, sf_dir, "events", "event_id", "ts").withColumns({"listed": F.date_format("ts", "MM/dd HH:mm"), "url": F.concat(F.lit("/news/"), F.date_format("ts", "yyyyMMdd"), F.col("event_id").cast("string"))})
    read = rows.select("event_id", files.date_in_url(F.col("url")).alias("day"), files.month_day_time("listed", F.year("ts")).alias("moment"))
    return files.listed_between(read, "moment", "2024-01-03", "2024-01-20")


REPORTING = "(SELECT DISTINCT news_id, ord, person FROM person_store WHERE person <> '' AND NOT regexp_matches(person, '[A-Za-z]|\\s'))"


@R.add(
    f"""WITH lists AS (SELECT news_id, string_agg(CASE ord % 3 WHEN 0 THEN 'Ann Lee、' || person WHEN 1 THEN person || ' 王五' ELSE person END, '、' ORDER BY ord) AS t FROM {REPORTING} GROUP BY news_id)
    SELECT news_id, regexp_replace(regexp_replace(replace(t, 'Ann Lee', 'Ann-Lee'), '[、 ]', ',', 'g'), ',+', ',', 'g') AS reporters FROM lists"""
)
def reporter_names(spark, sf_dir):
    rows = table(spark, sf_dir, "person_store", "news_id", "ord", "person").where("person <> '' and not regexp_like(person, '[A-Za-z]|\\\\s')").distinct()
    said = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Ann Lee、"), "person")).when(F.col("ord") % 3 == 1, F.concat("person", F.lit(" 王五"))).otherwise(F.col("person"))
    lists = rows.groupBy("news_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("t")))), lambda x: x["t"]), "、").alias("t"))  # the speakers of one article
    return lists.select("news_id", X.reporter_list("t").alias("reporters"))


QUERIES, ORACLE = R.queries, R.oracle
