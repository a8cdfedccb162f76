"""Readers and writers of the file formats in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.literals import labels_of

RAW_NEWS = "timestamp double, title string, article string, url string, company string, category string, reporter string"
PROCESSED = "title string, article string, url string, company string, category string, reporter string, space_index array<int>, datetime timestamp_ntz"
# What a response status tells a crawler to do.
STATUS_ACTIONS = {200: "use", 403: "banned", 404: "missing", 410: "missing", 429: "slow down"}


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; no types are guessed. Empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_csv_folder(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All CSV files below a folder, with each row's file in the column ``file``."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return reader.csv(path).withColumn("file", F.input_file_name())


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON documents that may span lines; no rows where there are no files."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_labelled(spark: SparkSession, path: str, key: str = "news_id") -> DataFrame:
    """(file, key, start, end, text, label) of all labelled spans in the CSV files below a folder, which have the columns ``key`` and label."""
    rows = read_csv_folder(spark, path, f"{key} int, label string")
    name = F.substring_index("file", "/", -1)
    return rows.select(name.alias("file"), key, F.explode(labels_of("label")).alias("s")).select("file", key, "s.*")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(p) and files.getFileStatus(p).isFile()


def read_lexicon(spark: SparkSession, negative: str, positive: str, encoding: str = "UTF-16") -> DataFrame:
    """(polarity, word) from two files with a word on each line. Words that occur twice stay twice; blank lines are dropped."""
    def one(path: str, polarity: str) -> DataFrame:
        text = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("t"))
        lines = text.select(F.explode(F.split("t", "\r\n|\r|\n")).alias("word"))
        return lines.select(F.lit(polarity).alias("polarity"), F.trim(F.replace("word", F.lit("﻿"), F.lit(""))).alias("word")).where("word <> ''")

    return one(negative, "negative").unionByName(one(positive, "positive"))


def listed_between(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Listed articles of a half-open time range."""
    return rows.where((F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz")))


def date_in_url(url: str | Column, start: int = 7) -> Column:
    """The eight digits of a date that stand at a place of a link."""
    return F.to_date(F.substring(url, start, 8), "yyyyMMdd")


def month_day_time(text: str, year: int | Column) -> Column:
    """A list page's 'MM/dd HH:mm' in a given year."""
    y = F.lit(year) if isinstance(year, int) else year
    return F.try_to_timestamp(F.concat(y.cast("string"), F.lit("/"), F.col(text)), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz")


def status_action(code: str | Column) -> Column:
    """'use', 'banned', 'missing', 'slow down' or 'error' for a response status."""
    c = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for item in STATUS_ACTIONS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit("error"))


def waiting_seconds(responses: DataFrame, waits: DataFrame, code: str = "status_code") -> DataFrame:
    """Adds wait_seconds by outlet and action; waits: (company_id, action, wait_seconds), a small table. 0 where none is listed."""
    acted = responses.withColumn("action", status_action(code))
    return acted.join(waits, ["company_id", "action"], "left").na.fill(0.0, ["wait_seconds"])


def jitter(seed: int, mean: float = 1.0, spread: float = 2.0, most: float = 10.0, draws: int = 16) -> Column:
    """A normal number between 0 and ``most``: the first of ``draws`` tries in range. All of them miss it with a chance of about 1 in 100 million
    by default; the mean then stands in."""
    tries = F.array(*[F.randn(seed + i) * spread + mean for i in range(draws)])
    return F.coalesce(F.try_element_at(F.filter(tries, lambda x: (x >= 0) & (x <= most)), F.lit(1)), F.lit(mean))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    """Parquet by day; a day that is written again replaces only itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_documents(df: DataFrame, path: str, *by: str) -> None:
    """JSON documents in folders by the given columns, the whole tree anew."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_report(scores: DataFrame, path: str) -> None:
    """An evaluation as lines of 'measure = value'."""
    columns = scores.columns
    lines = scores.select(F.explode(F.array(*[F.concat(F.lit(f"{c} = "), F.col(c).cast("string")) for c in columns])).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)  # one row of scores
