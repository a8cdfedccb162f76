"""Filters, projections and unions that bring outlet files into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entity tags without a topic, and pronouns that are no speaker.
TAGS_WITHOUT_TOPIC = ("DATE", "CARDINAL", "PERCENT", "QUANTITY", "TIME", "ORDINAL")
PRONOUNS = ("你", "妳", "我", "他", "她")
OPINION_LENGTHS = (11, 149)


def with_text(news: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns (title and article by default) are not null."""
    return news.na.drop(subset=list(columns or ("title", "article")))


def veto_files(rows: DataFrame, file: str, column: str) -> DataFrame:
    """Rows of the files in which ``column`` is never null: one null row discards its whole file. Null files count as one."""
    bad = rows.groupBy(file).agg(F.bool_or(F.col(column).isNull()).alias("bad")).where("bad").select(F.col(file).alias("bad_file"))
    return rows.join(bad, rows[file].eqNullSafe(bad["bad_file"]), "left_anti")


def union_files(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name; a column that a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def number_news(news: DataFrame, day: str, *order: str) -> DataFrame:
    """Adds news_id, the row's number within its day from 0, by the given columns."""
    return news.withColumn("news_id", (F.row_number().over(Window.partitionBy(day).orderBy(*order)) - 1).cast("int"))


def opinion_length(opinion: Column | str) -> Column:
    return F.length(opinion).between(*OPINION_LENGTHS)


def topical(entities: Column | str) -> Column:
    """The entities (text, tag, ...) without those whose tag names no topic."""
    return F.filter(entities, lambda x: ~x["tag"].isin(*TAGS_WITHOUT_TOPIC))


def possible_person(text: Column, tag: Column) -> Column:
    """PERSON of 2 to 4 characters, ORG or NORP of at least 3."""
    return ((tag == "PERSON") & F.length(text).between(2, 4)) | (tag.isin("ORG", "NORP") & (F.length(text) >= 3))


def no_pronoun(agent: Column | str) -> Column:
    return ~(F.col(agent) if isinstance(agent, str) else agent).isin(*PRONOUNS)
