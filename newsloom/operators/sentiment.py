"""Word-list scoring of opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word lists beyond this number of rows are not sent to every task.
BROADCAST_WORDS = 100_000


def score(opinions: DataFrame, lexicon: DataFrame, opinion: str = "opinion", polarities: tuple[str, ...] = ("negative", "positive"), broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Adds <polarity>_score and <polarity>_list: each lexicon row that occurs in the opinion adds one.

    lexicon: (polarity, word). It is a bag: a word listed twice scores twice, and overlapping words all count.
    Lists are in the order of the words. Null and blank words match nothing; a null opinion has score 0.
    The lists travel as one array a polarity while their rows are few, so scoring needs no join and no shuffle;
    beyond ``broadcast_words`` the words meet the opinions by their first two characters in a shuffle join.
    """
    words = lexicon.where("word is not null and trim(word) <> ''").select("polarity", "word")
    if words.limit(broadcast_words + 1).count() <= broadcast_words:
        lists = words.groupBy().agg(*(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.col("word")))).alias(f"__{p}") for p in polarities))
        out = opinions.crossJoin(F.broadcast(lists))  # one row
        for p in polarities:
            out = out.withColumn(f"{p}_list", F.coalesce(F.filter(f"__{p}", lambda w: F.contains(F.col(opinion), w)), F.array().cast("array<string>"))).withColumn(f"{p}_score", F.size(f"{p}_list"))
        return out.drop(*(f"__{p}" for p in polarities))
    rows = opinions.withColumn("__row", F.xxhash64(opinion))
    texts = rows.select("__row", F.col(opinion).alias("o")).where("o is not null").distinct()
    starts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("o"))), lambda i: F.substring(F.col("o"), i, F.lit(2)))))
    longer, single = words.where("length(word) > 1"), words.where("length(word) = 1")
    hits = texts.select("__row", "o", starts.alias("head")).join(longer.withColumn("head", F.substring("word", 1, 2)), "head").where(F.contains("o", "word"))
    letters = F.explode(F.array_distinct(F.split("o", "")))
    ones = texts.select("__row", "o", letters.alias("head")).join(single.withColumn("head", F.col("word")), "head")
    found = hits.unionByName(ones).groupBy("__row").agg(*(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.col("word")))).alias(f"{p}_list") for p in polarities))
    out = rows.join(found, "__row", "left").drop("__row")
    for p in polarities:
        out = out.withColumn(f"{p}_list", F.coalesce(f"{p}_list", F.array().cast("array<string>"))).withColumn(f"{p}_score", F.size(f"{p}_list"))
    return out
