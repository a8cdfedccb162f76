"""How well extracted opinions fit labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_either


def gold_triples(labels: DataFrame, key: str = "news_id") -> DataFrame:
    """(key, gold_id, person, verb, opinion) from labelled spans (key, start, end, text, label): each opinion with the first person and verb
    that lie within it (they may start two characters before it). Without a person it is no case, without a verb the verb is null."""
    spans = labels.select(key, "start", "end", "text", "label")
    opinion = spans.where("label = 'opinion'").select(key, F.col("start").alias("os"), F.col("end").alias("oe"), F.col("text").alias("opinion")).distinct()
    inner = spans.where("label in ('person', 'verb')").join(opinion, key).where("end < oe and start >= os - 2")
    first = inner.groupBy(key, "os", "oe", "opinion").agg(F.min(F.when(F.col("label") == "person", F.struct("start", "text"))).alias("p"), F.min(F.when(F.col("label") == "verb", F.struct("start", "text"))).alias("v"))
    gold_id = F.row_number().over(Window.partitionBy(key).orderBy("os", "oe")) - 1
    return first.where("p is not null").select(key, gold_id.alias("gold_id"), F.col("p.text").alias("person"), F.col("v.text").alias("verb"), "opinion")


def match(predicted: DataFrame, gold: DataFrame, key: str = "news_id") -> DataFrame:
    """(key, pred_id, gold_id): each prediction's first gold case whose person and opinion contain, or are contained in, its own; null without one.
    predicted: key, pred_id, person, opinion; gold: key, gold_id, person, opinion. A gold case may serve several predictions."""
    g = gold.select(key, "gold_id", F.col("person").alias("gp"), F.col("opinion").alias("go"))
    hits = predicted.join(g, key).where(contains_either("person", "gp") & contains_either("opinion", "go")).groupBy(key, "pred_id").agg(F.min("gold_id").alias("gold_id"))
    return predicted.select(key, "pred_id").join(hits, [key, "pred_id"], "left")


def scores(predicted: DataFrame, gold: DataFrame, key: str = "news_id") -> DataFrame:
    """(key, tp, fp, fn, precision, recall, f1) of each article with a prediction or a gold case; undefined shares are 0."""
    m = match(predicted, gold, key)
    p = m.groupBy(key).agg(F.count("gold_id").alias("tp"), F.count_if(F.col("gold_id").isNull()).alias("fp"), F.countDistinct("gold_id").alias("used"))
    g = gold.groupBy(key).agg(F.countDistinct("gold_id").alias("golds"))
    both = p.join(g, key, "full").na.fill(0)
    out = both.select(key, "tp", "fp", (F.col("golds") - F.col("used")).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    out = out.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def scores_by_file(predicted: DataFrame, gold: DataFrame, file: str = "file", key: str = "news_id") -> DataFrame:
    """(file, articles, precision, recall, f1): the means over the articles of each file. predicted and gold have the file of each row."""
    keyed = lambda df: df.withColumn("__key", F.struct(file, key)).drop(file, key)
    each = scores(keyed(predicted), keyed(gold), "__key").select(F.col(f"__key.{file}").alias(file), "precision", "recall", "f1")
    return each.groupBy(file).agg(F.count(F.lit(1)).alias("articles"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def macro(per_article: DataFrame) -> DataFrame:
    """(precision, recall, f1): means over the articles."""
    return per_article.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def hits_and_misses(predicted: DataFrame, gold: DataFrame, key: str = "news_id") -> DataFrame:
    """(key, side, outcome, person, opinion): every prediction and every gold case as hit or miss."""
    m = match(predicted, gold, key)
    pred = predicted.join(m, [key, "pred_id"]).select(key, F.lit("predicted").alias("side"), F.when(F.col("gold_id").isNotNull(), "hit").otherwise("miss").alias("outcome"), "person", "opinion")
    used = m.where("gold_id is not null").select(key, "gold_id").distinct().withColumn("used", F.lit(True))
    g = gold.join(used, [key, "gold_id"], "left").select(key, F.lit("gold").alias("side"), F.when(F.col("used"), "hit").otherwise("miss").alias("outcome"), "person", "opinion")
    return pred.unionByName(g)
