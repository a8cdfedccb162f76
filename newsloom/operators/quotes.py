"""Quoted opinions and their speakers, by rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that introduce an opinion, in the order in which they are tried, and marks behind them.
VERBS = "提到 說明 說 表示 指出 宣布 解釋 強調 有感而發 回應 批評 評估 提出 呼籲 質疑 認為 不禁問道 發現 痛批".split()
MARKS = "， :「 ： : ; ,".split()


@dataclass(frozen=True)
class QuoteRules:
    """How an opinion looks: verb, marks, words up to an end mark, closing marks."""

    verbs: tuple[str, ...] = tuple(VERBS)
    marks: tuple[str, ...] = tuple(MARKS)
    end: str = "。"
    closing: str = "」"
    #: Words that disqualify a name if one stands in the ``look_back`` characters before it.
    blocking: tuple[str, ...] = ("於", "在", "受")
    look_back: int = 3
    #: Most characters from the start of the name to the start of the opinion, and least characters of an opinion.
    reach: int = 30
    least: int = 10

    @property
    def pattern(self) -> str:
        return f"({'|'.join(self.verbs)})((?:{'|'.join(self.marks)})*)(.+?)({self.end})({self.closing}*)"


RULES = QuoteRules()


def quote_spans(articles: DataFrame, key: str = "news_id", text: str = "article", rules: QuoteRules = RULES) -> DataFrame:
    """(key, verb_seq, verb, verb_start, verb_end, begin, end, opinion): matches of the rules from left to right, not overlapping.

    The pattern leaves control characters (stripped from the text before) around its groups; the text is split there
    and running lengths give the places, since Spark's regex offsets count UTF-16 units.
    """
    marked = F.regexp_replace(F.regexp_replace(F.col(text), "[\\x01-\\x03]", ""), rules.pattern, "\u0001$1\u0002$2\u0002$3$4$5\u0003")
    base = articles.select(key, text).where(F.col(text).isNotNull()).dropDuplicates([key])
    pieces = base.select(key, F.posexplode(F.split(marked, "\u0001", -1)).alias("n", "piece"))
    cut = pieces.select(key, "n", F.split("piece", "[\u0002\u0003]", -1).alias("p"), F.length(F.regexp_replace("piece", "[\u0002\u0003]", "")).alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    found = cut.withColumn("verb_start", start).where("n > 0").withColumns({"verb": F.col("p")[0], "opinion": F.col("p")[2], "verb_seq": (F.col("n") - 1).cast("int")})
    found = found.withColumn("verb_end", F.col("verb_start") + F.length("verb")).withColumn("begin", F.col("verb_end") + F.length(F.col("p")[1]))
    return found.select(key, "verb_seq", "verb", "verb_start", "verb_end", "begin", (F.col("begin") + F.length("opinion")).alias("end"), "opinion")


def attribute_quotes(articles: DataFrame, mentions: DataFrame, key: str = "news_id", text: str = "article", rules: QuoteRules = RULES) -> DataFrame:
    """(key, ord, person, person_start, person_end, verb, opinion, begin, end): each opinion with the nearest name before it.

    mentions: (key, name_seq, name, start, end) as from ``locate``. A name with a blocking word just before it is
    passed over; a name that starts fewer than ``look_back`` characters into the text has nothing before it and is
    never blocked. The nearest name that is left is the speaker, or nobody if it stands too far away. ``ord`` counts
    an article's opinions from 0. This is an as-of join: names and opinions are merged by place and one running
    maximum carries the nearest name along, so an article costs one sort.
    """
    spans = quote_spans(articles, key, text, rules).where(F.col("end") - F.col("begin") >= rules.least)
    base = articles.select(key, F.col(text).alias("t")).dropDuplicates([key])
    before = F.when(F.col("start") >= rules.look_back, F.substring(F.col("t"), F.col("start") - rules.look_back + 1, F.lit(rules.look_back))).otherwise("")
    free = mentions.join(base, key).where(~F.regexp_like(before, F.lit("|".join(rules.blocking)))).select(key, "name_seq", "name", "start", "end")
    none = F.lit(None)
    who = F.struct(F.col("start").alias("start"), F.col("name_seq").cast("int").alias("seq"), F.col("end").alias("end"), F.col("name").alias("name"))
    points = free.select(key, F.col("end").alias("pos"), F.lit(0).alias("kind"), who.alias("who"), none.cast("int").alias("verb_seq"))
    asks = spans.select(key, F.col("begin").alias("pos"), F.lit(1).alias("kind"), none.cast("struct<start:int,seq:int,end:int,name:string>").alias("who"), "verb_seq")
    near = F.max("who").over(Window.partitionBy(key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    answered = points.unionByName(asks).withColumn("near", near).where("kind = 1 and near is not null").select(key, "verb_seq", "near")
    found = spans.join(answered, [key, "verb_seq"]).where(F.col("begin") - F.col("near.start") <= rules.reach)
    ord_ = (F.row_number().over(Window.partitionBy(key).orderBy("begin")) - 1).cast("int")
    return found.select(key, ord_.alias("ord"), F.col("near.name").alias("person"), F.col("near.start").alias("person_start"), F.col("near.end").alias("person_end"), "verb", "opinion", "begin", "end")
