"""Opinions from parsed clauses: pairs of a speech verb and its agent.

The parser is external. Its output comes as one row a node: (key, clause_id, node_id, parent_id, pos, role,
word, delim); node_id numbers the nodes of a clause in tree order (each before its descendants, depth first), word is
null for inner nodes, delim is the mark that closes the clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prepare import no_pronoun

# Part-of-speech marks of speech verbs in the strict and the wide variant, and sentence ends.
STRICT, WIDE = ("VE2",), ("VE2", "VC", "VE11")
SENTENCE_ENDS = "。；;"
TOLERANCE, LEAST = 3, 10


def _holds(c: Column, marks: tuple[str, ...]) -> Column:
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit("|".join(marks)))


def node_spans(nodes: DataFrame, key: str = "news_id") -> DataFrame:
    """Adds start, end and text of each node in the article without spaces; an inner node spans its leaves."""
    order = Window.partitionBy(key).orderBy("clause_id", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("node_id").over(Window.partitionBy(key, "clause_id"))
    size = F.length(F.coalesce("word", F.lit(""))) + F.when(F.col("node_id") == last, F.length(F.coalesce("delim", F.lit("")))).otherwise(0)
    placed = nodes.withColumn("start", F.coalesce(F.sum(size).over(order), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length(F.coalesce("word", F.lit(""))))
    # in tree order a node's descendants follow it up to the first node that hangs above it, so a subtree is a range
    inner = placed.where("word is null and role like '%agent%'").select(key, "clause_id", F.col("node_id").alias("top"))
    later = placed.select(key, "clause_id", F.col("node_id").alias("at"), "parent_id", "word", "start", "end")
    after = inner.join(later, [key, "clause_id"]).where("at > top")
    stop = F.min(F.when(F.coalesce("parent_id", F.lit(-1)) < F.col("top"), F.col("at"))).over(Window.partitionBy(key, "clause_id", "top"))
    leaves = after.withColumn("stop", stop).where("word is not null and (stop is null or at < stop)")
    joined = leaves.groupBy(key, "clause_id", "top").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "").alias("t"))
    out = placed.join(joined.withColumnRenamed("top", "node_id"), [key, "clause_id", "node_id"], "left")
    return out.withColumns({"start": F.coalesce("s", "start"), "end": F.coalesce("e", "end"), "text": F.coalesce("t", "word")}).drop("s", "e", "t")


def clause_pairs(nodes: DataFrame, key: str = "news_id", strict: bool = True) -> DataFrame:
    """(key, clause_id, verb, verb_start, verb_end, agent, agent_start, agent_end) of clauses with a speech verb and an agent.

    strict: exactly one verb of the narrow kind and exactly one agent; otherwise at least one verb of the wide kind
    and one agent, the first of each counting.
    """
    spans = node_spans(nodes, key)
    verb, agent = _holds(F.col("pos"), STRICT if strict else WIDE), _holds(F.col("role"), ("agent",))
    item = F.struct("node_id", "text", "start", "end")
    grouped = spans.where(verb | agent).groupBy(key, "clause_id").agg(
        F.count_if(verb).alias("verbs"), F.count_if(agent).alias("agents"), F.min(F.when(verb, item)).alias("v"), F.min(F.when(agent, item)).alias("a")
    )
    fit = (F.col("verbs") == 1) & (F.col("agents") == 1) if strict else (F.col("verbs") >= 1) & (F.col("agents") >= 1)
    return grouped.where(fit).select(key, "clause_id", F.col("v.text").alias("verb"), F.col("v.start").alias("verb_start"), F.col("v.end").alias("verb_end"), F.col("a.text").alias("agent"), F.col("a.start").alias("agent_start"), F.col("a.end").alias("agent_end"))


def shift_for_spaces(pairs: DataFrame, spaces: DataFrame, key: str = "news_id") -> DataFrame:
    """Moves places in the text without spaces to those in the text with them; spaces: (key, space_index of the text with spaces, ascending)."""
    joined = pairs.join(spaces.select(key, "space_index"), key, "left")
    moved = lambda c: F.aggregate(F.coalesce("space_index", F.array().cast("array<int>")), F.col(c), lambda at, s: F.when(at >= s, at + 1).otherwise(at))
    starts = {c: moved(c) for c in ("verb_start", "agent_start")}
    sizes = {"verb_end": ("verb_start", "verb_end"), "agent_end": ("agent_start", "agent_end")}
    return joined.withColumns(starts | {e: starts[s] + (F.col(e) - F.col(s)) for e, (s, e) in sizes.items()}).drop("space_index")


def clause_opinions(articles: DataFrame, pairs: DataFrame, people: DataFrame, key: str = "news_id", text: str = "article") -> DataFrame:
    """(key, ord, person, verb, opinion, begin, end): what the agents of clause pairs say up to the sentence's end.

    An opinion starts behind the verb, or behind a comma within three characters of it, or behind a closing mark
    within three characters of that. A pair that touches two sentences counts in each. people: (key, name_seq, name);
    the first name that the agent contains is the speaker, an agent without one says nothing.
    """
    base = articles.select(key, F.col(text).alias("t")).where("t is not null").dropDuplicates([key])
    pieces = base.select(key, "t", F.posexplode(F.split("t", f"[{SENTENCE_ENDS}]", -1)).alias("n", "piece"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    bounds = pieces.withColumn("right", (F.sum(F.length("piece")).over(w) + F.col("n")).cast("int"))
    left = F.coalesce(F.lag("right").over(Window.partitionBy(key).orderBy("n")), F.lit(0))
    sentences = bounds.withColumn("left", left).select(key, "t", "left", "right")
    inside = pairs.where(no_pronoun("agent")).join(sentences, key).where((F.col("left") - TOLERANCE < F.col("agent_start")) & (F.col("verb_end") <= F.col("right")))

    def behind(at: Column, mark: str) -> Column:
        near = F.instr(F.substring(F.col("t"), at + 1, F.lit(3)), mark)
        return F.when(near > 0, at + near).otherwise(at)

    spoken = inside.withColumn("b1", behind(F.col("verb_end"), ",")).withColumn("begin", behind(F.col("b1"), "」")).where(F.col("right") - F.col("begin") >= LEAST)
    named = spoken.join(people.select(key, "name_seq", "name"), key).where(F.contains("agent", "name"))
    who = named.groupBy(key, "clause_id", "left", "right", "begin", "verb", "verb_start").agg(F.min_by("name", "name_seq").alias("person"), F.first("t").alias("t"))
    ord_ = (F.row_number().over(Window.partitionBy(key).orderBy("clause_id", "left")) - 1).cast("int")
    return who.select(key, ord_.alias("ord"), "person", "verb", F.substring(F.col("t"), F.col("begin") + 1, F.col("right") - F.col("begin")).alias("opinion"), "begin", F.col("right").alias("end"))
