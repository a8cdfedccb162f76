"""Where names stand in texts, and which names an article's persons are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prepare import possible_person

#: Names that an annotator by list holds at most.
MOST_NAMES = 500_000
#: A model that finds entities: texts in, for each text a list of (text, tag, start, end) out.
Annotator = Callable[[list[str]], list[list[tuple[str, str, int, int]]]]


def annotate(articles: DataFrame, annotator: Annotator, key: str = "news_id", text: str = "article") -> DataFrame:
    """(key, text, tag, start, end) of the entities that ``annotator`` finds in Arrow batches; spaces are dropped first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [str(t).replace(" ", "") for t in pdf["t"]]
            yield pd.DataFrame([(k, *e) for k, found in zip(pdf["k"], annotator(texts)) for e in found], columns=["k", "text", "tag", "start", "end"])

    rows = articles.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return rows.mapInPandas(run, "k long, text string, tag string, start int, end int").withColumnRenamed("k", key)


class KnownNames:
    """An annotator that finds all places of listed names, overlapping ones too, in one pass over each text."""

    def __init__(self, tags: dict[str, str]):
        self.tags = tags
        self.automaton = None

    def __getstate__(self):
        return {"tags": self.tags, "automaton": None}

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, int, int]]]:
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for name in self.tags:
                self.automaton.add_word(name, name)
            self.automaton.make_automaton()
        return [[(name, self.tags[name], end + 1 - len(name), end + 1) for end, name in self.automaton.iter(t)] if self.tags else [] for t in texts]


def known_names(names: DataFrame, most: int = MOST_NAMES) -> KnownNames:
    """An annotator from a list of names (text, tag): such as all persons of earlier days. Null and empty names are left out, of several tags
    the least counts. The list goes to every task, so it may hold ``most`` names at most."""
    rows = names.where("text is not null and text <> ''").groupBy("text").agg(F.min("tag").alias("tag")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return KnownNames({r.text: r.tag for r in rows})


def locate(articles: DataFrame, names: DataFrame, key: str = "news_id", text: str = "article", name: str = "person") -> DataFrame:
    """(key, name_seq, name, start, end): all occurrences of each article's own names, those of one name not overlapping.

    names holds (key, name[, name_seq]); without name_seq names are numbered alphabetically. Names count as plain
    text, not as patterns. Null texts, null and empty names are left out, repeated names count once. The text is
    split by the name, so the work stays in the JVM and the places are code points.
    """
    if "name_seq" not in names.columns:
        names = names.select(key, name).distinct().withColumn("name_seq", F.row_number().over(Window.partitionBy(key).orderBy(name)) - 1)
    wanted = names.where(F.col(name).isNotNull() & (F.col(name) != "")).select(key, F.col(name).alias("name"), "name_seq").dropDuplicates([key, "name"])
    joined = articles.select(key, F.col(text).alias("t")).where("t is not null").dropDuplicates([key]).join(wanted, key).where(F.contains("t", "name"))
    plain = F.concat(F.lit("\\Q"), F.replace(F.col("name"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = joined.select(key, "name_seq", "name", F.posexplode(F.split(F.col("t"), plain, -1)).alias("n", "piece"))
    w = Window.partitionBy(key, "name").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("start", (F.sum(F.length("piece")).over(w) + F.col("n") * F.length("name")).cast("int"))
    last = F.max("n").over(Window.partitionBy(key, "name"))
    return ends.withColumn("last", last).where("n < last").select(key, "name_seq", "name", "start", (F.col("start") + F.length("name")).alias("end"))


def person_candidates(entities: DataFrame, key: str = "news_id", from_zero: bool = True) -> DataFrame:
    """(key, name, uses, first_start): persons an article may speak of, in the order of their first mention.

    from_zero: counts start at 0, so ``uses`` is one less than the number of mentions.
    """
    fit = entities.where(possible_person(F.col("text"), F.col("tag")))
    return fit.groupBy(key, F.col("text").alias("name")).agg((F.count(F.lit(1)) - int(from_zero)).alias("uses"), F.min("start").alias("first_start"))


def surname_order(candidates: DataFrame, key: str = "news_id") -> DataFrame:
    """Adds name_seq: names without a namesake (same first character) keep their place; of namesakes the less
    frequent go to the end, then the longer, then the later."""
    namesakes = Window.partitionBy(key, F.substring("name", 1, 1))
    rank = F.row_number().over(namesakes.orderBy(F.desc("uses"), F.length("name"), "first_start", "name"))
    placed = candidates.withColumn("loser", (rank > 1).cast("int"))
    order = Window.partitionBy(key).orderBy("loser", F.when(F.col("loser") == 1, -F.col("uses")), F.when(F.col("loser") == 1, F.length("name")), "first_start", "name")
    return placed.withColumn("name_seq", F.row_number().over(order) - 1).drop("loser")


def expand_short(text: str, mentions: list[tuple[str, int, int]], candidates: list[str]) -> str:
    """``text`` with each mention of one or two characters that is no candidate itself written out as the first
    candidate with the same first character."""
    full = {c[0]: c for c in reversed(candidates) if c}
    known, out, done = set(candidates), [], 0
    for name, start, end in sorted(mentions, key=lambda m: (m[1], m[2])):
        if 0 < len(name) < 3 and name not in known and name[0] in full and start >= done:
            out += [text[done:start], full[name[0]]]
            done = end
    return "".join([*out, text[done:]])


def expand_short_names(articles: DataFrame, entities: DataFrame, key: str = "news_id", text: str = "article") -> DataFrame:
    """(key, article_coref, people): each article with short names written out, and its persons in order.

    An article without entities keeps its text and an empty list; one whose work fails comes with null in both.
    """
    people = surname_order(person_candidates(entities, key), key)
    lists = people.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("name_seq", "name"))), lambda x: x["name"]).alias("people"))
    persons = entities.where("tag = 'PERSON'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("mentions"))
    base = articles.select(key, F.replace(F.col(text), F.lit(" "), F.lit("")).alias("t")).dropDuplicates([key])
    joined = base.join(lists, key, "left").join(persons, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, names, found in zip(pdf[key], pdf["t"], pdf["people"], pdf["mentions"]):
                names = [] if names is None else list(names)
                try:
                    done = None if t is None else expand_short(t, [(m["text"], m["start"], m["end"]) for m in ([] if found is None else found)], names)
                    out.append((k, done, names))
                except (TypeError, ValueError):
                    out.append((k, None, None))
            yield pd.DataFrame(out, columns=[key, "article_coref", "people"])

    kind = dict(articles.dtypes)[key]
    return joined.mapInPandas(run, f"{key} {kind}, article_coref string, people array<string>")
