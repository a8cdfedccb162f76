"""One name for each person across days, and the store of what persons said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def _pieces(size: int) -> Column:
    """The different parts of ``size`` characters of a name that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring(F.col("name"), i, size)))


def containments(names: DataFrame) -> DataFrame:
    """(inner, outer): all pairs of different names of which one stands within the other.

    A name can only stand in those that hold each of its pairs of characters, so it is looked for where its rarest pair
    is; a single character is looked for by itself. What is found is compared exactly, names of any length alike.
    """
    out = []
    for size, inner in ((2, names.where("length(name) > 1")), (1, names.where("length(name) = 1"))):
        held = names.where(F.length("name") >= size).select("name", F.explode(_pieces(size)).alias("piece"))
        common = held.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
        rarest = inner.select("name", F.explode(_pieces(size)).alias("piece")).join(common, "piece").groupBy("name").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"))
        met = rarest.withColumnRenamed("name", "inner").join(held.withColumnRenamed("name", "outer"), "piece")
        out.append(met.where("inner <> outer").where(F.contains("outer", "inner")).select("inner", "outer"))
    return out[0].unionByName(out[1])


def canonical_names(names: DataFrame, name: str = "name", seq: str = "seq", rounds: int = 1_000) -> DataFrame:
    """(name, canonical): in the order of ``seq`` (then of the name), a name takes the first stored name that contains it or that it
    contains; if there is none, it is stored itself. ``seq`` of a repeated name is its least. Null and empty names are left out.

    A name is stored if no earlier name that it meets is stored. So those without an open earlier name are stored, what
    comes later and meets them is not, and the same holds for what is left: the rounds decide all names in the
    order of the fold without gathering them, as many at a time as do not depend on each other.
    """
    firsts = written(names.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(F.min(seq).alias("seq")))
    place = F.struct("seq", "name")
    inner, outer = firsts.select(F.col("name").alias("inner"), place.alias("p")), firsts.select(F.col("name").alias("outer"), place.alias("q"))
    met = containments(firsts).join(inner, "inner").join(outer, "outer")
    # from the earlier to the later name
    links = written(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct())
    stored = firsts.select("name").join(links.select(F.col("b").alias("name")), "name", "left_anti")
    parts, left = [], links
    for _ in range(rounds):
        stored = written(stored)
        parts.append(stored)
        taken = left.join(stored.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        decided = stored.select("name").unionByName(taken)
        following = written(left.join(decided.withColumnRenamed("name", "a"), "a", "left_anti").join(decided.withColumnRenamed("name", "b"), "b", "left_anti"))
        # open names: those that met only names that are taken now have no link left
        waiting = left.select(F.col("b").alias("name")).unionByName(left.select(F.col("a").alias("name"))).distinct().join(decided, "name", "left_anti")
        stored = waiting.join(following.select(F.col("b").alias("name")), "name", "left_anti")
        left = following
        if stored.isEmpty():
            break
    else:
        raise RuntimeError(f"names are left open after {rounds} rounds")
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    kept = written(kept.select("name").join(firsts, "name"))
    homes = links.join(kept.select(F.col("name").alias("a"), "seq"), "a").groupBy("b").agg(F.min(F.struct("seq", "a")).alias("h")).select(F.col("b").alias("name"), F.col("h.a").alias("canonical"))
    others = homes.join(kept.select("name"), "name", "left_anti")
    return kept.select("name", F.col("name").alias("canonical")).unionByName(others)


def rename(opinions: DataFrame, canonical: DataFrame, person: str = "person") -> DataFrame:
    """Opinions under their canonical names; a name that isn't listed stays."""
    names = canonical.select(F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
    return opinions.join(names, opinions[person] == names["__name"], "left").withColumn(person, F.coalesce("__canonical", person)).drop("__name", "__canonical")


def store_rows(opinions: DataFrame) -> DataFrame:
    """The rows that a day adds to the store: each (news_id, ord) once, its latest datetime winning, without ord."""
    latest = Window.partitionBy("news_id", "ord").orderBy(F.desc_nulls_last("datetime"), F.hash(*[F.col(c) for c, t in opinions.dtypes if not t.startswith("map")]))
    return opinions.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "ord")


def append_clusters(history: DataFrame, day: DataFrame) -> DataFrame:
    """The daily topics of all days; a day that comes again replaces its earlier rows."""
    again = day.select("date").distinct()
    return history.join(again, "date", "left_anti").unionByName(day, allowMissingColumns=True)
