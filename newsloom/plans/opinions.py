"""Queries over opinions, speakers, topics and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import opinions_of
from ..operators import clauses, entities, evaluation, grouping, mentions, prepare, quotes, sentiment, topics, views
from ..sources.tables import written
from .registry import Registry, table

R = Registry()
VERBS = "|".join(quotes.VERBS)
MARKS = "|".join(quotes.MARKS)

# One row for each opinion of the store, whatever came twice.
STORE = """(SELECT person, verb, opinion, ord, news_id, represent_title, datetime FROM (SELECT *, row_number() OVER (PARTITION BY news_id, ord ORDER BY datetime DESC NULLS LAST, person, opinion) AS n FROM person_store) WHERE n = 1)"""
NEWS = """(SELECT news_id, date, title, article, topic FROM (SELECT *, TRY_CAST(little_topic AS INTEGER) AS topic, row_number() OVER (PARTITION BY news_id ORDER BY little_topic NULLS LAST, date DESC, title NULLS LAST) AS n FROM article_page) WHERE n = 1)"""
PEOPLE = f"(SELECT news_id, person AS name, CAST(row_number() OVER (PARTITION BY news_id ORDER BY person) - 1 AS INTEGER) AS name_seq FROM (SELECT DISTINCT news_id, person FROM {STORE} WHERE person <> ''))"
MENTIONS = f"""(SELECT news_id, name_seq, name, CAST(start AS INTEGER) AS start, CAST(start + length(name) AS INTEGER) AS "end" FROM (
    SELECT news_id, name_seq, name, n, sum(length(piece)) OVER (PARTITION BY news_id, name ORDER BY n) + (n - 1) * length(name) AS start, max(n) OVER (PARTITION BY news_id, name) AS last FROM (
      SELECT a.news_id, p.name_seq, p.name, unnest(string_split(a.article, p.name)) AS piece, unnest(range(1, len(string_split(a.article, p.name)) + 1)) AS n FROM {NEWS} a JOIN {PEOPLE} p USING (news_id))) WHERE n < last)"""
SPANS = f"""(SELECT news_id, verb_seq, verb, verb_start, verb_start + length(verb) AS verb_end, verb_start + length(verb) + length(mark) AS begin, verb_start + length(verb) + length(mark) + length(opinion) AS "end", opinion FROM (
    SELECT news_id, n - 2 AS verb_seq, p[1] AS verb, p[2] AS mark, p[3] AS opinion, sum(length(piece) - len(p) + 1) OVER (PARTITION BY news_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS verb_start, n FROM (
      SELECT news_id, piece, n, string_split(replace(piece, chr(3), chr(2)), chr(2)) AS p FROM (
        SELECT news_id, unnest(string_split(m, chr(1))) AS piece, unnest(range(1, len(string_split(m, chr(1))) + 1)) AS n FROM (
          SELECT news_id, regexp_replace(article, '({VERBS})((?:{MARKS})*)(.+?)(。)(」*)', chr(1) || '\\1' || chr(2) || '\\2' || chr(2) || '\\3\\4\\5' || chr(3), 'g') AS m FROM {NEWS})))) WHERE n > 1)"""
ATTRIBUTED = f"""(SELECT news_id, CAST(row_number() OVER (PARTITION BY news_id ORDER BY begin) - 1 AS INTEGER) AS ord, person, person_start, person_end, verb, opinion, begin, "end" FROM (
    SELECT v.news_id, v.verb, v.opinion, v.begin, v."end", m.name AS person, m.start AS person_start, m."end" AS person_end,
      row_number() OVER (PARTITION BY v.news_id, v.verb_seq ORDER BY m.start DESC, m.name_seq DESC) AS n
    FROM {SPANS} v JOIN {MENTIONS} m ON v.news_id = m.news_id AND m."end" <= v.begin JOIN {NEWS} a ON a.news_id = v.news_id
    WHERE v."end" - v.begin >= 10 AND NOT (m.start >= 3 AND regexp_matches(substr(a.article, m.start - 2, 3), '於|在|受'))) WHERE n = 1 AND begin - person_start <= 30)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "person_store", "person", "verb", "opinion", "ord", "news_id", "represent_title", "datetime")
    latest = Window.partitionBy("news_id", "ord").orderBy(F.desc_nulls_last("datetime"), "person", "opinion")
    return rows.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "article_page", "news_id", "date", "title", "article", "little_topic")
    best = Window.partitionBy("news_id").orderBy(F.asc_nulls_last("little_topic"), F.desc("date"), F.asc_nulls_last("title"))
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("news_id", "date", "title", "article", F.col("little_topic").try_cast("int").alias("topic"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _store(spark, sf_dir).where("person <> ''").select("news_id", F.col("person").alias("name")).distinct()
    return names.withColumn("name_seq", (F.row_number().over(Window.partitionBy("news_id").orderBy("name")) - 1).cast("int"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.locate(_news(spark, sf_dir), _people(spark, sf_dir), name="name")


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.attribute_quotes(_news(spark, sf_dir), _mentions(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return rows.select("vec_id", (F.floor(F.col("vec_id") / 8)).cast("long").alias("article"), "label", "embedding", F.repeat(F.lit("x"), (F.col("vec_id") % 7 + 1).cast("int")).alias("words"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
VECTORS = "(SELECT vec_id, CAST(floor(vec_id / 8) AS BIGINT) AS article, label, embedding, repeat('x', CAST(vec_id % 7 + 1 AS INTEGER)) AS words, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)"
PAIRS = f"(SELECT a.article, a.vec_id AS a, b.vec_id AS b, round({DOT} / (a.norm * b.norm), 9) AS similarity, length(a.words) AS na, length(b.words) AS nb FROM {VECTORS} a JOIN {VECTORS} b ON a.article = b.article AND a.vec_id < b.vec_id)"


@R.add(f"SELECT news_id, name_seq, name, start, \"end\" FROM {MENTIONS}")
def mention_locate(spark, sf_dir):
    return _mentions(spark, sf_dir)


@R.add(f'SELECT news_id, CAST(verb_seq AS INTEGER) AS verb_seq, verb, CAST(verb_start AS INTEGER) AS verb_start, CAST(verb_end AS INTEGER) AS verb_end, CAST(begin AS INTEGER) AS begin, CAST("end" AS INTEGER) AS "end", opinion FROM {SPANS}')
def quote_spans(spark, sf_dir):
    return quotes.quote_spans(_news(spark, sf_dir))


@R.add(f'SELECT news_id, ord, person, person_start, person_end, verb, opinion, CAST(begin AS INTEGER) AS begin, CAST("end" AS INTEGER) AS "end" FROM {ATTRIBUTED}')
def quote_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir)


@R.add(
    f"""SELECT s.news_id, s.ord, s.opinion, CAST(count(*) FILTER (l.polarity = 'negative') AS INTEGER) AS negative_score, CAST(count(*) FILTER (l.polarity = 'positive') AS INTEGER) AS positive_score,
    coalesce(string_agg(l.word, '|' ORDER BY l.word) FILTER (l.polarity = 'negative'), '') AS negative_words, coalesce(string_agg(l.word, '|' ORDER BY l.word) FILTER (l.polarity = 'positive'), '') AS positive_words
    FROM {STORE} s LEFT JOIN lexicon l ON contains(s.opinion, l.word) AND trim(l.word) <> '' GROUP BY s.news_id, s.ord, s.opinion"""
)
def opinion_sentiment(spark, sf_dir):
    scored = sentiment.score(_store(spark, sf_dir).select("news_id", "ord", "opinion"), table(spark, sf_dir, "lexicon"))
    words = lambda c: F.array_join(c, "|")
    return scored.select("news_id", "ord", "opinion", "negative_score", "positive_score", words("negative_list").alias("negative_words"), words("positive_list").alias("positive_words"))


@R.add(f"SELECT person, CAST(sum(neg) AS BIGINT) AS negative, CAST(sum(pos) AS BIGINT) AS positive, count(*) AS opinions FROM (SELECT s.person, s.news_id, s.ord, count(*) FILTER (l.polarity = 'negative') AS neg, count(*) FILTER (l.polarity = 'positive') AS pos FROM {STORE} s LEFT JOIN lexicon l ON contains(s.opinion, l.word) GROUP BY ALL) GROUP BY person")
def speaker_polarity(spark, sf_dir):
    scored = sentiment.score(_store(spark, sf_dir).select("person", "opinion"), table(spark, sf_dir, "lexicon"))
    return scored.groupBy("person").agg(F.sum("negative_score").alias("negative"), F.sum("positive_score").alias("positive"), F.count(F.lit(1)).alias("opinions"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir)
    return found.select("news_id", F.col("name").alias("text"), F.when(F.length("name") <= 4, "PERSON").otherwise("ORG").alias("tag"), "start", "end")


CANDIDATES = f"(SELECT news_id, name, count(*) - 1 AS uses, min(start) AS first_start FROM {MENTIONS} WHERE length(name) BETWEEN 2 AND 4 OR length(name) > 4 GROUP BY news_id, name)"


@R.add(f"SELECT * FROM {CANDIDATES}")
def speaker_candidates(spark, sf_dir):
    return mentions.person_candidates(_entities(spark, sf_dir))


@R.add(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY news_id, substr(name, 1, 1) ORDER BY uses DESC, length(name), first_start, name) AS r FROM {CANDIDATES}),
    l AS (SELECT *, CASE WHEN r > 1 THEN 1 ELSE 0 END AS loser FROM c)
    SELECT news_id, name, uses, first_start, CAST(row_number() OVER (PARTITION BY news_id ORDER BY loser, CASE WHEN loser = 1 THEN -uses END, CASE WHEN loser = 1 THEN length(name) END, first_start, name) - 1 AS INTEGER) AS name_seq FROM l"""
)
def surname_tiebreak(spark, sf_dir):
    return mentions.surname_order(mentions.person_candidates(_entities(spark, sf_dir)))


SHORT_NAMED = f"(SELECT news_id, name, name_seq, coalesce(sum(length(name) + 1) OVER (PARTITION BY news_id ORDER BY name_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_start FROM {PEOPLE} WHERE length(name) BETWEEN 2 AND 4 AND NOT contains(name, ' '))"


@R.add(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY news_id, substr(name, 1, 1) ORDER BY length(name), first_start, name) AS r FROM {SHORT_NAMED}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY CASE WHEN r > 1 THEN 1 ELSE 0 END, CASE WHEN r > 1 THEN length(name) END, first_start, name) AS place FROM c),
    full_names AS (SELECT a.news_id, a.name_seq, arg_min(b.name, b.place) AS full_name FROM placed a JOIN placed b ON a.news_id = b.news_id AND substr(a.name, 1, 1) = substr(b.name, 1, 1) GROUP BY ALL)
    SELECT p.news_id, string_agg(p.name, ',' ORDER BY p.name_seq) || '。' || string_agg(f.full_name, '和' ORDER BY p.name_seq) AS article_coref, string_agg(p.name, '|' ORDER BY p.place) AS people
    FROM placed p JOIN full_names f USING (news_id, name_seq) GROUP BY p.news_id"""
)
def short_name_expansion(spark, sf_dir):
    """Texts that list an article's persons and then their surnames alone, which are written out."""
    people = _people(spark, sf_dir).where("length(name) between 2 and 4 and not contains(name, ' ')")
    listed = people.groupBy("news_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name_seq", "name"))), lambda x: x["name"]).alias("names"))  # the persons of one article
    full = F.array_join("names", ",")
    texts = listed.select("news_id", "names", F.concat(full, F.lit("。"), F.array_join(F.transform("names", lambda n: F.substring(n, 1, 1)), "和")).alias("article"), (F.length(full) + 1).alias("behind"))
    before = F.transform("names", lambda n, i: F.length(F.array_join(F.slice("names", 1, i), ",")) + F.when(i > 0, 1).otherwise(0))
    spans = texts.select("news_id", "behind", F.posexplode(F.arrays_zip("names", before.alias("at"))).alias("n", "m"))
    long = spans.select("news_id", F.col("m.names").alias("text"), F.col("m.at").cast("int").alias("start"), (F.col("m.at") + F.length("m.names")).cast("int").alias("end"))
    at = F.col("behind") + 2 * F.col("n")
    short = spans.select("news_id", F.substring("m.names", 1, 1).alias("text"), at.cast("int").alias("start"), (at + 1).cast("int").alias("end"))
    entities_found = long.unionByName(short).withColumn("tag", F.lit("PERSON"))
    return mentions.expand_short_names(texts.select("news_id", "article"), entities_found).withColumn("people", F.array_join("people", "|"))


KNOWN = f"(SELECT DISTINCT name FROM {PEOPLE})"


@R.add(
    f"""WITH found AS (SELECT a.news_id, p.name, unnest(range(1, length(a.article) - length(p.name) + 2)) AS pos, a.article FROM {NEWS} a JOIN {KNOWN} p ON contains(replace(a.article, ' ', ''), p.name))
    SELECT news_id, name AS text, CASE WHEN length(name) <= 4 THEN 'PERSON' ELSE 'ORG' END AS tag, CAST(pos - 1 AS INTEGER) AS start, CAST(pos - 1 + length(name) AS INTEGER) AS "end" FROM (
      SELECT news_id, name, pos, replace(article, ' ', '') AS t FROM found) WHERE substr(t, pos, length(name)) = name"""
)
def known_entities(spark, sf_dir):
    """Every place of every known name in every article, whoever speaks there."""
    names = _people(spark, sf_dir).select(F.col("name").alias("text"), F.when(F.length("name") <= 4, "PERSON").otherwise("ORG").alias("tag")).distinct()
    return mentions.annotate(_news(spark, sf_dir), mentions.known_names(names))


TOPIC_PEOPLE = f"(SELECT n.date, n.topic, m.name AS ner, count(*) AS cnt, min(m.news_id * 100000 + m.start) AS first_seen FROM {MENTIONS} m JOIN {NEWS} n USING (news_id) WHERE n.topic IS NOT NULL AND n.topic <> -1 GROUP BY ALL)"


def _topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mentions(spark, sf_dir).join(_news(spark, sf_dir).select("news_id", "date", "topic"), "news_id")
    seen = rows.select("date", "topic", F.col("name").alias("ner"), (F.col("news_id").cast("long") * 100000 + F.col("start")).alias("seq"))
    return topics.entity_counts(seen, "date", "topic", seq="seq")


@R.add(f"SELECT date, topic, ner, cnt - 1 AS cnt FROM {TOPIC_PEOPLE}")
def topic_entity_counts(spark, sf_dir):
    return _topic_counts(spark, sf_dir).select("date", "topic", "ner", (F.col("cnt") - 1).alias("cnt"))


@R.add(f"SELECT date, topic, CAST(rank AS INTEGER) AS rank, ner, cnt FROM (SELECT *, row_number() OVER (PARTITION BY date, topic ORDER BY cnt DESC, first_seen, ner) AS rank FROM {TOPIC_PEOPLE}) WHERE rank <= 5")
def topic_top5_tags(spark, sf_dir):
    return topics.top_tags(_topic_counts(spark, sf_dir), "date", "topic")


@R.add(
    f"""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings) GROUP BY label, i),
    k AS (SELECT label, list(x ORDER BY i) AS embedding, sqrt(sum(x * x)) AS norm FROM c GROUP BY label),
    s AS (SELECT a.label, a.vec_id, round({DOT} / (a.norm * b.norm), 6) AS similarity FROM {VECTORS} a JOIN k b ON a.label = b.label)
    SELECT label, min(vec_id) AS vec_id FROM s WHERE similarity = (SELECT max(similarity) FROM s t WHERE t.label = s.label) GROUP BY label"""
)
def topic_representative(spark, sf_dir):
    return topics.representatives(_vectors(spark, sf_dir)).select("label", "vec_id")


RADIUS, DENSE = 0.32, 3


@R.add(
    f"""WITH RECURSIVE v AS (SELECT a.vec_id, vec_id % 3 AS day, a.embedding, a.norm FROM {VECTORS} a),
    near AS (SELECT a.day, a.vec_id AS a, b.vec_id AS b, {DOT} / (a.norm * b.norm) AS s FROM v a JOIN v b ON a.day = b.day WHERE {DOT} / (a.norm * b.norm) >= {RADIUS}),
    cores AS (SELECT a AS core FROM near GROUP BY a HAVING count(*) >= {DENSE}),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT core FROM cores) AND b IN (SELECT core FROM cores)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    named AS (SELECT a AS core, min(b) AS cluster FROM reach GROUP BY a),
    joined AS (SELECT n.a AS vec_id, arg_max(c.cluster, n.s) AS cluster FROM near n JOIN named c ON n.b = c.core WHERE n.a NOT IN (SELECT core FROM cores) GROUP BY n.a UNION ALL SELECT core, cluster FROM named),
    sizes AS (SELECT v.day, j.cluster, count(*) AS n, min(j.vec_id) AS least FROM joined j JOIN v USING (vec_id) GROUP BY ALL),
    topics AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, least) - 1 AS INTEGER) AS topic FROM sizes)
    SELECT v.day, v.vec_id, coalesce(t.topic, -1) AS topic FROM v LEFT JOIN joined j USING (vec_id) LEFT JOIN topics t ON t.cluster = j.cluster"""
)
def topic_assignment(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("day", F.col("vec_id") % 3)
    return topics.assign_topics(rows, RADIUS, DENSE, "day")


FLAGGED = f"(SELECT *, coalesce(news_id = min(news_id) OVER (PARTITION BY date, topic), false) AS rep FROM {NEWS} WHERE topic IS NOT NULL AND topic <> -1)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _news(spark, sf_dir).where((F.col("topic") != topics.OUTLIER) & F.col("topic").isNotNull())
    return rows.withColumn("representative_docs", F.col("news_id") == F.min("news_id").over(Window.partitionBy("date", "topic")))


@R.add(f"SELECT date, topic, title, article FROM {FLAGGED} WHERE rep")
def front_page(spark, sf_dir):
    flagged = _flagged(spark, sf_dir)
    chosen = flagged.where("representative_docs").groupBy("date", "topic").agg(F.min("news_id").alias("topic_represent_article"))
    return views.front_page(chosen, flagged)


@R.add(f"SELECT date, topic, max(CASE WHEN rep THEN news_id END) AS represent_news_id, max(CASE WHEN rep THEN title END) AS represent_title, coalesce(string_agg(CAST(news_id AS VARCHAR), ',' ORDER BY news_id) FILTER (NOT rep), '') AS others FROM {FLAGGED} GROUP BY date, topic")
def cluster_list(spark, sf_dir):
    return views.cluster_list(_flagged(spark, sf_dir)).select("date", "topic", "represent_news_id", "represent_title", F.array_join("article_list.news_id", ",").alias("others"))


@R.add(f"SELECT n.date, n.news_id, coalesce(string_agg(coalesce(s.person, '') || ':' || coalesce(s.verb, '') || ':' || coalesce(s.opinion, ''), '|' ORDER BY s.ord) FILTER (s.news_id IS NOT NULL), '') AS opinions FROM {NEWS} n LEFT JOIN {STORE} s USING (news_id) GROUP BY n.date, n.news_id".replace("s.news_id IS NOT NULL", "s.ord IS NOT NULL"))
def article_opinions(spark, sf_dir):
    rows = _store(spark, sf_dir).withColumns({"negative_score": F.lit(0), "positive_score": F.lit(0)})
    said = F.transform("opinions", lambda o: F.concat(F.coalesce(o["person"], F.lit("")), F.lit(":"), F.coalesce(o["verb"], F.lit("")), F.lit(":"), F.coalesce(o["opinion"], F.lit(""))))
    return views.article_opinions(_news(spark, sf_dir), rows).select("date", "news_id", F.array_join(said, "|").alias("opinions"))


@R.add(f"SELECT s.news_id, CAST(s.ord AS INTEGER) AS ord, s.person, s.verb, s.opinion FROM {STORE} s JOIN (SELECT DISTINCT news_id FROM article_page WHERE opinions IS NOT NULL) USING (news_id)")
def parsed_opinions(spark, sf_dir):
    rows = table(spark, sf_dir, "article_page", "news_id", "opinions").where("opinions is not null").distinct()
    return rows.select("news_id", F.explode(opinions_of("opinions")).alias("o")).select("news_id", "o.ord", "o.person", "o.verb", "o.opinion").distinct()


# A day's topics stand for little clusters; an issue gathers the topics with the same number.
CLUSTERS = f"(SELECT date, topic AS little_cluster_number, title AS little_cluster_title, topic % 3 AS total_cluster_number FROM {FLAGGED} WHERE rep AND title IS NOT NULL)"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir).where("representative_docs and title is not null")
    return rows.select("date", F.col("topic").alias("little_cluster_number"), F.col("title").alias("little_cluster_title"), (F.col("topic") % 3).alias("total_cluster_number"))


@R.add(f"SELECT s.news_id, s.ord, c.total_cluster_number FROM {STORE} s LEFT JOIN (SELECT little_cluster_title, arg_max(total_cluster_number, (date, little_cluster_number)) AS total_cluster_number FROM {CLUSTERS} GROUP BY 1) c ON s.represent_title = c.little_cluster_title")
def cluster_lookup_last(spark, sf_dir):
    return topics.total_by_title(_store(spark, sf_dir), _clusters(spark, sf_dir)).select("news_id", "ord", "total_cluster_number")


@R.add(f"SELECT n.news_id, coalesce(c.total_cluster_number, -1) AS total_cluster_number FROM {NEWS} n LEFT JOIN (SELECT date, little_cluster_number, arg_min(total_cluster_number, little_cluster_title) AS total_cluster_number FROM {CLUSTERS} GROUP BY 1, 2) c ON n.date = c.date AND n.topic = c.little_cluster_number")
def cluster_lookup_first(spark, sf_dir):
    rows = _news(spark, sf_dir).withColumnRenamed("topic", "little_cluster_number")
    return topics.total_by_number(rows, _clusters(spark, sf_dir)).select("news_id", "total_cluster_number")


@R.add(f"SELECT n.news_id, t.title AS represent_title FROM {NEWS} n LEFT JOIN {FLAGGED} t ON t.rep AND n.date = t.date AND n.topic = t.topic")
def topic_title(spark, sf_dir):
    news = _news(spark, sf_dir).withColumn("slot", F.struct("date", "topic"))
    titles = _flagged(spark, sf_dir).where("representative_docs").select(F.struct("date", "topic").alias("slot"), "title")
    return topics.with_topic_title(news, titles, "slot").select("news_id", "represent_title")


ISSUED = f"(SELECT s.person, s.datetime, s.news_id, s.ord, s.opinion, c.total_cluster_number FROM {STORE} s LEFT JOIN (SELECT little_cluster_title, arg_max(total_cluster_number, (date, little_cluster_number)) AS total_cluster_number FROM {CLUSTERS} GROUP BY 1) c ON s.represent_title = c.little_cluster_title)"


def _issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.total_by_title(_store(spark, sf_dir), _clusters(spark, sf_dir))


@R.add(f"SELECT person, total_cluster_number, CAST(row_number() OVER (PARTITION BY person, total_cluster_number ORDER BY datetime NULLS LAST, news_id, opinion) AS INTEGER) AS place, datetime, news_id, opinion FROM {ISSUED}")
def person_timeline(spark, sf_dir):
    return views.person_timeline(_issued(spark, sf_dir))


@R.add(f"SELECT person, total_cluster_number, count(*) AS opinions, min(datetime) AS first, max(datetime) AS last FROM {ISSUED} GROUP BY ALL")
def person_slices(spark, sf_dir):
    return views.person_slices(_issued(spark, sf_dir))


# The issue of the cluster that holds most of them, and who says most on it.
MOST = f"(SELECT person, total_cluster_number AS issue FROM {ISSUED} WHERE person <> '' AND total_cluster_number IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, person, issue LIMIT 1)"


@R.add(f"SELECT i.person, i.total_cluster_number, i.datetime, i.news_id, i.ord, i.opinion FROM {ISSUED} i JOIN {MOST} m ON i.person = m.person AND i.total_cluster_number = m.issue")
def person_on_issue(spark, sf_dir):
    rows, clusters = _issued(spark, sf_dir), _clusters(spark, sf_dir)
    most = rows.where("person <> '' and total_cluster_number is not null").groupBy("person", "total_cluster_number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "person", "total_cluster_number").first()
    if most is None:
        return rows.select("person", "total_cluster_number", "datetime", "news_id", "ord", "opinion").limit(0)
    # any cluster of the issue leads to it, if its number on its day belongs to no other one
    asked = clusters.where(F.col("total_cluster_number") == most.total_cluster_number).orderBy("date", "little_cluster_number").first()
    found = views.person_on_issue(rows, clusters, most.person, asked.date, asked.little_cluster_number)
    return found.select("person", "total_cluster_number", "datetime", "news_id", "ord", "opinion")


@R.add(f"SELECT CAST(substr(datetime, 1, 10) AS DATE) AS day, count(*) AS opinions FROM {STORE} GROUP BY ALL")
def opinion_days(spark, sf_dir):
    return _store(spark, sf_dir).groupBy(views.day_of("datetime").alias("day")).agg(F.count(F.lit(1)).alias("opinions"))


@R.add(f"SELECT article, a, b, round(similarity, 6) AS similarity FROM {PAIRS} WHERE similarity > 0.2")
def cosine_pairs(spark, sf_dir):
    return grouping.similar_pairs(_vectors(spark, sf_dir), "article", "vec_id", "embedding", 0.2).withColumn("similarity", F.round("similarity", 6))


@R.add(f"SELECT article, vec_id FROM {VECTORS} v WHERE (article, vec_id) NOT IN (SELECT article, CASE WHEN na <= nb THEN a ELSE b END FROM {PAIRS} WHERE similarity > 0.3)")
def paraphrase_dedup(spark, sf_dir):
    return grouping.without_paraphrases(_vectors(spark, sf_dir), "article", "vec_id", "embedding", "words", 0.3).select("article", "vec_id")


@R.add(f"SELECT news_id, person, string_agg(opinion, '|' ORDER BY ord, verb, opinion) AS opinions FROM {STORE} WHERE length(opinion) BETWEEN 11 AND 149 GROUP BY news_id, person")
def opinions_by_speaker(spark, sf_dir):
    return grouping.by_speaker(_store(spark, sf_dir)).select("news_id", "person", F.array_join("opinions.opinion", "|").alias("opinions"))


PAIRED = VECTORS.replace("floor(vec_id / 8)", "floor(vec_id / 2)")
TWINS = PAIRS.replace("floor(vec_id / 8)", "floor(vec_id / 2)")


@R.add(f"SELECT article, vec_id FROM {PAIRED} v WHERE (article, vec_id) NOT IN (SELECT article, CASE WHEN na <= nb THEN b ELSE a END FROM {TWINS} WHERE similarity > 0.2)")
def pair_rule(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("article", F.floor(F.col("vec_id") / 2).cast("long"))
    return grouping.pair_rule(rows, "article", "vec_id", "embedding", "words", 0.2).select("article", "vec_id")


@R.add()
def opinion_medoids(spark, sf_dir):
    return grouping.opinion_medoids(_vectors(spark, sf_dir), "article", "vec_id", "embedding")


@R.add()
def kmeans_issue(spark, sf_dir):
    return grouping.sweep_clusters(_vectors(spark, sf_dir), "vec_id", "embedding")


# The fold as it is defined: one name after the other, with the list of those stored so far.
FOLD = f"""WITH RECURSIVE named AS (SELECT person AS name, min(news_id * 1000 + ord) AS seq FROM {STORE} WHERE person <> '' GROUP BY person),
    numbered AS (SELECT name, row_number() OVER (ORDER BY seq, name) AS n FROM named),
    fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS store, '' AS name, '' AS canonical
      UNION ALL SELECT x.n, CASE WHEN x.home IS NULL THEN list_append(x.store, x.name) ELSE x.store END, x.name, coalesce(x.home, x.name)
      FROM (SELECT m.n, m.name, f.store, list_filter(f.store, lambda c: contains(c, m.name) OR contains(m.name, c))[1] AS home FROM fold f JOIN numbered m ON m.n = f.n + 1) x)"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir).select("person", (F.col("news_id").cast("long") * 1000 + F.col("ord")).alias("seq"))
    return entities.canonical_names(rows, "person", "seq")


@R.add(f"{FOLD} SELECT name, canonical FROM fold WHERE n > 0")
def entity_resolve(spark, sf_dir):
    return _canonical(spark, sf_dir)


@R.add(f"{FOLD} SELECT s.news_id, s.ord, coalesce(f.canonical, s.person) AS person FROM {STORE} s LEFT JOIN fold f ON f.n > 0 AND f.name = s.person")
def entity_rename(spark, sf_dir):
    return entities.rename(_store(spark, sf_dir).select("news_id", "ord", "person"), _canonical(spark, sf_dir))


@R.add(f"SELECT person, verb, opinion, news_id, represent_title, datetime FROM {STORE}")
def store_append(spark, sf_dir):
    rows = table(spark, sf_dir, "person_store", "person", "verb", "opinion", "ord", "news_id", "represent_title", "datetime")
    return entities.store_rows(rows)


@R.add(f"SELECT date, little_cluster_number, little_cluster_title, CASE WHEN date IN (SELECT min(date) FROM {CLUSTERS} UNION ALL SELECT max(date) FROM {CLUSTERS}) THEN total_cluster_number + 100 ELSE total_cluster_number END AS total_cluster_number FROM {CLUSTERS}")
def clusters_append(spark, sf_dir):
    """All days but the last are known; the first comes again with other numbers, together with the last."""
    rows = _clusters(spark, sf_dir)
    ends = rows.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    placed = rows.crossJoin(F.broadcast(ends))  # one row
    again = placed.where("date in (first, last)").withColumn("total_cluster_number", F.col("total_cluster_number") + 100)
    return entities.append_clusters(placed.where("date < last").drop("first", "last"), again.drop("first", "last"))


@R.add(f"SELECT topic, min(news_id) AS topic_represent_article FROM {FLAGGED} WHERE rep GROUP BY topic")
def topic_representative_rows(spark, sf_dir):
    return topics.representative_rows(_flagged(spark, sf_dir))


@R.add(f"SELECT date, topic, string_agg(ner || '=' || cnt, '|' ORDER BY ner) AS entities FROM {TOPIC_PEOPLE} GROUP BY ALL")
def topic_entity_map(spark, sf_dir):
    maps = topics.as_map(_topic_counts(spark, sf_dir), "date", "topic")
    pairs = F.transform(F.array_sort(F.map_keys("topic_ner_dic")), lambda k: F.concat(k, F.lit("="), F.element_at("topic_ner_dic", k).cast("string")))
    return maps.select("date", "topic", F.array_join(pairs, "|").alias("entities"))


TAGGED = f"(SELECT news_id, name, CASE length(name) % 4 WHEN 0 THEN 'ORG' WHEN 1 THEN 'DATE' WHEN 2 THEN 'CARDINAL' ELSE 'PERSON' END AS tag, start FROM {MENTIONS})"


@R.add(f"SELECT news_id, coalesce(string_agg(name, '|' ORDER BY start, name) FILTER (tag NOT IN ('DATE', 'CARDINAL')), '') AS topical FROM {TAGGED} GROUP BY news_id")
def topical_entities(spark, sf_dir):
    tag = F.element_at(F.array(F.lit("ORG"), F.lit("DATE"), F.lit("CARDINAL"), F.lit("PERSON")), F.length("name") % 4 + 1)
    rows = _mentions(spark, sf_dir).groupBy("news_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("name").alias("text"), tag.alias("tag")))).alias("found"))  # the mentions of one article
    kept = prepare.topical("found")
    return rows.select("news_id", F.array_join(F.transform(kept, lambda x: x["text"]), "|").alias("topical"))


@R.add(f"SELECT news_id, row_number() OVER (PARTITION BY news_id ORDER BY ord) - 1 AS gold_id, person, CASE WHEN ord % 3 = 1 THEN NULL ELSE verb END AS verb, opinion FROM {STORE} WHERE person IS NOT NULL AND ord % 4 <> 2 AND opinion IS NOT NULL")
def gold_triples(spark, sf_dir):
    """Labelled spans as an annotator makes them: some opinions without a verb, some without a person, and persons that stand elsewhere."""
    rows = _store(spark, sf_dir).where("opinion is not null").withColumn("at", F.col("ord") * 1000)
    span = lambda first, last, text, label: F.struct((F.col("at") + first).alias("start"), (F.col("at") + last).alias("end"), F.col(text).alias("text"), F.lit(label).alias("label"))
    nothing = lambda s, keep: F.when(keep, s)
    spans = F.array(
        span(0, 900, "opinion", "opinion"),
        nothing(span(-1, 4, "person", "person"), F.col("person").isNotNull() & (F.col("ord") % 4 != 2)),
        nothing(span(30, 36, "represent_title", "person"), F.col("ord") % 4 != 2),
        nothing(span(5, 7, "verb", "verb"), F.col("ord") % 3 != 1),
        span(-9, -3, "person", "person"),
    )
    labels = rows.select("news_id", F.explode(spans).alias("s")).where("s is not null").select("news_id", "s.*").where("text is not null")
    return evaluation.gold_triples(labels)


GOLD = f"(SELECT news_id, CAST(ord AS INTEGER) AS gold_id, person, opinion FROM {STORE})"
PREDICTED = f"(SELECT news_id, ord AS pred_id, person, opinion FROM {ATTRIBUTED})"
EITHER = "(contains(p.person, g.person) OR contains(g.person, p.person)) AND (contains(p.opinion, g.opinion) OR contains(g.opinion, p.opinion))"
MATCHED = f"(SELECT p.news_id, p.pred_id, min(g.gold_id) AS gold_id FROM {PREDICTED} p LEFT JOIN {GOLD} g ON p.news_id = g.news_id AND {EITHER} GROUP BY 1, 2)"
SCORES = f"""(SELECT news_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM (
    SELECT news_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(golds, 0) - coalesce(used, 0) AS fn FROM (
      SELECT news_id, count(gold_id) AS tp, count(*) - count(gold_id) AS fp, count(DISTINCT gold_id) AS used FROM {MATCHED} GROUP BY news_id)
    FULL JOIN (SELECT news_id, count(DISTINCT gold_id) AS golds FROM {GOLD} GROUP BY news_id) USING (news_id)))"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    predicted = written(_attributed(spark, sf_dir).select("news_id", F.col("ord").alias("pred_id"), "person", "opinion"))
    return predicted, _store(spark, sf_dir).select("news_id", F.col("ord").alias("gold_id"), "person", "opinion")


@R.add(f'SELECT news_id, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM {SCORES}')
def eval_prf(spark, sf_dir):
    out = evaluation.scores(*_evaluated(spark, sf_dir))
    return out.select("news_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@R.add(f'SELECT round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END), 6) AS f1 FROM {SCORES}')
def eval_macro(spark, sf_dir):
    return evaluation.macro(evaluation.scores(*_evaluated(spark, sf_dir)))


@R.add(
    f"""SELECT p.news_id, 'predicted' AS side, CASE WHEN m.gold_id IS NOT NULL THEN 'hit' ELSE 'miss' END AS outcome, p.person, p.opinion FROM {PREDICTED} p JOIN {MATCHED} m USING (news_id, pred_id)
    UNION ALL SELECT g.news_id, 'gold', CASE WHEN (g.news_id, g.gold_id) IN (SELECT news_id, gold_id FROM {MATCHED} WHERE gold_id IS NOT NULL) THEN 'hit' ELSE 'miss' END, g.person, g.opinion FROM {GOLD} g"""
)
def hit_miss(spark, sf_dir):
    return evaluation.hits_and_misses(*_evaluated(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a parser: each opinion as a clause of one of four shapes.

    0: agent, verb, goal; 1: a second agent behind the verb; 2: a verb of the wide kind; 3: an agent of two words and a second verb of the wide kind.
    """
    rows = _store(spark, sf_dir).where("person <> '' and verb is not null and opinion is not null").withColumn("shape", F.pmod(F.col("news_id") + F.col("ord"), F.lit(4)))

    def node(i: int, parent: int | None, pos: str, role: str | None, word, delim: str = ""):
        return F.struct(F.lit(i).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(pos).alias("pos"), F.lit(role).cast("string").alias("role"), (F.lit(None).cast("string") if word is None else word).alias("word"), F.lit(delim).alias("delim"))

    root, person, verb, opinion = node(0, None, "S", None, None), F.col("person"), F.col("verb"), F.col("opinion")
    shapes = [
        F.array(root, node(1, 0, "Nba", "agent", person), node(2, 0, "VE2", "Head", verb), node(3, 0, "VP", "goal", opinion, ",")),
        F.array(root, node(1, 0, "Nba", "agent", person), node(2, 0, "VE2", "Head", verb), node(3, 0, "Nh", "agent", F.lit("他")), node(4, 0, "VP", "goal", opinion, "。")),
        F.array(root, node(1, 0, "Nba", "agent", person), node(2, 0, "VC2", "Head", verb), node(3, 0, "VP", "goal", opinion, "。")),
        F.array(root, node(1, 0, "NP", "agent", None), node(2, 1, "Nab", "property", F.lit("代表")), node(3, 1, "Nba", "Head", person), node(4, 0, "VE2", "Head", verb), node(5, 0, "VE11", "Head", F.lit("說")), node(6, 0, "VP", "goal", opinion, ";")),
    ]
    tree = F.when(F.col("shape") == 0, shapes[0]).when(F.col("shape") == 1, shapes[1]).when(F.col("shape") == 2, shapes[2]).otherwise(shapes[3])
    return rows.select("news_id", F.col("ord").alias("clause_id"), F.explode(tree).alias("n")).select("news_id", "clause_id", "n.*")


SHAPED = f"(SELECT news_id, ord, person, verb, opinion, (news_id + ord) % 4 AS shape FROM {STORE} WHERE person <> '' AND verb IS NOT NULL AND opinion IS NOT NULL)"
SPOKEN = f"""(SELECT *, coalesce(sum(length(spoken)) OVER (PARTITION BY news_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT news_id, ord, shape, verb, CASE shape WHEN 3 THEN '代表' ELSE '' END || person AS agent,
      CASE shape WHEN 3 THEN '代表' ELSE '' END || person || verb || CASE shape WHEN 1 THEN '他' WHEN 3 THEN '說' ELSE '' END || opinion || CASE shape WHEN 0 THEN ',' WHEN 3 THEN ';' ELSE '。' END AS spoken FROM {SHAPED}))"""
CLAUSES = f"SELECT news_id, ord AS clause_id, verb, CAST(s + length(agent) AS INTEGER) AS verb_start, CAST(s + length(agent) + length(verb) AS INTEGER) AS verb_end, agent, CAST(s AS INTEGER) AS agent_start, CAST(s + length(agent) AS INTEGER) AS agent_end FROM {SPOKEN}"


@R.add(f"{CLAUSES} WHERE shape IN (0, 3)")
def clause_pairs_v1(spark, sf_dir):
    return clauses.clause_pairs(_nodes(spark, sf_dir))


@R.add(CLAUSES)
def clause_pairs_v2(spark, sf_dir):
    return clauses.clause_pairs(_nodes(spark, sf_dir), strict=False)


NEAR = lambda at, mark: f"CASE WHEN strpos(substr(t, CAST({at} AS BIGINT) + 1, 3), '{mark}') > 0 THEN {at} + strpos(substr(t, CAST({at} AS BIGINT) + 1, 3), '{mark}') ELSE {at} END"


@R.add(
    f"""WITH texts AS (SELECT news_id, string_agg(spoken, '' ORDER BY ord) AS t FROM {SPOKEN} GROUP BY news_id),
    cut AS (SELECT news_id, t, unnest(regexp_split_to_array(t, '[。；;]')) AS piece, unnest(range(1, len(regexp_split_to_array(t, '[。；;]')) + 1)) AS n FROM texts),
    bounds AS (SELECT news_id, t, n, sum(length(piece)) OVER (PARTITION BY news_id ORDER BY n) + n - 1 AS r FROM cut),
    sentences AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY news_id ORDER BY n), 0) AS l FROM bounds),
    inside AS (SELECT c.*, x.t, x.l, x.r FROM ({CLAUSES}) c JOIN sentences x ON c.news_id = x.news_id AND x.l - 3 < c.agent_start AND c.verb_end <= x.r WHERE c.agent NOT IN ('你', '妳', '我', '他', '她')),
    first_mark AS (SELECT *, {NEAR('verb_end', ',')} AS b1 FROM inside), marked AS (SELECT *, {NEAR('b1', '」')} AS b FROM first_mark),
    named AS (SELECT m.news_id, m.clause_id, m.l, m.r, m.b, m.verb, m.t, arg_min(p.name, p.name_seq) AS person FROM marked m JOIN {PEOPLE} p ON m.news_id = p.news_id AND contains(m.agent, p.name) WHERE m.r - m.b >= 10 GROUP BY ALL)
    SELECT news_id, CAST(row_number() OVER (PARTITION BY news_id ORDER BY clause_id, l) - 1 AS INTEGER) AS ord, person, verb, substr(t, CAST(b AS BIGINT) + 1, CAST(r - b AS BIGINT)) AS opinion, CAST(b AS INTEGER) AS "begin", CAST(r AS INTEGER) AS "end" FROM named"""
)
def clause_opinion(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    words = nodes.groupBy("news_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "node_id", F.concat(F.coalesce("word", F.lit("")), "delim").alias("w")))), lambda x: x["w"]), "").alias("article"))  # the words of one article
    return clauses.clause_opinions(words, clauses.clause_pairs(nodes, strict=False), _people(spark, sf_dir))


QUERIES, ORACLE = R.queries, R.oracle
