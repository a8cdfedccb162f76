import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import components, entities, evaluation, grouping, prepare, topics, views


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    df = spark.createDataFrame([*edges, (None, 1), (7, None)], "a int, b int")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(df.where("a < 0")).count() == 0


def test_veto_and_union(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3)], "file string, t int")
    assert {tuple(r) for r in prepare.veto_files(rows, "file", "t").collect()} == {("b", 2), (None, 3)}
    assert prepare.union_files(rows, rows.select("t")).where("file is null").count() == 5
    assert prepare.with_text(rows, "file", "t").count() == 2
    days = spark.createDataFrame([("d", "y"), ("d", "x"), ("e", "z")], "date string, url string")
    assert {(r.url, r.news_id) for r in prepare.number_news(days, "date", "url").collect()} == {("x", 0), ("y", 1), ("z", 0)}
    tags = spark.createDataFrame([([("王", "PERSON"), ("三成", "PERCENT")],)], "e array<struct<text:string,tag:string>>")
    assert tags.select(F.size(prepare.topical("e"))).first()[0] == 1
    words = spark.createDataFrame([("他",), ("王",)], "a string")
    assert [r.a for r in words.where(prepare.no_pronoun("a")).collect()] == ["王"]


def fold(names):
    store, out = [], {}
    for n in names:
        if not n or n in out:
            continue
        home = next((c for c in store if n in c or c in n), None)
        if home is None:
            store.append(n)
            home = n
        out[n] = home
    return out


def test_entities_equal_the_sequential_fold(spark):
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("王李張小明"), rng.integers(1, 5))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seq int")
    got = {r.name: r.canonical for r in entities.canonical_names(df).collect()}
    assert got == fold(names)
    # names of any length, and chains in which each name meets the next
    long = "長" * 80 + "名字"
    chain = ["".join(chr(0x4E00 + i + k) for k in range(3 if i % 2 else 2)) for i in range(40)]
    for names in ([long, "名字", "長長"], ["名字", long, "字"], chain, chain[::-1], ["一"] + [f"一{c}" for c in "甲乙丙"] + ["乙"]):
        df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seq int")
        assert {r.name: r.canonical for r in entities.canonical_names(df).collect()} == fold(names)
    assert entities.canonical_names(df.limit(0)).count() == 0
    opinions = spark.createDataFrame([(1, 0, "小明", "2022-01-01 10:00"), (1, 0, "小明", None), (2, 0, "無名", "2022-01-02 10:00")], "news_id int, ord int, person string, datetime string")
    renamed = entities.rename(opinions, spark.createDataFrame([("小明", "王小明")], "name string, canonical string"))
    assert {r.person for r in renamed.collect()} == {"王小明", "無名"}
    stored = entities.store_rows(opinions)
    assert sorted((r.news_id, r.datetime) for r in stored.collect()) == [(1, "2022-01-01 10:00"), (2, "2022-01-02 10:00")]
    history = spark.createDataFrame([("d1", 1), ("d2", 1)], "date string, n int")
    again = entities.append_clusters(entities.append_clusters(history, history.where("date = 'd2'")), history.where("date = 'd2'"))
    assert again.count() == 2


def test_topics(spark):
    rows = spark.createDataFrame([(0, "甲", 1), (0, "甲", 2), (0, "乙", 3), (0, "丙", 4), (-1, "丁", 5)], "topic int, ner string, seq int")
    counts = topics.entity_counts(rows, "topic", seq="seq", from_zero=True)
    assert {(r.ner, r.cnt) for r in counts.collect()} == {("甲", 1), ("乙", 0), ("丙", 0)}
    assert [(r.rank, r.ner) for r in topics.top_tags(counts, "topic", k=2).orderBy("rank").collect()] == [(1, "甲"), (2, "乙")]
    assert topics.as_map(counts, "topic").first().topic_ner_dic == {"甲": 1, "乙": 0, "丙": 0}
    news = spark.createDataFrame([(1, 0, "同題"), (2, 0, "同題"), (3, -1, "離"), (4, 1, "另")], "news_id int, topic int, title string")
    rep = spark.createDataFrame([(0, 2), (1, 4)], "topic int, news_id int")
    flagged = topics.flag_by_title(news, rep)
    assert {r.news_id for r in flagged.where("representative_docs").collect()} == {1, 2, 4}
    assert {tuple(r) for r in topics.representative_rows(flagged).collect()} == {(0, 1), (1, 4)}
    titles = spark.createDataFrame([(0, "零"), (1, "一")], "topic int, title string")
    assert {(r.news_id, r.represent_title) for r in topics.with_topic_title(news, titles).where("topic = -1").collect()} == {(3, None)}
    assert {(r.news_id, r.represent_title) for r in topics.with_topic_title(news, titles, outliers="last_topic").where("topic = -1").collect()} == {(3, "一")}
    clusters = spark.createDataFrame([("d1", 0, "題", 1), ("d2", 0, "題", 2), ("d1", 0, "乙", 5)], "date string, little_cluster_number int, little_cluster_title string, total_cluster_number int")
    store = spark.createDataFrame([("題",), ("無",)], "represent_title string")
    assert {tuple(r) for r in topics.total_by_title(store, clusters).collect()} == {("題", 2), ("無", None)}
    keys = spark.createDataFrame([("d1", 0), ("d9", 0)], "date string, little_cluster_number int")
    assert {r.total_cluster_number for r in topics.total_by_number(keys, clusters).collect()} == {5, -1}


def test_clusters_of_opinions(spark):
    assert [list(grouping.cluster_range(n)) for n in (3, 4, 5, 6, 8)] == [[2], [2, 3], [3, 4], [3, 4, 5], [4, 5, 6, 7]]
    points = np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0]], float)
    labels, _ = grouping.k_means(points, 3)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    assert grouping.medoid_rows(points) == grouping.medoid_rows(points) and len(grouping.medoid_rows(points)) in (3, 4)
    assert grouping.silhouette(points, labels) > 0.5
    rows = spark.createDataFrame([(1, i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2, 9, [1.0, 1.0])], "g int, k int, v array<double>")
    got = grouping.opinion_medoids(rows, "g", "k", "v").collect()
    assert (2, 9) in {tuple(r) for r in got} and 3 <= len([r for r in got if r.g == 1]) <= 4
    swept = grouping.sweep_clusters(rows.where("g = 1"), "k", "v", range(2, 4)).collect()
    assert len(swept) == 5 and sum(r.medoid for r in swept) == len({r.cluster for r in swept})
    assert len(grouping.sweep_clusters(rows.where("k < 2"), "k", "v").collect()) == 2


@pytest.mark.parametrize("literal", [False, True])
def test_pairs_of_opinions(spark, literal):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], "長長"), (1, 1, [1.0, 0.01], "短"), (2, 0, [1.0, 0.0], "甲"), (2, 1, [0.0, 1.0], "乙"), (3, 0, [1.0, 1.0], "獨")], "g int, k int, v array<double>, t string")
    kept = {(r.g, r.k) for r in grouping.pair_rule(rows, "g", "k", "v", "t", literal=literal).collect()}
    assert kept == ({(1, 1), (3, 0)} if literal else {(1, 1), (2, 0), (2, 1), (3, 0)})
    left = {(r.g, r.k) for r in grouping.without_paraphrases(rows, "g", "k", "v", "t").collect()}
    assert left == {(1, 0), (2, 0), (2, 1), (3, 0)}


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, 0, "王小明", "預算要檢討"), (1, 1, "李四", "不行"), (2, 0, "張三", "好")], "news_id int, gold_id int, person string, opinion string")
    pred = spark.createDataFrame([(1, 0, "小明", "預算要檢討。"), (1, 1, "王五", "不行"), (3, 0, "張三", "好")], "news_id int, pred_id int, person string, opinion string")
    got = {r.news_id: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluation.scores(pred, gold).collect()}
    assert got == {1: (1, 1, 1, 0.5, 0.5), 2: (0, 0, 1, 0.0, 0.0), 3: (0, 1, 0, 0.0, 0.0)}
    assert evaluation.macro(evaluation.scores(pred, gold)).first().f1 == pytest.approx(0.5 / 3, abs=1e-6)
    assert evaluation.hits_and_misses(pred, gold).where("outcome = 'hit'").count() == 2
    spans = [(1, 0, 20, "全", "opinion"), (1, 0, 3, "王小明", "person"), (1, 5, 7, "李四", "person"), (1, 3, 4, "說", "verb"), (1, 30, 40, "無", "opinion")]
    triples = evaluation.gold_triples(spark.createDataFrame(spans, "news_id int, start int, end int, text string, label string")).collect()
    assert [(t.person, t.verb, t.opinion) for t in triples] == [("王小明", "說", "全")]


def test_views(spark):
    news = spark.createDataFrame([("2022-01-01", 0, 1, "甲", "文", True), ("2022-01-01", 0, 2, "乙", "文", False), ("2022-01-01", -1, 3, "丙", "文", False)], "date string, topic int, news_id int, title string, article string, representative_docs boolean")
    row = views.cluster_list(news).first()
    assert (row.represent_title, [x.news_id for x in row.article_list]) == ("甲", [2])
    page = views.front_page(spark.createDataFrame([("2022-01-01", 0, 1)], "date string, topic int, topic_represent_article int"), news)
    assert page.count() == 1 and '"title":"甲"' in views.front_page_json(page).first().json
    opinions = spark.createDataFrame([(1, 1, "王", "說", "b", 0, 0), (1, 0, "王", "說", "a", 0, 0)], "news_id int, ord int, person string, verb string, opinion string, negative_score int, positive_score int")
    lists = {r.news_id: [o.opinion for o in r.opinions] for r in views.article_opinions(news, opinions).collect()}
    assert lists == {1: ["a", "b"], 2: [], 3: []}
    assert views.day_view(news, "2022-01-02", "last").count() == 3 and views.day_view(news, "2022-01-02").count() == 0
    store = spark.createDataFrame([("王", 1, "2022-01-02 09:00", 5, "b"), ("王", 1, None, 6, "c"), ("王", 1, "2022-01-01 09:00", 4, "a")], "person string, total_cluster_number int, datetime string, news_id int, opinion string")
    assert [r.opinion for r in views.person_timeline(store).orderBy("place").collect()] == ["a", "b", "c"]
    assert tuple(views.person_slices(store).first()) == ("王", 1, 3, "2022-01-01 09:00", "2022-01-02 09:00")
    clusters = spark.createDataFrame([("2022-01-01", 0, "題", 1)], "date string, little_cluster_number int, little_cluster_title string, total_cluster_number int")
    assert views.person_on_issue(store, clusters, "王", "2022-01-01", 0).count() == 3 and views.person_on_issue(store, clusters, "王", "2022-01-09", 0).count() == 0
    assert str(store.select(views.day_of("datetime")).first()[0]) == "2022-01-02"
