import random
import re

import pytest

from newsloom.operators import clauses, mentions, quotes, sentiment

PATTERN = re.compile(quotes.RULES.pattern)


def plain_spans(text):
    return [(m.group(1), m.start(1), m.end(1), m.start(3), m.end(0)) for m in PATTERN.finditer(text)]


def plain_attribution(text, names):
    found = sorted(((m.start(), m.end(), n, s) for s, n in enumerate(names) for m in re.finditer(re.escape(n), text)), key=lambda x: x[0])
    out = []
    for verb, vs, ve, b, e in plain_spans(text):
        if e - b < 10:
            continue
        for start, end, name, _ in reversed([f for f in found if f[1] <= b]):
            if any(w in text[start - 3 : start] for w in quotes.RULES.blocking):
                continue
            if b - start <= 30:
                out.append((len(out), name, start, verb, text[b:e]))
            break
    return out


CASES = [
    ("王小明說道這件事情不能再拖了啦。", ["王小明"]),
    ("王小明表示:「我們會再看看情況怎麼樣。」李四在旁。", ["王小明", "李四"]),
    ("在王小明家,李四認為預算應該重新檢討才對。", ["王小明", "李四"]),
    ("於王小明指出預算應該重新檢討才對吧。", ["王小明"]),
    ("王小明來了,這裡有很多很多很多很多很多很多很多很多很多很多的字表示預算應該重新檢討才對。", ["王小明"]),
    ("x王指出預算應該重新檢討才對吧真的。", ["王"]),
    ("😀王小明強調,預算😀應該重新檢討才對。」」後。", ["王小明", "王"]),
    ("王小明說。", ["王小明"]),
    ("", ["王小明"]),
    (None, ["王小明"]),
    ("王小明說第一行\n沒有完。李四說預算應該重新檢討才對吧。", ["王小明", "李四", ""]),
]


@pytest.fixture(scope="module")
def attributed(spark):
    rng = random.Random(5)
    parts = ["王小明", "李四", "王五", "在", "於", "說", "表示", "指出:「", "認為,", "預算應該重新檢討", "好", "。", "。」", "\n", "😀", ",", "這是一段很長的話不會停下來的那一種"]
    cases = CASES + [("".join(rng.choice(parts) for _ in range(40)), ["王小明", "李四", "王五"]) for _ in range(150)]
    news = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "news_id int, article string")
    people = spark.createDataFrame([(i, n, s) for i, (_, ns) in enumerate(cases) for s, n in enumerate(ns)], "news_id int, name string, name_seq int")
    located = mentions.locate(news, people, name="name")
    return cases, news, located


def test_spans_equal_a_plain_scan(spark, attributed):
    cases, news, _ = attributed
    got = {}
    for r in quotes.quote_spans(news).collect():
        got.setdefault(r.news_id, []).append((r.verb, r.verb_start, r.verb_end, r.begin, r.end))
    for i, (text, _) in enumerate(cases):
        assert sorted(got.get(i, []), key=lambda x: x[1]) == plain_spans(text or ""), text


def test_attribution_equals_a_plain_walk_back(spark, attributed):
    cases, news, located = attributed
    got = {}
    for r in quotes.attribute_quotes(news, located).collect():
        got.setdefault(r.news_id, []).append((r.ord, r.person, r.person_start, r.verb, r.opinion))
    for i, (text, names) in enumerate(cases):
        assert sorted(got.get(i, [])) == plain_attribution(text or "", [n for n in names if n]), text


def test_candidates_and_order(spark):
    rows = [(1, "王小明", "PERSON", 0, 3), (1, "王大同", "PERSON", 9, 12), (1, "王大同", "PERSON", 20, 23), (1, "蔡", "PERSON", 30, 31), (1, "環保署", "ORG", 40, 43), (1, "三成", "PERCENT", 50, 52)]
    entities = spark.createDataFrame(rows, "news_id int, text string, tag string, start int, end int")
    got = {(r.name, r.uses, r.name_seq) for r in mentions.surname_order(mentions.person_candidates(entities)).collect()}
    assert got == {("王大同", 1, 0), ("環保署", 0, 1), ("王小明", 0, 2)}


def test_short_names(spark):
    assert mentions.expand_short("王說好,王也說", [("王", 0, 1), ("王", 4, 5)], ["王小明"]) == "王小明說好,王小明也說"
    assert mentions.expand_short("王說", [("王", 0, 1)], ["王小明", "王五"]) == "王小明說"
    assert mentions.expand_short("王說,李四說,無", [("李四", 3, 5), ("王", 0, 1), ("", 6, 6)], ["王小明", "李四"]) == "王小明說,李四說,無"
    news = spark.createDataFrame([(1, "王 說好"), (2, None), (3, "無")], "news_id int, article string")
    entities = spark.createDataFrame([(1, "王", "PERSON", 0, 1), (1, "王小明", "PERSON", 10, 13)], "news_id int, text string, tag string, start int, end int")
    got = {r.news_id: (r.article_coref, list(r.people)) for r in mentions.expand_short_names(news, entities).collect()}
    assert got == {1: ("王小明說好", ["王小明"]), 2: (None, []), 3: ("無", [])}


def test_annotator_hook(spark):
    news = spark.createDataFrame([(1, "王 小明來")], "news_id int, article string")
    found = mentions.annotate(news, lambda texts: [[("王小明", "PERSON", t.find("王小明"), t.find("王小明") + 3)] for t in texts]).collect()
    assert [(r.news_id, r.text, r.start, r.end) for r in found] == [(1, "王小明", 0, 3)]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_sentiment_is_a_bag(spark, limit):
    words = spark.createDataFrame([("negative", "沒有"), ("negative", "沒有"), ("negative", "有錢"), ("positive", "希望"), ("positive", " "), ("positive", None), ("positive", "好")], "polarity string, word string")
    rows = spark.createDataFrame([(1, "沒有錢也有希望"), (2, "好好好"), (3, ""), (4, None)], "i int, opinion string")
    got = {r.i: (r.negative_score, r.positive_score, list(r.negative_list)) for r in sentiment.score(rows, words, broadcast_words=limit).collect()}
    assert got == {1: (3, 1, ["有錢", "沒有", "沒有"]), 2: (0, 1, []), 3: (0, 0, []), 4: (0, 0, [])}


NODES = "news_id int, clause_id int, node_id int, parent_id int, pos string, role string, word string, delim string"


def test_clause_pairs_and_opinions(spark):
    rows = [
        (1, 0, 0, None, "S", None, None, ","), (1, 0, 1, 0, "NP", "agent", None, ","), (1, 0, 2, 1, "Nb", None, "王", ","), (1, 0, 3, 1, "Nb", None, "小明", ","), (1, 0, 4, 0, "VE2", "Head", "說", ","),
        (1, 1, 0, None, "S", None, None, "。"), (1, 1, 1, 0, "VC", "Head", "預算應該重新檢討了", "。"),
        (1, 2, 0, None, "S", None, None, "。"), (1, 2, 1, 0, "Nh", "agent", "他", "。"), (1, 2, 2, 0, "VE2", "Head", "說", "。"), (1, 2, 3, 0, "VE2", "x", "指", "。"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    strict = {(r.clause_id, r.verb, r.verb_start, r.agent, r.agent_start, r.agent_end) for r in clauses.clause_pairs(nodes).collect()}
    assert strict == {(0, "說", 3, "王小明", 0, 3)}
    wide = {(r.clause_id, r.agent) for r in clauses.clause_pairs(nodes, strict=False).collect()}
    assert wide == {(0, "王小明"), (2, "他")}
    deep = [(1, 0, 0, None, "S", None, None, "")] + [(1, 0, i, i - 1, "NP", "agent" if i == 1 else None, None, "") for i in range(1, 30)]
    deep += [(1, 0, 30, 29, "Nb", None, "王", ""), (1, 0, 31, 5, "Nb", None, "五", ""), (1, 0, 32, 0, "VE2", "Head", "說", "")]
    assert clauses.clause_pairs(spark.createDataFrame(deep, NODES)).first().agent == "王五"
    news = spark.createDataFrame([(1, "王小明說,預算應該重新檢討了。他說指。")], "news_id int, article string")
    people = spark.createDataFrame([(1, 0, "小明"), (1, 1, "王小明")], "news_id int, name_seq int, name string")
    got = [(r.person, r.verb, r.opinion) for r in clauses.clause_opinions(news, clauses.clause_pairs(nodes), people).collect()]
    assert got == [] or got == [("小明", "說", "預算應該重新檢討了")]
    longer = spark.createDataFrame([(1, "王小明說,「預算應該重新檢討了吧。他說指。")], "news_id int, article string")
    got = [(r.person, r.opinion) for r in clauses.clause_opinions(longer, clauses.clause_pairs(nodes), people).collect()]
    assert got == [("小明", "「預算應該重新檢討了吧")]
    spaces = spark.createDataFrame([(1, [0, 2])], "news_id int, space_index array<int>")
    moved = clauses.shift_for_spaces(clauses.clause_pairs(nodes), spaces).first()
    assert (moved.agent_start, moved.agent_end, moved.verb_start) == (1, 4, 5)


def test_known_names(spark):
    names = spark.createDataFrame([("王小明", "PERSON"), ("小明", "PERSON"), ("小明", "ORG"), ("", "ORG"), (None, "ORG")], "text string, tag string")
    news = spark.createDataFrame([(1, "😀王 小明說小明"), (2, ""), (3, None)], "news_id int, article string")
    got = {tuple(r) for r in mentions.annotate(news, mentions.known_names(names)).collect()}
    assert got == {(1, "王小明", "PERSON", 1, 4), (1, "小明", "ORG", 2, 4), (1, "小明", "ORG", 5, 7)}
    assert mentions.annotate(news, mentions.known_names(names.limit(0))).count() == 0
    with pytest.raises(ValueError):
        mentions.known_names(names, 1)
