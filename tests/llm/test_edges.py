"""Nulls in any column, empty and very long texts, repeated rows, ties, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import canonical, leaks, main_text, names, near_duplicates, packing, repeated_lines, sentences, spans, stories

OPINION = "[{{'person': '{0}', 'verb': '說', 'opinion': '{1}', 'order': 0, 'negative_score': 0, 'positive_score': 0, 'negative_list': [], 'positive_list': []}}]"
LONG = "這是一段很長的文字,沒有盡頭。" * 20_000
ARTICLES = "news_id int, title string, article string, opinions string, little_topic string, body string, doc long, piece string, kind string, name string, id int, a string, n int"
PAGES = "idx int, company_id int, raw_xml string, url_pattern string, line string, keys string, pages int, n int, band int"
DOCS = "doc_id long, text string, id long, gram string, fingerprint long, start int, size int, minimiser long, tokens long, spec_id int, piece string"
EXTRA = lambda n: (None,) * n


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        (1, "t", "預算應該重新檢討,里長表示同意。", OPINION.format("王小明", "好。"), "0"),
        (1, "t", "預算應該重新檢討,里長表示同意。", OPINION.format("王小明", "好。"), None),
        (2, None, None, None, None),
        (3, "", "", "", ""),
        (4, "x", "   \n \n", "[", "-1"),
        (5, "x", LONG, "[]", "-1"),
        (6, "x", LONG + "。", OPINION.format("", "ｘ"), "-1"),
        (None, "x", "預算應該重新檢討,里長表示同意。", OPINION.format("李四", "好。"), "-1"),
        (7, "x", "短", "None", "-1"),
    ]
    return spark.createDataFrame([r + EXTRA(8) for r in rows], ARTICLES)


@pytest.fixture(scope="module")
def pages(spark):
    page = "<html><head><title>題</title></head><body><p>頁尾版權所有</p><p>預算應該重新檢討的這件事情已經談了很久。</p></body></html>"
    rows = [(1, 1, page), (1, 1, page), (2, 1, page), (3, 1, page), (4, 1, page), (5, 1, None), (6, 1, ""), (7, None, page), (None, 1, page), (8, 2, "<body>" + "<p>" * 50_000), (9, 2, "<" * 100_000), (10, 2, "<body><p>" + LONG)]
    return spark.createDataFrame([r + EXTRA(6) for r in rows], PAGES)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " "), (None, LONG), (6, "x" * 159), (7, "x" * 159), (8, "ab" * 200), (9, "ab" * 200 + "c")]
    return spark.createDataFrame([r + EXTRA(9) for r in rows], DOCS)


ON_ARTICLES = {
    "pairs": (near_duplicates.near_duplicate_pairs, {(5, 6)}),
    "groups": (near_duplicates.near_duplicate_groups, {(1, 1, 0), (5, 5, 1), (6, 5, 1)}),
    "names": (names.same_names, set()),
    "name_groups": (names.name_groups, {("王小明", "王小明"), ("李四", "李四")}),
    "affected": (canonical.affected_fields, {(6, "opinions")}),
    "stories": (stories.story_members, set()),
    "typical": (stories.story_clusters, set()),
}


@pytest.mark.parametrize("what", sorted(ON_ARTICLES))
def test_articles(articles, what):
    make, expected = ON_ARTICLES[what]
    assert {tuple(r) for r in make(articles).collect()} == expected
    assert make(articles.limit(0)).count() == 0
    assert make(articles.select("news_id", "article", "opinions").where("news_id = 2")).count() == 0


def test_sentence_rows(articles):
    rows = sentences.sentence_boundaries(articles).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    by = {}
    for r in rows:
        by.setdefault(r.news_id, set()).add(r.end_pos)
    assert by[1] == {16} and by[7] == {1} and len(by[5]) == 20_000 and not by.keys() & {2, 3, 4, None}
    assert sentences.sentence_units(articles.limit(0)).count() == 0


def test_canonical_rows(articles):
    rows = canonical.canonical_fields(articles).collect()
    assert sorted((r.news_id, r.field) for r in rows) == [(1, "article"), (1, "opinions"), (3, "article"), (4, "article"), (5, "article"), (6, "article"), (6, "opinions"), (7, "article")]
    assert canonical.canonical_fields(articles.limit(0)).count() == 0


def test_pages(pages):
    found = {(r.company_id, r.line): (r.pages, r.of_pages) for r in repeated_lines.repeated_lines(pages).collect()}
    assert found[1, "頁尾版權所有"] == (4, 5)
    assert (1, "預算應該重新檢討的這件事情已經談了很久。") in found and not any(c == 2 for c, _ in found)
    freed = {r.idx: (r.text, r.removed) for r in repeated_lines.freed_pages(pages).collect()}
    assert freed[1] == ("", 2) and freed[6] == ("", 0) and set(freed) == {1, 2, 3, 4, 6, 8, 9, 10}
    lines = main_text.main_line_hashes(pages).collect()
    assert {r.idx for r in lines} == {1, 2, 3, 4, 7, 10} and len(lines) == len({tuple(r) for r in lines})
    for make in (repeated_lines.found_lines, repeated_lines.freed_pages, main_text.main_line_hashes):
        assert make(pages.limit(0)).count() == 0
        assert make(pages.where("raw_xml is null")).count() == 0


def test_documents(documents, spark):
    assert {tuple(r) for r in spans.shared_pairs(documents).collect()} == {(1, 2), (8, 9)}
    share = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_share(documents).collect()}
    assert share[1] == (len(LONG), len(LONG)) and share[9] == (401, 400) and share[3] == (0, 0) and share[6] == (159, 0) and set(share) == set(range(1, 10))
    assert spans.shared_pairs(documents.limit(0)).count() == 0 and spans.shared_share(documents.limit(0)).count() == 0
    items = spark.createDataFrame([(1, LONG[:200], 5), (1, LONG[:200], 5), (2, None, 5), (3, "", 5), (None, LONG[:100], 5), (4, "x" * 60, 5)], "item_id long, text string, doc_id int")
    for limit in (leaks.BROADCAST_FINGERPRINTS, 0):
        assert {tuple(r) for r in leaks.find_leaks(documents, items, broadcast_rows=limit).collect()} == {(1, 1), (2, 1), (6, 4), (7, 4)}
        assert leaks.find_leaks(documents, items.limit(0), broadcast_rows=limit).count() == 0
        assert leaks.find_leaks(documents.limit(0), items, broadcast_rows=limit).count() == 0


def test_packing(documents, spark):
    specs = spark.createDataFrame([(1, 64, "x"), (1, 64, "x"), (2, 0, "x"), (3, None, "x"), (None, 9, "x"), (4, 7, "x")], "spec_id int, capacity_tokens int, doc_id string")
    packed = packing.pack_documents(documents, specs, group_items=500)
    rows = packed.collect()
    assert {r.spec_id for r in rows} == {1, 4}
    sizes = {r.doc_id: r.tokens for r in packing.token_sizes(documents).collect()}
    for spec, capacity in ((1, 64), (4, 7)):
        own = [r for r in rows if r.spec_id == spec]
        held, pieces = {}, {}
        for r in own:
            held[r.container] = held.get(r.container, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.tokens))
        held.pop(None)
        assert max(held.values()) <= capacity
        for doc, n in sizes.items():
            got = sorted(pieces[doc])
            assert sum(p[2] for p in got) == n and len(got) == max(1, -(-n // capacity)) and [p[1] for p in got] == [i * capacity for i in range(len(got))]
    assert packing.fill_report(packed, specs).count() == 2
    assert packing.pack_documents(documents.limit(0), specs).count() == 0 and packing.pack_documents(documents, specs.limit(0)).count() == 0


def test_clashing_columns(articles):
    odd = articles.withColumns({"canonical": F.lit(1), "field": F.lit(2), "affected": F.lit(3), "number": F.lit(4), "group": F.lit(5), "story": F.lit(6), "gram": F.lit(7)})
    assert near_duplicates.near_duplicate_pairs(odd).count() == 1
    assert names.name_groups(odd).count() == 2 and stories.story_members(odd).count() == 0 and canonical.affected_fields(odd).count() == 1
