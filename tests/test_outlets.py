"""One page of each layout."""

import datetime

from pyspark.sql import functions as F

from newsloom.operators import outlets, sites

PAGES = {
    "cna": '<div class=centralContent><div class=breadcrumb><a>首頁</a><a>政治</a></div><h1><span>標題</span></h1><div class="x paragraph"><p>(中央社記者王小明)第一段。</p><p>第二段。(編輯:李四)1101231</p></div><div class=paragraph><p>別的</p></div></div>',
    "chinatimes": '<nav class=breadcrumb-wrapper><ol><li><a><span>首頁</span></a></li><li><a><span>政治</span></a></li></ol></nav><header class=article-header><h1 class=article-title>標題</h1><time datetime="2022-01-02 03:04">x</time></header><div class=author><a>王小明</a></div><div class=article-body><p>第一段。</p><p>第二段。</p></div>',
    "ettoday": '<meta name="pubdate" content="2022-01-02T03:04:05+0800"><div class=part_breadcrumb><div><a><span>政治</span></a></div></div><h1 class=title>標題</h1><div class=story><p class=no>圖</p><p>記者王小明/台北報導</p><p>第一段。<b>粗</b></p><p>第二段。</p></div>',
    "ftv": "<h1 class=text-center>標題</h1><div id=preface><p>第一段。</p></div><div id=newscontent><p>第二段。(民視新聞/王小明 台北報導)</p></div>",
    "setn": '<input type=hidden id=pageGroupID value=6><h1 class=news-title-3>標題</h1><time class=page-date>2022/01/02 03:04:05</time><div id=Content1><p>記者王小明/台北報導</p><p class=x>圖</p><p>第一段。</p><p>第二段。</p></div>',
    "storm": '<div id=title_tags_wrapper><a>政治</a><a>國內</a></div><h1 id=article_title>標題</h1><div id=author_block><span class=info_author>王小明</span></div><span id=info_time>2022-01-02 03:04</span><div id=CMS_wrapper><blockquote><p aid=9>引</p></blockquote><p aid=1>第一段。</p><p dir=ltr>第二段。</p></div>',
    "tvbs": '<meta name=pubdate content="2022-01-02T03:04:05+08:00"><div class=title_box><h1 class=title>標題</h1></div><div class=author_box><div class=author><a>王小明</a></div></div><div id=news_detail_div><div class=img>圖</div><p>第一段。</p><p>第二段。</p><span class=endtext>完</span></div>',
}


def test_layouts(spark):
    ids = {name: i for i, name in enumerate(PAGES)}
    df = spark.createDataFrame([(i, i, f"<html><body>{PAGES[name]}</body></html>") for name, i in ids.items()] + [(99, 3, "<html>"), (98, 3, None)], "idx int, company_id int, raw_xml string")
    got = {r.company_id: r for r in sites.read_pages(df, outlets.rules_by_id(ids)).collect()}
    assert set(got) == set(ids.values())
    for name, i in ids.items():
        r = got[i]
        assert (name, r.title, r.article, r.reporter) == (name, "標題", "第一段。 第二段。", "李四" if name == "x" else "王小明,李四" if name == "cna" else "王小明")
        assert r.category == {"ftv": "", "tvbs": "", "storm": "政治,國內"}.get(name, "政治")
        assert (r.published is None) == (name in ("cna", "ftv"))
    assert got[ids["setn"]].published == datetime.datetime(2022, 1, 2, 3, 4, 5)


def test_categories_in_links(spark):
    df = spark.createDataFrame([("https://x/news/detail/2022102P01M1", "/politics/123"), ("https://x/1", "/none/1"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(outlets.ftv_category("a"), outlets.tvbs_category(F.col("b"))).collect()] == [("政治", "政治"), ("", ""), ("", "")]
