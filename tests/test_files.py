from pyspark.sql import functions as F

from newsloom.operators import sites
from newsloom.sources import files
from newsloom.sources.tables import read_table, written
from newsloom.streaming import daily


def test_csv_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, 't"i', "a\nb, c", None)], "timestamp double, title string, article string, url string")
    files.write_csv(rows, f"{tmp_path}/d/one.csv")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/d/one.csv", rows.schema).collect()] == [tuple(r) for r in rows.collect()]
    folder = files.read_csv_folder(spark, f"{tmp_path}/d", rows.schema)
    assert folder.count() == 1 and "one.csv" in folder.first().file
    assert files.read_json(spark, f"{tmp_path}/none", "a int").count() == 0
    files.write_documents(spark.createDataFrame([("d", "王", 1)], "date string, person string, n int"), f"{tmp_path}/j", "date", "person")
    assert files.read_json(spark, f"{tmp_path}/j", "n int").first().n == 1


def test_lexicon(spark, tmp_path):
    (tmp_path / "n.txt").write_text("沒有\n\n沒有\n", encoding="utf-16")
    (tmp_path / "p.txt").write_text("希望\r\n", encoding="utf-16")
    got = sorted(tuple(r) for r in files.read_lexicon(spark, f"{tmp_path}/n.txt", f"{tmp_path}/p.txt").collect())
    assert got == [("negative", "沒有"), ("negative", "沒有"), ("positive", "希望")]


def test_lists_and_status(spark):
    df = spark.createDataFrame([("/news/20220610/1.htm", "06/10 22:15", 403, 1)], "url string, t string, status_code int, company_id int")
    row = df.select(files.date_in_url("url").alias("d"), files.month_day_time("t", 2022).alias("m"), files.status_action("status_code").alias("a"), files.jitter(3).alias("j")).first()
    assert str(row.d) == "2022-06-10" and str(row.m) == "2022-06-10 22:15:00" and row.a == "banned" and 0 <= row.j <= 10
    waits = spark.createDataFrame([(1, "banned", 60.0)], "company_id int, action string, wait_seconds double")
    assert files.waiting_seconds(df, waits).first().wait_seconds == 60.0
    assert files.waiting_seconds(df.withColumn("status_code", F.lit(500)), waits).first().wait_seconds == 0.0


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/days"
    files.write_days(spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n int"), path)
    files.write_days(spark.createDataFrame([("d2", 3)], "date string, n int"), path)
    assert sorted((r.date, r.n) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 3)]
    files.write_report(spark.createDataFrame([(0.5,)], "precision double"), f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["precision = 0.5"]
    assert written(spark.range(3)).count() == 3


def test_page_records(spark):
    page = """<html><head><title>t</title></head><body><nav><ol><li><a><span>首頁</span></a><li><a><span>政治</span></a></ol></nav><div class="a b" id="x"><h1>題目　一【快訊】</h1>
    <p class="byline">記者王小明／台北報導</p><p>第一段。</p><div class="ad"><p>廣告</p></div><p>第二段<strong>重點<img src=1>後</strong></p><p>延伸閱讀：別的</p><time datetime="2022-06-10 22:15">x</time></div></body></html>"""
    rules = sites.SiteRules(
        title="div#x > h1", paragraphs="div.a > p", remove="div.ad", category="nav li a span", category_at=-1, time="time[datetime]", time_attribute="datetime", time_formats=("%Y-%m-%d %H:%M",),
        reporter_mode="first", reporter_patterns=("^記者(.*?)/.*?報導",), truncate=("延伸閱讀:",), article_rules=(("重點", "要點"),), title_rules=(("【.*?】", ""),), end_mark="。", repair=((r"(<strong[^>]*>[^<]*)(<img[^>]*>)([^<]*)", r"\1</strong>\2<strong>\3"),),
    )
    got = sites.read_page(page, rules)
    assert (got["title"], got["category"], got["reporter"], str(got["published"])) == ("題目 一", "政治", "王小明", "2022-06-10 22:15:00")
    assert got["article"] == "第一段。 第二段要點後。"
    pages = spark.createDataFrame([(1, 1, page), (2, 1, None), (3, 1, "<p>"), (4, 1, "")], "idx int, company_id int, raw_xml string")
    assert [r.idx for r in sites.read_pages(pages, {1: rules}).collect()] == [1]
    assert sites.matches(sites.select(sites.parse_page("<ul><li>a<li class=k>b<li class=k>c</ul>"), "li")[2], "li:nth-child(2 of .k)")
    stopped = sites.read_page(page, sites.SiteRules(title="h1", paragraphs="div.a > p", stop=("第二段",), category="nav li a span", category_at="all", reporter_patterns=("記者(..)",)))
    assert stopped["category"] == "首頁,政治" and stopped["article"].endswith("第一段。") and stopped["reporter"] == "王小"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-02 10:00:00", "b", 2.0)], "event_id int, ts string, event_type string, value double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: daily.read_stream(spark, f"{tmp_path}/in", rows.schema)
    assert daily.run_to_table(daily.unique_events(stream()), f"{tmp_path}/u").count() == 2
    days = daily.run_to_table(daily.daily_counts(stream()), f"{tmp_path}/d", "complete")
    assert {(str(r.day), r.n) for r in days.collect()} == {("2024-01-01", 2), ("2024-01-02", 1)}
    opinions = spark.createDataFrame([(1, 0, "王", "2024-01-01 09:00"), (1, 0, "王", "2024-01-01 08:00"), (2, 0, "李", None)], "news_id int, ord int, person string, datetime string")
    opinions.write.parquet(f"{tmp_path}/o")
    for _ in range(2):
        daily.keep_store(daily.read_stream(spark, f"{tmp_path}/o", opinions.schema), f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    assert sorted((r.news_id, r.person) for r in spark.read.parquet(f"{tmp_path}/s/store").collect()) == [(1, "王"), (2, "李")]


def test_tables(spark, data):
    assert read_table(spark, data, "outlet", "company_id").count() == 24
