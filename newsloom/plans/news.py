"""Queries over texts, pages and times."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times
from ..operators import outlets, prepare, sites
from ..streaming import daily
from ..sources.tables import shared_folder
from .registry import Registry, table

R = Registry()
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
PAGES = "(SELECT DISTINCT idx, company_id, raw_xml, url_pattern FROM raw_news WHERE raw_xml IS NOT NULL)"
ARTICLES = "(SELECT DISTINCT news_id, article FROM article_page WHERE article IS NOT NULL)"

CUT = ["本報將持續追蹤", "更多.{1,12}消息", "延伸專題:"]
RULES = [(r"\(註:[^()]*\)", ""), (r"詳細數字公布於[^,]*,", ""), (r"No\.(\d+)號", "第$1號"), (r"!{2,}", "!"), (r"\?{2,}", "?")]
NOISE = ["影音》", "快訊》", "!$"]
REPORTERS = [r"記者([^／<]{2,4})／", r"撰稿：([^ <]{2,4}) ", r"文／([^（<]{2,4})（"]


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_page", "news_id", "article").where("article is not null").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_news", "idx", "company_id", "raw_xml", "url_pattern").where("raw_xml is not null").distinct()


@R.add(f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS collapsed FROM documents")
def ws_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.collapse_whitespace("text").alias("collapsed"))


@R.add(
    f"""WITH p AS (SELECT news_id, article, string_split(article, ' ') AS parts FROM {ARTICLES}),
    e AS (SELECT news_id, article, unnest(range(1, len(parts))) AS n, parts FROM p WHERE len(parts) > 1),
    i AS (SELECT DISTINCT news_id, article, CAST(length(array_to_string(parts[1:n], '')) AS INTEGER) AS place FROM e)
    SELECT news_id, place FROM i"""
)
def space_strip_index(spark, sf_dir):
    return _articles(spark, sf_dir).select("news_id", F.explode(X.space_index("article")).alias("place"))


@R.add(f"SELECT news_id, trim(regexp_replace(article, ' +', ' ', 'g')) AS restored FROM {ARTICLES}")
def space_restore(spark, sf_dir):
    rows = _articles(spark, sf_dir)
    return rows.select("news_id", F.trim(X.restore_spaces(X.strip_spaces("article"), X.space_index("article"))).alias("restored"))


def _nfkc_sql(column: str) -> str:
    """Each character's compatibility form, from the Unicode tables of Python, then the canonical composition, with white space collapsed."""
    # Hangul syllables and other canonical forms are left to nfc_normalize
    forms = {c: n for c in map(chr, range(0xA0, 0x30000)) if not 0xAC00 <= ord(c) < 0xE000 and (n := unicodedata.normalize("NFKD", c)) != c and n != unicodedata.normalize("NFD", c)}
    keys, values = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for xs in (forms, forms.values()))
    form = f"nfc_normalize(array_to_string(list_transform(string_split({column}, ''), lambda c: coalesce(map({keys}, {values})[c], c)), ''))"
    return f"trim(regexp_replace({form}, '{WS}+', ' ', 'g'))"


@R.add(f"SELECT doc_id, {_nfkc_sql('text')} AS normalised FROM documents")
def nfkc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.nfkc("text").alias("normalised"))


@R.add(f"SELECT news_id, replace(article, ',', '，') AS widened FROM {ARTICLES}")
def comma_widen(spark, sf_dir):
    return _articles(spark, sf_dir).select("news_id", X.widen_commas("article").alias("widened"))


@R.add(
    f"""SELECT p.idx, p.company_id, CASE WHEN regexp_matches(u.url, '^(?:' || o.url_regex || ')') THEN regexp_extract(u.url, '^(?:' || o.url_regex || ')', 1) ELSE u.url END AS short_url
    FROM {PAGES} p JOIN outlet o USING (company_id), LATERAL (SELECT o.base_url || replace(replace(replace(o.url_regex, '\\.', '.'), o.base_url, ''), '(\\d+)', coalesce(p.url_pattern, 'none')) AS url) u"""
)
def url_compress(spark, sf_dir):
    outlet = table(spark, sf_dir, "outlet", "company_id", "base_url", "url_regex")
    path = F.replace(F.replace(F.replace("url_regex", F.lit("\\."), F.lit(".")), F.col("base_url"), F.lit("")), F.lit("(\\d+)"), F.coalesce("url_pattern", F.lit("none")))
    rows = _pages(spark, sf_dir).join(outlet, "company_id").withColumn("url", F.concat("base_url", path))
    return rows.select("idx", "company_id", X.compress_url("url", "url_regex").alias("short_url"))


@R.add(f"SELECT o.company, o.base_url, count(*) AS pages, count(p.url_pattern) AS known FROM {PAGES} p JOIN outlet o USING (company_id) GROUP BY ALL")
def outlet_lookup(spark, sf_dir):
    outlet = table(spark, sf_dir, "outlet", "company_id", "company", "base_url")
    return _pages(spark, sf_dir).join(outlet, "company_id").groupBy("company", "base_url").agg(F.count(F.lit(1)).alias("pages"), F.count("url_pattern").alias("known"))


@R.add(
    f"""SELECT idx, regexp_extract(raw_xml, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
    CAST(len(regexp_extract_all(raw_xml, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS BIGINT) AS paragraphs,
    regexp_extract(raw_xml, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1) AS heading FROM {PAGES}"""
)
def html_title_text(spark, sf_dir):
    tag = lambda p: F.regexp_extract("raw_xml", p, 1)
    return _pages(spark, sf_dir).select(
        "idx", tag("(?is)<title[^>]*>(.*?)</title>").alias("title"), F.size(sites.tag_texts("raw_xml", "p")).cast("long").alias("paragraphs"), tag("(?is)<h[12][^>]*>(.*?)</h[12]>").alias("heading")
    )


@R.add()
def site_records(spark, sf_dir):
    return sites.read_pages(_pages(spark, sf_dir))


#: A page in each of the layouts of ``outlets``; TITLE and BODY stand for an article's title and its lines as paragraphs.
LAYOUTS = {
    "cna": "<div class=centralContent><div class=breadcrumb><a>首頁</a><a>政治</a></div><h1><span>TITLE</span></h1><div class=paragraph>BODY</div><div class=paragraph><p>別的</p></div></div>",
    "chinatimes": '<nav class=breadcrumb-wrapper><ol><li><a><span>政治</span></a></li></ol></nav><header class=article-header><h1 class=article-title>TITLE</h1><time datetime="2022-01-02 03:04">x</time></header><div class=article-body>BODY</div>',
    "ettoday": '<meta name="pubdate" content="2022-01-02T03:04:00+0800"><div class=part_breadcrumb><div><a><span>政治</span></a></div></div><h1 class=title>TITLE</h1><div class=story><p class=no>圖</p>BODY</div>',
    "ftv": "<h1 class=text-center>TITLE</h1><div id=newscontent>BODY</div>",
    "setn": "<input type=hidden id=pageGroupID value=6><h1 class=news-title-3>TITLE</h1><time class=page-date>2022/01/02 03:04:00</time><div id=Content1>BODY<p class=x>圖</p></div>",
    "storm": "<div id=title_tags_wrapper><a>政治</a></div><h1 id=article_title>TITLE</h1><span id=info_time>2022-01-02 03:04</span><div id=CMS_wrapper><blockquote><p dir=ltr>引</p></blockquote>BODY</div>",
    "tvbs": '<meta name=pubdate content="2022-01-02T03:04:00+08:00"><div class=title_box><h1 class=title>TITLE</h1></div><div id=news_detail_div>BODY<span class=endtext>完</span></div>',
}
TITLED = "(SELECT news_id, min(title) AS title, min(article) AS article FROM article_page WHERE trim(title) <> '' AND trim(article) <> '' GROUP BY news_id)"


@R.add(
    f"""SELECT news_id AS idx, news_id % 7 AS company_id, {_nfkc_sql('title')} AS title, {_nfkc_sql('article')} AS article, CASE WHEN news_id % 7 IN (3, 6) THEN '' ELSE '政治' END AS category,
    CASE WHEN news_id % 7 IN (0, 3) THEN NULL ELSE TIMESTAMP '2022-01-02 03:04:00' END AS published FROM {TITLED} WHERE {_nfkc_sql('article')} <> ''"""
)
def layout_records(spark, sf_dir):
    """Every article as a page of one of the layouts, and read from it again."""
    rows = table(spark, sf_dir, "article_page", "news_id", "title", "article").where("trim(title) <> '' and trim(article) <> ''").groupBy("news_id").agg(F.min("title").alias("title"), F.min("article").alias("article"))
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<p dir=ltr>"), F.replace(safe("article"), F.lit("\n"), F.lit("</p><p dir=ltr>")), F.lit("</p>"))
    page = F.element_at(F.array(*map(F.lit, LAYOUTS.values())), F.col("news_id") % len(LAYOUTS) + 1)
    pages = rows.select(F.col("news_id").alias("idx"), (F.col("news_id") % len(LAYOUTS)).alias("company_id"), F.replace(F.replace(page, F.lit("TITLE"), safe("title")), F.lit("BODY"), body).alias("raw_xml"))
    found = sites.read_pages(pages, outlets.rules_by_id({name: i for i, name in enumerate(LAYOUTS)}))
    return found.select("idx", "company_id", "title", "article", "category", "published")


@R.add(
    f"""SELECT news_id, CASE WHEN regexp_matches(article, '{CUT[0]}') THEN regexp_replace(article, '(?s)^(.*?)(?:{CUT[0]}).*$', '\\1')
    WHEN regexp_matches(article, '{CUT[1]}') THEN regexp_replace(article, '(?s)^(.*?)(?:{CUT[1]}).*$', '\\1')
    WHEN regexp_matches(article, '{CUT[2]}') THEN regexp_replace(article, '(?s)^(.*?)(?:{CUT[2]}).*$', '\\1') ELSE article END AS kept FROM {ARTICLES}"""
)
def truncate_pattern(spark, sf_dir):
    return _articles(spark, sf_dir).select("news_id", X.truncate_at("article", CUT).alias("kept"))


def _cascade_sql(column: str) -> str:
    for p, t in RULES:
        column = f"regexp_replace({column}, '{p}', '{t.replace('$', chr(92))}', 'g')"
    return column


@R.add(f"SELECT news_id, {_cascade_sql('article')} AS cleaned FROM {ARTICLES}")
def regex_cascade(spark, sf_dir):
    return _articles(spark, sf_dir).select("news_id", X.substitute_all("article", RULES).alias("cleaned"))


@R.add(
    "SELECT DISTINCT news_id, regexp_replace(regexp_replace(regexp_replace(title, '影音》', ''), '快訊》', ''), '!$', '') AS clean_title FROM article_page WHERE title IS NOT NULL"
)
def title_noise(spark, sf_dir):
    rows = table(spark, sf_dir, "article_page", "news_id", "title").where("title is not null")
    return rows.select("news_id", X.remove_first("title", NOISE).alias("clean_title")).distinct()


@R.add(
    f"""SELECT idx, array_to_string(list_concat(regexp_extract_all(raw_xml, '{REPORTERS[0]}', 1), regexp_extract_all(raw_xml, '{REPORTERS[1]}', 1), regexp_extract_all(raw_xml, '{REPORTERS[2]}', 1)), ',') AS reporters,
    CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(raw_xml, '{REPORTERS[0]}', '', 'g'), '{REPORTERS[1]}', '', 'g'), '{REPORTERS[2]}', '', 'g'))) AS BIGINT) AS rest_length FROM {PAGES}"""
)
def reporter_extract_all(spark, sf_dir):
    names, rest = X.extract_all("raw_xml", REPORTERS)
    return _pages(spark, sf_dir).select("idx", names.alias("reporters"), F.length(rest).cast("long").alias("rest_length"))


@R.add(
    f"""SELECT idx, CASE WHEN regexp_matches(raw_xml, '{REPORTERS[0]}') THEN trim(regexp_extract(raw_xml, '{REPORTERS[0]}', 1))
    WHEN regexp_matches(raw_xml, '{REPORTERS[1]}') THEN trim(regexp_extract(raw_xml, '{REPORTERS[1]}', 1))
    WHEN regexp_matches(raw_xml, '{REPORTERS[2]}') THEN trim(regexp_extract(raw_xml, '{REPORTERS[2]}', 1)) ELSE '' END AS reporter FROM {PAGES}"""
)
def reporter_extract_first(spark, sf_dir):
    return _pages(spark, sf_dir).select("idx", X.extract_first("raw_xml", REPORTERS)[0].alias("reporter"))


@R.add(f"SELECT news_id, CASE WHEN article = '' OR regexp_matches(article, '[。!?]$') THEN article ELSE article || '。' END AS closed FROM {ARTICLES}")
def sentence_end(spark, sf_dir):
    return _articles(spark, sf_dir).select("news_id", X.ensure_sentence_end("article").alias("closed"))


@R.add("SELECT lang, CASE lang WHEN 'zh-TW' THEN '繁體' WHEN 'zh-CN' THEN '簡體' WHEN 'en' THEN '英文' WHEN 'ja' THEN '日文' WHEN 'ko' THEN '韓文' ELSE '' END AS category, count(*) AS n FROM documents GROUP BY ALL")
def category_decode(spark, sf_dir):
    names = {"zh-TW": "繁體", "zh-CN": "簡體", "en": "英文", "ja": "日文", "ko": "韓文"}
    return table(spark, sf_dir, "documents", "lang").select("lang", X.category_of("lang", names).alias("category")).groupBy("lang", "category").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    """WITH w AS (SELECT event_id, CAST(to_timestamp(CAST(epoch_us(ts) // 1000000 AS DOUBLE)) AT TIME ZONE 'UTC' AS TIMESTAMP) + INTERVAL 8 HOUR AS wall FROM events)
    SELECT event_id, strftime(wall, '%Y-%m-%d %H:%M') AS datetime, CAST(year(wall) AS INTEGER) AS year, CAST(month(wall) AS INTEGER) AS month, CAST(day(wall) AS INTEGER) AS day,
    CAST(hour(wall) AS INTEGER) AS hour, CAST(minute(wall) AS INTEGER) AS minute FROM w"""
)
def epoch_parts(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events", "event_id", "ts").select("event_id", times.wall_time(seconds).alias("wall"))
    return times.with_time_parts(rows, "wall").drop("wall")


@R.add("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def half_open_range(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "event_type", "ts").where(times.half_open("ts", "2024-01-05", "2024-01-12")).select("event_id", "event_type")


@R.add("SELECT DISTINCT news_id, title FROM article_page WHERE title IS NOT NULL AND article IS NOT NULL")
def with_title_and_article(spark, sf_dir):
    return prepare.with_text(table(spark, sf_dir, "article_page", "news_id", "title", "article")).select("news_id", "title").distinct()


@R.add(
    """SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.published_at IS NULL AND b.source IS NOT DISTINCT FROM d.source AND b.lang IS NOT DISTINCT FROM d.lang)"""
)
def file_null_veto(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "published_at").withColumn("file", F.struct("source", "lang"))
    return prepare.veto_files(rows, "file", "published_at").select("doc_id", "source", "lang")


@R.add(
    "SELECT company_id, idx, NULL AS news_id, 'page' AS kind FROM raw_news UNION ALL SELECT NULL, NULL, news_id, 'article' FROM article_page"
)
def union_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "raw_news", "company_id", "idx").withColumn("kind", F.lit("page"))
    return prepare.union_files(pages, table(spark, sf_dir, "article_page", "news_id").withColumn("kind", F.lit("article"))).select("company_id", "idx", "news_id", "kind")


@R.add(
    """SELECT date, title, article, CAST(row_number() OVER (PARTITION BY date ORDER BY title NULLS FIRST, article, old_id) - 1 AS INTEGER) AS news_id
    FROM (SELECT DISTINCT date, title, article, news_id AS old_id FROM article_page)"""
)
def number_by_day(spark, sf_dir):
    rows = table(spark, sf_dir, "article_page", "date", "title", "article", F.col("news_id").alias("old_id")).distinct()
    return prepare.number_news(rows, "date", "title", "article", "old_id").select("date", "title", "article", "news_id")


@R.add(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
    SELECT day, CAST(day - INTERVAL 1 DAY AS DATE) AS previous_day, CAST(day + INTERVAL 1 DAY AS DATE) AS next_day, (day - 1) IN (SELECT day FROM d) AS has_previous, (day + 1) IN (SELECT day FROM d) AS has_next FROM d"""
)
def day_nav(spark, sf_dir):
    return times.neighbour_days(table(spark, sf_dir, "events", "ts"), "ts")


@R.add("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_daily_window(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = daily.read_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return daily.run_to_table(daily.daily_counts(stream), f"{shared_folder(spark)}/{_name('daily')}", "complete")


@R.add("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = daily.read_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    unique = daily.unique_events(stream).select("event_id", "user_id", "event_type")
    return daily.run_to_table(unique, f"{shared_folder(spark)}/{_name('unique')}")


def _name(kind: str) -> str:
    import uuid

    return f"{kind}_{uuid.uuid4().hex[:12]}"


QUERIES, ORACLE = R.queries, R.oracle
