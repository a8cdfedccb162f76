"""How the pages of some Taiwanese news sites are laid out: rules for sites.read_pages, and categories that stand in links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import category_of
from .sites import SiteRules

# Where each site has its title, paragraphs, category, time and reporter, and what its categories are called.
CNA = SiteRules(
    title="div.centralContent h1 span",
    paragraphs="div.author, div.centralContent div:nth-child(1 of .paragraph) > p, div.dictionary > span",
    category="div.breadcrumb > a",
    category_at=1,
    reporter_patterns=(r"\(中央社記者(\S{2,4}?)\d*日?(?:電|專電)?\)", r"\(編輯:([^)]{2,12})\)\d*"),
)
CHINATIMES = SiteRules(
    title="h1.article-title",
    paragraphs="div.article-body > p",
    fallback="div.article-body",
    category="nav.breadcrumb-wrapper > ol > li > a > span",
    time="header.article-header time[datetime]",
    time_attribute="datetime",
    time_formats=("%Y-%m-%d %H:%M",),
    reporter="div.author > a, div.author",
)
ETTODAY = SiteRules(
    title="h1.title, h1.title_article, div.subject_article > header > h1",
    paragraphs="div.story > p:not([class]), div.story > link > p:not([class])",
    remove="b, img, iframe",
    category="div:is(.menu_bread_crumb, .part_breadcrumb) > div > a > span",
    time="meta[name=pubdate]",
    time_attribute="content",
    time_formats=("%Y-%m-%dT%H:%M:%S%z",),
    reporter_patterns=(r"記者([^/\s]{2,12})/\S*?報導",),
)
FTV = SiteRules(title="h1.text-center", paragraphs="div#preface > p, div#newscontent > p", reporter_mode="first", reporter_patterns=(r"\(民視新聞/([^)\s]{2,20})[^)]*\)",))
SETN = SiteRules(
    title="h1.news-title-3",
    paragraphs="div#Content1 > p:not([class]):not([style])",
    category="input#pageGroupID, input#hfPageGroupId",
    categories=dict(zip("0 2 4 5 6 7 8 9 12 17 34 41 42 45 46 47 50 52 54 65".split(), "熱門 財經 生活 國際 政治 科技 娛樂 名家專欄 汽車 華流 運動 社會 新奇 日韓 音樂 寵物 旅遊 女孩 房產 健康".split())),
    time="time.page-date",
    time_formats=("%Y/%m/%d %H:%M:%S",),
    reporter_mode="first",
    reporter_patterns=(r"^記者([^/]{2,12})/\S*?報導",),
    reporter_keeps="after",
)
STORM = SiteRules(
    title="h1#article_title",
    paragraphs="div#CMS_wrapper p[aid], div#CMS_wrapper p[dir]",
    remove="div#CMS_wrapper > blockquote, div#CMS_wrapper .related_copy_content",
    category="div#title_tags_wrapper a",
    category_at="all",
    time="span#info_time",
    time_formats=("%Y-%m-%d %H:%M",),
    reporter="div#author_block span.info_author",
)
TVBS = SiteRules(
    title="div.title_box > h1.title",
    paragraphs="div#news_detail_div p",
    fallback="div#news_detail_div",
    remove="div.img, span.endtext, b",
    time="meta[name=pubdate]",
    time_attribute="content",
    time_formats=("%Y-%m-%dT%H:%M:%S%z",),
    reporter="div.author_box > div.author > a",
)
RULES = {"cna": CNA, "chinatimes": CHINATIMES, "ettoday": ETTODAY, "ftv": FTV, "setn": SETN, "storm": STORM, "tvbs": TVBS}
FTV_CATEGORIES = dict(zip("ACFIJLNPRSUW", "體育 一般 財經 國際 美食 生活 社會 政治 美食 社會 社會 一般".split()))
TVBS_CATEGORIES = dict(zip("local life world entertainment china politics sports tech focus fun travel health cars money".split(), "社會 生活 國際 娛樂 中國 政治 運動 科技 焦點 新奇 旅遊 健康 車 財經".split()))


def rules_by_id(companies: dict[str, int]) -> dict[int, SiteRules]:
    """The rules of the sites in ``companies`` (name to company_id), as sites.read_pages takes them."""
    return {number: RULES[name] for name, number in companies.items() if name in RULES}


def ftv_category(url: Column | str) -> Column:
    """The category that the eighth character of a link's last part stands for, '' without one."""
    return category_of(F.substring(F.substring_index(url, "/", -1), 8, 1), FTV_CATEGORIES)


def tvbs_category(path: Column | str) -> Column:
    """The category that the first part of a path with a number behind it stands for, '' without one."""
    return category_of(F.regexp_extract(path, r"^/([^/]*)/\d+", 1), TVBS_CATEGORIES)
