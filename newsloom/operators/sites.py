"""Pages of an outlet as records: article, category, reporter, time, title. What differs between outlets is data (SiteRules)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_ITSELF = {"p": {"p", "div", "ul", "ol", "table", "section", "h1", "h2", "h3", "h4", "hr"}, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}}


class Node:
    """An element of a page, or its root."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo.extend(reversed(x.children))
        return "".join(out)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self) -> Iterator[Node]:
        todo = list(reversed(self.elements()))
        while todo:
            x = todo.pop()
            yield x
            todo.extend(reversed(x.elements()))

    def remove(self) -> None:
        if self.parent and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_ITSELF.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_page(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:=["']?(?P<val>[^"'\]]*)["']?)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""")


def _split(selector: str, on: str) -> list[str]:
    """Parts between the separators that stand outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if depth == 0 and c == on:
            out.append(selector[last:i])
            last = i + 1
    return [p.strip() for p in [*out, selector[last:]] if p.strip()]


def _fits(node: Node, simple: str) -> bool:
    for m in _PART.finditer(simple):
        g = m.groupdict()
        if g["tag"] and g["tag"] != "*" and node.tag != g["tag"].lower():
            return False
        if g["id"] and node.attrs.get("id") != g["id"]:
            return False
        if g["cls"] and g["cls"] not in node.attrs.get("class", "").split():
            return False
        if g["attr"] and (g["attr"] not in node.attrs or (g["val"] is not None and node.attrs[g["attr"]] != g["val"])):
            return False
        if p := g["pseudo"]:
            same = node.parent.elements() if node.parent else [node]
            ok = {
                "not": lambda: not any(matches(node, s) for s in _split(g["arg"], ",")),
                "is": lambda: any(matches(node, s) for s in _split(g["arg"], ",")),
                "has": lambda: bool(select(node, g["arg"])),
                "first-child": lambda: same[0] is node,
                "last-child": lambda: same[-1] is node,
                "nth-child": lambda: nth(node, same, g["arg"]),
            }[p]
            if not ok():
                return False
    return True


def nth(node: Node, same: list[Node], arg: str) -> bool:
    """nth-child(k) and nth-child(k of selector)."""
    k, _, of = arg.partition(" of ")
    kept = [x for x in same if not of or matches(x, of.strip())]
    return int(k) <= len(kept) and kept[int(k) - 1] is node


def matches(node: Node, selector: str) -> bool:
    """Whether a node is the subject of one selector: simple selectors with '>' or white space between them."""
    steps = [s for s in re.split(r"\s*(>)\s*|\s+(?![^(\[]*[)\]])", selector.strip()) if s]
    if not _fits(node, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return node.parent is not None and bool(node.parent.tag) and matches(node.parent, " ".join(steps[:-2]))
    up = node.parent
    while up is not None and up.tag:
        if matches(up, " ".join(steps[:-1])):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Nodes below ``root`` that one of the comma-separated selectors names, in the order of the page."""
    wanted = _split(selector, ",")
    return [x for x in root.descendants() if any(matches(x, s) for s in wanted)]


@dataclass(frozen=True)
class SiteRules:
    """How an outlet's pages are read. Patterns apply in their order, each to what the ones before have left."""

    title: str
    paragraphs: str
    #: Tried if ``paragraphs`` names nothing.
    fallback: str = ""
    #: Elements removed before anything is read, and substitutions on the page's source, repeated until nothing changes.
    remove: str = ""
    repair: tuple[tuple[str, str], ...] = ()
    category: str = ""
    #: Which of the category elements counts: a number, or 'all' for all, joined by ','.
    category_at: int | str = -1
    categories: dict[str, str] = field(default_factory=dict)
    time: str = ""
    time_attribute: str = ""
    time_formats: tuple[str, ...] = ("%Y-%m-%d %H:%M:%S",)
    reporter: str = ""
    #: 'all': every match of every pattern, joined by ','; 'first': the first pattern that matches.
    reporter_mode: str = "all"
    reporter_patterns: tuple[str, ...] = ()
    #: Kept side of the text for patterns of mode 'first': 'both', 'after' or 'before'.
    reporter_keeps: str = "both"
    truncate: tuple[str, ...] = ()
    #: Reading stops at the first paragraph that starts with one of these.
    stop: tuple[str, ...] = ()
    article_rules: tuple[tuple[str, str], ...] = ()
    title_rules: tuple[tuple[str, str], ...] = ()
    end_mark: str = ""


LATIN = re.compile("[A-Za-z]")


def _clean(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def _names(found: list[str]) -> str:
    """Reporters with ',' between them, as functions.text.reporter_list gives them."""
    out: list[str] = []
    for part in re.split("[、,]", ",".join(map(_clean, found))):
        words = part.split()
        for i, word in enumerate(words):
            # parts of a Latin name belong together
            if i and LATIN.match(words[i - 1][-1]) and LATIN.match(word):
                out[-1] += f"-{word}"
            else:
                out.append(word)
    return ",".join(out)


def read_page(page: str, rules: SiteRules) -> dict | None:
    """The record of a page; None if it has no title or no article."""
    for pattern, text in rules.repair:
        before = None
        while before != page:
            before, page = page, re.sub(pattern, text, page)
    root = parse_page(page)
    for node in select(root, rules.remove) if rules.remove else []:
        node.remove()
    titles = select(root, rules.title)
    parts = [t for n in select(root, rules.paragraphs) if (t := _clean(n.text))]
    if not parts and rules.fallback:
        parts = [t for n in select(root, rules.fallback)[:1] if (t := _clean(n.text))]
    for i, part in enumerate(parts):
        if any(re.match(p, part) for p in rules.stop):
            parts = parts[:i]
            break
    if not titles or not parts:
        return None
    article = " ".join(parts)
    for p in rules.truncate:
        if m := re.search(p, article):
            article = article[: m.start()]
            break
    found: list[str] = []
    if rules.reporter_mode == "all":
        for p in rules.reporter_patterns:
            found += [m[1] for m in re.finditer(p, article)]
            article = _clean(re.sub(p, "", article))
    else:
        for p in rules.reporter_patterns:
            if m := re.search(p, article):
                found = [m[1]]
                article = {"both": article[: m.start()] + article[m.end() :], "after": article[m.end() :], "before": article[: m.start()]}[rules.reporter_keeps].strip()
                break
    if not found and rules.reporter:
        found = [n.text for n in select(root, rules.reporter)[:1]]
    for p, text in rules.article_rules:
        article = _clean(re.sub(p, text, article))
    if rules.end_mark and article and article[-1] not in "。!?":
        article += rules.end_mark
    title = _clean(titles[0].text)
    for p, text in rules.title_rules:
        title = _clean(re.sub(p, text, title))
    nodes = [_clean(n.attrs.get("value") or n.text) for n in select(root, rules.category)] if rules.category else []
    category = ",".join(nodes) if rules.category_at == "all" else (nodes[rules.category_at] if nodes and -len(nodes) <= rules.category_at < len(nodes) else "")
    moment = None
    for n in select(root, rules.time)[:1] if rules.time else []:
        text = _clean(n.attrs.get(rules.time_attribute, "") if rules.time_attribute else n.text)
        for f in rules.time_formats:
            try:
                moment = datetime.strptime(text, f)
                break
            except ValueError:
                continue
    return {"title": title, "article": article, "category": rules.categories.get(category, "" if rules.categories else category), "reporter": _names(found), "published": None if moment is None else moment.replace(tzinfo=None)}


#: Rules for layouts with a heading and paragraphs of their own; outlets get theirs by company_id.
PLAIN = SiteRules(title="h1, h2, div.t", paragraphs="article > p, section p, section span, h1 ~ p, td, div > p, p", remove="nav, footer, aside, header nav, script, style, noscript", truncate=("延伸閱讀:",), end_mark="")


def read_pages(pages: DataFrame, rules: dict[int, SiteRules] | None = None, default: SiteRules = PLAIN) -> DataFrame:
    """(idx, company_id, title, article, category, reporter, published) of the pages that hold a title and an article.

    pages: idx, company_id, raw_xml; null pages and pages that fail to parse give no row. rules: by company_id.
    """
    rules = rules or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, company, page in zip(pdf["idx"], pdf["company_id"], pdf["raw_xml"]):
                try:
                    record = read_page(page, rules.get(company, default))
                except (AssertionError, ValueError, RecursionError):
                    record = None
                if record:
                    out.append((idx, company, *record.values()))
            yield pd.DataFrame(out, columns=["idx", "company_id", "title", "article", "category", "reporter", "published"])

    rows = pages.select("idx", "company_id", "raw_xml").where("idx is not null and raw_xml is not null")
    return rows.mapInPandas(run, "idx int, company_id int, title string, article string, category string, reporter string, published timestamp_ntz")


def tag_texts(page: str, tag: str):
    """All texts of one tag, by a pattern that stays in the JVM; for tags without nested ones of their kind."""
    return F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
