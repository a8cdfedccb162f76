"""The pN_ queries over the test tables, each over its whole tables."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import canonical, codes, leaks, main_text, names, near_duplicates, packing, pages, repeated_lines, sentences, spans, stories


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "article_page", "news_id", "article", "opinions")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "raw_news", "idx", "company_id", "raw_xml")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_articles(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_articles(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.found_lines(_pages(spark, sf_dir))


def p2_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.freed_pages(_pages(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_names(_articles(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_groups(_articles(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_boundaries(_articles(spark, sf_dir))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(_articles(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.affected_fields(_articles(spark, sf_dir))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_fields(_articles(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_line_hashes(_pages(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.story_members(_articles(spark, sf_dir))


def p7_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.story_clusters(_articles(spark, sf_dir))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read_table(spark, sf_dir, "packing_spec", "spec_id", "capacity_tokens")
    return packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), specs)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir), read_table(spark, sf_dir, "packing_spec", "spec_id", "capacity_tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "eval_item", "item_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_freed, p3_found, p3_groups, p4_found, p4_sentences, p5_found, p5_canonical, p6_found, p7_found, p7_typical, p8_packed, p8_fill, p9_found, p10_found, p10_share)
}

# SQL for the queries that SQL can answer on whole tables.
_CANONICAL = canonical.canonical_sql().replace("FROM src)", "FROM (SELECT DISTINCT news_id AS id, 'article' AS field, article AS text FROM article_page WHERE article IS NOT NULL))")
_WINDOWS = f"""(SELECT DISTINCT doc_id, pos, md5(substr(text, pos, {spans.SPAN})) AS piece FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - {spans.SPAN} + 2)) AS pos FROM documents WHERE length(text) >= {spans.SPAN}))"""

_LATEST = "(SELECT news_id, ord, opinion FROM (SELECT *, row_number() OVER (PARTITION BY news_id, ord ORDER BY datetime DESC NULLS LAST, person, opinion) AS n FROM person_store) WHERE n = 1)"
#: The opinions of an article are the rows of person_store that hold its news_id.
_FIELDS = canonical.canonical_sql().replace(
    "FROM src)",
    f"""FROM (SELECT DISTINCT news_id AS id, 'article' AS field, article AS text FROM article_page WHERE article IS NOT NULL
    UNION ALL SELECT news_id, 'opinions', string_agg(coalesce(opinion, ''), chr(10) ORDER BY ord) FROM {_LATEST} WHERE news_id IN (SELECT news_id FROM article_page WHERE opinions IS NOT NULL AND opinions <> '[]') GROUP BY news_id))""",
)


def _folded_sql(table: str, key: str) -> str:
    """(id, t): the letters and digits of each text without differences of width and case, by Python's Unicode tables."""
    forms = {c: f for c in map(chr, range(1, 0x10000)) if not 0xAC00 <= ord(c) < 0xE000 and (f := codes.folded(c)) != c}
    keys, values = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for xs in (forms, forms.values()))
    return f"(SELECT {key} AS id, array_to_string(list_transform(string_split(nfc_normalize(text), ''), lambda c: coalesce(map({keys}, {values})[c], c)), '') AS t FROM {table} WHERE text IS NOT NULL)"


def _lines_sql() -> str:
    """(company_id, idx, line): the lines of the pages, split, freed of tags and decoded in SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    inside = r"""(?:[^<>"'=]|=\s*(?:"[^"]*"|'[^']*')|["'=])*"""
    unseen = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript"))
    block = rf"""(?is)</?(?:{"|".join(pages.BLOCK_TAGS)})(?:[^\w<>"'=-]{inside})?(?:>|\z)"""
    tag = rf"(?is)<(?:/?[a-zA-Z]|[!?]){inside}(?:>|\z)"
    names = {f"&{k}": v for k, v in html.entities.html5.items()}
    keys, values = ("[" + ", ".join(map(quoted, xs)) + "]" for xs in (names, names.values()))
    return f"""(WITH seen AS (SELECT DISTINCT company_id, idx, regexp_replace(raw_xml, {quoted(unseen)}, '', 'g') AS t FROM raw_news WHERE raw_xml IS NOT NULL AND company_id IS NOT NULL AND idx IS NOT NULL),
        bodies AS (SELECT company_id, idx, regexp_replace(CASE WHEN regexp_matches(t, '(?is)<body\\b[^>]*>') THEN regexp_replace(t, '(?is)^.*?<body\\b[^>]*>', '') ELSE regexp_replace(t, '(?is)<head\\b.*?</head\\s*>', '', 'g') END, '(?is)</body\\s*>.*$', '') AS t FROM seen),
        cut AS (SELECT company_id, idx, unnest(string_split(regexp_replace(t, {quoted(block)}, chr(1), 'g'), chr(1))) AS t FROM bodies),
        bare AS (SELECT DISTINCT company_id, idx, regexp_replace(t, {quoted(tag)}, '', 'g') AS t FROM cut),
        decoded AS (SELECT company_id, idx, CASE WHEN NOT contains(t, '&') THEN t ELSE array_to_string(list_transform(regexp_extract_all(t, '&#?[0-9A-Za-z]+;?|[^&]+|&'), lambda x:
          CASE WHEN regexp_matches(x, '^&#[xX][0-9A-Fa-f]+;?$') THEN chr(CAST('0x' || regexp_extract(x, '[xX]([0-9A-Fa-f]+)', 1) AS INTEGER)) WHEN regexp_matches(x, '^&#[0-9]+;?$') THEN chr(CAST(regexp_extract(x, '[0-9]+') AS INTEGER))
          ELSE coalesce(map({keys}, {values})[x], x) END), '') END AS t FROM bare)
        SELECT DISTINCT company_id, idx, trim(regexp_replace(t, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS line FROM decoded)"""


def _shared_sql() -> str:
    n = leaks.MIN_SHARED
    windows = lambda table, key: f"(SELECT DISTINCT id, md5(substr(t, pos, {n})) AS w FROM (SELECT id, t, unnest(range(1, length(t) - {n} + 2)) AS pos FROM {_folded_sql(table, key)} WHERE length(t) >= {n}))"
    return f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM {windows('documents', 'doc_id')} d JOIN {windows('eval_item', 'item_id')} i ON d.w = i.w"


ORACLE = {
    "p1_groups": f"""WITH RECURSIVE members AS (SELECT DISTINCT id, regexp_replace(canonical, '\\s', '', 'g') AS body FROM ({_CANONICAL}) WHERE length(regexp_replace(canonical, '\\s', '', 'g')) >= {near_duplicates.RUN}),
        docs AS (SELECT DISTINCT body FROM members),
        grams AS (SELECT DISTINCT body, substr(body, pos, {near_duplicates.RUN}) AS gram FROM (SELECT body, unnest(range(1, length(body) - {near_duplicates.RUN} + 2)) AS pos FROM docs)),
        sizes AS (SELECT body, count(*) AS n FROM grams GROUP BY body),
        shared AS (SELECT a.body AS a, b.body AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.body <> b.body GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared s JOIN sizes x ON x.body = s.a JOIN sizes y ON y.body = s.b WHERE s.n >= {near_duplicates.SIMILARITY} * (x.n + y.n - s.n)),
        edges AS (SELECT a, b FROM links UNION SELECT x.body, y.body FROM members x JOIN members y USING (id)),
        reach AS (SELECT body AS a, body AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        groups AS (SELECT r.a AS body, min(m.id) AS group_id FROM reach r JOIN members m ON m.body = r.b GROUP BY r.a),
        degrees AS (SELECT a AS body, count(*) AS n FROM links GROUP BY a)
        SELECT m.id AS news_id, min(g.group_id) AS group_id, max(coalesce(d.n, 0)) AS links FROM members m JOIN groups g USING (body) LEFT JOIN degrees d USING (body) GROUP BY m.id""",
    "p2_found": f"""WITH outlets AS (SELECT company_id, count(DISTINCT idx) AS pages FROM raw_news WHERE raw_xml IS NOT NULL GROUP BY company_id)
        SELECT company_id, line FROM {_lines_sql()} JOIN outlets USING (company_id) WHERE line <> '' GROUP BY company_id, line, pages
        HAVING count(DISTINCT idx) >= {repeated_lines.LEAST_PAGES} AND count(DISTINCT idx) >= {repeated_lines.LEAST_SHARE} * pages""",
    "p5_found": f"SELECT DISTINCT id AS news_id, field FROM ({_FIELDS}) WHERE affected",
    "p5_canonical": f"SELECT DISTINCT id AS news_id, field, canonical, affected FROM ({_FIELDS})",
    "p9_found": _shared_sql(),
    "p1_found": f"""WITH bodies AS (SELECT id, regexp_replace(canonical, '\\s', '', 'g') AS body FROM ({_CANONICAL})),
        grams AS (SELECT DISTINCT id, substr(body, pos, {near_duplicates.RUN}) AS gram FROM (SELECT id, body, unnest(range(1, length(body) - {near_duplicates.RUN} + 2)) AS pos FROM bodies)),
        sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
        shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2)
        SELECT a AS news_a, b AS news_b FROM shared s JOIN sizes x ON x.id = s.a JOIN sizes y ON y.id = s.b WHERE s.n >= {near_duplicates.SIMILARITY} * (x.n + y.n - s.n)""",
    "p10_found": f"SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM {_WINDOWS} a JOIN {_WINDOWS} b ON a.piece = b.piece AND a.doc_id < b.doc_id",
    "p10_share": f"""WITH w AS {_WINDOWS}, twice AS (SELECT piece FROM w GROUP BY piece HAVING min(doc_id) < max(doc_id)),
        held AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM w WHERE piece IN (SELECT piece FROM twice)),
        covered AS (SELECT doc_id, CAST(sum(least({spans.SPAN}, coalesce(following - pos, {spans.SPAN}))) AS BIGINT) AS chars FROM held GROUP BY doc_id)
        SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars, coalesce(any_value(chars), 0) AS shared_chars, CASE WHEN max(length(text)) > 0 THEN coalesce(any_value(chars), 0) / max(length(text)) ELSE 0.0 END AS share
        FROM documents LEFT JOIN covered USING (doc_id) GROUP BY doc_id""",
}
