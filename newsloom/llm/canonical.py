"""Problem 5: one form for texts that look alike but differ in their characters.

DuckDB runs inside each Arrow partition; the whole work is one SQL statement a batch. Its
character classes and translation strings are made from the Unicode tables of Python.
"""

from __future__ import annotations

import threading
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import parse_opinions

#: Characters of one batch handed to DuckDB at once, and its memory in a Python worker.
BATCH_CHARS = 2_000_000
DUCKDB_MEMORY = "300MB"

# Look-alike letters, each written above or before the Latin letter it resembles.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεικνορτυχϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXayeiKvoptuxcj"
CYRILLIC = "АВЕЅІЈКМНОРСТУХЗЬаеѕіјкорсухԁһԛԝүӏгпт"
CYRILLIC_AS = "ABESIJKMHOPCTYX3baesijkopcyxdhqwylrnt"
ARMENIAN = "ՕՍՏօոսհցզ"
ARMENIAN_AS = "OUSonuhgq"
#: Scripts whose letters pass for Latin ones.
OTHER_SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Georgian")
LOOK_ALIKES = GREEK + CYRILLIC + ARMENIAN
LOOK_ALIKES_AS = GREEK_AS + CYRILLIC_AS + ARMENIAN_AS
#: Format characters that are seen on the page, and line breaks.
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
LINE_BREAKS = {0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
#: Letters and marks that have no shape of their own.
BLANK_LETTERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{25A0}-\x{27BF}\x{2B00}-\x{2BFF}0-9#*]"


def _class(points) -> str:
    """A character class of code points, as ranges."""
    out, points = [], sorted(points)
    first = last = None
    for p in [*points, None]:
        if first is not None and p == last + 1:
            last = p
            continue
        if first is not None:
            out.append(f"\\x{{{first:X}}}" + (f"-\\x{{{last:X}}}" if last > first else ""))
        first = last = p
    return "[" + "".join(out) + "]"


@lru_cache
def _tables() -> dict[str, str]:
    invisible, spaces, compat, one_from, one_to, many, odd = [], [], [], [], [], {}, []
    for p in range(0x110000):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        kind = unicodedata.category(c)
        if p in LINE_BREAKS:
            continue
        if kind[0] == "M" or unicodedata.normalize("NFC", c) != c or 0x1100 <= p < 0x1200:
            odd.append(p)
        if (kind == "Cf" and p not in VISIBLE_FORMATS) or (kind == "Cc" and p != 9) or p in BLANK_LETTERS:
            invisible.append(p)
        elif kind == "Zs" and p != 0x20:
            spaces.append(p)
        elif (n := unicodedata.normalize("NFKC", c)) != c:
            # canonical variants other than ideographs are left to nfc_normalize
            if unicodedata.normalize("NFC", c) == c or 0xF900 <= p < 0xFB00 or 0x2F800 <= p < 0x2FA20:
                compat.append(p)
            if len(n) == 1:
                one_from.append(c)
                one_to.append(n)
            elif unicodedata.normalize("NFC", c) == c:
                many[c] = n.replace("⁄", "/")
    compat.extend(p for p in range(0x2E80, 0x2FD6) if unicodedata.category(chr(p)) == "So" and p not in set(compat))
    odd = {*odd, *invisible, *spaces, *compat, *map(ord, one_from), *map(ord, many), 0x200D, 0xFE0F}
    return {
        "odd": _class(odd),
        "invisible": _class(invisible), "spaces": _class(spaces), "compat": _class(compat),
        "from": "".join(one_from) + "".join(map(chr, spaces)), "to": "".join(one_to) + " " * len(spaces),
        "several": _class(map(ord, many)), "keys": list(many), "values": list(many.values()),
    }


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache
def canonical_sql() -> str:
    """SQL over src(id, field, text): id, field, canonical, affected.

    A text without any character that a later step could change or that could join its neighbour passes as it is.
    """
    t = _tables()
    other = "".join(f"\\p{{{s}}}" for s in OTHER_SCRIPTS)
    mixed = f"\\p{{Latin}}[\\p{{M}}]*[{other}]|[{other}][\\p{{M}}]*\\p{{Latin}}"
    word = f"[\\p{{Latin}}{other}\\p{{M}}]+|[^\\p{{Latin}}{other}\\p{{M}}]+"
    emoji = f"{EMOJI}\\x{{FE0F}}?[\\x{{1F3FB}}-\\x{{1F3FF}}]?\\x{{20E3}}?(?:\\x{{200D}}{EMOJI}\\x{{FE0F}}?[\\x{{1F3FB}}-\\x{{1F3FF}}]?)*[\\x{{E0020}}-\\x{{E007F}}]*"
    keys, values = (f"[{', '.join(map(_quoted, t[k]))}]" for k in ("keys", "values"))
    odd = f"[{t['odd'][1:-1]}{other}]"
    return f"""
WITH looked AS (SELECT *, regexp_matches(text, {_quoted(odd)}) AS odd FROM src),
visible AS (
  SELECT id, field, text,
         CASE WHEN regexp_matches(text, '[\\x{{FE0F}}\\x{{200D}}\\x{{E0020}}-\\x{{E007F}}]') THEN regexp_replace(text, {_quoted(emoji)}, '', 'g') ELSE text END AS plain,
         regexp_replace(text, {_quoted(t["invisible"])}, '', 'g') AS seen
  FROM looked WHERE odd),
expanded AS (
  SELECT *, CASE WHEN regexp_matches(seen, {_quoted(t["several"])})
                 THEN array_to_string(list_transform(string_split(seen, ''), lambda c: coalesce(map({keys}, {values})[c], c)), '')
                 ELSE seen END AS wide
  FROM visible),
composed AS (
  SELECT *, nfc_normalize(translate(wide, {_quoted(t["from"])}, {_quoted(t["to"])})) AS joined
  FROM expanded)
SELECT id, field,
       CASE WHEN regexp_matches(joined, {_quoted(mixed)})
            THEN array_to_string(list_transform(regexp_extract_all(joined, {_quoted(word)}),
                 lambda w: CASE WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, {_quoted(LOOK_ALIKES)}, {_quoted(LOOK_ALIKES_AS)}) ELSE w END), '')
            ELSE joined END AS canonical,
       regexp_matches(plain, {_quoted(t["invisible"])}) OR regexp_matches(text, {_quoted(t["spaces"])})
         OR regexp_matches(text, {_quoted(t["compat"])}) OR regexp_matches(text, {_quoted(mixed)})
         OR nfc_normalize(seen) <> seen OR regexp_matches(joined, {_quoted(mixed)}) AS affected
FROM composed
UNION ALL SELECT id, field, text, false FROM looked WHERE NOT odd"""


_local = threading.local()


def _engine():
    import duckdb

    if not hasattr(_local, "engine"):
        _local.engine = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
    return _local.engine


def canonical_table(table: pa.Table) -> pa.Table:
    """canonical_sql over one Arrow table with the columns id, field, text."""
    engine = _engine()
    engine.register("src", table)
    try:
        return engine.sql(canonical_sql()).to_arrow_table()
    finally:
        engine.unregister("src")


def canonical_texts(texts: list[str]) -> list[str]:
    """The canonical forms of some texts, in their order; for use inside other operators' partitions."""
    out = canonical_table(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "field": pa.array([""] * len(texts)), "text": pa.array(texts, pa.string())}))
    forms = dict(zip(out.column("id").to_pylist(), out.column("canonical").to_pylist()))
    return [forms[i] for i in range(len(texts))]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("news_id", pa.int64()), ("field", pa.string()), ("canonical", pa.string()), ("affected", pa.bool_())])

    def flush(rows):
        table = pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("id", pa.int64()), ("field", pa.string()), ("text", pa.string())))})
        for b in canonical_table(table).rename_columns(["news_id", "field", "canonical", "affected"]).cast(schema).to_batches():
            yield b

    rows, held = [], 0
    for batch in batches:
        for key, article, opinions in zip(*(batch.column(c).to_pylist() for c in ("news_id", "article", "opinions"))):
            texts = [("article", article)] if article is not None else []
            if parsed := parse_opinions(opinions):
                texts.append(("opinions", "\n".join(str(x.get("opinion") or "") for x in parsed)))
            for field, text in texts:
                rows.append((key, field, text))
                held += len(text)
            if held > BATCH_CHARS:
                yield from flush(rows)
                rows, held = [], 0
    if rows:
        yield from flush(rows)


def canonical_fields(articles: DataFrame) -> DataFrame:
    """(news_id, field, canonical, affected) of the article and the opinion texts of each row.

    articles: news_id, article, opinions; other columns are ignored. A null article, and opinions that are null,
    empty or unreadable give no row; an empty article gives an empty form. Rows with a null news_id are left out.
    A repeated row is listed once, so a news_id has more than one row only where its texts differ.
    """
    rows = articles.select(F.col("news_id").cast("long").alias("news_id"), "article", "opinions").where("news_id is not null")
    return rows.mapInArrow(_run, "news_id long, field string, canonical string, affected boolean").distinct()


def affected_fields(articles: DataFrame) -> DataFrame:
    """(news_id, field) of the texts that hold a character unlike the one it looks like."""
    rows = articles.select(F.col("news_id").cast("long").alias("news_id"), "article", "opinions").where("news_id is not null")
    return rows.mapInArrow(_run, "news_id long, field string, canonical string, affected boolean").where("affected").select(F.col("news_id").cast("int").alias("news_id"), "field").distinct()
