"""String functions as Spark columns. All positions are code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, written out because regex engines differ about \s.
WHITE_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　]"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_column(c), f"{WHITE_SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """Compatibility composition, then collapsed white space. Spark has no builtin for it, so text goes to Python in Arrow batches."""
    return collapse_whitespace(_nfkc(_column(c)))


def compress_url(url: Column | str, pattern: Column | str, groups: int = 1) -> Column:
    """The groups that ``pattern`` captures at the start of ``url``, joined by '-'; the whole url where it doesn't match."""
    url, pattern = _column(url), _column(pattern)
    anchored = F.concat(F.lit("^(?:"), pattern, F.lit(")"))
    parts = [F.call_function("regexp_extract", url, anchored, F.lit(i + 1)) for i in range(groups)]
    return F.when(F.regexp_like(url, anchored), F.concat_ws("-", *parts)).otherwise(url)


def strip_spaces(c: Column | str) -> Column:
    """The text without U+0020."""
    return F.replace(_column(c), F.lit(" "), F.lit(""))


def space_index(c: Column | str) -> Column:
    """Ascending, distinct places in the stripped text where spaces stood (a space after the last character counts too)."""
    lengths = F.transform(F.split(_column(c), " ", -1), lambda p: F.length(p))
    heads = F.slice(lengths, F.lit(1), F.size(lengths) - 1)
    running = F.aggregate(
        heads,
        F.array().cast("array<int>"),
        lambda done, n: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n)),
    )
    return F.when(F.size(lengths) > 1, F.array_sort(F.array_distinct(running))).otherwise(F.array().cast("array<int>"))


def restore_spaces(stripped: Column | str, index: Column | str) -> Column:
    """Puts one space back at each place of ``index``: the text with runs of spaces shrunk to one."""
    text, index = _column(stripped), _column(index)
    ends = F.concat(index, F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), index)
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), " ")


def widen_commas(c: Column | str) -> Column:
    return F.replace(_column(c), F.lit(","), F.lit("，"))


def truncate_at(c: Column | str, patterns: Sequence[str]) -> Column:
    """Cuts the text from where the first listed pattern that occurs at all occurs first; later patterns are then ignored."""
    c = _column(c)
    out = c
    for p in reversed(patterns):
        out = F.when(F.regexp_like(c, F.lit(p)), F.regexp_replace(c, f"(?s)^(.*?)(?:{p}).*$", "$1")).otherwise(out)
    return out


def substitute_all(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered substitutions, each over the result of the ones before it."""
    return reduce(lambda done, rule: F.regexp_replace(done, *rule), rules, _column(c))


def remove_first(c: Column | str, patterns: Sequence[str]) -> Column:
    """Of each pattern in order, its first match is removed."""
    return reduce(lambda done, p: F.regexp_replace(done, f"(?s)^(.*?)(?:{p})(.*)$", "$1$2"), patterns, _column(c))


def extract_all(c: Column | str, patterns: Sequence[str]) -> tuple[Column, Column]:
    """(first groups of all matches, in the order of the patterns, joined by ','; the text without the matches).

    A pattern sees the text that the patterns before it have left.
    """
    rest, found = _column(c), []
    for p in patterns:
        found.append(F.regexp_extract_all(rest, F.lit(p), F.lit(1)))
        rest = F.regexp_replace(rest, p, "")
    joined = F.array_join(F.filter(F.transform(F.flatten(F.array(*found)), lambda x: F.trim(x)), lambda x: x != ""), ",")
    return joined, F.trim(rest)


def extract_first(c: Column | str, patterns: Sequence[str], keep: str = "both") -> tuple[Column, Column]:
    """(first group of the first pattern that matches, '' if none does; the text without the match).

    keep: 'both' keeps the text on either side, 'after' what follows the match, 'before' what precedes it.
    """
    c = _column(c)
    side = {"both": "$1$2", "after": "$2", "before": "$1"}[keep]
    found, rest = F.lit(""), c
    for p in reversed(patterns):
        hit = F.regexp_like(c, F.lit(p))
        found = F.when(hit, F.trim(F.regexp_extract(c, p, 1))).otherwise(found)
        whole = "(?s)^(.*?)" + p.replace("(", "(?:").replace("(?:?", "(?").replace("\\(?:", "\\(") + "(.*)$"
        rest = F.when(hit, F.trim(F.regexp_replace(c, whole, side))).otherwise(rest)
    return found, rest


def reporter_list(c: Column | str) -> Column:
    """A list of reporters with ',' between them: '、' and white space separate, parts of Latin names are joined by '-'."""
    rules = [("、", ","), (r"([A-Za-z]) +(?=[A-Za-z])", "$1-"), (f"{WHITE_SPACE}+", ","), (",{2,}", ","), ("^,|,$", "")]
    return substitute_all(F.trim(_column(c)), rules)


def ensure_sentence_end(c: Column | str, mark: str = "。") -> Column:
    c = _column(c)
    return F.when((c == "") | F.regexp_like(c, F.lit("[。!?]$")), c).otherwise(F.concat(c, F.lit(mark)))


def category_of(key: Column | str, names: dict[str, str]) -> Column:
    """The category that a code stands for, '' for unknown and null codes."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), _column(key)), F.lit(""))


def contains_either(a: Column | str, b: Column | str) -> Column:
    """Whether one text contains the other."""
    a, b = _column(a), _column(b)
    return F.contains(a, b) | F.contains(b, a)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers; null where one of them has no length."""
    a, b = _column(a), _column(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
