"""Python literals stored as text (the ``opinions`` column) as typed values."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _INT, _WORDS = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
OPINION = T.ArrayType(
    T.StructType(
        [T.StructField(k, _STRING) for k in ("person", "verb", "opinion")]
        + [T.StructField(k, _INT) for k in ("ord", "negative_score", "positive_score")]
        + [T.StructField(k, _WORDS) for k in ("negative_list", "positive_list")]
    )
)


def parse_opinions(text: str | None) -> list[dict] | None:
    """The list of opinions that ``text`` denotes; None where it denotes none (null, malformed, no list)."""
    if not text:
        return None
    if text == "[]":
        return []
    try:
        found = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None


def _words(x) -> list[str] | None:
    return [str(w) for w in x] if isinstance(x, list) else None


@F.pandas_udf(OPINION)
def _parsed(texts: pd.Series) -> pd.Series:
    def one(text):
        found = parse_opinions(text)
        if found is None:
            return None
        return [
            {
                **{k: (str(x[k]) if x.get(k) is not None else None) for k in ("person", "verb", "opinion")},
                **{to: (x.get(k) if isinstance(x.get(k), int) else None) for k, to in (("order", "ord"), ("negative_score", "negative_score"), ("positive_score", "positive_score"))},
                **{k: _words(x.get(k)) for k in ("negative_list", "positive_list")},
            }
            for x in found
        ]

    return texts.map(one)


def opinions_of(text: Column | str) -> Column:
    """A Python repr of an opinion list as an array of structs; null where it can't be read."""
    return _parsed(text)


LABEL = T.ArrayType(T.StructType([T.StructField("start", _INT), T.StructField("end", _INT), T.StructField("text", _STRING), T.StructField("label", _STRING)]))


@F.pandas_udf(LABEL)
def _labels(texts: pd.Series) -> pd.Series:
    def one(text):
        spans = []
        for x in parse_opinions(text) or []:
            kinds, start, end = x.get("labels"), x.get("start"), x.get("end")
            if isinstance(kinds, list) and kinds and isinstance(start, int) and isinstance(end, int):
                spans.append({"start": start, "end": end, "text": str(x.get("text") or ""), "label": str(kinds[-1])})
        return spans

    return texts.map(one)


def labels_of(text: Column | str) -> Column:
    """A Python repr of an annotator's spans (start, end, text, labels) as an array of structs with the last of a span's labels; empty
    where it can't be read or says that nothing is labelled."""
    return _labels(text)
