"""Problem 9: evaluation texts that leaked into a collection.

Winnowing: of every window of ``min_shared - k + 1`` neighbouring k-grams of the folded text
the least hash is kept, so two texts that share ``min_shared`` letters or digits keep a common
fingerprint. Fingerprints of both sides are joined, and each hit is extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.tables import written
from . import codes

MIN_SHARED = 50
GRAM = 25
#: Test-side fingerprints with their texts up to this number of rows and characters are sent to every task; beyond it both sides are shuffled.
BROADCAST_FINGERPRINTS, BROADCAST_CHARS = 300_000, 20_000_000

_HITS = "fingerprint long, {id} long, before string, gram string, after string"


def _fingerprints(id_column: str, min_shared: int, k: int, only: np.ndarray | None):
    """A mapInArrow function: kept fingerprints with the gram and what stands before and after it."""
    side = min_shared - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in codes.chunks(batch, "text"):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                folded, borders = codes.folded_codes(texts)
                hashes = codes.gram_hashes(folded, borders, k)
                width = min_shared - k + 1
                least = codes.sliding(hashes, width)
                if not len(least):
                    continue
                pad = np.zeros(width - 1, np.uint64)
                most = codes.sliding(np.concatenate([pad, least, pad]), width, np.maximum)
                kept = np.flatnonzero((hashes == most) & (hashes != codes.NONE))
                if only is not None and len(kept):
                    value = hashes[kept].view(np.int64)
                    place = np.minimum(np.searchsorted(only, value), len(only) - 1)
                    kept = kept[only[place] == value] if len(only) else kept[:0]
                if not len(kept):
                    continue
                text = np.searchsorted(borders, kept, "right") - 1
                start = np.maximum(kept - side, borders[text])
                end = np.minimum(kept + k + side, borders[text + 1])
                cut = lambda a, b: pa.array([codes.text_of(folded[x:y]) for x, y in zip(a, b)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [codes.signed(hashes[kept]), pa.array(ids[text], pa.int64()), cut(start, kept), cut(kept, kept + k), cut(kept + k, end)],
                    names=["fingerprint", id_column, "before", "gram", "after"],
                )

    return run


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series, at_end: pd.Series) -> pd.Series:
    """Characters that a and b share at their end or their start."""
    out = []
    for x, y, end in zip(a, b, at_end):
        if end:
            x, y = x[::-1], y[::-1]
        n = 0
        for p, q in zip(x, y):
            if p != q:
                break
            n += 1
        out.append(n)
    return pd.Series(out, dtype="int32")


def find_leaks(documents: DataFrame, items: DataFrame, min_shared: int = MIN_SHARED, k: int = GRAM, broadcast_rows: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """(doc_id, item_id) of all pairs with ``min_shared`` neighbouring letters or digits in common.

    documents: doc_id, text; items: item_id, text; other columns are ignored. Null or short texts and
    null ids have no partner; repeated rows count once; empty tables give an empty result.
    Items are assumed fewer than documents. Their fingerprints go to every task only while their rows, counted as
    often as items hold them, and their characters are few; otherwise both sides meet in a shuffle join.
    """
    if not 0 < k <= min_shared:
        raise ValueError("k must lie between 1 and min_shared")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    right = written(tests.mapInArrow(_fingerprints("item_id", min_shared, k, None), _HITS.format(id="item_id")).distinct())
    rows, chars = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("before") + F.length("gram") + F.length("after")), F.lit(0))).first()
    only = None
    if rows <= broadcast_rows and chars <= BROADCAST_CHARS:
        only = np.sort(np.array([r[0] for r in right.select("fingerprint").distinct().collect()], np.int64))
        right = F.broadcast(right)
    left = docs.mapInArrow(_fingerprints("doc_id", min_shared, k, only), _HITS.format(id="doc_id"))
    right = right.select("fingerprint", "gram", "item_id", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    hits = left.join(right, ["fingerprint", "gram"]).dropDuplicates(["doc_id", "item_id", "before", "gram", "after", "item_before", "item_after"])
    extended = F.length("gram") + _shared("before", "item_before", F.lit(True)) + _shared("after", "item_after", F.lit(False))
    return hits.where(extended >= min_shared).select("doc_id", "item_id").distinct()
