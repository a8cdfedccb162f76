"""Problem 10: long exact spans that several records share.

Super-k-mer partitioning: neighbouring windows of ``span`` characters that share a minimiser
(their least m-gram hash) form one packed string, and equal windows always meet in the bucket of
their minimiser. A first pass moves only (minimiser, document) rows; strings travel only for
minimisers that at least two documents have. Equal strings are counted as one; only buckets with
several different strings are opened into windows, which are sorted and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import codes

SPAN = 160
MINIMISER = 64


def _pieces(span: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in codes.chunks(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                text, start, n, value = codes.runs_of_minima(*codes.codes_of(texts), span, m)
                yield pa.RecordBatch.from_arrays(
                    [codes.signed(value), pa.array(ids[text], pa.int64()), pa.array(start.astype(np.int32)), pa.array((n + span - 1).astype(np.int32))],
                    names=["minimiser", "doc_id", "start", "size"],
                )

    return run


def _windows(span: int):
    """Hashes (two of 64 bits) of all windows of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in codes.chunks(batch, "piece"):
                points, borders = codes.codes_of(texts)
                one, two = codes.gram_hashes(points, borders, span, 1), codes.gram_hashes(points, borders, span, 2)
                good = np.flatnonzero(one != codes.NONE)
                text = np.searchsorted(borders, good, "right") - 1
                ids = part.column("piece_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [codes.signed(one[good]), codes.signed(two[good]), pa.array(ids[text], pa.int64()), pa.array((good - borders[text]).astype(np.int32))],
                    names=["one", "two", "piece_id", "at"],
                )

    return run


def _pieces_of(documents: DataFrame, span: int, m: int) -> DataFrame:
    """Super-k-mers whose minimiser at least two documents have: minimiser, piece_id, piece, doc_id, start."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(F.length("text") >= span)
    runs = docs.mapInArrow(_pieces(span, m), "minimiser long, doc_id long, start int, size int")
    runs = written(runs)
    common = runs.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimiser")
    places = runs.join(common, "minimiser").groupBy("doc_id").agg(F.collect_set(F.struct("minimiser", "start", "size")).alias("places"))
    found = docs.join(places, "doc_id").select("doc_id", "text", F.explode("places").alias("p"))
    return found.select(
        "doc_id", F.col("p.minimiser").alias("minimiser"), F.col("p.start").alias("start"), F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.size")).alias("piece")
    ).withColumn("piece_id", F.xxhash64("piece", "minimiser"))


def _shared_windows(pieces: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Different strings with the sets of documents that hold them, and their windows that occur in several strings."""
    strings = pieces.groupBy("minimiser", "piece_id", "piece").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    several = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("minimiser")
    windows = strings.join(several, "minimiser").select("piece_id", "piece").mapInArrow(_windows(span), "one long, two long, piece_id long, at int")
    return strings, written(windows)


def shared_pairs(documents: DataFrame, span: int = SPAN, m: int = MINIMISER) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents with ``span`` neighbouring characters exactly in common.

    documents: doc_id, text; other columns are ignored. Null ids and texts shorter than ``span`` (null and
    empty ones too) share nothing; repeated rows count once; a document does not share with itself.
    Groups of records are never gathered: equal sets of documents are recognised by their size and
    two 64-bit sums over their members, one set of each kind is kept, and its pairs come from a join,
    which adaptive execution splits where one set is large.
    """
    pieces = written(_pieces_of(documents, span, m))
    strings, windows = _shared_windows(pieces, span)
    wide = windows.groupBy("one", "two").agg(*_signature("piece_id")).where("n > 1")
    some = wide.groupBy("n", "x", "y").agg(F.min(F.struct("one", "two")).alias("w")).select("w.one", "w.two")
    members = windows.join(some, ["one", "two"]).select(F.xxhash64("one", "two").alias("set_id"), "piece_id").distinct()
    holders = pieces.select("piece_id", "doc_id").distinct()
    across = members.join(holders, "piece_id").select("set_id", "doc_id").distinct()
    alone = strings.where("lo < hi").select("piece_id").join(holders, "piece_id").select(F.col("piece_id").alias("set_id"), "doc_id")
    sets = written(across.unionByName(alone).distinct())
    kinds = sets.groupBy("set_id").agg(*_signature("doc_id")).where("n > 1").groupBy("n", "x", "y").agg(F.min("set_id").alias("set_id")).select("set_id")
    left = sets.join(kinds, "set_id").select("set_id", "doc_id")
    a, b = left.withColumnRenamed("doc_id", "doc_a"), left.withColumnRenamed("doc_id", "doc_b")
    return a.join(b, "set_id").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def _signature(column: str):
    h = lambda seed: F.xxhash64(F.lit(seed), F.col(column))
    return F.count(F.lit(1)).alias("n"), F.bit_xor(h(1)).alias("x"), F.sum((h(2).bitwiseAND(0x3FFFFFFF)).cast("decimal(28,0)")).alias("y")


def shared_share(documents: DataFrame, span: int = SPAN, m: int = MINIMISER) -> DataFrame:
    """One row a document: doc_id, n_chars, shared_chars (characters within spans that another document holds), share.

    Null and short texts have 0 shared characters and, where empty or null, a share of 0. Of a
    repeated doc_id the longest text counts for n_chars.
    """
    pieces = written(_pieces_of(documents, span, m))
    strings, windows = _shared_windows(pieces, span)
    docs_of = pieces.select("piece_id", "doc_id").groupBy("piece_id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    per_window = windows.join(docs_of, "piece_id").groupBy("one", "two").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    inner = windows.join(per_window.select("one", "two"), ["one", "two"]).select("piece_id", "at")
    gap = F.col("at") - F.row_number().over(Window.partitionBy("piece_id").orderBy("at"))
    spans = inner.distinct().withColumn("g", gap).groupBy("piece_id", "g").agg(F.min("at").alias("a"), (F.max("at") + span).alias("b")).drop("g")
    whole = strings.where("lo < hi").select("piece_id", F.lit(0).alias("a"), F.length("piece").alias("b"))
    places = pieces.join(spans.unionByName(whole), "piece_id").select("doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"))
    # of each stretch only what reaches behind all that begin before it
    before = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("stop").over(before), F.col("start")))
    shared = places.distinct().withColumn("new", F.greatest(F.lit(0), F.col("stop") - reached)).groupBy("doc_id").agg(F.sum("new").alias("shared_chars"))
    every = documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    some = F.coalesce("shared_chars", F.lit(0))
    return every.join(shared, "doc_id", "left").select("doc_id", "n_chars", some.cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, some / F.col("n_chars")).otherwise(0.0).alias("share"))
