"""How many texts hold a feature, in a table of fixed size that every task can have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import codes

#: Texts in, the hashes of the different features of each out.
Features = Callable[[list[str]], list[np.ndarray]]
#: The table has 2 ** BITS places of one byte.
BITS = 22
_BLOCK = 4096


def _counted(features: Features, column: str, bits: int):
    """Rows (block, counts): how many texts of a task hold features of each place of the table."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, texts in codes.chunks(batch, column):
                place, n = np.unique(np.concatenate(features(texts)) & np.uint64(len(counts) - 1), return_counts=True)
                counts[place.astype(np.int64)] += n.astype(np.int32)
        blocks = counts.reshape(-1, min(_BLOCK, len(counts)))
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    return go


def level_of(count):
    """The logarithm of a count, eight levels for each doubling; 0 only for a count of 0 or 1."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def _levels(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("counts"))
    return pa.table({"block": table.column("block").slice(0, 1), "levels": pa.array([level_of(total).tobytes()], pa.binary())})


def table_of(texts: DataFrame, column: str, features: Features, bits: int = BITS) -> np.ndarray:
    """One byte for each place of the table: the level of the number of texts that hold its features.

    Features that share a place count together, so a level is never too low. The driver gets the table and nothing else.
    """
    counted = texts.select(column).mapInArrow(_counted(features, column, bits), "block int, counts binary")
    out = np.zeros((max(1, (1 << bits) // _BLOCK), min(_BLOCK, 1 << bits)), np.uint8)
    for block, levels in counted.groupBy("block").applyInArrow(_levels, "block int, levels binary").collect():
        out[block] = np.frombuffer(levels, np.uint8)
    return out.reshape(-1)


def ordered(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text by rarity: keys that order them alike everywhere, the level in the upper eight bits, and the levels."""
    level = table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)]
    key = np.sort(level.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))
    return key, (key >> np.uint64(56)).astype(np.uint8)
