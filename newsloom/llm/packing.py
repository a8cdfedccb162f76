"""Problem 8: texts of varying length in containers of fixed capacity.

Sizes are counted once in tokens. For each capacity a dynamic programme over the global histogram of
sizes chooses the bucket boundaries that minimise padding (a size counts as its bucket's upper
boundary), and token-budget batches form from the buckets: the boundary says which bucket a container takes from. Room that a
bucket can't use is open to smaller buckets, and the budget counts true tokens, so the padding itself is used as well.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import codes

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies split text before their merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 128
#: Items that one task packs; beyond it items are spread over more groups, each with its own containers.
GROUP_ITEMS = 50_000
MOST_SPECS = 1_000


@lru_cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def _counted(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            for part, texts in codes.chunks(batch, "text"):
                sizes = [len(encode(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return go


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens); null and empty texts have 0. A repeated doc_id counts once, with its longest text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(_counted(tokenizer), "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def best_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper boundaries of at most ``buckets`` buckets over ascending ``sizes`` that minimise the sum of
    counts times (boundary - size). Exact. The best start of the last bucket never falls as the end grows, so each
    row of the dynamic programme is found by halving, all ends of one depth in one pass."""
    n = len(sizes)
    if n <= buckets:
        return sizes.copy()
    number = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    weight = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    cost = lambda i, j: sizes[j - 1] * (number[j] - number[i]) - (weight[j] - weight[i])  # noqa: E731  sizes i..j-1 in one bucket
    ends = np.arange(1, n + 1)
    best = np.concatenate([[0.0], cost(np.zeros(n, np.int64), ends)])
    # the ends that each depth decides, between the decided ones beside them
    depths, spans = [], np.array([[1, n]])
    while len(spans):
        middle = (spans[:, 0] + spans[:, 1]) // 2
        depths.append((middle, spans[:, 0] - 1, spans[:, 1] + 1))
        spans = np.concatenate([np.stack([spans[:, 0], middle - 1], 1), np.stack([middle + 1, spans[:, 1]], 1)])
        spans = spans[spans[:, 0] <= spans[:, 1]]
        spans = spans[np.argsort(spans[:, 0])]
    choice = []
    for _ in range(1, buckets):
        new, at = np.zeros(n + 1), np.zeros(n + 2, np.int64)
        at[n + 1] = n - 1
        for j, left, right in depths:
            low, high = at[left], np.minimum(at[right], j - 1)
            many = high - low + 1
            first = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(first - low, many)
            c = best[i] + cost(i, np.repeat(j, many))
            least = np.minimum.reduceat(c, first)
            where = np.flatnonzero(c == np.repeat(least, many))
            chosen = where[np.searchsorted(where, first)]
            new[j], at[j] = least, i[chosen]
        choice.append(at)
        best = new
    bounds, j = [], n
    for at in reversed(choice):
        bounds.append(sizes[j - 1])
        j = at[j]
        if j == 0:
            break
    if j:
        bounds.append(sizes[j - 1])
    return np.array(sorted(set(bounds)))


def pack(tokens: np.ndarray, bucket: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers for items of at most ``capacity`` tokens, whose buckets are numbered by ascending size.

    An item counts as the upper boundary of its bucket: a container takes an item of the largest bucket that fits into its
    room by this measure, and is then charged the item's true tokens. When no bucket fits any more, or an item fills the room to the
    last token, the room goes to the largest item that fits of the bucket whose boundary is beyond it. So no container ends while an item is left that fits."""
    order = np.lexsort((np.arange(len(tokens)), tokens, bucket))
    _, first, many = np.unique(bucket[order], return_index=True, return_counts=True)
    waiting = [order[x : x + n].tolist() for x, n in zip(first, many)]
    size = tokens.tolist()
    bounds = [size[w[-1]] for w in waiting]
    out = np.zeros(len(tokens), np.int64)
    left, container = len(tokens), -1
    while left:
        container += 1
        room = capacity
        while True:
            beyond = bisect_right(bounds, room)
            k = next((k for k in range(beyond - 1, -1, -1) if waiting[k]), -1)
            held = waiting[beyond] if beyond < len(waiting) else []
            i = bisect_right(held, room, key=size.__getitem__)
            if i and (k < 0 or size[held[i - 1]] == room):
                item = held.pop(i - 1)
            elif k >= 0:
                item = waiting[k].pop()
            else:
                break
            out[item] = container
            room -= size[item]
            left -= 1
    return out


def _bounds(buckets: int):
    def go(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("tokens")
        bounds = best_boundaries(sizes.tokens.to_numpy(np.int64), sizes.n.to_numpy(np.int64), buckets)
        return pd.DataFrame({"spec_id": [sizes.spec_id.iloc[0]], "items": [sizes.n.sum()], "bounds": [bounds.tolist()]})

    return go


def _packed(bounds_of: dict[int, list[int]], capacity_of: dict[int, int]):
    def go(items: pd.DataFrame) -> pd.DataFrame:
        spec = int(items.spec_id.iloc[0])
        items = items.sort_values(["doc_id", "piece"], ignore_index=True)
        tokens = items.tokens.to_numpy(np.int64)
        items["container"] = pack(tokens, np.searchsorted(bounds_of[spec], tokens), capacity_of[spec])
        return items[["spec_id", "grp", "container", "doc_id", "piece", "start_token", "tokens"]]

    return go


def pack_documents(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(spec_id, container, doc_id, piece, start_token, tokens): for each spec the containers of all texts.

    documents: doc_id, text; specs: spec_id, capacity_tokens; other columns are ignored. Only texts larger than a
    container are cut, into full pieces and a rest, so no text has more cuts than it needs. Texts without tokens
    (null, empty) take no room and come with a null container. Null ids and capacities, and capacities below 1,
    are left out; repeated rows count once (a spec_id with several capacities keeps the largest). Container names
    are unique within a spec. The histogram of a spec has at most one row a size, so at most the capacity;
    groups of ``group_items`` items bound what one task packs. specs is a table of settings: the driver reads up to
    MOST_SPECS of them.
    """
    sizes = written(token_sizes(documents, tokenizer))
    wanted = specs.where("spec_id is not null and capacity_tokens >= 1").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity")).limit(MOST_SPECS + 1).collect()
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    capacity_of = {int(r.spec_id): int(r.capacity) for r in wanted}
    schema = "spec_id int, container string, doc_id long, piece int, start_token long, tokens long"
    if not capacity_of:
        return documents.sparkSession.createDataFrame([], schema)
    capacities = documents.sparkSession.createDataFrame([(s, c) for s, c in capacity_of.items()], "spec_id int, capacity long")
    whole = sizes.where("tokens > 0").crossJoin(F.broadcast(capacities))  # a handful of specs, not pairs of rows
    n = F.ceil(F.col("tokens") / F.col("capacity"))
    pieces = whole.select("spec_id", "capacity", "doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    pieces = pieces.select("spec_id", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("all") - F.col("piece") * F.col("capacity")).alias("tokens"))
    # the boundaries are found in one task for each spec, and at most ``buckets`` of them come to the driver
    histogram = pieces.groupBy("spec_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    found = histogram.groupBy("spec_id").applyInPandas(_bounds(buckets), "spec_id int, items long, bounds array<long>").collect()
    bounds_of = {r.spec_id: list(r.bounds) for r in found}
    groups = max([1, *(math.ceil(r["items"] / group_items) for r in found)])
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    packed = grouped.groupBy("spec_id", "grp").applyInPandas(_packed(bounds_of, capacity_of), "spec_id int, grp int, container long, doc_id long, piece int, start_token long, tokens long")
    named = packed.select("spec_id", F.concat_ws("-", "grp", "container").alias("container"), "doc_id", "piece", "start_token", "tokens")
    empty = sizes.where("tokens = 0").crossJoin(F.broadcast(capacities)).selectExpr("spec_id", "cast(null as string) container", "doc_id", "0 piece", "0L start_token", "0L tokens")
    return named.unionByName(empty)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, items, tokens, fill, pieces_of_cut_texts) of a packing."""
    used = packed.where("container is not null")
    cut = used.where("piece > 0").groupBy("spec_id").agg(F.count(F.lit(1)).alias("cuts"))
    each = used.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    known = specs.where("spec_id is not null and capacity_tokens >= 1").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return each.join(known, "spec_id").join(cut, "spec_id", "left").select("spec_id", "capacity_tokens", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), F.coalesce("cuts", F.lit(0)).alias("cuts"))
