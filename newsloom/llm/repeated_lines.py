"""Problem 2: lines that one outlet repeats across its pages.

Lines are masked (numbers, dates, names), and their masked forms are clustered within each outlet by
locality-sensitive hashing: equal masked forms, and bands of MinHash values over their character trigrams. A cluster is
verified against its most frequent line, and those that occur in enough pages are frequent. All their lines
are removed from the pages; the lines that are frequent by themselves are read off the clusters.

Each task reads a page once and keeps one row for each different line of an outlet, with the page
numbers it saw; that is all that is shuffled, so a line on a third of all pages costs a few numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import codes
from .pages import texts_of

LEAST_PAGES = 4
LEAST_SHARE = 0.08
#: Bands of MinHash values besides the hash of the masked form.
BANDS, BAND_ROWS = 4, 3
#: Least share of trigrams that a line has in common with its cluster's most frequent line.
SIMILARITY = 0.8
#: Rows or characters of different lines that a task holds before it passes them on.
HOLD_ROWS, HOLD_CHARS = 200_000, 8_000_000
#: Frequent clusters up to this number are sent to all tasks; more are joined in a shuffle.
BROADCAST_LINES = 50_000

_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
_NAME = re.compile(r"(?<=記者)[\w·]{2,4}|(?<=[文圖攝]／)[\w·]{2,4}|(?<=撰稿：)[\w·]{2,4}|(?<=編輯：)[\w·]{2,6}|\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b")


def masked(line: str) -> str:
    """The line with numbers (dates too) as 0 and names as N."""
    return _NAME.sub("N", _NUMBER.sub("0", line))


def _masked_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the masked lines behind each other (shorter lines: the line), and the borders between lines."""
    points, borders = codes.codes_of([m if len(m := masked(x)) >= 3 else m.ljust(3) for x in lines])
    return codes.gram_hashes(points, borders, 3), borders


def band_keys(lines: list[str]) -> np.ndarray:
    """1 + BANDS keys for each line: one of its masked form, and MinHash values of that form's trigrams."""
    grams, borders = _masked_grams(lines)
    out = np.zeros((len(lines), 1 + BANDS), np.uint64)
    starts = borders[:-1]
    place = np.arange(len(grams)) - starts.repeat(np.diff(borders))
    out[:, 0] = np.add.reduceat(codes._mixed(grams + codes._mixed(place.astype(np.uint64))), starts)
    for band in range(1, 1 + BANDS):
        for row in range(BAND_ROWS):
            odd = np.uint64((2 * (band * BAND_ROWS + row) + 1) * 0x9E37_79B9_7F4A_7C15 & codes.NONE.item())
            mixed = np.where(grams == codes.NONE, codes.NONE, codes._mixed(grams * odd))
            out[:, band] = codes._mixed(out[:, band] * np.uint64(0x1000_0000_01B3) + np.minimum.reduceat(mixed, starts))
    return out


def alike(lines: list[str], others: list[str]) -> list[bool]:
    """Whether the masked forms of two lines have SIMILARITY of their trigrams in common."""
    sets = []
    for side in (lines, others):
        grams, borders = _masked_grams(side)
        sets.append([set(grams[x:y].tolist()) - {codes.NONE.item()} for x, y in zip(borders[:-1], borders[1:])])
    return [len(a & b) >= SIMILARITY * len(a | b) for a, b in zip(*sets)]


_SCHEMA = "company_id int, line string, keys array<long>, pages array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of different lines of each outlet; a row without a line names the pages of an outlet."""
    held: dict[tuple[int, str | None], set[int]] = {}
    chars = 0

    def flush():
        lines = [k[1] or "" for k in held]
        keys = band_keys(lines).view(np.int64)
        offsets = np.arange(0, keys.size + 1, 1 + BANDS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in held], pa.int32()),
                pa.array([k[1] for k in held], pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                pa.array([sorted(v) for v in held.values()], pa.list_(pa.int32())),
            ],
            names=["company_id", "line", "keys", "pages"],
        )

    for batch in batches:
        for company, idx, page in zip(*(batch.column(c).to_pylist() for c in ("company_id", "idx", "raw_xml"))):
            for line in (None, *texts_of(page)):
                if (seen := held.get((company, line))) is None:
                    held[company, line] = {idx}
                    chars += len(line or "")
                else:
                    seen.add(idx)
            if len(held) > HOLD_ROWS or chars > HOLD_CHARS:
                yield flush()
                held, chars = {}, 0
    if held:
        yield flush()


def _usable(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("company_id").cast("int").alias("company_id"), F.col("idx").cast("int").alias("idx"), "raw_xml")
    return rows.where("company_id is not null and idx is not null and raw_xml is not null")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield batch.filter(pa.array(alike(batch.column("line").to_pylist(), batch.column("first").to_pylist())))


def _clusters(pages: DataFrame, least_pages: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """The lines of frequent clusters as (company_id, band, key, first, line, pages), a row for each task that saw them; (company_id, of_pages)."""
    rows = written(_usable(pages).mapInArrow(_lines, _SCHEMA))
    outlets = rows.where("line is null").select("company_id", F.explode("pages").alias("idx")).distinct().groupBy("company_id").agg(F.count(F.lit(1)).alias("of_pages"))
    outlets = written(outlets)
    # pages of a cluster, counted in each task alone: never less than the true number
    bands = rows.where("line is not null").select("company_id", F.size("pages").alias("n"), F.posexplode("keys").alias("band", "key"))
    large = bands.groupBy("company_id", "band", "key").agg(F.sum("n").alias("n")).join(outlets, "company_id").where(F.col("n") >= _needed(least_pages, least_share))
    large = _sent(written(large.select("company_id", "band", "key")))
    placed = rows.where("line is not null").select("company_id", "line", "pages", F.posexplode("keys").alias("band", "key"))
    placed = written(placed.join(large, ["company_id", "band", "key"], "left_semi"))
    counted = placed.groupBy("company_id", "band", "key", "line").agg(F.sum(F.size("pages")).alias("n"))
    first = counted.groupBy("company_id", "band", "key").agg(F.max_by("line", F.struct("n", "line")).alias("first"))
    near = placed.join(first, ["company_id", "band", "key"]).select("company_id", "band", "key", "first", "line", "pages")
    near = written(near.mapInArrow(_verified, "company_id int, band int, key long, first string, line string, pages array<int>"))
    places = near.select("company_id", "band", "key", F.explode("pages").alias("idx")).distinct()
    frequent = places.groupBy("company_id", "band", "key").agg(F.count(F.lit(1)).alias("n")).join(outlets, "company_id").where(F.col("n") >= _needed(least_pages, least_share))
    return near.join(_sent(written(frequent.select("company_id", "band", "key"))), ["company_id", "band", "key"], "left_semi"), outlets


def _needed(least_pages: int, least_share: float):
    return F.greatest(F.lit(float(least_pages)), F.col("of_pages") * least_share) - 1e-9


def _sent(clusters: DataFrame) -> DataFrame:
    return F.broadcast(clusters) if clusters.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else clusters


def repeated_lines(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(company_id, line, pages, of_pages) of the lines in at least ``least_pages`` pages and ``least_share`` of an outlet's pages.

    pages: company_id, idx, raw_xml; other columns are ignored. Rows with a null among these are no pages; repeated
    rows of an idx count once; an empty page counts as a page without lines; no pages give no rows. A line is
    in the cluster of its own masked form, whatever else that holds, so none is missed.
    """
    near, outlets = _clusters(pages, least_pages, least_share)
    places = near.select("company_id", "line", F.explode("pages").alias("idx")).distinct()
    counted = places.groupBy("company_id", "line").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(outlets, "company_id").where(F.col("pages") >= _needed(least_pages, least_share)).select("company_id", "line", "pages", "of_pages")


def found_lines(pages: DataFrame) -> DataFrame:
    return repeated_lines(pages).select("company_id", "line")


def _freed(clusters: dict[tuple[int, int, int], str]):
    """Pages without the lines of the given clusters, each different line of an outlet being looked at once in a while."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, str], bool] = {}
        for batch in batches:
            company = batch.column("company_id").to_pylist()
            pages = [texts_of(p) for p in batch.column("raw_xml").to_pylist()]
            if len(known) > HOLD_ROWS:
                known = {}
            new = list(dict.fromkeys((c, x) for c, lines in zip(company, pages) for x in lines if (c, x) not in known))
            if new:
                keys = band_keys([x for _, x in new]).view(np.int64).tolist()
                tries = [(at, clusters[k]) for at, (c, _) in enumerate(new) for band, key in enumerate(keys[at]) if (k := (c, band, key)) in clusters]
                gone = {at for (at, _), same in zip(tries, alike([new[at][1] for at, _ in tries], [f for _, f in tries]) if tries else []) if same}
                known |= {x: at in gone for at, x in enumerate(new)}
            kept = [[x for x in lines if not known[c, x]] for c, lines in zip(company, pages)]
            removed = [len(lines) - len(k) for lines, k in zip(pages, kept)]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("company_id"), pa.array(["\n".join(k) for k in kept], pa.string()), pa.array(removed, pa.int32())], names=["idx", "company_id", "text", "removed"])

    return go


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [texts_of(p) for p in batch.column("raw_xml").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("company_id"), pa.array(lines, pa.list_(pa.string()))], names=["idx", "company_id", "lines"])


def freed_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(idx, company_id, text, removed): each different page's lines, joined by line breaks, without the lines of the outlet's
    frequent clusters: repeated lines and those that differ from them in numbers, dates and names, or little else.

    An outlet has at most lines of a page * (1 + BANDS) / ``least_share`` such clusters. They go to all tasks
    while their number, which is counted first, is small; else their lines are joined to the pages' lines.
    """
    rows = _usable(pages)
    near, _ = _clusters(pages, least_pages, least_share)
    near = written(near.drop("pages").distinct())
    known = near.select("company_id", "band", "key", "first").distinct().limit(BROADCAST_LINES + 1).collect()
    if len(known) <= BROADCAST_LINES:
        return rows.mapInArrow(_freed({(c, band, key): first for c, band, key, first in known}), "idx int, company_id int, text string, removed int").distinct()
    lines = near.select("company_id", "line").distinct()
    split = rows.mapInArrow(_split, "idx int, company_id int, lines array<string>").withColumn("page", F.xxhash64("idx", "company_id", "lines"))
    single = split.dropDuplicates(["page"])
    each = single.select("page", "company_id", F.posexplode("lines").alias("at", "line")).join(lines, ["company_id", "line"], "left_anti")
    kept = each.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kept"))  # the lines of one page
    joined = single.join(kept, "page", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<at:int,line:string>>")))
    return joined.select("idx", "company_id", F.array_join("kept.line", "\n").alias("text"), (F.size("lines") - F.size("kept")).alias("removed"))
