"""Problem 6: the paragraphs of a page's own article, without the boilerplate around them.

Two passes over a page's lines. The first decides by link density, elements set apart, sentence ends, length and the
density of function words; what stays open are short lines and those with few function words, and the second gives
these the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import Line, lines_of, title_of

LINK_DENSITY = 0.5
#: Lines shorter than this are open, if nothing else decides them.
SHORT = 12
#: Least share of characters that belong to function words in a text without spaces, and of words in one with spaces.
STOP_DENSITY = 0.02

# Frequent function words, in Chinese (as strings) and in languages with spaces (as words).
STOP_STRINGS = "的 了 在 是 與 和 及 將 就 因 由 對 於 為 之 以 從 把 被 也 都 而 但 並 若 等 這 那 其 中 再 已 未 才 卻 要 不 有 無 一 到 至 讓 使 向 自 比 所 說 上 下 の は が を に と で も した する して ます です 은 는 이 가 을 를 의 에 고".split()
STOP_WORDS = frozenset("the a an of to in on for and or by with from at as is was were be been that this it its their his her said not no but because although while after before under shortly der die das und in zu den von mit le la les de des et un une el los las y en que".split())
#: Marks that end a sentence, and what may stand behind them.
ENDS, CLOSERS = "。！？!?．.…｡؟।", "」』”’\"'）)》〉】]"

_LABEL = re.compile(r"^[^\s：:，。]{1,16}?\d+\s*[：:]")
_NOTE = re.compile(r"^[※→►▶●■◆◎©®★☆▲△▼◇○＊*#|｜]")
_SPACES = re.compile(r"\s")
_STOPS = re.compile("|".join(sorted(map(re.escape, STOP_STRINGS), key=len, reverse=True)))


def ends_sentence(text: str) -> bool:
    """Whether the text closes a sentence: an end mark, with closing marks behind it or not."""
    bare = text.rstrip(CLOSERS)
    return bool(bare) and bare[-1] in ENDS


def stop_density(text: str) -> float:
    words = text.split()
    if len(words) > 3 and len(text) / len(words) > 2.5 and sum(c.isascii() for c in text) > 0.7 * len(text):
        return sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
    return sum(len(m) for m in _STOPS.findall(text)) / max(1, len(_SPACES.sub("", text)))


def _first_pass(line: Line, title: str) -> tuple[bool | None, bool]:
    """The label if it is plain, and whether the line may pass its label on to its neighbours.

    Captions, bylines and notes stand between paragraphs as well as elsewhere, so they say nothing
    about the lines beside them.
    """
    text = line.text
    if line.links >= LINK_DENSITY or line.aside or line.tag in ("h1", "h2", "h3", "h4") or text == title:
        return False, True
    if line.tag == "figcaption" or _LABEL.match(text) or _NOTE.match(text) or not ends_sentence(text):
        return False, False
    if text[0] in "（(【[" and text[-1] in "）)】]":
        return False, False
    if len(text) >= SHORT and stop_density(text) >= STOP_DENSITY:
        return True, True
    return None, False


def _inherited(first: list[tuple[bool | None, bool]]) -> list[bool]:
    """The label of each line: its own, or that of the nearest line that passes its label on; content where two
    such lines are equally near and differ, and never content where there is none."""
    n = len(first)
    near = [(n, False)] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last = None
        for i in order:
            label, passes = first[i]
            if last is not None:
                distance = abs(i - last)
                if distance < near[i][0]:
                    near[i] = distance, first[last][0]
                elif distance == near[i][0]:
                    near[i] = distance, near[i][1] or first[last][0]
            if passes:
                last = i
    return [near[i][1] if label is None else label for i, (label, _) in enumerate(first)]


def paragraphs(page: str) -> list[str]:
    """The main paragraphs of a page."""
    lines = lines_of(page)
    title = title_of(page)
    labels = _inherited([_first_pass(x, title) for x in lines])
    return [line.text for line, label in zip(lines, labels) if label]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx, line = [], []
        for i, page in zip(batch.column("idx").to_pylist(), batch.column("raw_xml").to_pylist()):
            for text in paragraphs(page):
                idx.append(i)
                line.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), pa.array(line, pa.string())], names=["idx", "line"])


def main_lines(pages: DataFrame) -> DataFrame:
    """(idx, line): the paragraphs of each page's own article, each once a page.

    pages: idx, raw_xml; other columns are ignored. Null idx or raw_xml, empty pages and pages without an article
    give no row; repeated rows count once.
    """
    rows = pages.select(F.col("idx").cast("int").alias("idx"), "raw_xml").where("idx is not null and raw_xml is not null")
    return rows.mapInArrow(_run, "idx int, line string")


def main_line_hashes(pages: DataFrame) -> DataFrame:
    """(idx, line_md5) of main_lines."""
    return main_lines(pages).select("idx", F.md5(F.encode("line", "UTF-8")).alias("line_md5")).distinct()
