"""Texts as arrays of code points, and hashes and minima over sliding windows of them.

All texts of a chunk lie behind each other in one array, so that every step is one NumPy
call for the whole chunk. Positions are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 500_000
NONE = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_BASE = 0x9E37_79B9_7F4A_7C15


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batch`` with about ``most`` characters each (a single text may hold more), nulls as ''."""
    texts = [t or "" for t in batch.column(text).to_pylist()]
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield batch.slice(first, i - first), texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield batch.slice(first), texts[first:]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the n + 1 borders between the texts."""
    borders = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=borders[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), borders


def text_of(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58_476D_1CE4_E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, borders: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` code points from each position; NONE where the text ends earlier.

    Built by doubling, so the number of passes is logarithmic in ``k``.
    """
    n = len(codes)
    if n < k:
        return np.full(n, NONE)
    power = _mixed(codes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed * 2 + 1))
    width, rest, done, total = 1, k, 0, None
    base = _BASE + 2 * seed
    while True:
        if rest & 1:
            if total is None:
                total, done = power, width
            else:
                m = min(len(total), len(power) - done)
                total = total[:m] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + m]
                done += width
        rest >>= 1
        if not rest:
            break
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:] if width < len(power) else power[:0]
        width *= 2
    out = np.full(n, NONE)
    m = n - k + 1
    out[:m] = np.minimum(_mixed(total[:m]), NONE - np.uint64(1))
    for back in (np.repeat(borders[1:], np.diff(borders)) - np.arange(n),):
        out[back < k] = NONE
    return out


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` of each ``width`` neighbouring values, by doubling; shorter by width - 1."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def runs_of_minima(codes: np.ndarray, borders: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of neighbouring windows of ``window`` characters that share their least k-gram hash.

    Returns the text's number, the first window's start in that text, the run's number of windows,
    and the shared hash.
    """
    hashes = gram_hashes(codes, borders, k)
    least = sliding(hashes, window - k + 1)
    left = np.repeat(borders[1:], np.diff(borders)) - np.arange(len(codes))
    good = np.flatnonzero(left[: len(least)] >= window)
    if not len(good):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    value = least[good]
    new = np.ones(len(good), bool)
    new[1:] = (value[1:] != value[:-1]) | (good[1:] != good[:-1] + 1)
    text = np.searchsorted(borders, good, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(new)
    return text[at], good[at] - borders[text[at]], np.diff(np.append(at, len(good))), value[at]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


@lru_cache
def folding() -> tuple[np.ndarray, np.ndarray]:
    """Per code point, its letter or digit once width and case are ignored (0: no letter or digit),
    and whether it must be looked at within its text (it becomes several, or joins its neighbours)."""
    fold, special = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = unicodedata.normalize("NFKC", chr(c)).casefold()
        s = unicodedata.normalize("NFKC", s)
        kept = [x for x in s if x.isalnum()]
        special[c] = len(kept) > 1 or unicodedata.combining(chr(c)) != 0 or 0x1100 <= c < 0x1200 or 0xFF65 <= c < 0xFFDD
        fold[c] = ord(kept[0]) if len(kept) == 1 else 0
    return fold, special


def folded(text: str) -> str:
    """``text`` as its letters and digits only, without differences of width and case."""
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(filter(str.isalnum, s))


def folded_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """codes_of the folded texts."""
    fold, special = folding()
    codes, borders = codes_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(borders))
    odd = np.unique(owner[special[codes]])
    if len(odd):
        texts = list(texts)
        for i in odd:
            texts[i] = folded(texts[i])
        codes, borders = codes_of(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(borders))
    out = fold[codes]
    keep = out != 0
    borders = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(texts)), out=borders[1:])
    return out[keep], borders
