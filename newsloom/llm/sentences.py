"""Problem 4: sentence boundaries across languages and scripts.

A pushdown automaton reads each line. Its stack holds the open quotations and brackets with their
places; end marks count only while the stack is empty, and a closing mark that empties it decides
whether the quotation ended the sentence. Dots are looked up in a trie of abbreviations, read backwards.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks and abbreviations.
LINE_BREAKS = "\n\r\x0b\x0c\x85  "
END_MARKS = "。！？!?｡؟۔।॥։።፧"
DOTS = ".．…‥"
QUOTES = {"「": "」", "『": "』", "“": "”", "„": "”", "«": "»", "‹": "›", "〝": "〞", "｢": "｣"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "〖": "〗"}
TITLE_CLOSERS, NOTE_OPENERS = "》〉", "(（[［"
EITHER = '"＂'
GOING_ON = ",，、;；:：､・–—-～~/"
#: Behind a quotation that ends in an exclamation or question: words that lead the sentence on; in Hindi, behind any.
LEADING_ON = "並并而"
#: Particles that no sentence starts with, so that they lead on behind any mark.
TRAILING = "的等之時时"
LEADING_WORDS = frozenset("कहा कहते कही कहकर बताया बोला बोले बोली पूछा लिखा दोहराया जोड़ा कि ने और को का की के में से पर तो ऐसा यह".split())
#: Abbreviations that never end a sentence, those that don't before a number, and those that do where another sentence may begin.
NEVER_ENDING = "mr mrs ms mx dr prof gov sen rep lt col gen sgt capt cmdr maj adm hon rev fr hr st mt ft cf vs v e.g i.e viz approx ca eds trans dept est sr.a srta sra bzw z.b d.h usw.u mme mlle".split()
NUMBERED = "no nr nos vol fig eq sec ch art pp p para tel ext jan feb mar apr jun jul aug sept oct nov dec mon tue wed thu fri sat sun".split()
MAYBE_ENDING = "inc corp ltd co llc plc jr sr a.m p.m am pm u.n u.s u.k e.u u.s.a etc b.c a.d ph.d m.d b.a m.a d.c".split()

_CLOSERS = {**{b: a for a, b in QUOTES.items()}, **{b: a for a, b in BRACKETS.items()}}
_EVENTS = re.compile("[" + re.escape(END_MARKS + DOTS + "".join(QUOTES) + "".join(BRACKETS) + "".join(_CLOSERS) + EITHER) + "]")
_EVENTS_AND_SPACES = re.compile(_EVENTS.pattern[:-1] + r"\s]")
_LINES = re.compile(f"[^{LINE_BREAKS}]+")
_THAI = re.compile("[ก-๛]")
_LIST_MARK = re.compile(r"\s*(?:[(（]?(?:\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,5})[.)）．]\s+|[•‣▪◦*·-]\s+)+")


def _trie(words: list[str], kind: str, root: dict) -> dict:
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = kind
    return root


_ABBREVIATIONS = _trie(MAYBE_ENDING, "maybe", _trie(NUMBERED, "numbered", _trie(NEVER_ENDING, "never", {})))


def _hidden(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") or c == "️"


def _plain(c: str) -> str:
    return c if c.isascii() else unicodedata.normalize("NFKC", c)


def _abbreviation(line: str, dot: int) -> str | None:
    """What stands before the dot: 'never', 'numbered' or 'maybe' of the trie, 'initial' for a single capital, else None."""
    node, i, kind, first = _ABBREVIATIONS, dot - 1, None, ""
    length = 0
    while i >= 0 and node is not None:
        c = line[i]
        if _hidden(c):
            i -= 1
            continue
        c = _plain(c)
        if not (c.isalpha() or c == "."):
            break
        first, length = c, length + 1
        node = node.get(c.lower())
        i -= 1
        if node is not None and "" in node:
            before = next((_plain(line[j]) for j in range(i, -1, -1) if not _hidden(line[j])), " ")
            if not (before.isalnum() and before.isascii()) and before != ".":
                kind = node[""]
    if kind is None and length:
        before = next((_plain(line[j]) for j in range(dot - 1 - 1, -1, -1) if not _hidden(line[j])), " ")
        last = _plain(line[dot - 1]) if not _hidden(line[dot - 1]) else first
        if last.isupper() and last.isascii() and not before.isalnum():
            return "initial"
    return kind


def _next_seen(line: str, i: int) -> tuple[str, bool]:
    """The first visible character from i on ('' at the line's end), and whether white space stands before it."""
    spaced = False
    while i < len(line):
        c = line[i]
        if c.isspace():
            spaced = True
        elif not _hidden(c):
            return c, spaced
        i += 1
    return "", spaced


def _blank(line: str, a: int, b: int) -> bool:
    return all(line[i].isspace() for i in range(a, b))


def _last_seen(line: str, i: int) -> str:
    """The last character before i that isn't hidden, '' if there is none."""
    i -= 1
    while i >= 0 and _hidden(line[i]):
        i -= 1
    return line[i] if i >= 0 else ""


def _mark_inside(line: str, i: int) -> str:
    """The character before i, hidden ones, white space and closing marks aside."""
    i -= 1
    while i >= 0 and (_hidden(line[i]) or line[i].isspace() or line[i] in _CLOSERS or line[i] in EITHER):
        i -= 1
    return line[i] if i >= 0 else ""


def _ends_inside(line: str, i: int) -> bool:
    """Whether that character is an end mark."""
    mark = _mark_inside(line, i)
    return bool(mark) and (mark in END_MARKS or mark in DOTS)


def _sentence_goes_on(line: str, i: int) -> bool:
    """Whether the sentence goes on behind a quotation that has its own full stop and ends before i."""
    c, spaced = _next_seen(line, i)
    if not c:
        return False
    if c in GOING_ON or c in END_MARKS or c in DOTS or c in _CLOSERS:
        return True
    if c in QUOTES or c in EITHER or c in BRACKETS:
        return c in NOTE_OPENERS
    p = _plain(c)[:1]
    if "ぁ" <= p <= "ゟ" or "가" <= p <= "힣" or "ᄀ" <= p <= "ᇿ":
        return not spaced
    if "ऀ" <= p <= "ॣ":
        word = re.match(r"[ऀ-ॣ॰-ॿ‌‍]+", line[line.index(c, i) :])
        return word is not None and unicodedata.normalize("NFC", re.sub("[‌‍]", "", word[0])) in LEADING_WORDS
    if "㐀" <= p <= "鿿":
        return not spaced and (p in TRAILING or (p in LEADING_ON and _mark_inside(line, i) in "!?！？"))
    return p.islower()


def _after_mark(line: str, start: int, i: int, dots: int) -> bool:
    """Whether the marks from start to i end the sentence; dots: their number if they are only dots."""
    c, spaced = _next_seen(line, i)
    if not c:
        return True
    p = _plain(c)[:1]
    if c in GOING_ON and not spaced:
        return False
    if dots == 1:
        if not spaced and (p.isalnum() or c in "@_&=%#?"):
            return False
        kind = _abbreviation(line, i - 1)
        if kind in ("never", "initial"):
            return False
        if kind == "numbered" and p.isdigit():
            return False
        if kind == "maybe":
            return p.isupper() or c in QUOTES or c in EITHER
        return not p.islower()
    if dots > 1:
        return spaced and not p.islower()
    inside_address = start and not spaced and i - start == 1 and all(x.isascii() and x.isalnum() for x in (c, line[start - 1]))
    return not inside_address and not (spaced and p.islower())


def _line_ends(line: str, plain: frozenset[int], nesting: bool, thai: bool) -> tuple[list[int], list[int]]:
    """Ends within one line, and the places of openers that stayed open. plain: places that count as plain characters."""
    ends: list[int] = []
    stack: list[tuple[str, int]] = []
    pending: Counter = Counter()
    listed = _LIST_MARK.match(line)
    done = listed.end() if listed else 0
    for m in (_EVENTS_AND_SPACES if thai else _EVENTS).finditer(line, done):
        i, c = m.start(), m[0]
        if i < done or i in plain:
            continue
        if c in QUOTES or c in BRACKETS:
            if nesting:
                closer = QUOTES.get(c) or BRACKETS[c]
                stack.append((closer, i))
                pending[closer] += 1
            continue
        if c in _CLOSERS or c in EITHER:
            quote = c in EITHER or _CLOSERS[c] in QUOTES
            if not pending[c]:
                if c in EITHER and nesting:
                    stack.append((c, i))
                    pending[c] += 1
                continue
            start = i
            while stack:
                closer, start = stack.pop()
                pending[closer] -= 1
                if closer == c:
                    break
            if stack or not _ends_inside(line, i):
                continue
            if quote:
                if not _sentence_goes_on(line, i + 1):
                    ends.append(i + 1)
            elif c not in TITLE_CLOSERS and _blank(line, ends[-1] if ends else 0, start) and not _sentence_goes_on(line, i + 1):
                ends.append(i + 1)
            continue
        if stack:
            continue
        if c.isspace():
            before = _last_seen(line, i)
            after = _next_seen(line, i)[0]
            if _THAI.match(before) and (_THAI.match(after) or not after.isalnum()) or (_THAI.match(after) and not before.isspace()):
                ends.append(i)
            continue
        j = i
        while j < len(line) and (line[j] in END_MARKS or line[j] in DOTS):
            j += 1
        only_dots = all(x in DOTS for x in line[i:j])
        k = j
        while k < len(line) and line[k] in _CLOSERS:
            k += 1
        done = k
        if _after_mark(line, i, j, (3 if j - i > 1 or line[i] in "…‥" else 1) if only_dots else 0) or k > j:
            if k == j or not _sentence_goes_on(line, k):
                ends.append(k)
    return ends, [p for _, p in stack]


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences of a text, as numbers of code points from its start.

    Each line that holds more than white space yields at least one. Quotations and brackets that are never
    closed within their line count as plain characters.
    """
    out = []
    for m in _LINES.finditer(text):
        line = m[0]
        last = len(line.rstrip())
        if not last:
            continue
        line = line[:last]
        thai = _THAI.search(line) is not None
        ends, left = _line_ends(line, frozenset(), True, thai)
        if left:
            ends, again = _line_ends(line, frozenset(left), True, thai)
            if again:
                ends, _ = _line_ends(line, frozenset(), False, thai)
        if not ends or line[ends[-1] :].strip():
            ends.append(last)
        previous = 0
        for e in ends:
            if line[previous:e].strip():
                out.append(m.start() + e)
                previous = e
    return out


def sentences(text: str) -> list[str]:
    starts = 0
    out = []
    for e in sentence_ends(text):
        out.append(text[starts:e].strip())
        starts = e
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ends, numbers, texts = [], [], [], []
        for i, text in zip(batch.column("news_id").to_pylist(), batch.column("article").to_pylist()):
            start = 0
            for n, e in enumerate(sentence_ends(text)):
                ids.append(i)
                ends.append(e)
                numbers.append(n)
                texts.append(text[start:e].strip())
                start = e
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(numbers, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=["news_id", "number", "end_pos", "sentence"])


def sentence_units(articles: DataFrame) -> DataFrame:
    """(news_id, number, end_pos, sentence) of every article, numbers from 0.

    articles: news_id, article; other columns are ignored. Null ids and null, empty or blank articles give no
    row; repeated rows count once (a news_id with different texts has the sentences of each).
    """
    rows = articles.select(F.col("news_id").cast("int").alias("news_id"), "article").where("news_id is not null and article is not null")
    return rows.mapInArrow(_run, "news_id int, number int, end_pos int, sentence string").distinct()


def sentence_boundaries(articles: DataFrame) -> DataFrame:
    """(news_id, end_pos) of sentence_units."""
    rows = articles.select(F.col("news_id").cast("int").alias("news_id"), "article").where("news_id is not null and article is not null")
    return rows.mapInArrow(_run, "news_id int, number int, end_pos int, sentence string").select("news_id", "end_pos").distinct()
