"""Problem 3: variant spellings of the same person or organisation.

Every spelling is written in canonical form and given keys (without titles, white space, order of parts).
Keys are joined by prefix-filtered set similarity over their q-grams, and verified by a soft similarity of their tokens
(ideographs, or words), in which rare tokens count more: tokens are alike as far as one looks like a slip of the
other, which for ideographs is learned from all names (a character that regularly stands for the other one). Short forms
that a name alone doesn't explain (nicknames, surname with title, initials, acronyms) are read from the articles that
introduce them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import parse_opinions
from ..operators.components import connected_components
from ..sources.tables import written
from . import codes
from .canonical import canonical_texts

#: Least share of q-grams that two keys must have in common to be compared: pairs of letters, and pairs of ideographs.
SIMILARITY, PAIR_SIMILARITY = 0.5, 0.2
#: Least weighted similarity of two spellings of one name, in ideographs and in words, and the likeness of two ideographs of which one regularly
#: stands for the other.
ALIKE, ALIKE_WORDS, SOFT = 0.9, 0.8, 0.9
#: Least likeness of two words to count at all.
WORD = 0.7
#: Ideographs up to this distance form pairs.
NEAR = 8
#: Least regularity of a differing character: the share of the names with it that also exist with the other one.
REGULAR = 0.5
#: Least share of a differing character's evidence in which one spelling is at least twice as frequent as the other:
#: a slip is rarer than the name, while two persons' names need not be.
UNEVEN = 0.25

# Titles, words that introduce a short form, endings of organisations, administrative endings in their names.
TITLES = "主任委員 副主委 主委 副處長 處長 副理事長 理事長 常務理事 理事 執行長 副執行長 總幹事 顧問 書記 里長 村長 副館長 館長 議員 立委 委員 監事 召集人 市長 縣長 鄉長 鎮長 局長 部長 主席 秘書長 副秘書長 董事長 總經理 經理 發言人 教授 博士 律師 醫師 校長 院長 會長 副會長 主任 組長 隊長 先生 女士 小姐".split()
SHORT_FORM = "以下簡稱 以下稱 下稱 簡稱 又稱 俗稱 人稱".split()
ORGANISATIONS = "會 会 盟 社 團 团 黨 党 院 部 局 處 公司 基金 中心 協 联 工 聯".split()
ADMINISTRATIVE = "市 縣 县 鄉 乡 鎮 镇 區 区 省".split()

_HAN = r"㐀-鿿"
_TITLES = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_FRONT, _BACK = re.compile(rf"^(?:{_TITLES})(?=.{{2,}})"), re.compile(rf"(?<=..)(?:{_TITLES})$")
_RUN = rf"([{_HAN}][{_HAN}·・]{{1,18}})"
_LEAD = _RUN.replace("{1,18}", "{1,18}?")
_OPEN, _SHUT = r"[「『“\"]?", r"[」』”\"]?"
_CALLED = re.compile(rf"{_RUN}\(\s*(?:{'|'.join(SHORT_FORM)})\s*{_OPEN}([^()「」『』“”\",]{{1,24}}?){_SHUT}\s*\)")
_NICKNAME = re.compile(rf"(?:綽號|外號|暱稱|人稱){_OPEN}([^「」『』“”\",。]{{1,8}}){_SHUT}的([{_HAN}·・]{{2,14}})")
_ALL_CALL = re.compile(rf"{_LEAD}(?:在地方上|在地方|地方上|大家|鄉親)都(?:叫|稱){_OPEN}([{_HAN}]{{1,4}}){_SHUT}(?=[,。;])")
_BECAME = re.compile(rf"{_LEAD}(?:出任|擔任|接任|升任|就任)[{_HAN}]{{2,6}}?後?(?:人稱|被稱為){_OPEN}([{_HAN}]{{2,8}}){_SHUT}(?=[,。;])")
_FOREIGN = re.compile(rf"{_RUN}\(\s*([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ .'’-]{{2,80}}?)\s*(?:,\s*(?:{'|'.join(SHORT_FORM)})\s*([A-Z][A-Za-z]{{1,9}})\s*)?\)")
#: Each pattern runs only over texts that hold one of its words.
_CUES = ((_CALLED, SHORT_FORM), (_ALL_CALL, ("都叫", "都稱")), (_BECAME, ("人稱", "被稱為")))
_INITIAL = re.compile(r"^([a-z])(?:\. ?| )([a-z][a-z'’-]{2,})$")
_PREFIXED = re.compile(r"^(?:o|d|mc|mac|de|von|van)['’ ]([a-z-]{3,})$")
_BRACKETED = re.compile(r"^(.+?)[(（]([^()（）]+)[)）]$")
_LAST_FIRST = re.compile(r"^([^,]+), *([^,]+)$")
_CJK = re.compile(rf"[{_HAN}]")
_FRESH = 4
_BY_TITLE = re.compile(rf"^..?(?:{_TITLES})$|^.(?:{_TITLES})$")


def bare(name: str) -> str:
    """A canonical name without titles and, if written in ideographs, without white space; brackets resolved."""
    name = " ".join(name.replace("・", "·").split())
    if m := _BRACKETED.match(name):
        inner, outer = m[2].strip(), m[1].strip()
        name = inner + outer if _CJK.search(inner) and _CJK.search(outer) else outer
    if not _CJK.search(name):
        if m := _LAST_FIRST.match(name):
            name = f"{m[2]} {m[1]}"
        return name.casefold().replace("’", "'")
    name = "".join(name.split())
    for pattern in (_FRONT, _BACK):
        shorter = pattern.sub("", name)
        if len(shorter) >= 3 or (len(shorter) == 2 and len(name) > 3 + len(shorter)):
            name = shorter
    return name


def _filed(core: str) -> str:
    """A bare name with the parts between its dots in a fixed order."""
    return "·".join(sorted(filter(None, core.split("·")))) if "·" in core else core


def keys_of(name: str) -> list[str]:
    """The keys under which a canonical name is filed; names with a common key are the same."""
    core = bare(name)
    if not core:
        return []
    if not _CJK.search(core):
        return [core]
    out = [core]
    if "·" in core:
        parts = [p for p in core.split("·") if p]
        out = [_filed(core), "".join(parts), "".join(reversed(parts))]
    elif len(core) >= 5 and core.endswith(tuple(ORGANISATIONS)) and core[2] in ADMINISTRATIVE:
        out.append(core[:2] + core[3:])
    return list(dict.fromkeys(out))


def _person(run: str) -> list[str]:
    """Candidates for the name that a run of ideographs ends with, the most likely first."""
    core = bare(run)
    if "·" in core or core.endswith(tuple(ORGANISATIONS)) and len(core) > _FRESH or len(core) <= _FRESH:
        return [core]
    return [core[-3:], core[-4:], core[-2:]]


def introductions(text: str, speakers: list[str]) -> list[tuple[tuple[str, ...], str]]:
    """(candidates for the full name, short form) of a canonical article and its canonical speakers."""
    out: list[tuple[tuple[str, ...], str]] = []
    for pattern, cues in _CUES:
        if any(c in text for c in cues):
            out += [(tuple(_person(m[1])), bare(m[2])) for m in pattern.finditer(text)]
    for m in _NICKNAME.finditer(text):
        run = m[2]
        if "·" in run:
            first, _, rest = run.partition("·")
            out.append((tuple(f"{first}·{rest[:n]}" for n in (3, 2, 4) if len(rest) >= n), bare(m[1])))
        else:
            out.append((tuple(run[:n] for n in (3, 2, 4) if len(run) >= n), bare(m[1])))
    shorts = [s for s in map(bare, speakers) if not _CJK.search(s)]
    for m in _FOREIGN.finditer(text):
        full, foreign = tuple(_person(m[1])), bare(m[2])
        out.append((full, foreign))
        if m[3]:
            out.append((full, bare(m[3])))
        out += [((foreign,), s) for s in shorts if s != foreign and shortens(s, foreign)]
    filed = [(tuple(dict.fromkeys(_filed(f) for f in full)), _filed(short)) for full, short in out]
    return [(full, short) for full, short in filed if short and short not in full]


def shortens(short: str, full: str) -> bool:
    """Whether ``short`` may stand for the Latin name ``full``: initials, a surname with a prefix, or an acronym."""
    words = full.split()
    if len(words) < 2:
        return False
    if m := _INITIAL.match(short):
        return m[2] == words[-1] and m[1] == words[0][0]
    if m := _PREFIXED.match(short):
        return m[1] == words[-1]
    return len(words) > 2 and short == "".join(w[0] for w in words)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """('name', spelling, canonical spelling, n) and ('intro', candidates, short form, n), counted in each batch."""
    for batch in batches:
        for part, articles in codes.chunks(batch, "article"):
            parsed = [[str(x["person"]) for x in parse_opinions(o) or [] if x.get("person")] for o in part.column("opinions").to_pylist()]
            spelled = sorted({p for ps in parsed for p in ps})
            form = dict(zip(spelled, canonical_texts(spelled))) if spelled else {}
            seen: Counter = Counter(("name", p, form[p]) for ps in parsed for p in ps)
            for text, people in zip(canonical_texts(articles) if articles else [], parsed):
                for full, short in introductions(text, [form[p] for p in people]):
                    seen["intro", "\x1f".join(full), short] += 1
            rows = list(seen)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array([seen[r] for r in rows], pa.int64())],
                names=["kind", "a", "b", "n"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        name, key = [], []
        for n, form in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            for k in keys_of(form):
                name.append(n)
                key.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(key, pa.string())], names=["name", "key"])


def kind_of(key: str) -> str:
    """'latin', 'org', 'han' (a name of up to four ideographs), 'long' (other ideographs) or 'by title' (a surname with a title, or less)."""
    if not _CJK.search(key):
        return "latin"
    if len(key) < 3 or _BY_TITLE.match(key):
        return "by title"
    if key.endswith(tuple(ORGANISATIONS)) and len(key) > 3:
        return "org"
    return "han" if len(key) <= _FRESH and "·" not in key else "long"


def grams(key: str) -> list[str]:
    """q-grams of a key: pairs of near ideographs, whatever their order, or pairs of neighbouring letters in each word; numbered when repeated."""
    if _CJK.search(key):
        letters = key.replace("·", "")
        parts = ["".join(sorted((x, y))) for i, x in enumerate(letters) for y in letters[i + 1 : i + 1 + NEAR]]
    else:
        parts = [w[i : i + 2] for w in sorted(f"^{x}$" for x in key.split()) for i in range(len(w) - 1)]
    seen: Counter = Counter()
    out = []
    for p in parts:
        seen[p] += 1
        out.append(f"{p}{seen[p]}" if seen[p] > 1 else p)
    return out


def tokens(key: str) -> list[str]:
    return list(key.replace("·", "")) if _CJK.search(key) else key.split()


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, gram, size, least = [], [], [], []
        for k in batch.column("key").to_pylist():
            if kind_of(k) == "by title":
                continue
            g = grams(k)
            least += [PAIR_SIMILARITY if _CJK.search(k) else SIMILARITY] * len(g)
            key += [k] * len(g)
            gram += g
            size += [len(g)] * len(g)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(gram, pa.string()), pa.array(size, pa.int32()), pa.array(least, pa.float64())], names=["key", "gram", "size", "least"])


def word_likeness(a: str, b: str) -> float:
    """1 less the share of letters that are changed, left out, put in or swapped with their neighbour."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    if not a or not b or min(len(a), len(b)) < WORD * longest:
        return 0.0
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            least = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                least = min(least, before[j - 1] + 1)
            row.append(least)
        before, last = last, row
    return 1 - last[-1] / longest


def _in_order(a: list[str], b: list[str], weight_a: list[float], weight_b: list[float], soft: bool) -> float:
    """The greatest weight of tokens that two lists have in common in the same order, neighbours being free to swap.
    soft: where all others agree, the one that differs is a slip."""
    alike = lambda x, y: 1.0 if x == y else SOFT if soft else 0.0
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            most = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + alike(x, y) * (weight_a[i - 1] + weight_b[j - 1]) / 2)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                most = max(most, rows[i - 2][j - 2] + (weight_a[i - 1] + weight_a[i - 2] + weight_b[j - 1] + weight_b[j - 2]) / 2)
            rows[i][j] = most
    return rows[-1][-1]


def soft_similarity(a: list[str], b: list[str], weight_a: list[float], weight_b: list[float], soft: bool, latin: bool) -> float:
    """The weight that the tokens of two names have in common, soft tokens in part, by the mean weight of both names."""
    total = (sum(weight_a) + sum(weight_b)) / 2
    if total <= 0:
        return 0.0
    if not latin:
        return _in_order(a, b, weight_a, weight_b, soft) / total
    # each word with its best partner that is left, the likest first
    pairs = sorted(((s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := word_likeness(x, y)) >= WORD), key=lambda t: (-t[0], t[1], t[2]))
    used_a, used_b, common = set(), set(), 0.0
    for likeness, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            common += likeness * (weight_a[i] + weight_b[j]) / 2
    return common / total


def slip(a: str, b: str) -> tuple[str, str, str] | None:
    """(x, y, rest): the only ideographs in which two keys of one length differ, and all others in order; None if they differ otherwise."""
    if len(a) != len(b) or not _CJK.search(a):
        return None
    at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    # persons with one given name and different surnames are common, misspelt surnames are not
    if len(at) != 1 or (at[0] == 0 and kind_of(a) == "han"):
        return None
    return a[at[0]], b[at[0]], "".join(sorted(a[: at[0]] + a[at[0] + 1 :]))


def shortened(a: str, b: str) -> tuple[str, str] | None:
    """(long, short) if the one is an organisation's name and the other leaves characters of it out."""
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if len(short) < 3 or len(long) < 6 or len(short) == len(long) or short[0] != long[0] or not long.endswith(tuple(ORGANISATIONS)):
        return None
    rest = iter(long)
    return (long, short) if all(c in rest for c in short) else None


_PAIR = "a string, b string, kind string, x string, y string, rest string, long string, short string"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates with the slip in which they differ, or how one shortens the other."""
    for batch in batches:
        rows = [(a, b, kind_of(a), *(slip(a, b) or (None,) * 3), *(shortened(a, b) or (None,) * 2)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()) if bool(_CJK.search(a)) == bool(_CJK.search(b))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(8)], names=[c.split()[0] for c in _PAIR.split(", ")])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for a, b, wa, wb, soft in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb", "soft"))):
            latin = not _CJK.search(a)
            differ = not latin and kind_of(a) == "han" and kind_of(b) == "han" and a[0] != b[0]
            same.append(not differ and soft_similarity(tokens(a), tokens(b), wa, wb, soft, latin) >= (ALIKE_WORDS if latin else ALIKE) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.bool_())], names=["a", "b", "same"])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, i, t) for k in batch.column("key").to_pylist() for i, t in enumerate(tokens(k))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["key", "at", "token"])


def _weights(keys: DataFrame) -> DataFrame:
    """(key, weights): for each token of a key, in order, the logarithm of its rarity among the keys."""
    rows = keys.select("key").distinct().mapInArrow(_token_rows, "key string, at int, token string")
    df = rows.groupBy("token").agg(F.countDistinct("key").alias("df"))
    many = keys.agg(F.countDistinct("key").alias("many"))
    weighed = rows.join(df, "token").crossJoin(F.broadcast(many)).withColumn("w", F.log(1 + F.col("many") / F.col("df")))  # one row
    return weighed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda t: t["w"]).alias("weights"))  # the tokens of one key


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different characters of each key, with the key's kind and all its characters in order, whatever their places."""
    for batch in batches:
        rows = [(kind_of(k), c, "".join(sorted(k))) for k in batch.column("key").to_pylist() for c in sorted(set(k))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "c", "all"])


def _similar_keys(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: keys that share the least share of their q-grams, by the rarest of them."""
    rows = written(keys.mapInArrow(_gram_rows, "key string, gram string, size int, least double"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(counts, "gram")
    order = Window.partitionBy("key").orderBy("df", "gram")
    many = F.count(F.lit(1)).over(Window.partitionBy("key"))
    prefix = shared.withColumn("rank", F.row_number().over(order)).withColumn("many", many)
    prefix = written(prefix.where(F.col("size") - F.col("many") + F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.col("least") - 1e-9) + 1).select("key", "gram", "size", "least"))
    a, b = prefix.select("gram", "least", F.col("key").alias("a"), F.col("size").alias("na")), prefix.select("gram", F.col("key").alias("b"), F.col("size").alias("nb"))
    return a.join(b, "gram").where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.col("least") - 1e-9).select("a", "b").distinct()


def _spelling_links(keys: DataFrame, regular: float) -> DataFrame:
    """(a, b): keys that are spellings of one name as far as the spellings themselves tell."""
    found = written(_similar_keys(keys.select("key")).mapInArrow(_compared, _PAIR))
    # a character is soft where most names that hold it also exist with the other character in its place; names
    # that only differ in the order of their characters are one piece of evidence
    subs = found.where("x is not null").select("a", "b", "kind", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "rest")
    letters = written(keys.select("key").mapInArrow(_letters, "kind string, c string, all string").groupBy("kind", "c").agg(F.countDistinct("all").alias("names")))
    support = subs.groupBy("kind", "p", "q").agg(F.countDistinct("rest").alias("support"))
    weighed = support.join(letters.select("kind", F.col("c").alias("p"), F.col("names").alias("np")), ["kind", "p"])
    weighed = weighed.join(letters.select("kind", F.col("c").alias("q"), F.col("names").alias("nq")), ["kind", "q"])
    uses = keys.select("key", "n")
    counted = subs.join(uses.withColumnsRenamed({"key": "a", "n": "na"}), "a").join(uses.withColumnsRenamed({"key": "b", "n": "nb"}), "b")
    uneven = F.countDistinct(F.when(2 * F.least("na", "nb") <= F.greatest("na", "nb"), F.col("rest")))
    weight = counted.groupBy("kind", "p", "q").agg(uneven.alias("uneven"))
    regularly = weighed.where(F.col("support") >= regular * F.least("np", "nq")).join(weight, ["kind", "p", "q"])
    soft = regularly.where(F.col("uneven") >= F.greatest(F.lit(1), F.col("support") * UNEVEN)).select("kind", "p", "q", F.lit(True).alias("soft"))
    weights = written(_weights(keys))
    pairs = found.withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")}).join(soft, ["kind", "p", "q"], "left").withColumn("soft", F.coalesce("soft", F.lit(False)))
    both = pairs.join(weights.select(F.col("key").alias("a"), F.col("weights").alias("wa")), "a").join(weights.select(F.col("key").alias("b"), F.col("weights").alias("wb")), "b")
    alike = both.select("a", "b", "wa", "wb", "soft").mapInArrow(_likeness, "a string, b string, same boolean").where("same").select("a", "b")
    # an abbreviation that fits several organisations is left to the articles
    shorts = found.where("long is not null").select(F.col("long").alias("a"), F.col("short").alias("b"))
    plainer = F.regexp_replace("a", f"^(..)[{''.join(ADMINISTRATIVE)}]", "$1")
    single = shorts.groupBy("b").agg(F.countDistinct(plainer).alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b")
    return alike.unionByName(single)


def _shortened_latin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Latin keys with the short forms they allow ('full'), and short forms themselves ('short')."""
    for batch in batches:
        key, short, full = [], [], []
        for k in batch.column("key").to_pylist():
            if _CJK.search(k):
                continue
            words = k.split()
            if m := _INITIAL.match(k):
                key.append(k), short.append(f"{m[1]} {m[2]}"), full.append(False)
            elif m := _PREFIXED.match(k):
                key.append(k), short.append(f"' {m[1]}"), full.append(False)
            elif len(words) >= 2:
                for s in (f"{words[0][0]} {words[-1]}", f"' {words[-1]}", *(["".join(w[0] for w in words)] if len(words) > 2 else [])):
                    key.append(k), short.append(s), full.append(True)
            else:
                key.append(k), short.append(k), full.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(short, pa.string()), pa.array(full, pa.bool_())], names=["key", "short", "full"])


def name_groups(articles: DataFrame, regular: float = REGULAR, introduced: bool = True) -> DataFrame:
    """(name, group): each different ``person`` string as written, and the least spelling of its group.

    articles: article, opinions (and any others, ignored). Null, empty or unreadable opinions and null or empty
    persons hold no name; a null article tells nothing. Evidence is counted in rows. A short form belongs to
    the full name that the most introductions give it (ties: the lesser name). introduced: whether introductions count.
    """
    rows = articles.select("article", "opinions").where("article is not null or opinions is not null")
    seen = written(rows.mapInArrow(_read, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    named = seen.where("kind = 'name'")
    filed = written(named.select("a", "b").mapInArrow(_keyed, "name string, key string"))
    known = written(filed.join(named.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n")), "name").groupBy("key").agg(F.sum("n").alias("n")))
    # introductions: the candidate that most names have, or else the likeliest; then the most frequent full name of each short form
    intros = seen.where(f"kind = 'intro' and {str(introduced).lower()}").select(F.monotonically_increasing_id().alias("id"), F.split("a", "\x1f").alias("full"), F.col("b").alias("short"), "n")
    intros = written(intros)
    each = intros.select("id", "short", "n", F.posexplode("full").alias("at", "key")).join(known.select("key", F.col("n").alias("uses")), "key", "left")
    best = each.groupBy("id", "short", "n").agg(F.min_by("key", F.struct(-F.coalesce("uses", F.lit(0)), F.col("at"))).alias("key"))
    told = best.groupBy("short", "key").agg(F.sum("n").alias("n")).groupBy("short").agg(F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("key"))
    told = written(told)
    every = known.select("key", "n").unionByName(told.select("key", F.lit(0).alias("n"))).unionByName(told.select(F.col("short").alias("key"), F.lit(0).alias("n")))
    every = written(every.groupBy("key").agg(F.max("n").alias("n")))
    # a short form that was introduced is explained; its likeness to other short forms means nothing
    explained = told.select(F.col("short").alias("key"))
    spelled = _spelling_links(every.join(explained.where("key rlike '[\\\\x{3400}-\\\\x{9FFF}]'"), "key", "left_anti"), regular)
    # Latin short forms without an introduction: only if a single full name allows them
    latin = every.select("key").mapInArrow(_shortened_latin, "key string, short string, full boolean")
    latin = written(latin)
    open_short = latin.where("not full").join(told.select(F.col("short").alias("key")), "key", "left_anti").select(F.col("key").alias("b"), "short")
    fulls = latin.where("full").select(F.col("key").alias("a"), "short")
    guessed = open_short.join(fulls, "short").where("a <> b").groupBy("b").agg(F.min("a").alias("a"), F.countDistinct("a").alias("n")).where("n = 1").select("a", "b")
    key = lambda c: F.concat(F.lit("k"), F.col(c))
    links = (
        filed.select(F.concat(F.lit("n"), F.col("name")).alias("a"), key("key").alias("b"))
        .unionByName(told.select(key("key").alias("a"), key("short").alias("b")))
        .unionByName(spelled.select(key("a").alias("a"), key("b").alias("b")))
        .unionByName(guessed.select(key("a").alias("a"), key("b").alias("b")))
    )
    groups = connected_components(links)
    names = groups.where(F.col("node").startswith("n")).select(F.col("node").substr(F.lit(2), F.length("node")).alias("name"), "component")
    least = names.groupBy("component").agg(F.min("name").alias("group"))
    return names.join(least, "component").select("name", "group")


def same_names(articles: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all pairs of spellings of one person or organisation."""
    groups = written(name_groups(articles))
    a, b = groups.select("group", F.col("name").alias("name_a")), groups.select("group", F.col("name").alias("name_b"))
    return a.join(b, "group").where("name_a < name_b").select("name_a", "name_b")
