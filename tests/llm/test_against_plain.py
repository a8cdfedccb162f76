"""Operators against plain versions on small inputs."""

import hashlib
import html
import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import canonical, codes, leaks, main_text, names, near_duplicates, packing, pages, repeated_lines, sentences, spans

rng = random.Random(11)
CHARS = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]


def words(n, pool=CHARS):
    return "".join(rng.choice(pool) for _ in range(n))


def test_grams_and_minima():
    texts = ["", "abc", words(500), "😀" * 90, words(5)]
    points, borders = codes.codes_of(texts)
    for k in (1, 3, 7, 25):
        hashes = codes.gram_hashes(points, borders, k)
        seen = {}
        for t, a in zip(texts, borders):
            for i in range(len(t)):
                if i + k <= len(t):
                    assert seen.setdefault(t[i : i + k], hashes[a + i]) == hashes[a + i] != codes.NONE
                else:
                    assert hashes[a + i] == codes.NONE
        assert len(set(seen.values())) == len(seen)
    values = np.array([5, 3, 9, 1, 1, 7])
    assert codes.sliding(values, 3).tolist() == [3, 1, 1, 1] and codes.sliding(values, 7).tolist() == []
    text, start, n, _ = codes.runs_of_minima(points, borders, 60, 20)
    for t in range(len(texts)):
        assert sum(n[text == t]) == max(0, len(texts[t]) - 59)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_folding_is_that_of_unicode(text):
    points, borders = codes.folded_codes(["x", text])
    assert codes.text_of(points[borders[1] : borders[2]]) == codes.folded(text)


def edited(text, share):
    out = []
    for c in text:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice(CHARS) if r < 2 * share / 3 else c)
        if r > 1 - share / 3:
            out.append(rng.choice(CHARS))
    return "".join(out)


def test_near_duplicates(spark):
    base = [words(rng.choice([8, 30, 70, 140, 300, 900])) for _ in range(40)]
    texts = base + [edited(t, rng.choice([0.0, 0.02, 0.05, 0.1])) for t in base for _ in range(2)] + [t[len(t) // 3 :] + t[: len(t) // 3] for t in base]
    rows = [(i, t) for i, t in enumerate(texts)]
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    truth = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if grams[a] | grams[b] and len(grams[a] & grams[b]) >= 0.45 * len(grams[a] | grams[b])}
    df = spark.createDataFrame(rows, "news_id int, article string").repartition(3)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    assert got == truth
    groups = {r.news_id: r.group_id for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and all(g <= i for i, g in groups.items())


def test_shared_spans(spark):
    pool = [words(200) for _ in range(6)]
    texts = ["".join(rng.choice([words(50), rng.choice(pool)[rng.randrange(60) :], rng.choice(pool)]) for _ in range(4)) for _ in range(40)]
    windows = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 159):
            windows.setdefault(t[k : k + 160], set()).add(i)
    truth = {p for s in windows.values() for p in itertools.combinations(sorted(s), 2)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == truth and truth
    for r in spans.shared_share(df).collect():
        held = bytearray(len(texts[r.doc_id]))
        for k in range(len(held) - 159):
            if len(windows[texts[r.doc_id][k : k + 160]]) > 1:
                held[k : k + 160] = b"\1" * 160
        assert r.shared_chars == sum(held)


@pytest.mark.parametrize("limit", [leaks.BROADCAST_FINGERPRINTS, 0])
def test_leaks(spark, limit):
    items = [words(rng.randrange(40, 90)) for _ in range(20)]
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        a = rng.randrange(12)
        part = item[a : a + rng.choice([48, 49, 50, 51, 80])]
        texts.append(words(30) + " ".join(c + rng.choice(["", "", ",", "。"]) for c in part) + words(20))
    folded = [codes.folded(t) for t in texts]
    truth = {(d, i) for d, t in enumerate(folded) for i, x in enumerate(items) if any(x[k : k + 50] in t for k in range(len(x) - 49))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in leaks.find_leaks(docs, tests, broadcast_rows=limit).collect()} == truth and truth


def plain_lines(page):
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|noscript)\b.*?</\1>", "", page)
    page = re.search(r"(?s)<body[^>]*>(.*?)(</body>|\Z)", page)[1]
    blocks = re.split(rf"(?i)</?(?:{'|'.join(pages.BLOCK_TAGS)})\b[^>]*>", page)
    return [t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()))]


PAGE = '<html><head><title>題目</title><script>var a="<p>x</p>"</script></head><body class=a><!-- <p>隱</p> --><nav><ul><li><a href="/1">政治</a><li><a href="/2">生活</a></ul></nav><h1>題目</h1><P ALIGN=right>記者王小明／報導<p>第一段的內容是這樣的，因為&nbsp;預算&#x61c9;該<b>重新</b>檢討。　<br>第二段也是這樣的，因為大家都說好。<noscript>x</noscript><p>短句好！</p><div><a href="/3">相關的新聞在這裡，因為大家都想看。</a></div><p>讀者123：我也是這樣想的，因為很好。</p><footer><p>版權所有，請勿轉載。</p></footer></body></html>'


def test_lines_and_main_text():
    assert pages.texts_of(PAGE) == plain_lines(PAGE)
    assert main_text.paragraphs(PAGE) == ["第一段的內容是這樣的，因為 預算應該重新檢討。", "第二段也是這樣的，因為大家都說好。", "短句好！"]
    assert main_text.paragraphs("<body><h1>題</h1><p>本則影音已下架</p></body>") == []
    assert pages.texts_of("<p>a<p title='x>y'>b") == ["a", "b"] and pages.texts_of("<body>1 < 2<div") == ["1 < 2"]
    # a short line between two decided ones, and one on a page where nothing is decided
    assert main_text.paragraphs("<nav>首頁</nav><figcaption>圖說</figcaption><p>短句。</p><nav>更多</nav>") == []
    assert main_text.paragraphs("<p>短句。</p><p>首頁</p>") == []
    nested = pages.lines_of('<body><div><a href="/n">一二三<a href="/t">四</a>五六</a></div></body>')
    assert nested[0].links == 1.0


@pytest.mark.parametrize("limit", [repeated_lines.BROADCAST_LINES, 0])
def test_repeated_lines(spark, limit, monkeypatch):
    monkeypatch.setattr(repeated_lines, "BROADCAST_LINES", limit)
    monkeypatch.setattr(repeated_lines, "HOLD_ROWS", 40)
    rows = []
    for i in range(120):
        company = i % 3
        lines = [words(12) for _ in range(4)] + [f"版權{company}"] * (rng.random() < 0.5) + [f"第{i}頁"] + [rng.choice(["甲甲甲", "乙乙乙", "丙丙丙"])]
        rows += [(i, company, "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>")] * (1 + (i % 10 == 0))
    df = spark.createDataFrame(rows, "idx int, company_id int, raw_xml string").repartition(4)
    seen, of = {}, {}
    for i, c, page in rows:
        of.setdefault(c, set()).add(i)
        for line in plain_lines(page):
            seen.setdefault((c, line), set()).add(i)
    truth = {k: len(v) for k, v in seen.items() if len(v) >= 4 and len(v) >= 0.08 * len(of[k[0]])}
    assert {(r.company_id, r.line): r.pages for r in repeated_lines.repeated_lines(df).collect()} == truth
    freed = {r.idx: r.text for r in repeated_lines.freed_pages(df).collect()}
    # page numbers are one line but for the number
    assert freed == {i: "\n".join(x for x in plain_lines(p) if (c, x) not in truth and x != f"第{i}頁") for i, c, p in rows}


@pytest.mark.parametrize("limit", [repeated_lines.BROADCAST_LINES, 0])
def test_lines_that_differ_in_names_and_dates_go(spark, limit, monkeypatch):
    monkeypatch.setattr(repeated_lines, "BROADCAST_LINES", limit)
    rows = []
    for i in range(60):
        byline = f"記者{words(3)}／台北報導 2011-{i % 12 + 1:02}-{i % 28 + 1:02} {i % 24}:{i % 60:02}"
        legal = "本站內容由編輯部提供" + ("" if i % 3 else "的") + "，讀者言論不代表本社的立場，如有侵權將於三個工作日內下架"
        rows.append((i, 1, f"<body><p>{byline}</p><p>{words(40)}</p><p>{legal}</p><p>單獨{words(20)}</p></body>"))
    df = spark.createDataFrame(rows, "idx int, company_id int, raw_xml string").repartition(3)
    freed = {r.idx: r.text for r in repeated_lines.freed_pages(df).collect()}
    assert freed == {i: "\n".join(plain_lines(p)[1::2]) for i, _, p in rows}
    assert {r.line[:3] for r in repeated_lines.found_lines(df).collect()} == {"本站內"}


def test_many_short_lines_take_linear_time():
    first = [(None, False)] * 200_000 + [(True, True)]
    assert all(main_text._inherited(first)) and not any(main_text._inherited(first[:-1]))


CASES = {
    "但": "他說:「好。」但她走了。「好。」地方也走了。「好。」的說法。「好。」《條例》通過。「好。」(註)他說。",
    "zh": "他說:「好。不行!」她走了。「先救人!」,他喊著。高喊「要活路!」並靜坐。為何?!真的!!!價格3.5元,見data.a.example/r/1.html頁。第71號(註:甲。乙。)。\n小標題\n《誰說了算?》出版。「這......再看」",
    "en": 'Dr. No met Mr. B. Smith at 9 a.m. on Main St. today. It cost $3.5 (see p. 4 of the U.N. report). "We go. They stay." The end... "Stop!" shouted Al. He left at 6 p.m. The U.S. won',
    "ja": "彼は「待てない。急ぐ。」と言った。住民が「返せ!」と叫んだ。次。",
    "ko": '그는 "하겠다. 검토한다."라고 밝혔다. 42.4%로 됐다. 끝',
    "hi": 'उसने "है। भी है।" कहा। आज हुई।',
    "th": "ราคา58.8บาท ที่นี่ ไป",
    "list": "1. First item here. 2nd part.\n(a) Other item.",
    "open": "「沒有關上。還有一句。\n下一行。",
}
EXPECTED = {
    "但": ["他說:「好。」", "但她走了。", "「好。」", "地方也走了。", "「好。」的說法。", "「好。」", "《條例》通過。", "「好。」(註)他說。"],
    "zh": ["他說:「好。不行!」", "她走了。", "「先救人!」,他喊著。", "高喊「要活路!」並靜坐。", "為何?!", "真的!!!", "價格3.5元,見data.a.example/r/1.html頁。", "第71號(註:甲。乙。)。", "小標題", "《誰說了算?》出版。", "「這......再看」"],
    "en": ["Dr. No met Mr. B. Smith at 9 a.m. on Main St. today.", "It cost $3.5 (see p. 4 of the U.N. report).", '"We go. They stay."', "The end...", '"Stop!" shouted Al.', "He left at 6 p.m.", "The U.S. won"],
    "ja": ["彼は「待てない。急ぐ。」と言った。", "住民が「返せ!」と叫んだ。", "次。"],
    "ko": ['그는 "하겠다. 검토한다."라고 밝혔다.', "42.4%로 됐다.", "끝"],
    "hi": ['उसने "है। भी है।" कहा।', "आज हुई।"],
    "th": ["ราคา58.8บาท", "ที่นี่", "ไป"],
    "list": ["1. First item here.", "2nd part.", "(a) Other item."],
    "open": ["「沒有關上。", "還有一句。", "下一行。"],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_sentences(case):
    assert sentences.sentences(CASES[case]) == EXPECTED[case]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="甲aB.。!?「」\"() \n,ก…1", max_size=40))
def test_sentences_cover_the_text(text):
    ends = sentences.sentence_ends(text)
    assert ends == sorted(set(ends)) and "".join("".join(s.split()) for s in sentences.sentences(text)) == "".join(text.split())
    assert all(not text[e - 1].isspace() for e in ends)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aéÀ甲가ᄀ​­　ＡｱﾞⅣ⼈不е́"), st.characters(blacklist_categories=["Cs"])), max_size=15), min_size=1, max_size=5))
def test_canonical_form_is_stable(texts):
    once = canonical.canonical_texts(texts)
    assert canonical.canonical_texts(once) == once
    for t, c in zip(texts, once):
        assert unicodedata.normalize("NFC", c) == c


@pytest.mark.parametrize(
    "text,form,affected",
    [("ＡＢ，", "AB,", True), ("⼈不", "人不", True), ("café", "café", True), ("한", "한", True), ("が", "が", True), ("a​b", "ab", True), ("a b", "a b", True), ("Βelin", "Belin", True), ("Mоscow", "Moscow", True), ("Москва αβγ", "Москва αβγ", False), ("naïve Łódź", "naïve Łódź", False), ("甲\n乙 丙", "甲\n乙 丙", False), ("👩‍🚀 ok", "👩🚀 ok", False), ("", "", False)],
)
def test_canonical_cases(text, form, affected):
    import pyarrow as pa

    row = canonical.canonical_table(pa.table({"id": [1], "field": ["a"], "text": [text]})).to_pylist()[0]
    assert (row["canonical"], row["affected"]) == (form, affected)


def test_boundaries_are_optimal():
    gen = np.random.default_rng(2)
    for _ in range(150):
        n, k = int(gen.integers(1, 9)), int(gen.integers(1, 5))
        sizes, counts = np.sort(gen.choice(40, n, replace=False)) + 1, gen.integers(1, 9, n)
        cost = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes, counts))  # noqa: E731, B023
        bounds = packing.best_boundaries(sizes, counts, k)
        assert len(bounds) <= k and cost(bounds) == min(cost({*q, sizes[-1]}) for m in range(k) for q in itertools.combinations(sizes, m))


def test_packing_fills():
    gen = np.random.default_rng(4)
    tokens = gen.integers(1, 513, 5000)
    bounds = packing.best_boundaries(*np.unique(tokens, return_counts=True))
    container = packing.pack(tokens, np.searchsorted(bounds, tokens), 512)
    held = np.bincount(container, tokens)
    assert held.max() <= 512 and tokens.sum() / (len(held) * 512) > 0.97
    assert sorted(np.bincount(container)) == sorted(np.bincount(container)) and (np.bincount(container) > 0).all()


def test_boundaries_decide_the_packing():
    gen = np.random.default_rng(6)
    tokens = gen.integers(1, 257, 800)
    found = []
    for buckets in (1, 8, 128):
        bounds = packing.best_boundaries(*np.unique(tokens, return_counts=True), buckets)
        container = packing.pack(tokens, np.searchsorted(bounds, tokens), 256)
        held = np.bincount(container, tokens)
        assert held.max() <= 256 and (held > 0).all()
        # a container ends only when nothing fits that is left
        assert all(tokens[container > c].min(initial=257) > 256 - held[c] for c in range(len(held)))
        found.append(container.tolist())
    assert found[0] != found[1]
    # an item of 4 counts as 6 in the bucket of 6, so one of 3 goes first; in a bucket of its own it counts as 4
    assert packing.pack(np.array([6, 4, 3]), np.array([1, 1, 0]), 11).tolist() == [0, 1, 0]
    assert packing.pack(np.array([6, 4, 3]), np.array([2, 1, 0]), 11).tolist() == [0, 0, 1]


def test_tokens_are_those_of_the_public_pattern():
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ["it's  we'll 3.5\n\n x", words(50), "<|endoftext|> don't", ""]:
        assert packing.count_tokens(t) == len(own.encode_ordinary(t))


def opinion(*people):
    return repr([{"person": p, "verb": "說", "opinion": "好。", "order": i} for i, p in enumerate(people)])


def test_likeness_of_names():
    like = lambda a, b, soft=False: names.soft_similarity(names.tokens(a), names.tokens(b), [1.0] * len(names.tokens(a)), [1.0] * len(names.tokens(b)), soft, not "一" <= a[0] <= "鿿")
    assert like("王小明", "王小明") == like("王小明", "王明小") == 1 and like("王小明", "王大明") == pytest.approx(2 / 3)
    assert like("王小明", "王曉明", True) == pytest.approx(2.9 / 3) and like("王小明", "明小王") < 0.9
    assert like("john smith", "smith john") == 1 and like("john smith", "john smyth") == pytest.approx(0.9) and like("john smith", "jane doe") == 0
    # rare tokens count more
    one, two = names.tokens("王小明"), names.tokens("王大明")
    assert names.soft_similarity(one, two, [5, 1, 5], [5, 1, 5], False, False) > 0.9 > names.soft_similarity(one, two, [1, 5, 1], [1, 5, 1], False, False)
    assert names.word_likeness("johnson", "jonson") == pytest.approx(6 / 7) and names.word_likeness("abcd", "abdc") == 0.75 and names.word_likeness("a", "") == 0
    assert names.slip("王小明", "王大明") == ("小", "大", "".join(sorted("王明")))
    assert names.slip("王小明", "李小明") is None and names.shortened("澈穗護理促進會", "澈護會") == ("澈穗護理促進會", "澈護會")


def test_latin_names_with_other_letters(spark):
    people = [[f"{a} {b}" for a in ("John", "Mary", "Peter", "Anna")] for b in ("Featherstone", "Okonkwo", "Lindqvist", "Marchetti")]
    rows = [(i, "Text.", opinion(n)) for i, n in enumerate([*(x for p in people for x in p), "John Fetherstone", "Lindqvist, Peter", "Anna Marchetty", "Mary Oconkwo"])]
    groups = {}
    for r in names.name_groups(spark.createDataFrame(rows, "news_id int, article string, opinions string")).collect():
        groups.setdefault(r.group, set()).add(r.name)
    linked = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert linked == {frozenset(x) for x in (("John Featherstone", "John Fetherstone"), ("Peter Lindqvist", "Lindqvist, Peter"), ("Anna Marchetti", "Anna Marchetty"), ("Mary Okonkwo", "Mary Oconkwo"))}


def test_names(spark):
    # persons who share a surname share no other character, so each slip has one reading
    surnames, given_chars = list("王李張陳林黃吳劉"), [chr(0x4E00 + 7 * i) for i in range(24)]
    people = []
    for s in surnames:
        order = rng.sample(given_chars, 24)
        people += [s + order[2 * i] + order[2 * i + 1] for i in range(8)]
    twin = {c: chr(0x9000 + i) for i, c in enumerate(given_chars)}
    spelled = {p: {p, f"處長{p}", f"{p}處長", " ".join(p), p[0] + p[1] + twin[p[2]], p[0] + p[2] + p[1]} for p in people}
    rows, n = [], 0
    for p, forms in spelled.items():
        for f in forms:
            n += 1
            rows.append((n, "本文。", opinion(f)))
    extra = [
        ("理事長王大明(以下稱王理事長)來了。", ["王理事長", "王大明"]),
        ("綽號「阿明」的王大明說好。", ["阿明"]),
        ("李小華在地方上都叫小華,隨後走了。", ["小華", "李小華"]),
        ("陳大文出任館長後人稱陳館長,說好。", ["陳館長", "陳大文"]),
        ("貝葛·羅尼沃(Belgri Lonyvo)來了。", ["Lonyvo, Belgri", "B. Lonyvo", "貝葛·羅尼沃", "羅尼沃·貝葛", "貝葛羅尼沃", "Belgri Lonvyo", "Belgri Loonyvo"]),
        ("台北果農監督聯盟(Belda Orchard Watch Alliance,簡稱BOWA)指出。", ["BOWA", "台北果農監督聯盟", "果農監督聯盟(台北)", "台北市果農監督聯盟", "台北果督盟"]),
    ]
    rows += [(1000 + i, t, opinion(*ps)) for i, (t, ps) in enumerate(extra)]
    df = spark.createDataFrame(rows, "news_id int, article string, opinions string")
    groups = {}
    for r in names.name_groups(df).collect():
        groups.setdefault(r.group, set()).add(r.name)
    found = {frozenset(g) for g in groups.values()}
    for g in spelled.values():
        assert frozenset(g) in found, [x for x in found if x & g]
    for wanted in ({"王理事長", "王大明", "阿明"}, {"小華", "李小華"}, {"陳館長", "陳大文"}, set(extra[4][1]), set(extra[5][1])):
        assert frozenset(wanted) in found, [x for x in found if x & wanted]
    pairs = {tuple(r) for r in names.same_names(df).collect()}
    assert pairs == {p for g in found for p in itertools.combinations(sorted(g), 2)}


def test_hashes_of_lines(spark):
    df = spark.createDataFrame([(1, 1, PAGE)], "idx int, company_id int, raw_xml string")
    got = {r.line_md5 for r in main_text.main_line_hashes(df).collect()}
    assert got == {hashlib.md5(p.encode()).hexdigest() for p in main_text.paragraphs(PAGE)}
