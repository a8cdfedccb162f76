import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import times
from newsloom.functions.literals import opinions_of, parse_opinions

ROWS = ["", " ", "a b", "  a  b c ", "甲　乙\t\n丙 ", "x y", None, "😀 說 好"]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first().r


def test_whitespace_is_that_of_python(spark):
    got = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "i int, t string").orderBy("i").select(X.collapse_whitespace("t").alias("r")).collect()]
    assert got == [None if t is None else re.sub(r"\s+", " ", t).strip() for t in ROWS]


def test_nfkc(spark):
    assert one(spark, "ＡＢ，：  ﾊﾞ", X.nfkc) == "AB,: バ"
    assert one(spark, None, X.nfkc) is None


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab 甲😀", max_size=20), min_size=60, max_size=60))
def test_space_index_round_trip(spark, texts):
    def places(t):
        seen, out = 0, []
        for c in t:
            if c == " ":
                out.append(seen)
            else:
                seen += 1
        return sorted(set(out))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.strip_spaces("t").alias("s"), X.space_index("t").alias("i"), X.restore_spaces(X.strip_spaces("t"), X.space_index("t")).alias("b")).collect():
        assert r.s == r.t.replace(" ", "") and list(r.i) == places(r.t) and r.b == re.sub(" +", " ", r.t)


def test_truncation_takes_the_first_listed_pattern(spark):
    cut = lambda t, p: one(spark, t, lambda c: X.truncate_at(c, p))
    assert cut("一二延伸三更多四", ["更多", "延伸"]) == "一二延伸三"
    assert cut("一\n二延伸\n三", ["延伸"]) == "一\n二"
    assert cut("一二", ["更多"]) == "一二"


def test_substitutions_run_in_order(spark):
    assert one(spark, "aab", lambda c: X.substitute_all(c, [("aa", "b"), ("bb", "c")])) == "c"
    assert one(spark, "影/影/題", lambda c: X.remove_first(c, ["影/"])) == "影/題"


def test_reporters(spark):
    patterns = [r"\(記者(.{2,3})報導\)", r"記者(.{2})"]
    df = spark.createDataFrame([("(記者王小明報導)文。記者李四",)], "t string")
    names, rest = X.extract_all("t", patterns)
    assert tuple(df.select(names, rest).first()) == ("王小明,李四", "文。")
    name, rest = X.extract_first("t", patterns)
    assert tuple(df.select(name, rest).first()) == ("王小明", "文。記者李四")
    name, rest = X.extract_first("t", [r"記者(李.)"], keep="before")
    assert tuple(df.select(name, rest).first()) == ("李四", "(記者王小明報導)文。")
    assert one(spark, "王小明、 Ann Lee 李四,", X.reporter_list) == "王小明,Ann-Lee,李四"


def test_small_functions(spark):
    assert one(spark, "說完", X.ensure_sentence_end) == "說完。" and one(spark, "說!", X.ensure_sentence_end) == "說!" and one(spark, "", X.ensure_sentence_end) == ""
    assert one(spark, "P", lambda c: X.category_of(c, {"P": "政治"})) == "政治" and one(spark, None, lambda c: X.category_of(c, {"P": "政治"})) == ""
    assert one(spark, "王小明", lambda c: X.contains_either(c, F.lit("小明"))) is True
    assert one(spark, "https://x.tw/n/12-7?a", lambda c: X.compress_url(c, F.lit(r"https://x\.tw/n/(\d+)-(\d+)"), 2)) == "12-7"
    assert one(spark, "z https://x.tw/n/12", lambda c: X.compress_url(c, F.lit(r"https://x\.tw/n/(\d+)"))) == "z https://x.tw/n/12"
    vectors = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in vectors.select(X.cosine("a", "b")).collect()]
    assert abs(got[0] - 0.96) < 1e-12 and got[1] is None


def test_times(spark):
    df = spark.createDataFrame([("1654869600",), ("bad",), (None,)], "s string").select(times.wall_time("s").alias("w"))
    rows = times.with_time_parts(df, "w").collect()
    assert (rows[0].datetime, rows[0].year, rows[0].hour) == ("2022-06-10 22:00", 2022, 22)
    assert rows[1].datetime is None and rows[2].minute is None
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "d string")
    assert {(str(r.day), r.has_previous, r.has_next) for r in times.neighbour_days(days, "d").collect()} == {("2024-01-01", False, True), ("2024-01-02", True, False)}


def test_opinion_literals(spark):
    text = "[{'person': \"O'X\", 'verb': '說', 'opinion': '好。', 'order': 2, 'negative_list': [], 'positive_list': ['好']}]"
    assert parse_opinions(text)[0]["person"] == "O'X"
    assert parse_opinions("[") is None and parse_opinions(None) is None and parse_opinions("[]") == [] and parse_opinions("3") is None
    got = spark.createDataFrame([(text,), ("[",), (None,)], "t string").select(opinions_of("t").alias("o")).collect()
    assert got[0].o[0].ord == 2 and got[0].o[0].positive_list == ["好"] and got[1].o is None and got[2].o is None


def test_nfkc_matches_python(spark):
    texts = ["①②", "ｶﾞ", "ﬁ", "Å", "が"]
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.nfkc("t").alias("r")).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]
