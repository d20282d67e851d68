import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import scalar as S


def column(spark, rows, expr, kinds="a string"):
    return [r[0] for r in spark.createDataFrame(rows, kinds).select(expr).collect()]


def test_parse_heat(spark):
    rows = [("1234 万热度",), ("1.5亿",), ("987",), ("",), ("热",), (" 12.5万播放 ",), ("1.2.3",), (None,)]
    assert column(spark, rows, S.parse_heat(F.col("a"))) == [12_340_000, 150_000_000, 987, 0, 0, 125_000, 0, 0]


def test_format_heat(spark):
    rows = [(9_999,), (7_809_483,), (150_000_000,), (925_000_000,), (2_500_000_000,)]
    assert column(spark, rows, S.format_heat(F.col("a"), "热搜"), "a long") == ["9999 热搜", "780 万热搜", "1.5 亿热搜", "9.2 亿热搜", "25 亿热搜"]
    assert column(spark, [(15_600,)], S.format_heat(F.col("a"), wan_rounds=True, gap=False), "a long") == ["2万"]


def test_nearly_equal_counts_code_points(spark):
    rows = [("暴雨预警", "暴雨预报"), ("暴雨", "暴雨预警"), ("暴雨", "晴天"), ("abc", "abd"), ("abc", "axd"), ("", "a"), ("é", "e")]
    assert column(spark, rows, S.nearly_equal(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, True, False, False, True]


def test_normalisers(spark):
    assert column(spark, [("A Ü　b",)], S.squeeze(F.col("a"))) == ["aüb"]
    assert column(spark, [("A Ü b",)], S.squeeze_ascii(F.col("a"))) == ["aÜb"]
    fp = column(spark, [("Hello, World!",), ("hello world",), ("hello worlds",)], S.fingerprint(F.col("a")))
    assert fp[0] == fp[1] != fp[2] and len(fp[0]) == 16


def test_titles(spark):
    assert column(spark, [("short",), ("one two three four five six seven",)], S.cut_at_word(F.col("a"), 14)) == ["short", "one two three…"]
    assert column(spark, [("abcdef",)], S.excerpt(F.col("a"), 3)) == ["abc…"]


def test_scores(spark):
    rows = [(100, 40), (100, 200), (0, 5)]
    assert column(spark, rows, S.article_score(F.col("h"), F.col("p")), "h long, p long") == [160, 100, 10_000]
    assert column(spark, [(10, 1), (10, 2), (10, 3), (-1, 3)], S.diversity_boost(F.col("h"), F.col("p")), "h long, p long") == [10, 20, 40, -1]
    assert column(spark, [(1, 1), (1, 0), (-1, 5)], S.momentum(F.col("h"), F.col("p")), "h long, p long") == ["up", "flat", "down"]
    t = dt.datetime(2024, 1, 1)
    rows = [(t, t + dt.timedelta(hours=h)) for h in (0, 2, 5, 10, 20, 30)] + [(t, None)]
    assert column(spark, rows, S.time_proximity(F.col("a"), F.col("b")), "a timestamp, b timestamp") == [1.0, 0.8, 0.6, 0.4, 0.2, 0.05, 0.5]


def test_overlap_and_duplicates(spark):
    rows = [(["ab", "abc"],), (["abcde"],), ([],)]
    assert column(spark, rows, S.weighted_overlap(F.col("a")), "a array<string>") == [1.0, 1.0, 0.0]
    rows = [("A, b!", "ab", ["a"], ["b"]), ("x y z", "x y q", ["x", "y", "z"], ["x", "y"]), ("x y z", "q", ["x"], ["q"])]
    assert column(spark, rows, S.near_duplicate_title(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "a string, b string, c array<string>, d array<string>") == [True, True, False]


def test_classifiers(spark):
    rows = [("暴雨",), ("A股",), ("3万元",), ("abc",), ("暴A雨",), ("12",)]
    assert column(spark, rows, S.han_count(F.col("a"))) == [2, 1, 2, 0, 2, 0]
    assert column(spark, rows, S.is_pure_han(F.col("a"))) == [True, False, False, False, False, False]
    assert column(spark, rows, S.other_between_han(F.col("a"))) == [False, False, False, False, True, False]
    assert column(spark, rows, S.is_numeric_measure(F.col("a")))[2] and not column(spark, rows, S.is_numeric_measure(F.col("a")))[0]
    rows = [("the ai boom", "ai"), ("said so", "ai"), ("x openai y", "openai")]
    assert column(spark, rows, S.term_weight(F.col("a"), F.lit(""), F.col("b")), "a string, b string") == [3, 0, 3]


def test_display(spark):
    assert column(spark, [("someone@example.org",)], S.mask_email(F.col("a"))) == ["s***@example.org"]
    assert column(spark, [("暴雨 a",)], S.search_url("u?q=", F.col("a"))) == ["u?q=%E6%9A%B4%E9%9B%A8+a"]
