import datetime as dt

from pyspark.sql import functions as F

from trendloom.operators import mining as M
from trendloom.operators.extract import seed_lexicon
from trendloom.plans.endpoints import CachedAnswers, TrendEngine

T0 = dt.datetime(2024, 1, 2)


def noon():
    return F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")


def engine(spark):
    rows = [
        (1, "a", "Huawei发布新品手机", "x", 100, 10, T0), (2, "b", "华为手机上海发布", "y", 300, 20, T0 + dt.timedelta(hours=1)),
        (3, "a", "上海暴雨预警升级", "z", 50, 50, T0 + dt.timedelta(hours=2)), (4, "c", "暴雨预警持续", "w", 70, 0, T0 + dt.timedelta(hours=3)),
    ]
    a = spark.createDataFrame(rows, "id long, source_key string, title string, content string, heat_value long, prev_heat_value long, published_at timestamp_ntz")
    s = spark.createDataFrame([(1, 10, T0 - dt.timedelta(days=2)), (1, 100, T0), (2, 300, T0)], "article_id long, heat_value long, captured_at timestamp_ntz")
    return TrendEngine(a, s, seed_lexicon())


def test_reads(spark):
    e = engine(spark)
    assert [r.id for r in e.article_list("暴雨").collect()] == [4, 3]
    assert "华为" in e.keywords(1).first().keywords
    topics = {r.label: r for r in e.topics(noon()).collect()}
    assert topics["华为"]["count"] == 2 and topics["暴雨预警"]["count"] == 2 and topics["华为"].count_delta == 1
    s = e.storyline("华为", noon()).first()
    assert s.total_articles == 2 and s.n_sources == 2 and s.score_delta == 390
    assert all(r.label != "华为" for r in e.related("华为", noon()).collect())
    assert e.feed().first().xml.count("<item>") == 4


def test_events(spark):
    groups = engine(spark).events(noon()).collect()
    assert groups and all(g["count"] >= 2 for g in groups)


def test_discovery_rounds_promote(spark):
    state = spark.createDataFrame([], "word string, hit_days long, total_hits long, last_hit_at timestamp_ntz, promoted_at timestamp_ntz")
    bad = spark.createDataFrame([("bad",)], "word string")
    words = spark.createDataFrame([("new", 3), ("bad", 9)], "gram string, articles long")
    for day in (2, 3, 8):
        now = F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")
        state = M.discovery_round(state, words, bad, now)
        state = spark.createDataFrame(state.collect(), state.schema)
    got = {r.word: r for r in state.collect()}
    assert got["new"].hit_days == 2 and got["new"].promoted_at == dt.datetime(2024, 1, 3) and got["bad"].promoted_at is None and got["bad"].hit_days == 1


def test_daily_summary(spark):
    stats = spark.createDataFrame([("a", 3, "x" * 30), ("b", 5, None), ("hidden", 9, "t")], "source_key string, n long, top_title string")
    text = M.daily_summary(stats, ["hidden"]).first().summary
    assert text == "Today: 8 articles (b 5, a 3)\na: " + "x" * 22 + "…"


def test_shared_entity_with_unrelated_rest_does_not_link(spark):
    v = spark.createDataFrame([(1, "acme", 1.0), (1, "opens", 1.0), (1, "shop", 1.0), (2, "acme", 1.0), (2, "sues", 1.0), (2, "rival", 1.0)], "id long, token string, weight double")
    p = spark.createDataFrame([(1, 2, ["acme"])], "a long, b long, entities array<string>")
    assert M.residual_cosine(p, v).first().semantic == 0.0


def test_near_titles_of_one_source_collapse(spark):
    rows = [(9, "a", 1, "storm hits the coast", 5), (9, "a", 2, "storm hits the coast!", 7), (9, "b", 3, "storm hits the coast", 1)]
    got = M.collapse_same_source(spark.createDataFrame(rows, "component long, source_key string, id long, title string, heat_value long")).collect()
    assert sorted(r.id for r in got) == [2, 3]


def test_topics_take_discovered_words_and_drop_generic_ones(spark):
    rows = [(i, f"s{i % 3}", t, "x", 100, 10, T0 + dt.timedelta(minutes=i)) for i, t in enumerate(["糯叽叽 走红", "糯叽叽 开店", "今天糯叽叽", "手机 手机", "手机 手机", "脆哨子 来了", "脆哨子 走了"])]
    a = spark.createDataFrame(rows, "id long, source_key string, title string, content string, heat_value long, prev_heat_value long, published_at timestamp_ntz")
    s = spark.createDataFrame([], "article_id long, heat_value long, captured_at timestamp_ntz")
    e = TrendEngine(a, s, seed_lexicon())
    assert "糯叽叽" in {r["gram"] for r in e.heat_of(a).collect()}
    labels = lambda x: {r.label for r in x.topics(noon()).collect()}
    assert "糯叽叽" in labels(e) and "手机" not in labels(e)
    assert "糯叽叽" not in labels(TrendEngine(a, s, seed_lexicon(), blacklist=frozenset({"糯叽叽"})))
    assert "走红" in TrendEngine(a, s, seed_lexicon(), pending=frozenset({"走红"})).discovered(a)


def test_answers_are_kept_for_a_while(spark):
    at = [0.0]
    asked = []

    class Counting(TrendEngine):
        def topics(self, now, hours=24, limit=12):
            asked.append((hours, limit))
            return super().topics(now, hours, limit)

    e = engine(spark)
    c = CachedAnswers(Counting(e.articles, e.snapshots, e.lexicon), clock=lambda: at[0])
    first = c.topics(noon()).collect()
    at[0] = 59.0
    assert c.topics(noon()).collect() == first and asked == [(24, 12)]
    c.topics(noon(), 6)
    at[0] = 60.0
    c.topics(noon())
    assert asked == [(24, 12), (6, 12), (24, 12)]
    c.forget()
