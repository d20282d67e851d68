import collections
import datetime as dt
import itertools
import json
import random

from pyspark.sql import functions as F

from trendloom.operators import ingest as I
from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.operators.graph import components
from trendloom.sources import feeds
from trendloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
OBS = "url string, source_key string, title string, heat_value long, source_rank int, observed_at timestamp_ntz, id long"


def obs(r, n):
    return [(f"u{r.randrange(8)}", "s", f"t{i}", r.randrange(100), i % 5, T0 + dt.timedelta(minutes=i), i) for i in range(n)]


def test_merging_in_parts_equals_one_fold(spark):
    r = random.Random(1)
    rows = obs(r, 60)
    whole = sorted(map(tuple, I.fold_observations(spark.createDataFrame(rows, OBS)).collect()))
    state = I.fold_observations(spark.createDataFrame(rows[:10], OBS))
    for a, b in ((10, 11), (11, 35), (35, 60)):
        state = I.merge_state(state, spark.createDataFrame(rows[a:b], OBS))
    assert sorted(map(tuple, state.collect())) == whole


def test_asof_join_equals_a_loop(spark):
    r = random.Random(2)
    left = [(r.randrange(3), i, T0 + dt.timedelta(minutes=r.randrange(100))) for i in range(30)]
    right = [(r.randrange(3), T0 + dt.timedelta(minutes=m), r.random()) for m in r.sample(range(100), 25)]
    got = R.asof_join(spark.createDataFrame(left, "k int, i int, t timestamp_ntz"), spark.createDataFrame(right, "k int, u timestamp_ntz, v double"), "k", "t", "u", "v").collect()
    for x in got:
        past = [(u, v) for k, u, v in right if k == x.k and u <= x.t]
        assert x.asof_v == (max(past)[1] if past else None)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (103, 101)], "a int, b int")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 103)} == {100}


def test_ngram_takes_the_place_of_its_fragment(spark):
    titles = [(1, "a", "天问 探测 器"), (2, "b", "天问 探测 器"), (3, "a", "天问 探测 器")]
    tokens = M.letter_tokens(spark.createDataFrame(titles, "id int, source_key string, title string"))
    words = {r.gram for r in M.heat_words(M.ngram_support(tokens, M.DiscoveryParams()), M.DiscoveryParams()).collect()}
    assert words == {"天问探测器"}


def test_dictionary_sets_how_many_articles_a_word_needs(spark):
    rows = [(i, f"s{i % 3}", "发现 新词") for i in range(4)]
    tokens = M.letter_tokens(spark.createDataFrame(rows, "id int, source_key string, title string"))
    p = M.DiscoveryParams(max_ngram_len=2)
    d = spark.createDataFrame([("发现", 24826.0)], "word string, freq double")
    assert {r.gram for r in M.heat_words(M.ngram_support(tokens, p), p, dictionary=d).collect()} == {"新词"}


def test_absorption_leaves_an_antichain(spark):
    labels = ["".join(random.Random(i).choices("ab", k=1 + i % 5)) for i in range(30)]
    t = spark.createDataFrame([(x,) for x in set(labels)], "label string")
    kept = [r.label for r in M.absorb_labels(t).collect()]
    assert kept and not any(a != b and a in b for a, b in itertools.product(kept, kept))


def test_grid_has_eight_variants_and_a_baseline(spark):
    support = spark.createDataFrame([("x", 1, 3, 3), ("bad", 1, 2, 2)], "gram string, n int, articles long, sources long")
    grid = M.evaluate_grid(support, spark.createDataFrame([("bad",)], "word string")).collect()
    assert len(grid) == 9 and sum(r.baseline for r in grid) == 1
    assert next(r for r in grid if r.baseline).precision == 0.5
    assert M.suggest_variant(M.evaluate_grid(support, spark.createDataFrame([("bad",)], "word string"))).first().suggested is not None


def test_cluster_and_same_source_collapse(spark):
    rows = [(1, "a", "storm hits coast", 50), (2, "b", "storm hits coast hard", 90), (3, "a", "storm hits coast", 40), (4, "c", "unrelated talk show", 10)]
    a = spark.createDataFrame([(*r, 0, T0) for r in rows], "id long, source_key string, title string, heat_value long, prev_heat_value long, published_at timestamp_ntz")
    t = M.letter_tokens(a)
    groups = M.cluster_events(a, t.select("id", F.col("token").alias("term")).filter("term = 'storm'"), t.select("id", F.col("token").alias("term")), t, hub_share=0.9).collect()
    assert [(g["count"], g.ids, g.title) for g in groups] == [(2, [1, 2], "storm hits coast hard")]


def test_storyline_summary(spark):
    a = spark.createDataFrame([(1, "a", "first", 5, T0), (2, "b", "second", 3, T0 + dt.timedelta(hours=1))], "id long, source_key string, title string, heat_value long, published_at timestamp_ntz")
    s = M.storyline_summary(M.storyline(a), "x", 24).first()
    assert s.latest_title == "second" and s.hottest_title == "first" and len(s.summary) == 3
    assert len(M.storyline_summary(M.storyline(a.limit(0)), "x", 24).first().summary) == 1


def payload(spark, key, body):
    return spark.createDataFrame([(key, body, T0)], "source_key string, body string, fetched_at timestamp_ntz")


def test_payload_parsers(spark):
    nested = {"data": [{"target": {"id": 7, "title": "t", "url": "u", "created": 0, "excerpt": "e", "author_name": "n"}, "detail_text": "12 万热度"}, {"target": {"title": ""}, "detail_text": ""}]}
    x = feeds.nested_list(payload(spark, "z", json.dumps(nested)), "q/").collect()
    assert [(r.url, r.heat_value, r.source_rank) for r in x] == [("q/7", 120_000, 1)]
    videos = {"code": 0, "data": {"list": [{"bvid": "B", "title": "v", "desc": "", "pubdate": 1, "owner": {"name": "o"}, "stat": {"view": 23_456}}]}}
    x = feeds.video_list(payload(spark, "b", json.dumps(videos))).collect()
    assert [(r.heat, r.heat_value, r.source_rank) for r in x] == [("2 万播放", 23_456, None)]
    assert feeds.video_list(payload(spark, "b", '{"code": -412}')).count() == 0
    item = lambda i, w, s: {"index": i, "word": w, "hotScore": s, "desc": "", "rawUrl": ""}
    cards = {"success": True, "data": {"cards": [{"topContent": [item(0, "置顶词条", "1")], "content": [item(2, "第二词条甲", "300"), item(1, "另外话题", "x"), item(3, "第二词条乙", "5")]}]}}
    x = feeds.card_list(payload(spark, "c", json.dumps(cards))).orderBy("source_rank").collect()
    assert [(r.title, r.heat_value, r.source_rank) for r in x] == [("置顶词条", 1, 1), ("另外话题", 0, 2), ("第二词条甲", 300, 3)]
    ranked = {"data": [{"id": "1", "attributes": {"title": "b", "num": 20_000, "rank": 5}}, {"id": "2", "attributes": {"title": "a", "num": 3, "rank": 2}}]}
    x = feeds.ranked_list(payload(spark, "s", json.dumps(ranked))).orderBy("source_rank").collect()
    assert [(r.title, r.source_rank, r.heat) for r in x] == [("a", 1, "3"), ("b", 2, "2万")]
    html = '<a href="/weibo?q=%23x%23&band_rank=3&r=1" target="_blank">topic</a> <span> 剧集 4512</span><a href="/weibo?q=ad&topic_ad=1&band_rank=4" target="_blank">ad</a><span>1</span>'
    x = feeds.html_list(payload(spark, "w", html), "q=").collect()
    assert [(r.url, r.title, r.heat_value, r.source_rank) for r in x] == [("q=%23x%23", "topic", 4512, 3)]


def test_url_of_a_near_title_is_kept(spark):
    new = spark.createDataFrame([("s", "n1", "大雨预警"), ("s", "n2", "别的话题")], "source_key string, url string, title string")
    old = spark.createDataFrame([("s", "o1", "大雨预报"), ("s", "o2", "大雨预警")], "source_key string, url string, title string")
    assert sorted(r.url for r in feeds.replace_url_of_near_title(new, old).collect()) == ["n2", "o2"]


def test_feed_and_pages(spark):
    a = spark.createDataFrame([(1, "A & B", "http://x/1?a&b", "text ]]> more", "9", T0)], "id long, title string, url string, content string, heat string, published_at timestamp_ntz")
    import xml.etree.ElementTree as E

    root = E.fromstring(feeds.rss(a, "t", "http://x").first().xml.split("?>", 1)[1])
    assert root.find("channel/item/title").text == "A & B" and "]]>" in root.find("channel/item/description").text
    assert "A &amp; B" in feeds.share_page(a).first().html


def test_plug_in_source(spark, tmp_path):
    (tmp_path / "zhihu.json").write_text("{}")
    spark.dataSource.register(feeds.PayloadFiles)
    assert [tuple(r) for r in spark.read.format("payload_files").option("path", str(tmp_path)).load().collect()] == [("zhihu", "{}")]


def test_stream_of_batches_equals_the_batch_fold(spark, tmp_path):
    rows = obs(random.Random(5), 40)
    for i in range(4):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], OBS).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    df = spark.readStream.schema(spark.createDataFrame([], OBS).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    told = jobs.alert_sink(str(tmp_path / "alerts"))
    after = lambda new, n: told(new.select(F.lit(1).cast("long").alias("subscription_id"), F.hash("url").cast("long").alias("id")), n)
    jobs.fold_stream(df, str(tmp_path / "state"), str(tmp_path / "cp"), after=after).awaitTermination()
    newest = spark.read.parquet(str(tmp_path / "state/version=3"))
    cols = ["url", "heat_value", "n_observations", "published_at", "fetched_at"]
    assert sorted(map(tuple, newest.select(cols).collect())) == sorted(map(tuple, I.fold_observations(spark.createDataFrame(rows, OBS)).select(cols).collect()))
    alerts = spark.read.parquet(str(tmp_path / "alerts"))
    assert alerts.count() == alerts.select("subscription_id", "id").distinct().count() == newest.count()


def test_near_equal_pairs_equal_brute_force(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abü", k=r.randrange(0, 5))) for _ in range(60)] + [None]

    def near(x, y):
        one = {x} | {x[:i] + x[i + 1 :] for i in range(len(x))}
        two = {y} | {y[:i] + y[i + 1 :] for i in range(len(y))}
        edit = x in two or y in one or (len(x) == len(y) and sum(c != e for c, e in zip(x, y)) <= 1)
        return x in y or y in x or edit

    want = sorted((i, j) for i, j in itertools.combinations(range(61), 2) if words[i] and words[j] and near(words[i], words[j]))
    got = R.near_equal_pairs(spark.createDataFrame(list(enumerate(words)), "k long, w string")).collect()
    assert sorted((x.a, x.b) for x in got) == want


def test_near_equal_pairs_of_one_word_are_many_tasks(spark):
    words = spark.createDataFrame([(i, "same") for i in range(300)] + [(300, "sane"), (None, "same")], "k long, w string")
    got = R.near_equal_pairs(words, block_rows=16, task_pairs=4_000).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((x.a, x.b) for x in got) == list(itertools.combinations(range(301), 2))
    of = collections.Counter(x.part for x in got)
    assert len(of) >= 16 and max(of.values()) < len(got) / 4


def test_near_equal_pairs_write_little_to_disk(spark):
    def written():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {(f := files.apply(i)).getName(): f.length() for i in range(files.size())}

    words = spark.range(3_000).select(F.col("id").alias("k"), F.lit("same").alias("w"))
    before = written()
    assert R.near_equal_pairs(words, block_rows=16, task_pairs=1_000_000).count() == 3_000 * 2_999 // 2
    assert sum(n for name, n in written().items() if name not in before) < 1_000_000  # 35,344 couples of blocks are 9 MB


def test_near_equal_pairs_over_slices_and_blocks(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(40)]), r.choice(["same", "same", "sane", "am", "other", "", None])) for _ in range(150)]
    near = {("same", "sane"), ("same", "am")}
    want = sorted((k, q) for k, w in rows for q, v in rows if None not in (k, q, w, v) and k < q and w and v and (w == v or (w, v) in near or (v, w) in near))
    out = R.near_equal_pairs(spark.createDataFrame(rows, "k long, w string"), block_rows=3, task_pairs=64)
    assert sorted((x.a, x.b) for x in out.collect()) == want
    blocks = [x for x in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "explode(transform(" in x]
    assert len(blocks) == 2 and not any("*(" in x for x in blocks)  # compiled, they would hold all pairs of a couple of slices


def test_tasks_of_entity_counts_grow_with_the_links(spark):
    r = random.Random(5)
    links, events = ([(r.randrange(40), r.randrange(12)) for _ in range(600)] for _ in range(2))
    frame = lambda rows, c: spark.createDataFrame([*rows, (None, 1)], f"article_id long, {c} long")
    entities = spark.createDataFrame([(i,) for i in range(14)], "entity_id long")
    out = R.entity_counts(entities, frame(links, "entity_id"), frame(events, "event_id"), task_rows=50)
    of = {i: {x for x, y in links if y == i} for i in range(14)}
    want = {i: (len(of[i]) + (i == 1), len({y for x, y in events if x in of[i]})) for i in range(14)}
    assert {x.entity_id: (x.article_count, x.event_count) for x in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().count(", 24), REPARTITION_BY_NUM") >= 3


def test_near_equal_customers_sees_every_customer(spark, tmp_path):
    from trendloom.plans.text_queries import QUERIES

    spark.createDataFrame([(i, f"Customer#{i:09d}") for i in (299, 300, 1299, 1300, 14300)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert {(x.a, x.b) for x in QUERIES["near_equal_pairs"](spark, str(tmp_path)).collect()} == {(299, 1299), (300, 1300), (300, 14300), (1300, 14300)}


def test_event_groups_keep_terms_of_many_articles(spark, tmp_path):
    """A term of 45 of 120 articles, more than any fixed number or five in a hundred, still links them."""
    from trendloom.plans.text_queries import QUERIES

    recent = [i for i in range(1, 43200) if i * 7919 % 43200 >= 41760][:120]
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(i, (f"tremors shake northern valley q{name(n)}" if n < 45 else f"zz{name(n)} yy{name(n)} xx{name(n)}"), f"s{n}", 50) for n, i in enumerate(recent)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [g["count"] for g in QUERIES["event_groups"](spark, str(tmp_path)).collect()] == [45]


def test_absorption_sees_the_whole_label(spark):
    long = "a" * 45
    labels = ["b" * 50 + "storm", "storm", long, "c" + long, "x", "", "🌊" + "d" * 41 + "é", "é"]
    kept = {r.label for r in M.absorb_labels(spark.createDataFrame([(x,) for x in labels if x], "label string")).collect()}
    assert kept == {"storm", long, "x", "é"}


def test_share_page_digests_has_every_article(spark, tmp_path):
    from trendloom.plans.text_queries import QUERIES

    spark.createDataFrame([(i, f'A & "b" <{i}>\n' + "x" * 90 * (i % 3), "s", 9) for i in range(1, 120)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["share_pages"](spark, str(tmp_path)).collect()
    assert {x.id for x in got} == set(range(1, 120)) and len({x.digest for x in got}) == 119 and all(x.size > 100 for x in got)


def test_late_and_tied_batches_equal_one_fold(spark):
    """Observations in any split, also of one time, also repeated."""
    r = random.Random(7)
    rows = [(f"u{r.randrange(5)}", "s", f"t{r.randrange(3)}", r.randrange(100), r.choice([None, 1, 2]), T0 + dt.timedelta(minutes=r.randrange(12)), r.randrange(4)) for _ in range(90)]
    rows += rows[:6] + [("alone", "s", "t", 1, None, T0, 1), ("twice", "s", "t", 5, 1, T0, 1), ("twice", "s", "t", 9, 1, T0, 1)]

    def plain():
        out = {}
        for u in {x[0] for x in rows}:
            own = sorted((x[5], x[6], x[1], x[2], x[3], -1 if x[4] is None else x[4]) for x in rows if x[0] == u)
            out[u] = (own[-1][4], own[-2][4] if len(own) > 1 else 0, own[-1][1], own[0][0], own[-1][0], len(own))
        return out

    df = lambda part: spark.createDataFrame(part, OBS)
    pick = lambda s: {x.url: (x.heat_value, x.prev_heat_value, x.id, x.published_at, x.fetched_at, x.n_observations) for x in s.collect()}
    assert pick(I.fold_observations(df(rows))) == plain()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        state = I.fold_observations(df(rows[:31]))
        for a, b in ((31, 32), (32, 70), (70, len(rows))):
            state = I.merge_state(state, df(rows[a:b]))
        assert pick(state) == plain()


def test_stream_into_buckets(spark, tmp_path):
    """Only touched buckets get a new version; what newer ones replace can go."""
    rows = obs(random.Random(6), 40)
    for i in range(4):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], OBS).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    df = spark.readStream.schema(spark.createDataFrame([], OBS).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    jobs.fold_stream(df, state, str(tmp_path / "cp"), buckets=5).awaitTermination()
    cols = ["url", "heat_value", "prev_heat_value", "n_observations", "published_at", "fetched_at"]
    whole = sorted(map(tuple, I.fold_observations(spark.createDataFrame(rows, OBS)).select(cols).collect()))
    assert sorted(map(tuple, jobs.read_state(spark, state).select(cols).collect())) == whole
    # batches have removed what newer ones replace: two versions of a bucket are left at most
    assert max(collections.Counter(b for _, b, _ in jobs._folders(spark, state)).values()) <= 2
    assert jobs.drop_old_versions(spark, state, 4) > 0
    assert jobs.drop_old_versions(spark, state, 4) == 0
    assert sorted(map(tuple, jobs.read_state(spark, state).select(cols).collect())) == whole


def test_many_keywords_are_found_as_few(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcé_%🙂 ") for _ in range(n))
    articles = spark.createDataFrame([(i, r.choice([None, text(20)]), r.choice([None, "", text(200)])) for i in range(60)], "id long, title string, content string")
    subs = spark.createDataFrame([(i, r.choice([text(1), text(2), text(3), text(4).upper(), text(6)])) for i in range(100)] + [(200, ""), (201, None)], "id int, keyword string")
    few, many = (sorted(map(tuple, R.keyword_hits(articles, subs, few=n).collect())) for n in (1000, 3))
    assert few == many and len(few) > 200


def test_places_in_groups_of_any_size(spark):
    rows = [(i, "hot" if i % 10 else f"g{i % 3}", (i * 37) % 50) for i in range(500)] + [(1000, None, 5), (1001, None, 7)]
    df = spark.createDataFrame(rows, "id long, g string, h int").repartition(7)
    got = {x.id: x.place for x in R.places(df, "g", [F.desc("h"), F.asc("id")], "place").collect()}
    for g in {x[1] for x in rows}:
        for n, (_, i) in enumerate(sorted((-h, i) for i, k, h in rows if k == g), 1):
            assert got[i] == n
    a = spark.createDataFrame([(i, g, h, 0 if h % 3 else 20) for i, g, h in rows], "id long, source_key string, heat_value int, prev_heat_value int")
    badge = {x.id: x.badge for x in R.top_badges(a, 3).collect()}
    assert all((badge[i] or 99) == (got[i] if got[i] <= 3 else 99) for i in got)


def test_words_that_are_no_discoveries(spark):
    d = spark.createDataFrame([("发现", 24826), ("异常", 3360), ("量子", 617), ("计算", 9000), ("专家", 201), ("声明", 200), ("委员会", 401), ("工作人员", 301), ("摆烂", 3)], "word string, freq long")
    words = ["发现异常", "量子计算", "专家", "声明", "委员会", "工作人员", "摆烂", "鸿蒙", "2024", "30万元", "listed", "AI"]
    got = M.excluded_words(spark.createDataFrame([(w,) for w in words * 2], "gram string"), d, spark.createDataFrame([("listed",), ("else",)], "word string")).collect()
    assert sorted(x.word for x in got) == sorted(["发现异常", "专家", "委员会", "工作人员", "2024", "30万元", "listed"])


def test_generic_topics_and_hubs(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "label string, n int")
    d = spark.createDataFrame([("a", 601), ("b", 600), ("c", 5000)], "word string, freq long")
    one = lambda w: spark.createDataFrame([(w,)], "word string")
    assert sorted(x.label for x in M.drop_generic(t, d, one("d"), one("c")).collect()) == ["b", "c"]
    terms = [(i, "wide") for i in range(9)] + [(i, "narrow") for i in range(8)] + [(1, "AI"), (19, "AI")]
    docs = spark.range(20)
    hub = lambda least: sorted(x.term for x in M.hubs(spark.createDataFrame(terms, "id long, term string"), least_docs=least, docs=docs).collect())
    assert hub(20) == ["AI", "wide"] and hub(21) == ["AI"]
    assert [M.hub_least(h) for h in (1, 3, 6, 24)] == [8, 8, 12, 20]


def test_a_bucket_of_told_alerts_is_one_file(spark, tmp_path):
    sink = jobs.alert_sink(str(tmp_path / "told"), buckets=4)
    rows = [(i % 3, i) for i in range(400)]
    for number, part in enumerate((rows[:250], rows[150:])):
        sink(spark.createDataFrame(part, "subscription_id long, id long").repartition(16), number)
    got = spark.read.parquet(str(tmp_path / "told"))
    assert sorted((r.subscription_id, r.id) for r in got.collect()) == sorted(rows)
    assert len(list((tmp_path / "told").glob("batch=*/bucket=*/*.parquet"))) == 8
