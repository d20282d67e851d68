"""Relational reads and ingest folds as registered queries, each with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import ingest as I
from trendloom.operators import relational as R
from trendloom.sources.adapters import ARTICLES, AS_OF, OBSERVATIONS, SNAPSHOTS, articles, as_of, observations, snapshots, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = f"timestamp '{AS_OF}'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


FOLD = f"""{OBSERVATIONS}, st as (select url, max_by(id, observed_at) id, max_by(source_key, observed_at) source_key, max_by(title, observed_at) title, max_by(heat_value, observed_at) heat_value,
 arg_max(source_rank, observed_at) source_rank, min(observed_at) published_at, max(observed_at) fetched_at, count(*) n_observations from ob group by url),
 pv as (select url, heat_value prev from (select *, row_number() over (partition by url order by observed_at desc) n from ob) where n = 2),
 state as (select st.id, st.url, st.source_key, st.title, st.heat_value, coalesce(pv.prev, 0) prev_heat_value, case when st.id % 5 > 0 then cast(st.id % 50 + 1 as int) end source_rank, published_at, fetched_at, n_observations, n_observations = 1 is_new from st left join pv on st.url = pv.url)"""


def state_of(spark, d):
    return I.fold_observations(observations(spark, d)).drop("previous")


@query(f"with {SNAPSHOTS}, cur as (select article_id, max_by(heat_value, captured_at) heat from sn where captured_at <= {NOW} group by 1), base as (select article_id, max_by(heat_value, captured_at) base from sn where captured_at <= {NOW} - interval 24 hours group by 1) select article_id, heat, base, heat - base delta from cur join base using (article_id) where heat > base order by delta desc, article_id limit 20")
def surging_24h(spark, d):
    return R.surging(snapshots(spark, d), as_of(), 24, 20)


@query(f"with {SNAPSHOTS}, cur as (select article_id, max_by(heat_value, captured_at) heat_value from sn group by 1), base as (select article_id, max_by(heat_value, captured_at) b from sn where captured_at <= timestamp '2024-01-02 00:00:00' group by 1) select article_id, heat_value, heat_value - coalesce(b, 0) delta, b is null is_new from cur left join base using (article_id)")
def window_deltas(spark, d):
    sn = snapshots(spark, d)
    return R.window_deltas(R.asof_latest(sn, as_of()), sn, as_of("2024-01-02 00:00:00"))


@query("")
def asof_join_events(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("ts2"), "value")
    return R.asof_join(left, right, "user_id", "ts", "ts2", "value").select("user_id", "event_id", "ts", "asof_value")


ORACLE_SQL["asof_join_events"] = "select l.user_id, l.event_id, l.ts, r.value asof_value from (select * from events where event_type = 'purchase') l asof left join (select * from events where event_type = 'click') r on l.user_id = r.user_id and l.ts >= r.ts"


@query(f"with {ARTICLES} select id, source_key, title, heat_value, published_at from ar where source_key = 'src3' and (contains(lower(title), 'the') or contains(lower(content), 'the')) order by published_at desc, id desc limit 20 offset 5")
def article_page(spark, d):
    return R.page(R.search(articles(spark, d), "the", "src3"), 20, 5).select("id", "source_key", "title", "heat_value", "published_at")


@query(f"with {ARTICLES} select count(*) total, 5 + greatest(0, least(20, count(*) - 5)) < count(*) has_more from ar where source_key = 'src3'")
def article_count(spark, d):
    return R.page_info(R.search(articles(spark, d), None, "src3"), 20, 5)


@query(f"with {ARTICLES} select id, title from ar where title ilike '%an_r%' or content ilike '%an_r%'")
def article_search_ilike(spark, d):
    return R.search(articles(spark, d), "an_r", raw_pattern=True).select("id", "title")


@query(f"with {ARTICLES} select id, source_key, title, content, heat_value, prev_heat_value, published_at from ar where id = 7")
def article_point(spark, d):
    return articles(spark, d).filter("id = 7")


@query(f"with {ARTICLES} select id, title, heat_value, published_at from ar where published_at >= {NOW} - interval 48 hours order by heat_value desc nulls last, published_at desc, id limit 500")
def recent_window(spark, d):
    return R.recent(articles(spark, d), as_of(), 48, 500).select("id", "title", "heat_value", "published_at")


@query(f"with {ARTICLES} select id, title from ar where published_at >= {NOW} - interval 240 hours and (contains(lower(title), 'tion') or contains(lower(content), 'tion') or contains(lower(title), 'über') or contains(lower(content), 'über')) order by published_at desc, id desc limit 200")
def terms_or_search(spark, d):
    return R.any_term(articles(spark, d), ["tion", "Über"], as_of(), 240).select("id", "title")


@query(f"with {ARTICLES} select id, title from ar where contains(lower(title), '12') or contains(lower(title), 'ö')")
def weak_content_filter(spark, d):
    return R.drop_weak_content_matches(articles(spark, d), ["12", "ö"]).select("id", "title")


@query("with t(term) as (values ('Big Blue'), ('acme'), ('nobody')), al(label, alias) as (values ('ibm','big blue'),('ibm','i.b.m.'),('acme','acme corp')), known as (select lower(alias) a, label from al union select lower(label), label from al), f as (select label, alias from al union select label, label from al) select distinct t.term, coalesce(f.alias, t.term) expanded from t left join known on lower(t.term) = known.a left join f on f.label = known.label")
def alias_expansion(spark, d):
    terms = spark.createDataFrame([("Big Blue",), ("acme",), ("nobody",)], "term string")
    al = spark.createDataFrame([("ibm", "big blue"), ("ibm", "i.b.m."), ("acme", "acme corp")], "label string, alias string")
    return R.expand_terms(terms, al)


@query(f"with {SNAPSHOTS} select * from (select article_id, heat_value, captured_at from sn where article_id = 3 order by captured_at desc limit 48) order by captured_at")
def heat_history(spark, d):
    return R.heat_history(snapshots(spark, d), 3)


@query(f"""with {FOLD}, lt as (select source_key, date_trunc('minute', max(fetched_at)) cutoff from state group by 1),
 bt as (select state.* from state join lt using (source_key) where heat_value > 0 and fetched_at >= cutoff - interval 20 days and source_rank is not null),
 od as (select * from (select *, row_number() over (partition by source_key, title order by source_rank, id) n from bt) where n = 1),
 sm as (select * from (select *, row_number() over (partition by source_key order by source_rank, id) "rank" from od) where "rank" <= 30),
 pr as (select *, row_number() over (partition by source_key order by prev_heat_value desc, "rank") p from sm)
 select source_key, id, title, heat_value, cast("rank" as int) "rank", cast(case when prev_heat_value = 0 or p > 15 then 0 else p - "rank" end as int) rank_change, prev_heat_value = 0 or p > 15 is_new from pr where "rank" <= 15""")
def hotlist_rank_change(spark, d):
    # the events have no batches: everything within twenty days of the last poll counts as one
    state = state_of(spark, d)
    latest = state.groupBy("source_key").agg(F.date_trunc("minute", F.max("fetched_at")).cast("timestamp_ntz").alias("_c"))
    batch = state.join(latest, "source_key").filter(F.col("fetched_at") >= F.col("_c") - F.make_dt_interval(F.lit(20))).withColumn("fetched_at", F.col("_c")).drop("_c")
    return R.hotlist(batch, 15)


@query(f"with {OBSERVATIONS} select title, source_rank, id, observed_at from (select *, row_number() over (partition by title order by source_rank nulls first, id, observed_at) n from ob) where n = 1")
def distinct_on_title(spark, d):
    return R.distinct_on(observations(spark, d), ["title"], ["source_rank", "id", "observed_at"]).select("title", "source_rank", "id", "observed_at")


@query(f"with an(id, level, priority, starts_at, ends_at, is_active) as (values (1,'info',1,timestamp '2024-01-01',null,true),(2,'warn',5,timestamp '2024-01-01',timestamp '2024-01-10',true),(3,'quote',2,timestamp '2024-01-20',timestamp '2024-02-20',true),(4,'critical',9,timestamp '2024-03-01',null,true),(5,'info',3,timestamp '2024-01-01',null,false)) select id, level, priority from an where is_active and starts_at <= {NOW} and (ends_at is null or ends_at > {NOW})")
def active_announcements(spark, d):
    rows = spark.sql("select * from values (1,'info',1,timestamp_ntz'2024-01-01',null,true),(2,'warn',5,timestamp_ntz'2024-01-01',timestamp_ntz'2024-01-10',true),(3,'quote',2,timestamp_ntz'2024-01-20',timestamp_ntz'2024-02-20',true),(4,'critical',9,timestamp_ntz'2024-03-01',null,true),(5,'info',3,timestamp_ntz'2024-01-01',null,false) t(id, level, priority, starts_at, ends_at, is_active)")
    return R.active(rows, as_of()).select("id", "level", "priority")


@query(f"""with {FOLD}, td as (select * from state where fetched_at >= timestamp '2024-01-30'), ct as (select source_key, count(*) n, date_trunc('minute', max(fetched_at)) cutoff from td group by 1),
 ld as (select td.*, row_number() over (partition by td.source_key order by source_rank, id) k from td join ct using (source_key) where source_rank is not null and fetched_at >= cutoff)
 select ct.source_key, ct.n, ld.title top_title, ld.heat_value top_heat from ct left join ld on ct.source_key = ld.source_key and k = 1""")
def today_stats(spark, d):
    return R.today_stats(state_of(spark, d), as_of("2024-01-30 12:00:00"))


@query("""with ae as (select distinct l_orderkey a, l_partkey e from lineitem), av as (select distinct l_orderkey a, l_suppkey v from lineitem),
 na as (select e, count(*) n from ae group by 1), nv as (select e, count(distinct v) n from ae join av using (a) group by 1)
 select p_partkey entity_id, coalesce(na.n, 0) article_count, coalesce(nv.n, 0) event_count from part left join na on p_partkey = na.e left join nv on p_partkey = nv.e""")
def entity_counts(spark, d):
    li = table(spark, d, "lineitem")
    links = li.select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"))
    events = li.select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("event_id"))
    return R.entity_counts(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id")), links, events)


@query("""with ae as (select distinct l_orderkey a, l_partkey e from lineitem where l_partkey = 5), av as (select distinct l_orderkey a, l_suppkey v from lineitem)
 select 5::bigint entity_id, (select count(*) from ae) article_count, (select count(distinct v) from ae join av using (a)) event_count""")
def entity_one(spark, d):
    return entity_counts(spark, d).filter("entity_id = 5")


@query(f"with {ARTICLES}, l as (select distinct l_orderkey % 200 a from lineitem where l_partkey = 5) select id, title, published_at from ar where id in (select a from l) order by published_at desc, id desc limit 20")
def entity_articles(spark, d):
    links = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("article_id"), F.col("l_partkey").alias("entity_id"))
    return R.entity_articles(articles(spark, d), links, 5).select("id", "title", "published_at")


SUBS = [(1, "tion"), (2, "100%"), (3, "über"), (4, "_x"), (5, "The and")]


@query(f"with {ARTICLES}, su(sid, k) as (values (1,'tion'),(2,'100%'),(3,'über'),(4,'_x'),(5,'The and')) select cast(sid as int) subscription_id, k keyword, id from ar join su on contains(lower(title), lower(k)) or contains(lower(content), lower(k)) where not (sid = 1 and id % 2 = 0)")
def alert_hits(spark, d):
    a = articles(spark, d)
    told = a.filter("id % 2 = 0").select(F.lit(1).alias("subscription_id"), F.col("id").alias("article_id"))
    return R.keyword_hits(a, spark.createDataFrame(SUBS, "id int, keyword string"), told)


@query(f"with {ARTICLES}, su(sid, k) as (values (1,'tion'),(2,'100%'),(3,'über'),(4,'_x'),(5,'The and')) select k keyword, count(*) n, min(id) first_id from ar join su on contains(lower(title), lower(k)) or contains(lower(content), lower(k)) group by 1")
def alert_groups(spark, d):
    h = R.hits_by_keyword(R.keyword_hits(articles(spark, d), spark.createDataFrame(SUBS, "id int, keyword string")))
    return h.select("keyword", "n", F.element_at("ids", 1).alias("first_id"))


@query(f"with {ARTICLES} select source_key, id, heat_value, badge, surging from (select *, cast(case when n <= 10 then n end as int) badge, case when prev_heat_value <= 0 then n <= 10 else (heat_value - prev_heat_value) * 10 >= prev_heat_value end surging from (select *, row_number() over (partition by source_key order by heat_value desc, id) n from ar))")
def top10_per_source(spark, d):
    return R.top_badges(articles(spark, d)).select("source_key", "id", "heat_value", "badge", "surging")


@query(f"with {SNAPSHOTS} select article_id, captured_at, heat_value, prev, case when prev is null or prev = heat_value then 'flat' when heat_value > prev then 'up' else 'down' end trend from (select *, lag(heat_value) over (partition by article_id order by captured_at) prev from sn)")
def heat_trend(spark, d):
    return R.heat_trend(snapshots(spark, d)).select("article_id", "captured_at", "heat_value", "prev", "trend")


@query(f"with {ARTICLES}, b as (select *, case when published_at >= timestamp '2024-01-25' then 'today' when published_at >= timestamp '2024-01-24' then 'yesterday' when published_at >= timestamp '2024-01-18' then 'week' else 'older' end bucket from ar) select id, bucket, cast(row_number() over (partition by bucket order by heat_value desc, id) as int) place from b")
def time_buckets(spark, d):
    return R.time_buckets(articles(spark, d), as_of("2024-01-25 10:00:00")).select("id", "bucket", "place")


@query(f"with {SNAPSHOTS} select article_id, min(heat_value) low, max(heat_value) high, min_by(captured_at, (heat_value, captured_at)) low_at, min_by(heat_value, captured_at) \"first\", max_by(heat_value, captured_at) \"last\", case when max_by(heat_value, captured_at) > min_by(heat_value, captured_at) then 'up' when max_by(heat_value, captured_at) < min_by(heat_value, captured_at) then 'down' else 'flat' end trend from sn group by 1")
def sparkline_stats(spark, d):
    return R.sparklines(snapshots(spark, d))


@query(f"with {ARTICLES}, nw as (select * from ar order by published_at desc, id desc limit 50) select id, title, heat_value, case when length(content) > 80 then substr(content, 1, 80) || '…' else content end excerpt from nw order by heat_value desc, published_at desc, id desc limit 10")
def digest_top10(spark, d):
    return R.digest(articles(spark, d)).select("id", "title", "heat_value", "excerpt")


@query(f"with {ARTICLES}, pl as (select * from ar where source_key <> 'src1') select id from pl where published_at >= (select max(published_at) from pl) - interval 72 hours and id not in (select id from ar where id % 3 = 0)")
def ungrouped_articles(spark, d):
    a = articles(spark, d)
    return R.ungrouped(a, a.filter("id % 3 = 0"), 72, "src1").select("id")


@query(f"with {FOLD} select * from state")
def upsert_fold(spark, d):
    return state_of(spark, d)


@query(f"with {FOLD} select * from state")
def upsert_merge(spark, d):
    ob = observations(spark, d)
    # batches that interleave in time, the later observations partly before the earlier ones
    first = (F.hour("observed_at") % 2 == 0) | (F.col("observed_at") >= F.lit("2024-01-12").cast("timestamp_ntz"))
    return I.merge_state(I.fold_observations(ob.filter(first)), ob.filter(~first)).drop("previous")


@query(f"with {SNAPSHOTS} select article_id, heat_value, captured_at from sn")
def snapshot_dedup(spark, d):
    sn = snapshots(spark, d)
    return I.append_snapshots(sn, sn.filter("article_id % 2 = 0").withColumn("heat_value", F.col("heat_value") + 1)).select("article_id", "heat_value", "captured_at")


@query(f"with {FOLD}, kp as (select url, id from state where fetched_at >= {NOW} - interval 2 days), sn as (select user_id article_id, count(*) n from events group by 1) select article_id, n from sn where article_id in (select id from kp)")
def retention_survivors(spark, d):
    kept = I.retained(state_of(spark, d), as_of(), 2)
    per = snapshots(spark, d).groupBy("article_id").agg(F.count("*").alias("n"))
    return I.cascade(per, kept, "article_id")


@query(f"with {ARTICLES} select id, title from ar where id % 3 <> 0 and id % 5 < 3 order by published_at desc, id desc limit 50")
def extract_pending(spark, d):
    a = articles(spark, d).withColumn("extracted_at", F.when(F.col("id") % 3 == 0, F.col("published_at"))).withColumn("extract_attempts", F.col("id") % 5)
    return I.pick_pending(a, 50).select("id", "title")


@query(f"with {ARTICLES} select id, case when id % 4 = 0 then {NOW} when id % 3 = 0 then published_at end extracted_at, id % 5 + case when id % 4 = 1 then 1 else 0 end extract_attempts from ar")
def extract_marked(spark, d):
    a = articles(spark, d).withColumn("extracted_at", F.when(F.col("id") % 3 == 0, F.col("published_at"))).withColumn("extract_attempts", F.col("id") % 5)
    outcome = a.filter("id % 4 < 2").select("id", (F.col("id") % 4 == 0).alias("ok"))
    return I.mark_extracted(a, outcome, as_of()).select("id", "extracted_at", "extract_attempts")


@query(f"with {ARTICLES} select source_key as type, title as \"name\", min(published_at) created_at from ar group by 1, 2")
def entity_upsert(spark, d):
    e = articles(spark, d).select(F.col("title").alias("name"), F.col("source_key").alias("type"), F.col("published_at").alias("seen_at"))
    return I.upsert_entities(e).select("type", "name", "created_at")


@query("select user_id, event_type, min(event_id) event_id from events where event_id % 2 = 0 group by 1, 2 union all select user_id, event_type, -1 from (select distinct user_id, event_type from events where event_id % 2 = 1 except select distinct user_id, event_type from events where event_id % 2 = 0)")
def link_insert_ignore(spark, d):
    e = table(spark, d, "events")
    old = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return I.insert_ignore(old, e.filter("event_id % 2 = 1").select("user_id", "event_type", F.lit(-1).cast("bigint").alias("event_id")), ["user_id", "event_type"])


HITS = "hits as (select event_type || '-' || (user_id % 20) word, cast(user_id % 3 + 1 as int) hits, ts hit_at from events)"


def _hits(spark, d):
    return table(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 20).alias("word"), (F.col("user_id") % 3 + 1).cast("int").alias("hits"), F.col("ts").alias("hit_at"))


STREAKS = f"""{HITS}, g as (select *, case when hit_at - lag(hit_at) over (partition by word order by hit_at) > interval 36 hours then 1 else 0 end s from hits),
 k as (select *, sum(s) over (partition by word order by hit_at rows unbounded preceding) streak from g), p as (select word, streak, count(*) d, sum(hits) n, max(hit_at) l from k group by 1, 2),
 cd as (select word, max_by(d, streak) hit_days, cast(sum(n) as bigint) total_hits, max(l) last_hit_at from p group by 1)"""


@query(f"with {STREAKS} select * from cd")
def candidate_streaks(spark, d):
    return I.candidate_streaks(_hits(spark, d))


@query(f"with {STREAKS} select word, hit_days, total_hits from cd where hit_days >= 2 and total_hits >= 5 and word not in ('click-1', 'view-2')")
def promote_candidates(spark, d):
    bad = spark.createDataFrame([("click-1",), ("view-2",)], "word string")
    return I.promote_candidates(I.candidate_streaks(_hits(spark, d)), bad).select("word", "hit_days", "total_hits")


@query(f"with {STREAKS} select word, total_hits, hit_days from cd order by total_hits desc, hit_days desc, word limit 20")
def candidate_list(spark, d):
    return I.candidate_streaks(_hits(spark, d)).orderBy(F.desc("total_hits"), F.desc("hit_days"), "word").limit(20).select("word", "total_hits", "hit_days")


@query(f"with {STREAKS} select word, case when word = 'click-1' then null else last_hit_at end promoted_at from cd")
def blacklist_word(spark, d):
    c = I.candidate_streaks(_hits(spark, d)).withColumn("promoted_at", F.col("last_hit_at"))
    return I.blacklist_word(c, spark.createDataFrame([], "word string"), "click-1")[0].select("word", "promoted_at")


@query("select * from (values (1, 'info', true), (2, 'quote', false), (9, 'quote', true)) t(id, level, is_active)")
def quote_replacement(spark, d):
    a = spark.createDataFrame([(1, "info", True), (2, "quote", True)], "id int, level string, is_active boolean")
    return I.replace_quote(a, spark.createDataFrame([(9, "quote", True)], "id int, level string, is_active boolean"))


@query("select lower(keyword) k from (values ('Rain'), ('Sun'), ('wind')) t(keyword)")
def subscription_upsert(spark, d):
    subs = spark.createDataFrame([(1, "Rain"), (2, "Sun")], "id int, keyword string")
    wanted = spark.createDataFrame([("RAIN",), (" wind ",), ("Wind",), ("  ",)], "keyword string")
    return I.add_subscription(subs, wanted).select(F.lower("keyword").alias("k"))


@query(f"with {ARTICLES} select source_key from ar where heat_value > 500000 union select source_key from ar where id % 10 = 0 except select source_key from ar where id = 10")
def source_set_algebra(spark, d):
    a = articles(spark, d)
    return a.filter("heat_value > 500000").select("source_key").union(a.filter("id % 10 = 0").select("source_key")).distinct().exceptAll(a.filter("id = 10").select("source_key").distinct())


@query("select event_type, approx from (select event_type, round(avg(value), 6) approx from events group by 1)")
def value_averages(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("approx"))
