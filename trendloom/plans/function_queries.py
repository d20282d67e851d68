"""Scalar functions, deltas, discovery state, reports and sinks as registered queries with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendloom.functions import scalar as S
from trendloom.operators import extract as X
from trendloom.operators import ingest as I
from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.operators.graph import shared_folder
from trendloom.plans.text_queries import CANDIDATES, GRID, PARAMS, TOKENS, _candidates, _support, query
from trendloom.sources import feeds
from trendloom.sources.adapters import ARTICLES, AS_OF, SNAPSHOTS, articles, as_of, snapshots, table
from trendloom.streaming import jobs

@query("select event_id id, case when v >= 1000000000 then printf('%.0f亿', round_even(v / 1e8, 0)) when v >= 100000000 then printf('%.1f亿', round_even(v / 1e8, 1)) when v >= 10000 then printf('%.0f万', round_even(v / 1e4, 0)) else v::varchar end t from (select event_id, event_id * event_id * 53 v from events)")
def format_heat_rounded(spark, d):
    """Heat texts without units and gaps, ten thousands rounded."""
    v = F.col("event_id") * F.col("event_id") * 53
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.format_heat(v, wan_rounds=True, gap=False).alias("t"))


@query(f"with {ARTICLES} select id, lower(regexp_replace(title, '\\s+', '', 'g')) t, translate(regexp_replace(title, '[ \\t\\r\\n]+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') a from ar")
def squeezed_titles(spark, d):
    return articles(spark, d).select("id", S.squeeze(F.col("title")).alias("t"), S.squeeze_ascii(F.col("title")).alias("a"))


@query(f"with {ARTICLES}, h as (select id, title, substr(title, 1, 25) head, regexp_replace(substr(title, 1, 25), '\\s+\\S*$', '') words, substr(title, 26, 1) nxt from ar) select id, case when length(title) > 25 then rtrim(case when nxt in ('', ' ') then head when words <> '' then words else head end) || '…' else title end t from h")
def titles_cut_at_word(spark, d):
    return articles(spark, d).select("id", S.cut_at_word(F.col("title")).alias("t"))


@query("select event_id id, case when b <= 0 or s <= 1 then b when s = 2 then b * 2 else b * 4 end boosted from (select event_id, event_id % 7 - 1 b, user_id % 5 s from events)")
def diversity_boosts(spark, d):
    b, s = F.col("event_id") % 7 - 1, F.col("user_id") % 5
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.diversity_boost(b, s).alias("boosted"))


@query(f"with {ARTICLES}, w as (select id, regexp_extract_all(lower(title), '[\\p{{L}}]+') l from ar) select id, least(len(l) / 4.0, 1.0)::double share, round(least(coalesce(list_sum(list_transform(l, lambda x: case when length(x) <= 2 then 1.0 when length(x) = 3 then 1.5 when length(x) = 4 then 2.0 else 2.5 end)), 0) / 9.0, 1.0), 6)::double weighted from w")
def overlap_scores(spark, d):
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}+)"), F.lit(1))
    return articles(spark, d).select("id", S.overlap_ratio(words, 4).alias("share"), F.round(S.weighted_overlap(words, 9.0), 6).alias("weighted"))


@query(f"""with {ARTICLES}, w as (select id, title, lower(regexp_replace(title, '[\\p{{Z}}\\s\\p{{P}}\\p{{S}}]', '', 'g')) bare, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}]+')) l from ar)
 select a.id a, b.id b, a.bare = b.bare or (len(list_intersect(a.l, b.l)) >= 2 and len(list_intersect(a.l, b.l)) * 4 >= least(len(a.l), len(b.l)) * 3) near from w a join w b on b.id = a.id + 1""")
def near_titles(spark, d):
    """Whether an article's title nearly repeats that of the next one."""
    t = articles(spark, d).select("id", "title", F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    a, b = (t.select(F.col("id").alias(x), F.col("title").alias(f"t{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", S.near_duplicate_title(F.col("ta"), F.col("tb"), F.col("wa"), F.col("wb")).alias("near"))


#: Short texts of many kinds, made of part keys.
KIND_SQL = """ks as (select p_partkey id, case p_partkey % 11 when 0 then '中国' || p_partkey when 1 then '华为手机' when 2 then 'A' || p_partkey when 3 then 'NASA' when 4 then p_partkey || '万元'
 when 5 then p_partkey::varchar when 6 then '中A国' when 7 then '3.5亿元' when 8 then '第' || p_partkey || '名' when 9 then '-' || p_partkey || '-' else '约' || p_partkey || '人' end t from part)"""


def _kinds(spark, d):
    k = F.col("p_partkey").cast("string")
    texts = [F.concat(F.lit("中国"), k), F.lit("华为手机"), F.concat(F.lit("A"), k), F.lit("NASA"), F.concat(k, F.lit("万元")), k, F.lit("中A国"), F.lit("3.5亿元"), F.concat(F.lit("第"), k, F.lit("名")), F.concat(F.lit("-"), k, F.lit("-")), F.concat(F.lit("约"), k, F.lit("人"))]
    t = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        t = F.when(F.col("p_partkey") % 11 == i, x).otherwise(t)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))


@query(f"with {KIND_SQL} select id, cast(length(regexp_replace(t, '[^\\p{{Han}}]', '', 'g')) as int) han, regexp_full_match(t, '\\p{{Han}}+') pure_han, regexp_matches(t, '\\p{{Han}}[^\\p{{Han}}]+\\p{{Han}}') split_han, regexp_full_match(t, '\\p{{Nd}}+') digits, regexp_matches(t, '[A-Z]') upper, regexp_full_match(t, '[A-Z]+') all_upper, regexp_matches(t, '[A-Za-z]') letter, regexp_matches(t, '\\p{{L}}') readable from ks")
def text_classes(spark, d):
    t = F.col("t")
    return _kinds(spark, d).select("id", S.han_count(t).alias("han"), S.is_pure_han(t).alias("pure_han"), S.other_between_han(t).alias("split_han"), S.is_digits(t).alias("digits"), S.has_upper(t).alias("upper"), S.is_all_upper(t).alias("all_upper"), S.has_letter(t).alias("letter"), S.has_han_or_letter(t).alias("readable"))


UNITS = S.MEASURE_UNITS


@query(f"with {KIND_SQL}, m as (select *, length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) n from ks) select id, (n * 2 >= length(t) and n > 0 and regexp_matches(t, '[{UNITS}]')) or regexp_matches(t, '^[0-9.]*[万亿千百兆]+[{UNITS}]$') measure from m")
def numeric_measures(spark, d):
    return _kinds(spark, d).select("id", S.is_numeric_measure(F.col("t")).alias("measure"))


@query(f"with {ARTICLES} select id, contains(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ') has_the, contains(lower(title), 'the') has_within from ar")
def words_in_titles(spark, d):
    """Whole words against plain containment."""
    t = F.lower("title")
    return articles(spark, d).select("id", S.contains_word(t, F.lit("the")).alias("has_the"), F.contains(t, F.lit("the")).alias("has_within"))


@query(f"with {ARTICLES} select id, 'https://example.org/s?q=' || replace(replace(replace(url_encode(title), '%20', '+'), '%2A', '*'), '~', '%7E') url from ar")
def search_urls(spark, d):
    return articles(spark, d).select("id", S.search_url("https://example.org/s?q=", F.col("title")).alias("url"))


@query("select c_custkey id, case when c_custkey % 10 = 0 then '***' when c_custkey % 10 = 1 then '***' else substr(c_name, 1, 1) || '***@' || c_custkey || '.example' end mail from customer")
def masked_emails(spark, d):
    """Addresses with a name, without one, and none at all."""
    k = F.col("c_custkey")
    mail = F.when(k % 10 == 0, F.col("c_name")).when(k % 10 == 1, F.concat(F.lit("@"), k)).otherwise(F.concat("c_name", F.lit("@"), k, F.lit(".example")))
    return table(spark, d, "customer").select(k.alias("id"), S.mask_email(mail).alias("mail"))


@query(f"with {ARTICLES}, m as (select id, (epoch_us(timestamp '{AS_OF}') - epoch_us(published_at)) // 60000000 m from ar) select id, case when m < 1 then 'just now' when m < 60 then m || ' min ago' when m < 1440 then (m // 60) || ' h ago' else (m // 1440) || ' d ago' end ago from m")
def relative_times(spark, d):
    return articles(spark, d).select("id", S.relative_time(F.col("published_at"), as_of()).alias("ago"))


@query("select '{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || ',\"p_brand\":\"' || p_brand || '\"}' json from part")
def json_sink_rows(spark, d):
    return feeds.json_rows(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"))


@query("select event_type, quantile_cont(floor(value * 10), 0.5) p50, quantile_cont(floor(value * 10), 0.9) p90, round(avg(value), 6) mean, count(*) n from events group by 1")
def value_percentiles(spark, d):
    """Median, ninth decile and mean of values: quantiles over counts of rounded values, of which there are few."""
    e = table(spark, d, "events").withColumn("v", F.floor(F.col("value") * 10))
    counted = e.groupBy("event_type", "v").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return counted.groupBy("event_type").agg(F.percentile("v", 0.5, F.col("n")).alias("p50"), F.percentile("v", 0.9, F.col("n")).alias("p90"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


DELTAS = f"{SNAPSHOTS}, bs as (select article_id, max_by(heat_value, captured_at) b from sn where captured_at <= timestamp '2024-01-20' group by 1), dl as (select ar.id, heat_value - coalesce(b, 0) delta, b is null is_new from ar left join bs on bs.article_id = ar.id)"


def _deltas(spark, d):
    return R.window_deltas(articles(spark, d).select(F.col("id").alias("article_id"), "heat_value"), snapshots(spark, d), as_of("2024-01-20 00:00:00"))


@query(f"""with {CANDIDATES}, {DELTAS}, sc as (select *, case when heat_value > 0 then heat_value + greatest(heat_value - prev_heat_value, 0) else 10000 end score from ar)
 select kind, label, count(*) "count", cast(sum(delta) as bigint) score_delta, cast(sum(is_new::int) as bigint) count_delta, case when sum(delta) > 0 and sum(is_new::int) > 0 then 'up' when sum(delta) < 0 then 'down' else 'flat' end momentum, max(published_at) latest from cd join sc using (id) join dl using (id) group by 1, 2 having count(*) >= 2 and sum(score) <> 0""")
def topic_deltas(spark, d):
    """Topics with the change of their articles' heat since the window began, and how many are new."""
    return M.accumulate_topics(_candidates(spark, d), articles(spark, d), _deltas(spark, d)).select("kind", "label", "count", "score_delta", "count_delta", "momentum", "latest")


@query(f"""with {ARTICLES}, {DELTAS}, m as (select * from ar where contains(lower(title), 'heen') or contains(lower(content), 'heen') order by published_at desc, id desc limit 200)
 select count(*) total_articles, cast(sum(delta) as bigint) score_delta, cast(sum(is_new::int) as bigint) new_count, case when sum(delta) > 0 and sum(is_new::int) > 0 then 'up' when sum(delta) < 0 then 'down' else 'flat' end momentum from m join dl using (id)""")
def storyline_deltas(spark, d):
    found = R.any_term(articles(spark, d), ["heen"])
    return M.storyline(found, _deltas(spark, d)).select("total_articles", "score_delta", "new_count", "momentum")


@query(f"""with {ARTICLES}, s as (select source_key, count(*) n, min(title) t from ar group by 1), o as (select *, case when length(t) > 22 then substr(t, 1, 22) || '…' else t end x from s)
 select 'Today: ' || sum(n) || ' articles (' || string_agg(source_key || ' ' || n, ', ' order by n desc, source_key) || ')' || chr(10) || string_agg(source_key || ': ' || x, chr(10) order by n desc, source_key) summary from o""")
def daily_summary(spark, d):
    s = articles(spark, d).groupBy("source_key").agg(F.count("*").alias("n"), F.min("title").alias("top_title"))
    return M.daily_summary(s)


@query(f"""with {TOKENS}, wd as (select token word, count(distinct id) h from tk where length(token) = 4 group by 1 having count(distinct id) >= 2),
 cn as (select token word, 1 + length(token) % 2 hit_days, count(*) total_hits, timestamp '2024-01-30' - to_hours(cast(count(*) % 60 as int)) last_hit_at, case when count(*) % 5 = 0 then timestamp '2024-01-02' end promoted_at from tk where length(token) in (4, 5) group by 1),
 j as (select coalesce(cn.word, wd.word) word, hit_days, coalesce(total_hits, 0) total_hits, last_hit_at, promoted_at, h, h is not null and promoted_at is null hit from cn full join wd on cn.word = wd.word),
 n as (select word, case when not hit then hit_days when coalesce(last_hit_at > timestamp '2024-01-31' - interval 36 hours, false) then hit_days + 1 else 1 end hit_days, total_hits + case when hit then h else 0 end total_hits, case when hit then timestamp '2024-01-31' else last_hit_at end last_hit_at, promoted_at from j)
 select word, cast(hit_days as int) hit_days, total_hits, last_hit_at, case when promoted_at is null and word not in ('than', 'that') and hit_days >= 2 and total_hits >= 5 then timestamp '2024-01-31' else promoted_at end promoted_at from n""")
def discovery_round(spark, d):
    """Candidate words after a round of discovered ones: streaks, hits, promotion."""
    t = M.letter_tokens(articles(spark, d))
    words = t.filter("length(token) = 4").groupBy(F.col("token").alias("gram")).agg(F.count_distinct("id").alias("articles")).filter("articles >= 2")
    known = t.filter("length(token) in (4, 5)").groupBy(F.col("token").alias("word")).agg(F.count("*").alias("total_hits"))
    state = known.select("word", (1 + F.length("word") % 2).alias("hit_days"), "total_hits", (as_of("2024-01-30 00:00:00") - F.make_dt_interval(hours=(F.col("total_hits") % 60).cast("int"))).alias("last_hit_at"), F.when(F.col("total_hits") % 5 == 0, as_of("2024-01-02 00:00:00")).alias("promoted_at"))
    bad = spark.createDataFrame([("than",), ("that",)], "word string")
    return M.discovery_round(state, words, bad, as_of()).withColumn("hit_days", F.col("hit_days").cast("int"))


@query(f"with {TOKENS} select distinct id, token term from tk where length(token) >= 5 and token not in ('their', 'other')")
def connector_keywords(spark, d):
    t = M.letter_tokens(articles(spark, d)).select("id", F.col("token").alias("term"))
    return M.connectors(t, 5, ["their", "other"]).distinct()


@query(f"with {TOKENS}, w as (select id, list_distinct(list(token)) l from tk group by 1) select id, cast(len(list_filter(l, lambda x: x in ('the', 'and'))) as int) promoted, cast(len(list_filter(l, lambda x: x not in ('the', 'and', 'of', 'to'))) as int) unknown from w")
def split_terms(spark, d):
    words = M.letter_tokens(articles(spark, d)).groupBy("id").agg(F.collect_set("token").alias("l"))
    promoted, unknown = X.split_terms(F.col("l"), ["the", "and"], ["of", "to"])
    return words.select("id", F.size(promoted).alias("promoted"), F.size(unknown).alias("unknown"))


@query("with h as (select event_type keyword, count(*) n from events group by 1) select string_agg(keyword || ': ' || n || ' new', chr(10) order by keyword) body from h")
def alert_mail_body(spark, d):
    hits = table(spark, d, "events").groupBy(F.col("event_type").alias("keyword")).agg(F.count("*").alias("n"))
    return feeds.mail_body(hits)


@query("""with t as (select p_partkey id, case p_partkey % 4 when 0 then '《作品' || p_partkey || '》主演张小明' when 1 then '北京今日降雨' when 2 then '《上海》与《第' || p_partkey || '回》' else '无' end title from part)
 select id, '作品' || id "name", 'work' "type" from t where id % 4 = 0 union all select id, '张小明', 'person' from t where id % 4 = 0 union all select id, '北京', 'location' from t where id % 4 = 1
 union all select id, '上海', 'work' from t where id % 4 = 2 union all select id, '第' || id || '回', 'work' from t where id % 4 = 2 union all select id, '上海', 'location' from t where id % 4 = 2""")
def rule_entities(spark, d):
    """Works in title marks, actors after role words, places."""
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("《作品"), k, F.lit("》主演张小明"))).when(k % 4 == 1, "北京今日降雨").when(k % 4 == 2, F.concat(F.lit("《上海》与《第"), k, F.lit("回》"))).otherwise("无")
    return X.rule_entities(table(spark, d, "part").select(k.alias("id"), title.alias("title")), ["北京", "上海"])


@query(f"with {ARTICLES} select id, title from ar order by published_at desc, id desc limit 20")
def clamped_page(spark, d):
    """A page whose limit is out of bounds takes the default."""
    return R.page(articles(spark, d), 10_000).select("id", "title")


@query(f"with {ARTICLES} select id from (select * from ar where published_at >= timestamp '{AS_OF}' - interval 72 hours order by heat_value desc nulls last, published_at desc, id limit 800)")
def window_sample(spark, d):
    """The working set of a window of three days."""
    return R.recent(articles(spark, d), as_of(), 72, R.sample_limit(72)).select("id")


@query("select min_delay, max_delay, n from (select count(*) n from events), (select true min_delay, true max_delay)")
def poll_jitter(spark, d):
    """Delays of polls lie between 1 and 60 seconds."""
    delay = jobs.jitter(F.col("user_id"), F.col("ts"))
    return table(spark, d, "events").select(delay.alias("s")).agg((F.min("s") >= 1).alias("min_delay"), (F.max("s") <= 60).alias("max_delay"), F.count("*").alias("n"))


@query("select distinct cast(user_id % 7 as bigint) subscription_id, cast(user_id as bigint) id from events where value > 100")
def alert_stream(spark, d):
    """Hits of a stream are told once, over all its batches."""
    folder, sink = (f"{shared_folder(spark)}/{uuid.uuid4()}" for _ in range(2))
    hits = table(spark, d, "events").filter("value > 100").select((F.col("user_id") % 7).cast("bigint").alias("subscription_id"), F.col("user_id").cast("bigint").alias("id"))
    hits.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.writeStream.foreachBatch(jobs.alert_sink(sink)).option("checkpointLocation", f"{sink}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("subscription_id bigint, id bigint").parquet(sink).select("subscription_id", "id")


#: Headlines with a part's key, and what the rules take from each with the seed dictionary, by hand: works in title marks,
#: honorifics, pairs of countries, visits, affiliations, compounds, product models, aliases, repeated words, topic
#: words, places; and what they refuse: measures, numbered parts, columns of channels, stop words, places before nouns.
HEADLINES = (
    ("新书《流浪{k}》发布会", (("流浪{k}", "entity"),)),
    ("王建国教授访问北京", (("王建国教授", "entity"), ("北京", "entity"))),
    ("中美会谈第{k}轮", (("中国", "entity"), ("美国", "entity"))),
    ("代表团访俄{k}日", (("俄罗斯", "entity"),)),
    ("马斯克谈裁员{k}人", (("特斯拉", "entity"),)),
    ("北京暴雨预警发布", (("暴雨预警", "keyword"), ("北京", "entity"))),
    ("Huawei发布手机{k}", (("华为", "entity"),)),
    ("暴雨 暴雨 门票", (("暴雨", "keyword"), ("门票", "keyword"))),
    ("{k}万元大奖", ()),
    ("第{k}集大结局", ()),
    ("今天最新回应", ()),
    ("旧核调查", ()),
    ("北京女子{k}", ()),
)


def _headline_sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("{k}", "' || k || '") + "'"

    n = len(HEADLINES)
    rows = [f"select k id, {text(label)} label, '{kind}' kind from p where k % {n} = {i}" for i, (_, found) in enumerate(HEADLINES) for label, kind in found]
    return "with p as (select p_partkey k from part) " + " union all ".join(rows)


@query(_headline_sql())
def extracted_headlines(spark, d):
    """Candidates of built headlines with the seed dictionary."""
    k = F.col("p_partkey")
    title = F.lit(None).cast("string")
    for i, (text, _) in enumerate(HEADLINES):
        title = F.when(k % len(HEADLINES) == i, F.replace(F.lit(text), F.lit("{k}"), k.cast("string"))).otherwise(title)
    return X.explode_candidates(table(spark, d, "part").select(k.alias("id"), title.alias("title")), X.seed_lexicon()).select("id", "label", "kind")


@query(f"with {ARTICLES}, t as (select id, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}]+')) l from ar) select id, cast(least(len(list_filter(l, lambda x: length(x) > 5)) + len(list_filter(l, lambda x: length(x) = 4 or length(x) = 5)), 5) as int) n, cast(least(len(list_filter(l, lambda x: length(x) > 5)), 5) as int) entities from t where len(list_filter(l, lambda x: length(x) >= 4)) > 0")
def article_keyword_lists(spark, d):
    """At most five keywords of an article, entities before the others."""
    words = M.letter_tokens(articles(spark, d)).filter("length(token) >= 4").groupBy("id", F.col("token").alias("label")).agg(F.min("pos").alias("pos"))
    c = words.withColumn("kind", F.when(F.length("label") > 5, "entity").otherwise("keyword"))
    return X.article_keywords(c).select("id", F.size("keywords").alias("n"), F.size(F.filter("keywords", lambda x: F.length(x) > 5)).alias("entities"))


@query(f"""with {GRID}, sc as (select variant, a, s, a = 2 and s = 2 baseline, found, bad, case when found = 0 then 0 else (1 - bad / found) * ln(1 + found) end score from ct),
 b as (select max_by(variant, (score, baseline, -a, -s)) best, max(score) best_score, max(case when baseline then score end) baseline_score, max(case when baseline then found end) baseline_found from sc)
 select cast(row_number() over (order by score desc, variant) as int) place, variant, found, bad blacklisted, round(score, 6) score, best best_variant, case when best_score > 1.05 * baseline_score then best end suggestion, baseline_found, (select count(*) from ar) articles_count, 2 blacklist_count from sc, b""")
def evaluation_reports(spark, d):
    """An evaluation stored as JSON text among older ones, and the newest one read back."""
    bad = spark.createDataFrame([("the",), ("and",)], "word string")
    grid = M.evaluate_grid(_support(spark, d), bad, PARAMS)
    report = I.encode_report(I.evaluation_report(grid, M.suggest_variant(grid), articles(spark, d), bad, as_of(), 24))
    old = report.withColumn("evaluated_at", as_of("2024-01-01 00:00:00")).withColumn("candidates", F.lit("no json"))
    newest = I.latest_reports(old.unionByName(report), 1)
    rows = newest.select("*", F.posexplode("candidates").alias("pos", "c"))
    return rows.select((F.col("pos") + 1).alias("place"), "c.variant", "c.found", "c.blacklisted", F.round("c.score", 6).alias("score"), "best_variant", "suggestion", F.col("baseline.found").alias("baseline_found"), "articles_count", F.col("blacklist_count").cast("int").alias("blacklist_count"))


@query(f"with {ARTICLES}, {DELTAS} select id article_id, heat_value, delta, is_new from ar join dl using (id) where id in (select user_id from events where value > 90)")
def deltas_of_ids(spark, d):
    """Deltas of the articles on a list of ids, in which ids repeat."""
    ids = table(spark, d, "events").filter("value > 90").select(F.col("user_id").alias("id"))
    return R.by_ids(_deltas(spark, d), ids, "article_id")


@query("select n_nationkey source, ((n_nationkey * 3) % 15)::int first_minute, 4 polls from nation")
def poll_plan(spark, d):
    """When in the hour each source is polled first, and how often."""
    k = F.col("n_nationkey").cast("int")
    minutes = jobs.poll_minutes(k)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.element_at(minutes, 1).alias("first_minute"), F.size(minutes).alias("polls"))


@query("""with o as (select p_partkey k, 'src' || (p_partkey % 40) source_key, lower(p_name) t from part where p_partkey % 2 = 0), n as (select p_partkey k, 'src' || ((p_partkey - 1) % 40) source_key, lower(p_name) t from part where p_partkey % 2 = 1),
 s as (select n.k, n.source_key, replace(n.t, ' ', '') a, 'old/' || o.k u, replace(o.t, ' ', '') b from n join o on n.source_key = o.source_key),
 h as (select k, source_key, min_by(u, ((a <> b)::int, u)) u from s where a = b or contains(a, b) or contains(b, a) or levenshtein(a, b) <= 1 group by 1, 2)
 select distinct n.source_key, coalesce(u, 'new/' || n.k) url from n left join h on h.k = n.k""")
def urls_of_near_titles(spark, d):
    """New rows of fuzzy sources with the url of a recent row of nearly equal title."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    new = p.filter(k % 2 == 1).select(F.concat(F.lit("new/"), k).alias("url"), F.concat(F.lit("src"), (k - 1) % 40).alias("source_key"), F.lower("p_name").alias("title"))
    recent = p.filter(k % 2 == 0).select(F.concat(F.lit("old/"), k).alias("url"), F.concat(F.lit("src"), k % 40).alias("source_key"), F.lower("p_name").alias("title"))
    return feeds.replace_url_of_near_title(new, recent).select("source_key", "url").distinct()
