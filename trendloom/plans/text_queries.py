"""Scalar functions, payloads, mining and streams as registered queries, with DuckDB SQL where it can ask the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalar as S
from trendloom.operators import extract as X
from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.operators.graph import checkpoint, shared_folder
from trendloom.sources import feeds
from trendloom.sources.adapters import ARTICLES, AS_OF, OBSERVATIONS, articles, as_of, observations, table
from trendloom.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("with h as (select o_orderkey id, case o_orderkey % 4 when 0 then (o_orderkey % 977)::varchar || ' 万热度' when 1 then (o_orderkey % 90)::varchar || '.5亿' when 2 then o_orderkey::varchar else 'none' end t from orders) select id, coalesce(cast(trunc(try_cast(regexp_extract(t, '^([0-9.]+)', 1) as double) * case when contains(t, '亿') then 1e8 when contains(t, '万') then 1e4 else 1 end) as bigint), 0) heat from h")
def parse_heat(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat((k % 977).cast("string"), F.lit(" 万热度"))).when(k % 4 == 1, F.concat((k % 90).cast("string"), F.lit(".5亿"))).when(k % 4 == 2, k.cast("string")).otherwise(F.lit("none"))
    return table(spark, d, "orders").select(k.alias("id"), S.parse_heat(t).alias("heat"))


@query("select event_id id, case when v >= 1000000000 then printf('%.0f 亿播放', v / 1e8) when v >= 100000000 then printf('%.1f 亿播放', v / 1e8) when v >= 10000 then (v // 10000)::varchar || ' 万播放' else v::varchar || ' 播放' end t from (select event_id, event_id * event_id * 37 v from events)")
def format_heat(spark, d):
    v = F.col("event_id") * F.col("event_id") * 37
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.format_heat(v, "播放").alias("t"))


@query(f"with {ARTICLES} select id, substr(sha1(lower(regexp_replace(title, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))), 1, 16) fp from ar")
def fingerprints(spark, d):
    return articles(spark, d).select("id", S.fingerprint(F.col("title")).alias("fp"))


@query(f"with {ARTICLES}, f as (select *, substr(sha1(lower(regexp_replace(title, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))), 1, 16) fingerprint from ar) select fingerprint, min_by(title, (published_at, id)) title, min(published_at) first_seen_at, max(published_at) last_seen_at, count(distinct id) article_count from f group by 1")
def event_fingerprint_rollup(spark, d):
    from trendloom.operators.ingest import touch_events

    return touch_events(articles(spark, d).withColumn("fingerprint", S.fingerprint(F.col("title"))))


@query("with c as (select c_custkey k, lower(substr(c_name, 16, 3)) w from customer) select a.k a, b.k b from c a join c b on a.k < b.k where a.w <> '' and (a.w = b.w or contains(a.w, b.w) or contains(b.w, a.w) or levenshtein(a.w, b.w) <= 1)")
def near_equal_pairs(spark, d):
    return R.near_equal_pairs(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lower(F.substring("c_name", 16, 3)).alias("w")))


@query(f"with {ARTICLES} select id, case when heat_value > 0 then heat_value + greatest(heat_value - prev_heat_value, 0) else 10000 end score, 3 * contains(lower(title), 'tion')::int + contains(lower(content), 'tion')::int weight, case when heat_value - prev_heat_value > 0 and id % 2 > 0 then 'up' when heat_value - prev_heat_value < 0 then 'down' else 'flat' end momentum from ar")
def article_scores(spark, d):
    a = articles(spark, d)
    return a.select("id", S.article_score(F.col("heat_value"), F.col("prev_heat_value")).alias("score"), S.term_weight(F.col("title"), F.col("content"), F.lit("tion")).alias("weight"), S.momentum(F.col("heat_value") - F.col("prev_heat_value"), F.col("id") % 2).alias("momentum"))


@query(f"with {ARTICLES}, h as (select id, abs(epoch_us(published_at) - epoch_us(timestamp '{AS_OF}')) / 3.6e9 h from ar) select id, case when h <= 1 then 1.0 when h <= 3 then 0.8 when h <= 6 then 0.6 when h <= 12 then 0.4 when h <= 24 then 0.2 else 0.05 end::double p from h")
def time_proximities(spark, d):
    return articles(spark, d).select("id", S.time_proximity(F.col("published_at"), as_of()).alias("p"))


@query("select page_id, pos, href, text from (select page_id, unnest(range(len(l))) pos, unnest(list_transform(l, lambda x: regexp_extract(x, 'href=\"([^\"]*)\"', 1))) href, unnest(list_transform(l, lambda x: regexp_extract(x, '>([^<]*)<', 1))) \"text\" from (select page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') l from pages))")
def html_hot_entries(spark, d):
    return feeds.page_links(table(spark, d, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("select 'src' || (p_size % 3) source_key, p_partkey % 10 + 1 source_rank, count(*) n, cast(sum(p_partkey) as bigint) s from part group by 1, 2")
def json_payloads(spark, d):
    p = table(spark, d, "part").withColumn("batch", F.floor(F.col("p_partkey") / 10)).withColumn("source", F.concat(F.lit("src"), F.col("p_size") % 3))
    target = F.struct(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("u").alias("url"), F.lit(0).alias("created"), F.col("source").alias("excerpt"), F.lit("").alias("author_name")).alias("target"), F.col("p_partkey").cast("string").alias("detail_text"))
    body = p.groupBy("batch").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), target.alias("t")))), lambda x: x["t"]).alias("data"))).alias("body"))
    lists = feeds.nested_list(body.select(F.lit("x").alias("source_key"), "body", F.current_timestamp().alias("fetched_at")))
    first = F.col("heat_value") % 10 + 1
    return lists.select(F.col("content").alias("source_key"), first.alias("source_rank"), "heat_value").groupBy("source_key", "source_rank").agg(F.count("*").alias("n"), F.sum("heat_value").alias("s"))


TOKENS = f"{ARTICLES}, tk as (select id, source_key, unnest(range(len(l))) pos, unnest(l) token from (select id, source_key, regexp_extract_all(lower(title), '[\\p{{L}}]+') l from ar))"
PARAMS = M.DiscoveryParams(2, 2, 2, 8, 16)
SUPPORT = f"""{TOKENS}, w as (select *, lead(token, 1) over (partition by id order by pos) t2, lead(token, 2) over (partition by id order by pos) t3 from tk),
 g as (select id, source_key, 1 n, token gram from w where length(token) between 2 and 8 union all select id, source_key, 2, token || t2 from w where length(token || t2) between 2 and 16 union all select id, source_key, 3, token || t2 || t3 from w where length(token || t2 || t3) between 3 and 16),
 sp as (select gram, cast(n as int) n, count(distinct id) articles, count(distinct source_key) sources from g where gram is not null group by 1, 2)"""


def _support(spark, d):
    return M.ngram_support(M.letter_tokens(articles(spark, d)), PARAMS)


@query(f"with {SUPPORT} select * from sp")
def ngram_support(spark, d):
    return _support(spark, d)


HEAT_WORDS = f"""{SUPPORT}, ac as (select * from sp where articles >= 2 and sources >= 2), mg as (select gram, max(n) n, max(articles) articles, max(sources) sources, max(case when n = 1 then articles end) own from ac group by 1),
 hw as (select gram, n, articles, sources from mg m where not exists (select 1 from mg w where w.n > 1 and w.gram <> m.gram and contains(w.gram, m.gram) and coalesce(m.own, 0) <= w.articles))"""


@query(f"with {HEAT_WORDS} select * from hw")
def heat_words(spark, d):
    return M.heat_words(_support(spark, d), PARAMS)


#: Words of titles with how often they stand there, as a dictionary.
DICTIONARY = "dc as (select token word, count(*) freq from tk group by 1)"


def _dictionary(spark, d):
    return M.letter_tokens(articles(spark, d)).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("freq"))


EXCLUDED = f"""{DICTIONARY}, ex as (select distinct gram word from sp left join dc on dc.word = gram where gram in ('the', 'and') or regexp_matches(gram, '^\\p{{Nd}}+$') or (length(gram) = 2 and freq > 200) or (length(gram) = 3 and freq > 400) or (length(gram) >= 4 and freq > 300))"""


def _excluded(spark, d, support=None):
    return M.excluded_words(_support(spark, d) if support is None else support, _dictionary(spark, d), spark.createDataFrame([("the",), ("and",)], "word string"))


@query(f"with {SUPPORT}, {EXCLUDED} select word from ex")
def excluded_heat_words(spark, d):
    return _excluded(spark, d)


@query(f"""with {SUPPORT}, {EXCLUDED}, ac as (select sp.* from sp left join dc on dc.word = gram where gram not in (select word from ex) and sources >= 2 and articles >= case when n > 1 then 2 when freq is null then case when length(gram) >= 3 then 1 else 2 end when freq <= 500 then 2 when freq <= 2000 then 3 when freq <= 5000 then 4 when freq <= 8000 then 8 else 12 end),
 mg as (select gram, max(n) n, max(articles) articles, max(sources) sources, max(case when n = 1 then articles end) own from ac group by 1)
 select gram, n, articles, sources from mg m where not exists (select 1 from mg w where w.n > 1 and w.gram <> m.gram and contains(w.gram, m.gram) and coalesce(m.own, 0) <= w.articles)""")
def heat_words_discovered(spark, d):
    """Heat words without what the exclusions leave out, each with as many articles as its frequency in the dictionary asks for."""
    support = checkpoint(_support(spark, d))  # counted once, read by the exclusions and the words
    return M.heat_words(support, PARAMS, _excluded(spark, d, support), _dictionary(spark, d))


CANDIDATES = f"{TOKENS}, cd as (select distinct id, case when length(token) > 5 then 'entity' else 'keyword' end kind, token label from tk where length(token) >= 4)"


def _candidates(spark, d) -> DataFrame:
    t = M.letter_tokens(articles(spark, d)).filter("length(token) >= 4")
    return t.select("id", F.when(F.length("token") > 5, "entity").otherwise("keyword").alias("kind"), F.col("token").alias("label"), F.array().cast("array<string>").alias("related")).distinct()


TOPICS = f"""{CANDIDATES}, sc as (select *, case when heat_value > 0 then heat_value + greatest(heat_value - prev_heat_value, 0) else 10000 end score from ar),
 tp as (select kind, label, count(*) "count", cast(sum(score) as bigint) score, count(distinct source_key) n_sources, max_by(id, (heat_value, -id)) sample_id from cd join sc using (id) group by 1, 2 having count(*) >= 2)"""


@query(f"with {TOPICS} select * from tp")
def topic_accumulate(spark, d):
    t = M.accumulate_topics(_candidates(spark, d), articles(spark, d))
    return t.select("kind", "label", "count", "score", F.size("sources").cast("bigint").alias("n_sources"), "sample_id")


@query(f"with {TOPICS}, {DICTIONARY} select kind, label, \"count\", score from tp where label <> 'that' and (label in ('with') or label not in (select word from dc where freq > 600))")
def topic_generic_filter(spark, d):
    """Topics without labels that are common words."""
    one = lambda w: spark.createDataFrame([(w,)], "word string")
    t = M.accumulate_topics(_candidates(spark, d), articles(spark, d))
    return M.drop_generic(t, _dictionary(spark, d), one("that"), one("with")).select("kind", "label", "count", "score")


@query(f"with {TOPICS} select kind, label, \"count\", score from tp t where not exists (select 1 from tp o where o.label <> t.label and contains(t.label, o.label)) order by \"count\" desc, score desc, label, kind limit 30")
def topic_absorb(spark, d):
    t = M.accumulate_topics(_candidates(spark, d), articles(spark, d))
    return M.rank_topics(M.absorb_labels(t), 30).select("kind", "label", "count", "score")


@query(f"with {TOPICS}, c as (select label, source_key, count(*) n from cd join ar using (id) group by 1, 2) select label, string_agg(source_key || ':' || n, ',' order by n desc, source_key) sources from c group by 1 having sum(n) >= 2")
def source_stats(spark, d):
    t = M.accumulate_topics(_candidates(spark, d), articles(spark, d))
    return t.select("label", F.concat_ws(",", F.transform("sources", lambda x: F.concat(x["source_key"], F.lit(":"), x["count"].cast("string")))).alias("sources"))


VECTORS = f"{TOKENS}, tf as (select id, token, count(*) c from tk group by 1, 2), tl as (select id, count(*) t from tk group by 1), df as (select token, count(*) df from tf group by 1), vc as (select tf.id, tf.token, c / t * (ln((select count(distinct id) from tk) / df) + 1) weight, df from tf join tl using (id) join df using (token))"


@query(f"with {VECTORS} select id, token, round(weight, 6) weight from vc")
def title_tfidf(spark, d):
    return M.term_vectors(M.letter_tokens(articles(spark, d))).select("id", "token", F.round("weight", 6).alias("weight"))


#: The hottest articles of the last day, as many as the window's sample has, and their words without hubs.
SAMPLE = f"""{ARTICLES}, sm as (select * from ar where published_at >= timestamp '{AS_OF}' - interval 24 hours order by heat_value desc nulls last, published_at desc, id limit 500),
 tk as (select id, source_key, unnest(range(len(l))) pos, unnest(l) token from (select id, source_key, regexp_extract_all(lower(title), '[\\p{{L}}]+') l from sm)),
 tf as (select id, token, count(*) c from tk group by 1, 2), tl as (select id, count(*) t from tk group by 1), df as (select token, count(*) df from tf group by 1), nn as (select count(distinct id) n from tk),
 vc as (select tf.id, tf.token, c / t * (ln(n / df) + 1) weight, df from tf join tl using (id) join df using (token), nn)"""
PAIRS = f"{SAMPLE}, rt as (select id, token from vc, nn where not (n >= 20 and df > 0.4 * n)), pr as (select x.id a, y.id b, count(*) shared from rt x join rt y using (token) where x.id < y.id group by 1, 2)"


def _sample(spark, d):
    return R.recent(articles(spark, d), as_of(), 24, R.sample_limit(24))


def _pairs(spark, d):
    terms = M.letter_tokens(_sample(spark, d)).select("id", F.col("token").alias("term"))
    return M.candidate_pairs(terms.join(M.hubs(terms).select("term"), "term", "left_anti"))


@query(f"with {PAIRS} select * from pr")
def candidate_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.size("shared").cast("bigint").alias("shared"))


COSINES = f"""{PAIRS}, nm as (select id, sqrt(sum(weight * weight)) norm from vc group by 1), dt as (select a, b, sum(x.weight * y.weight) dot from pr join vc x on x.id = a join vc y on y.id = b and x.token = y.token group by 1, 2),
 cs as (select a, b, dot / (p.norm * q.norm) semantic from dt join nm p on p.id = a join nm q on q.id = b)"""


def _cosines(spark, d):
    return M.cosine(_pairs(spark, d), M.term_vectors(M.letter_tokens(_sample(spark, d))))


@query(f"with {COSINES} select a, b, round(semantic, 6) semantic from cs")
def pair_scores(spark, d):
    return _cosines(spark, d).select("a", "b", F.round("semantic", 6).alias("semantic"))


@query(f"""with recursive {COSINES}, lk as (select a, b from cs where semantic >= 0.2 union select b, a from cs where semantic >= 0.2),
 rc(node, c) as (select distinct a, a from lk union select lk.b, rc.c from rc join lk on lk.a = rc.node) select node, min(c) component from rc group by 1""")
def components(spark, d):
    return M.components(_cosines(spark, d).filter("semantic >= 0.2"))


@query()
def event_groups(spark, d):
    """As ``TrendEngine.events``: the hottest articles of the last day; entities that over 40 % of them have do not link."""
    a = _sample(spark, d)
    t = M.letter_tokens(a)
    entities = t.filter("length(token) > 6").select("id", F.col("token").alias("term"))
    keywords = t.filter("length(token) between 5 and 6").select("id", F.col("token").alias("term"))
    return M.cluster_events(a, entities, keywords, t, 24, 8).drop("ids")


@query(f"with {ARTICLES}, m as (select *, 3 * contains(lower(title), 'heen')::int + contains(lower(content), 'heen')::int weight from ar) select id, weight, title from m where weight > 0 order by weight desc, published_at desc, heat_value desc, id limit 20")
def matching_articles(spark, d):
    return M.matching_articles(articles(spark, d), ["heen"]).select("id", "weight", "title")


@query(f"""with {CANDIDATES}, m as (select *, 3 * contains(lower(title), 'heen')::int + contains(lower(content), 'heen')::int weight, case when heat_value > 0 then heat_value + greatest(heat_value - prev_heat_value, 0) else 10000 end score from ar),
 top as (select * from m where weight > 0 order by weight desc, published_at desc, heat_value desc, id limit 20), tp as (select kind, label, count(*) "count", cast(sum(score) as bigint) score from cd join top using (id) group by 1, 2 having count(*) >= 2)
 select * from tp t where label <> 'heen' and not exists (select 1 from tp o where o.label <> t.label and contains(t.label, o.label)) order by "count" desc, score desc, label, kind limit 8""")
def related_topics(spark, d):
    matched = M.matching_articles(articles(spark, d), ["heen"])
    t = M.absorb_labels(M.accumulate_topics(_candidates(spark, d), matched)).filter("label <> 'heen'")
    return M.rank_topics(t, 8).select("kind", "label", "count", "score")


@query(f"with {ARTICLES}, m as (select * from ar where contains(lower(title), 'heen') or contains(lower(content), 'heen') order by published_at desc, id desc limit 200) select count(*) total_articles, count(distinct source_key) n_sources, max_by(title, (published_at, id)) latest_title, max_by(title, (heat_value, published_at, id)) hottest_title, max(heat_value) hottest_heat, 'flat' momentum from m")
def storyline(spark, d):
    return M.storyline(R.any_term(articles(spark, d), ["heen"])).select("total_articles", "n_sources", "latest_title", "hottest_title", "hottest_heat", "momentum")


GRID = f"""{SUPPORT}, pm as (select 'a' || (2 + i) || 's' || (2 + j) variant, greatest(1, 2 + i) a, greatest(1, 2 + j) s from (values (-1), (0), (1)) x(i), (values (-1), (0), (1)) y(j)),
 ct as (select variant, any_value(a) a, any_value(s) s, count(gram) found, count(case when gram in ('the', 'and') then 1 end) bad from pm left join sp on articles >= a and sources >= s group by 1)"""


@query(f"with {GRID} select variant, found, bad blacklisted, round(case when found = 0 then 0 else (1 - bad / found) * ln(1 + found) end, 6) score from ct")
def param_grid_eval(spark, d):
    bad = spark.createDataFrame([("the",), ("and",)], "word string")
    return M.evaluate_grid(_support(spark, d), bad, PARAMS).select("variant", "found", "blacklisted", F.round("score", 6).alias("score"))


@query(f"""with {GRID}, sc as (select variant, a, s, a = 2 and s = 2 baseline, case when found = 0 then 0 else (1 - bad / found) * ln(1 + found) end score from ct),
 b as (select max_by(variant, (score, baseline, -a, -s)) best, max(score) best_score, max(case when baseline then score end) baseline_score from sc)
 select best, round(best_score, 6) best_score, round(baseline_score, 6) baseline_score, case when best_score > 1.05 * baseline_score then best end suggested from b""")
def grid_suggestion(spark, d):
    bad = spark.createDataFrame([("the",), ("and",)], "word string")
    s = M.suggest_variant(M.evaluate_grid(_support(spark, d), bad, PARAMS))
    return s.select("best", F.round("best_score", 6).alias("best_score"), F.round("baseline_score", 6).alias("baseline_score"), "suggested")


@query()
def extracted_candidates(spark, d):
    return X.explode_candidates(articles(spark, d), X.seed_lexicon()).select("id", "label", "kind")


@query(f"with {ARTICLES} select id, case when length(title) > 30 then substr(title, 1, 30) || '…' else title end short from ar")
def title_excerpts(spark, d):
    return articles(spark, d).select("id", S.excerpt(F.col("title"), 30).alias("short"))


SHARED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""with {ARTICLES}, p as (select id, '<html><head><meta property="og:title" content="' || {SHARED.format('title')} || '"><meta property="og:description" content="' || {SHARED.format("case when length(content) > 100 then substr(content, 1, 100) || '…' else coalesce(content, '') end")} || '"></head><body></body></html>' html from ar)
 select id, length(html) size, md5(html) digest from p""")
def share_pages(spark, d):
    """The share page of every article: its length and digest."""
    return feeds.share_page(articles(spark, d)).select("id", F.length("html").cast("bigint").alias("size"), F.md5("html").alias("digest"))


ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""with {ARTICLES}, nw as (select *, 'https://example.org/a/' || id url from ar order by published_at desc, id desc limit 50),
 it as (select id, published_at, '<item><title>' || {ESCAPED.format('title')} || '</title><link>' || url || '</link><description><![CDATA[' || replace('[' || heat_value || '] ' || coalesce(content, ''), ']]>', ']]]]><![CDATA[>') || ']]></description><guid>' || url || '</guid><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate></item>' item from nw)
 select count(*) items, md5('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>feed</title><link>https://example.org</link>' || string_agg(item, '' order by published_at desc, id desc) || '</channel></rss>') digest from it""")
def rss_feed(spark, d):
    """The feed of the newest articles: its items and the digest of all its text."""
    a = articles(spark, d).withColumn("url", F.concat(F.lit("https://example.org/a/"), F.col("id"))).withColumn("heat", F.col("heat_value"))
    xml = feeds.rss(a, "feed", "https://example.org")
    return xml.select((F.size(F.split("xml", "<item>")) - 1).cast("bigint").alias("items"), F.md5("xml").alias("digest"))


def _landed(spark, d, entry):
    """Payload rows of 25 parts each, with what ``entry`` makes of a part."""
    p = table(spark, d, "part").withColumn("batch", F.floor(F.col("p_partkey") / 25))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))), lambda x: x["e"])
    return p.groupBy("batch").agg(rows.alias("rows")), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("fetched_at")


PLAYS = "case when v >= 1000000000 then printf('%.0f 亿播放', v / 1e8) when v >= 100000000 then printf('%.1f 亿播放', v / 1e8) when v >= 10000 then (v // 10000)::varchar || ' 万播放' else v::varchar || ' 播放' end"


@query(f"select 'https://www.bilibili.com/video/BV' || k url, title, author, {PLAYS} heat, v heat_value, shown published_at from (select p_partkey k, p_name title, p_brand author, p_partkey * p_partkey * 7919 v, timestamp '2024-01-01' + to_seconds(p_partkey * 60) shown from part where p_partkey % 9 > 0)")
def video_payloads(spark, d):
    """Landed video lists; entries without a title and payloads with an error code stay out."""
    k = F.col("p_partkey")
    entry = F.struct(F.concat(F.lit("BV"), k).alias("bvid"), F.when(k % 9 > 0, F.col("p_name")).otherwise("").alias("title"), F.lit("").alias("desc"), (k * 60 + 1704067200).cast("bigint").alias("pubdate"), F.struct(F.col("p_brand").alias("name")).alias("owner"), F.struct((k * k * 7919).cast("bigint").alias("view")).alias("stat"))
    rows, at = _landed(spark, d, entry)
    good = rows.select(F.to_json(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("message"), F.struct(F.col("rows").alias("list")).alias("data"))).alias("body"))
    bad = rows.select(F.to_json(F.struct(F.lit(-412).alias("code"), F.lit("no").alias("message"), F.struct(F.col("rows").alias("list")).alias("data"))).alias("body"))
    got = feeds.video_list(good.union(bad).select(F.lit("video").alias("source_key"), "body", at))
    return got.select("url", "title", "author", "heat", "heat_value", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""with p as (select p_partkey k, p_partkey // 25 batch, substr(md5('w' || p_partkey), 1, 14) word, p_size idx, p_partkey % 4 = 0 pinned from part),
 o as (select *, row_number() over (partition by batch order by not pinned, k) pos from p)
 select 'https://www.baidu.com/s?wd=' || word url, word title, k * 1000 heat_value, cast(row_number() over (partition by batch order by idx, pos) as int) source_rank from o""")
def card_payloads(spark, d):
    """Landed cards: pinned entries come first, equal words of a payload once, ranks by index."""
    k = F.col("p_partkey")
    entry = F.struct(F.col("p_size").alias("index"), F.substring(F.md5(F.concat(F.lit("w"), k).cast("binary")), 1, 14).alias("word"), (k * 1000).cast("string").alias("hotScore"), F.lit("").alias("desc"), F.lit("").alias("rawUrl"), (k % 4 == 0).alias("pinned"))
    rows, at = _landed(spark, d, entry)
    card = F.struct(F.lit("0").alias("updateTime"), F.concat(F.filter("rows", lambda x: ~x["pinned"]), F.filter("rows", lambda x: x["pinned"])).alias("content"), F.filter("rows", lambda x: x["pinned"]).alias("topContent"))
    body = rows.select(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(card).alias("cards")).alias("data"))).alias("body"))
    return feeds.card_list(body.select(F.lit("cards").alias("source_key"), "body", at)).select("url", "title", "heat_value", "source_rank")


@query("""with p as (select p_partkey k, p_partkey // 25 batch, 'no' || p_partkey title, p_size rnk from part where p_partkey % 11 > 0)
 select 'https://www.sogou.com/web?query=' || title url, title, k * 100 heat_value, cast(row_number() over (partition by batch order by rnk, k) as int) source_rank from p""")
def ranked_payloads(spark, d):
    """Landed ranked lists, renumbered from one in each payload; entries without a title stay out."""
    k = F.col("p_partkey")
    title = F.when(k % 11 > 0, F.concat(F.lit("no"), k)).otherwise(" ")
    entry = F.struct(k.cast("string").alias("id"), F.struct(title.alias("title"), F.lit("").alias("flag"), (k * 100).cast("bigint").alias("num"), F.col("p_size").alias("rank")).alias("attributes"))
    rows, at = _landed(spark, d, entry)
    body = rows.select(F.to_json(F.struct(F.col("rows").alias("data"))).alias("body"))
    return feeds.ranked_list(body.select(F.lit("ranked").alias("source_key"), "body", at)).select("url", "title", "heat_value", "source_rank")


@query("select 'https://s.weibo.com/weibo?q=%23t' || p_partkey url, p_name title, case when p_partkey % 5 > 0 then p_partkey * 31 else 0 end heat_value, p_size source_rank from part where p_partkey % 13 > 0")
def html_hot_lists(spark, d):
    """Landed hot-list pages; advertisements stay out, entries without a number have no heat."""
    k = F.col("p_partkey")
    entry = F.concat(F.lit('<td><a href="/weibo?q=%23t'), k, F.lit("&band_rank="), F.col("p_size"), F.when(k % 13 == 0, "&topic_ad=1").otherwise(""), F.lit('" target="_blank"> '), F.col("p_name"), F.lit(" </a> <span> "), F.when(k % 5 > 0, F.concat(F.lit("综艺 "), k * 31)).otherwise(""), F.lit(" </span></td>"))
    rows, at = _landed(spark, d, entry)
    body = rows.select(F.concat(F.lit("<html><table>"), F.array_join("rows", "\n"), F.lit("</table></html>")).alias("body"))
    return feeds.html_list(body.select(F.lit("html").alias("source_key"), "body", at)).select("url", "title", "heat_value", "source_rank")


@query(f"with {ARTICLES}, b as (select case when id % 7 = 0 then 'banned' when id % 7 = 1 then 'rate_limited' end error, source_key, published_at, id from ar) select source_key, count(*) polls, count(error) failures from b group by 1")
def source_health(spark, d):
    k = F.col("id") % 7
    p = articles(spark, d).select("source_key", F.col("published_at").alias("polled_at"), F.when(k == 0, "banned").when(k == 1, "rate_limited").alias("error"))
    return jobs.source_health(p).select("source_key", "polls", "failures")


@query("select event_id, (hour(ts) >= 9 or minute(ts) < 15 or (minute(ts) >= 30 and minute(ts) < 45)) polls from events")
def poll_throttle(spark, d):
    return table(spark, d, "events").select("event_id", jobs.polls_now(F.col("ts")).alias("polls"))


WINDOWS = f"""{OBSERVATIONS}, x as (select *, unnest(range(6)) k from ob), w as (select date_trunc('hour', observed_at) - to_hours(k) window_start, source_key, heat_value from x)
 select window_start, window_start + interval 6 hours window_end, source_key, count(*) n, cast(sum(heat_value) as bigint) heat from w group by 1, 2, 3"""


@query(f"with {WINDOWS}")
def trailing_windows(spark, d):
    w = jobs.trailing_windows(observations(spark, d), "observed_at")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(f"with {WINDOWS}")
def trailing_window_stream(spark, d):
    """The same windows from a stream over the landed files, complete at its end."""
    raw = table(spark, d, "events")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d))
    ob = stream.select(F.concat(F.lit("src"), F.col("user_id") % 4).alias("source_key"), F.floor(F.col("value") * 10000).cast("bigint").alias("heat_value"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    out = _shared_folder(spark)
    q = jobs.trailing_windows(ob, "ts").writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", _shared_folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    last = got.groupBy("window_start", "window_end", "source_key").agg(F.max(F.struct("n", "heat")).alias("m"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "source_key", F.col("m.n").alias("n"), F.col("m.heat").alias("heat"))


@query("with h as (select event_type || '-' || (user_id % 20) word, ts from events), g as (select *, case when ts - lag(ts) over (partition by word order by ts) >= interval 36 hours then 1 else 0 end s from h), k as (select *, sum(s) over (partition by word order by ts rows unbounded preceding) z from g) select word, min(ts) first_hit_at, count(*) hit_days, count(*) total_hits from k group by word, z")
def session_streaks(spark, d):
    h = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 20).alias("word"), F.lit(1).alias("hits"), F.col("ts").alias("hit_at"))
    return jobs.streak_sessions(h).withColumn("first_hit_at", F.col("first_hit_at").cast("timestamp_ntz"))


@query("select 'u/' || user_id url, max_by(cast(floor(value*10000) as bigint), ts) heat_value, count(*) n_observations from events group by 1")
def fold_stream(spark, d):
    """The upsert fold as a stream into a versioned state table."""
    raw = table(spark, d, "events")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d))
    ob = stream.select(F.concat(F.lit("u/"), F.col("user_id")).alias("url"), F.lit("s").alias("source_key"), F.lit("t").alias("title"), F.floor(F.col("value") * 10000).cast("bigint").alias("heat_value"), F.lit(1).alias("source_rank"), F.col("ts").alias("observed_at"), F.col("user_id").alias("id"))
    state = _shared_folder(spark)
    jobs.fold_stream(ob, state, _shared_folder(spark), buckets=16).awaitTermination()
    return jobs.read_state(spark, state).select("url", "heat_value", "n_observations")


def _shared_folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    import uuid

    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def _stream_folder(spark, d: str) -> str:
    """A folder with the events file in it: file streams read folders."""
    out = _shared_folder(spark)
    table(spark, d, "events").write.parquet(out)
    return out
