"""Streams with keyed state and sources of their own as registered queries: each lands its table in time order, runs to the end
of what there is, and reads what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.graph import shared_folder
from trendloom.plans.text_queries import query
from trendloom.sources.adapters import table
from trendloom.sources.schedule import landed_payloads, poll_ticks
from trendloom.sources.schedule import scheduled_polls as polls_of
from trendloom.sources import feeds
from trendloom.streaming import jobs
from trendloom.streaming import keyed_state as K

#: Days of the events that each landed batch holds, and files it lies in.
DAYS, FILES = 7, 8
#: Batches in which landed payload files are read at most, however many there are: each costs its start and its log.
MOST_BATCHES = 30


def _landed(rows: DataFrame, at: str) -> DataFrame:
    """The rows as a stream of batches of DAYS days each, which are landed in order."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    numbered = rows.withColumn("_batch", F.floor(F.datediff(at, F.lit("2024-01-01")) / DAYS).cast("int"))
    for r in sorted(numbered.select("_batch").distinct().collect()):  # a week each
        numbered.filter(F.col("_batch") == r["_batch"]).drop("_batch").repartition(FILES).write.mode("append").parquet(f"{folder}/batch={r['_batch']:06d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", "true").parquet(folder)


def _told(stream: DataFrame) -> DataFrame:
    """What an append stream has written when it has read all there is."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/{uuid.uuid4()}"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _spread_sql(key: str, at: str, low: int, high: int) -> str:
    return f"({low} + ('0x' || substr(md5({key} || ':' || {at}), 1, 8))::bigint % {high - low})"


_PAUSES = " ".join(f"when err = '{e}' then {_spread_sql('k', 'us', lo, hi)}" for e, (lo, hi) in K.PAUSES.items())


@query(f"""with recursive p as (select 'src' || (user_id % 40) k, event_id poll, epoch_us(ts) us, case event_id % 11 when 0 then 'banned' when 1 then 'rate_limited' when 2 then 'cookie_expired' when 3 then 'empty' when 4 then 'timeout' when 5 then 'timeout' when 6 then 'refused' when 7 then 'refused' end err from events),
 o as (select *, row_number() over (partition by k order by us, coalesce(err, ''), poll) n from p),
 r as (select k, cast(0 as bigint) n, cast(null as bigint) poll, cast(0 as bigint) us, true allowed, 0 fails, cast(0 as bigint) till from (select distinct k from o) x
  union all select k, n, poll, us, allowed, fails, case when not allowed then till when err is null then 0 else coalesce(us + {K.SECOND} * nullif(case {_PAUSES} when fails >= {K.PLAIN_FROM} then {K.PLAIN_SECONDS} * least(fails, {K.PLAIN_MOST}) else 0 end, 0), 0) end
   from (select o.*, o.us >= r.till allowed, case when o.us < r.till then r.fails when o.err is null then 0 else r.fails + 1 end fails, r.till from r join o on o.k = r.k and o.n = r.n + 1) s)
 select k source_key, poll, allowed, fails in_a_row, case when till > 0 then make_timestamp(till) end "until" from r where n > 0""")
def backoff_polls(spark, d):
    """Polls of sources with whether they were allowed, failures in a row and the end of the pause: state by source with timers."""
    k = F.col("event_id") % 11
    error = F.when(k == 0, "banned").when(k == 1, "rate_limited").when(k == 2, "cookie_expired").when(k == 3, "empty").when(k.isin(4, 5), "timeout").when(k.isin(6, 7), "refused")
    polls = table(spark, d, "events").select(F.concat(F.lit("src"), F.col("user_id") % 40).alias("source_key"), F.col("event_id").alias("poll"), F.col("ts").cast("timestamp").alias("polled_at"), error.alias("error"))
    told = _told(K.backoff_stream(_landed(polls, "polled_at")))
    return told.filter("event = 'poll'").select("source_key", "poll", "allowed", "in_a_row", F.col("until").cast("timestamp_ntz").alias("until"))


#: A word expires when nobody has seen it for so many hours.
TTL_HOURS = 60


@query(f"""with e as (select 'w' || (user_id % 200) || '/' || event_type word, ts, case when value > 50 then 2 else 1 end hits from events),
 i as (select 'w' || (user_id % 200) || '/click' word, timestamp '2023-12-31' ts, 10 hits from events where event_id % 7 = 0 group by 1),
 a as (select * from e union all select * from i),
 g as (select *, case when ts > lag(ts) over w + interval {TTL_HOURS} hours then 1 else 0 end gap from a window w as (partition by word order by ts)),
 s as (select *, sum(gap) over (partition by word order by ts rows unbounded preceding) n from g),
 f as (select word, n, min(ts) first_seen, max(ts) last_seen, cast(sum(hits) as bigint) hits from s group by 1, 2)
 select word, first_seen, last_seen, hits, last_seen + interval {TTL_HOURS} hours expired_at from f where last_seen + interval {TTL_HOURS} hours <= (select max(ts) from events) - interval 1 day""")
def expired_words(spark, d):
    """Pending words that expired before the last day: each survives the batches between its sightings, some were pending before."""
    e = table(spark, d, "events")
    seen = e.select(F.concat(F.lit("w"), F.col("user_id") % 200, F.lit("/"), "event_type").alias("word"), F.col("ts").cast("timestamp").alias("seen_at"), F.when(F.col("value") > 50, 2).otherwise(1).alias("hits"))
    before = e.filter("event_id % 7 = 0").select(F.concat(F.lit("w"), F.col("user_id") % 200, F.lit("/click")).alias("word")).distinct()
    initial = before.select("word", *(F.lit("2023-12-31 00:00:00").cast("timestamp").alias(c) for c in ("first_seen", "last_seen")), F.lit(10).alias("hits"))
    told = _told(K.pending_words(_landed(seen, "seen_at"), TTL_HOURS * 3600, initial=initial)).filter("event = 'expired'")
    last = e.agg((F.max("ts") - F.make_dt_interval(days=F.lit(1))).alias("_last"))
    plain = told.select("word", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")), "hits", F.col("at").cast("timestamp_ntz").alias("expired_at"))
    return plain.join(F.broadcast(last), F.col("expired_at") <= F.col("_last")).drop("_last")


@query("""with m as (select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-02 23:59:00', interval 1 minute)) due_at),
 t as (select due_at, minute(due_at) % 15 slot from m where hour(due_at) >= 9 or minute(due_at) < 15 or minute(due_at) between 30 and 44)
 select s_suppkey source_key, due_at from t join supplier on (s_suppkey * 3) % 15 = slot""")
def scheduled_polls(spark, d):
    """Two days' polls of the suppliers as sources, from the stream of admitted minutes."""
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_key"), F.col("s_suppkey").alias("index"))
    polls = polls_of(poll_ticks(spark, "2024-01-01T00:00:00", "2024-01-03T00:00:00"), sources)
    return _told(polls).select("source_key", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


@query("select md5(string_agg(p_name, chr(10) order by p_partkey) || chr(10)) digest from part group by p_partkey // 100")
def landed_bodies(spark, d):
    """Digests of the payload files that lie landed in a folder, each file read once as a stream."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    p = table(spark, d, "part").withColumn("batch", F.floor(F.col("p_partkey") / 100))
    files = p.select("batch").distinct().count()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])  # a hundred of a batch
    bodies = p.groupBy("batch").agg(F.array_join(lines, "\n").alias("value"))
    bodies.repartition("batch").write.partitionBy("batch").text(folder)  # a file for each batch
    return _told(landed_payloads(spark, f"{folder}/batch=*", files_per_batch=max(7, -(-files // MOST_BATCHES)))).select(F.md5("body").alias("digest"))


@query("""with p as (select 'src' || (user_id % 20) source_key, ts, case when event_id % 13 = 0 then 403 when event_id % 13 = 1 then 429 when event_id % 13 = 2 then 401 when event_id % 13 = 3 then 500 else 200 end status, event_id % 17 = 5 throttled, event_id % 19 items from events),
 c as (select source_key, ts, case when status = 403 then 'banned' when status = 429 or throttled then 'rate_limited' when status = 401 then 'cookie_expired' when status >= 400 then 'other' when items = 0 then 'empty' end error from p),
 l as (select source_key, max(ts) filter (error is null) last_success, count(*) polls, count(error) failures, count(*) filter (error = 'banned') banned, count(*) filter (error = 'rate_limited') rate_limited from c group by 1)
 select l.*, (select count(*) from c where c.source_key = l.source_key and error is not null and (last_success is null or ts > last_success)) in_a_row from l""")
def poll_outcomes(spark, d):
    """Polls by the class of their answer, and the health of their sources with failures in a row and the last success."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    status = F.when(k % 13 == 0, 403).when(k % 13 == 1, 429).when(k % 13 == 2, 401).when(k % 13 == 3, 500).otherwise(200)
    error = feeds.classify(status, F.when(k % 17 == 5, -412).otherwise(0), k % 19)
    polls = e.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_key"), F.col("ts").alias("polled_at"), error.alias("error"))
    of = lambda x: F.sum((F.coalesce(F.col("error") == x, F.lit(False))).cast("bigint")).alias(x)
    return jobs.source_health(polls).join(polls.groupBy("source_key").agg(of("banned"), of("rate_limited")), "source_key")


@query("select p_partkey id, case when p_partkey % 7 > 0 then 'SUB=s' || p_partkey || case when p_partkey % 3 > 0 then '; SUBP=p' || p_size else '' end end cookie from part")
def visitor_cookies(spark, d):
    """Cookies from the fields of visitor answers, some of which lack one or both."""
    k = F.col("p_partkey")
    sub = F.when(k % 7 > 0, F.concat(F.lit('"sub":"s'), k, F.lit('",'))).otherwise("")
    subp = F.when(k % 3 > 0, F.concat(F.lit('"subp":"p'), F.col("p_size"), F.lit('",'))).otherwise("")
    body = F.concat(F.lit('window.gen_callback && gen_callback({"retcode":20000000,"data":{'), sub, subp, F.lit('"new":true}});'))
    return table(spark, d, "part").select(k.alias("id"), feeds.visitor_cookie(body).alias("cookie"))


@query(f"select event_id, cast({_spread_sql('user_id', 'epoch_us(ts)', 1, 61)} as int) delay from events")
def poll_delays(spark, d):
    """The delay of each poll: from 1 to 60 seconds, the same whenever it is planned again."""
    return table(spark, d, "events").select("event_id", jobs.jitter(F.col("user_id"), F.col("ts")).alias("delay"))
