"""Relational reads: search, windows, as-of joins, rankings, rollups. Every order has a total tie-break."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.scalar import nearly_equal
from trendloom.operators.graph import checkpoint

#: Rows of a dimension that may be broadcast for a condition that no equi-join expresses.
BROADCAST_ROWS = 10_000
#: Keywords that are looked for in every row; more of them meet the rows by pieces.
FEW_KEYWORDS = 64
#: Keys in one block of ``near_equal_pairs`` (Spark holds all rows that come of one couple of blocks), and pairs that one of its tasks writes out.
BLOCK_ROWS, TASK_PAIRS = 128, 50_000_000
#: Links, of both kinds together, that a task of ``entity_counts`` takes.
LINK_ROWS = 1_000_000


def clamp(value: int, default: int, most: int) -> int:
    """Parameter rule: values outside 1..most become the default."""
    return value if 0 < value <= most else default


def sample_limit(window_hours: int) -> int:
    """Working-set size by window."""
    return 300 if window_hours <= 3 else 800 if window_hours >= 72 else 500


def like_escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def matches(column: str, q: str, raw_pattern: bool = False) -> Column:
    """Case-insensitive containment; with ``raw_pattern`` the wildcards of q count."""
    return F.col(column).ilike(f"%{q}%") if raw_pattern else F.contains(F.lower(column), F.lit(q.lower()))


def search(articles: DataFrame, q: str | None = None, source: str | None = None, raw_pattern: bool = False) -> DataFrame:
    if source:
        articles = articles.filter(F.col("source_key") == source)
    if q:
        articles = articles.filter(matches("title", q, raw_pattern) | matches("content", q, raw_pattern))
    return articles


def page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("published_at"), F.desc("id")).offset(max(0, offset)).limit(clamp(limit, 20, 200))


def page_info(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """total and has_more of a page."""
    return rows.agg(F.count("*").alias("total")).select("total", (F.lit(offset) + F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)) < F.col("total")).alias("has_more"))


def recent(articles: DataFrame, now: Column, hours: int = 24, limit: int = 500) -> DataFrame:
    hours, limit = clamp(hours, 24, 168), clamp(limit, 500, 1000)
    return within(articles, now, hours).orderBy(F.desc_nulls_last("heat_value"), F.desc("published_at"), F.asc("id")).limit(limit)


def within(articles: DataFrame, now: Column, hours: int, ts: str = "published_at") -> DataFrame:
    return articles.filter(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))


def any_term(articles: DataFrame, terms: list[str], now: Column | None = None, since_hours: int = 0, limit: int = 200, most_terms: int = 30) -> DataFrame:
    """Articles with any of the terms in title or content."""
    found = articles if now is None or since_hours <= 0 else within(articles, now, since_hours)
    found = found.filter(reduce(lambda a, b: a | b, [matches(c, t) for t in terms[:most_terms] for c in ("title", "content")], F.lit(False)))
    return found.orderBy(F.desc("published_at"), F.desc("id")).limit(clamp(limit, 200, 500))


def expand_terms(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each term (column term) with all aliases of the label it names (aliases: label, alias); itself where unknown."""
    known = aliases.select(F.lower("alias").alias("_a"), "label").union(aliases.select(F.lower("label"), "label")).distinct()
    named = terms.withColumn("_a", F.lower("term")).join(known, "_a", "left").drop("_a")
    full = aliases.select("label", "alias").union(aliases.select("label", F.col("label"))).distinct()
    return named.join(full, "label", "left").select("term", F.coalesce("alias", "term").alias("expanded")).distinct()


def strong_term(term: str) -> bool:
    """Three Han characters or an ASCII letter."""
    return sum("一" <= c <= "鿿" for c in term) >= 3 or any(c.isascii() and c.isalpha() for c in term)


def drop_weak_content_matches(articles: DataFrame, terms: list[str]) -> DataFrame:
    """If no term is strong, only title matches count."""
    if any(strong_term(t) for t in terms):
        return articles
    return articles.filter(reduce(lambda a, b: a | b, [matches("title", t) for t in terms], F.lit(False)))


def active(announcements: DataFrame, now: Column) -> DataFrame:
    return announcements.filter(F.col("is_active") & (F.col("starts_at") <= now) & (F.col("ends_at").isNull() | (F.col("ends_at") > now))).orderBy(F.desc("priority"), F.desc("id"))


def asof_latest(snapshots: DataFrame, at: Column, key: str = "article_id", value: str = "heat_value", ts: str = "captured_at") -> DataFrame:
    """The value of each key at a time: its latest row not after it, of several the largest. A filter and one partial aggregate."""
    return snapshots.filter(F.col(ts) <= at).groupBy(key).agg(F.max_by(value, F.struct(ts, value)).alias(value))


def _moment(df: DataFrame, column: str) -> Column:
    """A number that never falls as the column's value rises."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "timestamp_ntz":  # no time zone may turn the clock back
        return F.datediff(c, F.lit("1970-01-01")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_micros(c).cast("double") if kind == "timestamp" else F.datediff(c, F.lit("1970-01-01")).cast("double") if kind == "date" else c.cast("double")


#: Steps of time that rows are counted in, at most as many rows in the driver; rows of a slice of time.
STEPS, SLICE_ROWS = 20_000, 1_000_000


def time_slices(sides: list[tuple[DataFrame, str]], slice_rows: int | None = None) -> tuple[DataFrame, list[Column]] | None:
    """Slices of time of about equal numbers of rows: (step, slice), and the step of each side's rows; None without rows."""
    per = slice_rows or SLICE_ROWS
    times = [df.select(_moment(df, ts).alias("_m")) for df, ts in sides]
    both = times[0]
    for t in times[1:]:
        both = both.union(t)
    low, high = both.agg(F.min("_m"), F.max("_m")).first()
    if low is None:
        return None
    width = max((high - low) / STEPS, 1e-9)
    step = lambda m: F.floor((m - low) / width).cast("int")
    counts = both.filter("_m is not null").groupBy(step(F.col("_m")).alias("step")).count().orderBy("step").collect()  # STEPS + 1 rows at most
    rows, held, number = [], 0, 0
    for r in counts:
        if held and held + r["count"] > per:
            held, number = 0, number + 1
        held += r["count"]
        rows.append((r["step"], number))
    return both.sparkSession.createDataFrame(rows, "_step int, _slice int"), [step(_moment(df, ts)) for df, ts in sides]


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, slice_rows: int | None = None) -> DataFrame:
    """For each left row the value of the latest right row of its key that has one, not after it, of several the largest; null without one,
    or where key or time is null.

    Rows lie by key and slice of time, so that a key that holds most rows is many tasks' work. What a slice begins with is
    the last value of the key in an earlier slice: a running maximum over one row for each key and slice."""
    kind = right.schema[value].dataType
    right = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull() & F.col(value).isNotNull())
    sliced = time_slices([(left, left_ts), (right, right_ts)], slice_rows)
    if sliced is None:
        return left.withColumn(f"asof_{value}", F.lit(None).cast(kind))
    slices, (left_step, right_step) = sliced
    slices = F.broadcast(slices)  # STEPS + 1 rows at most
    width = [c for c in left.columns if c != key]
    tagged = left.withColumn("_step", left_step).join(slices, "_step", "left").select(key, "_slice", F.col(left_ts).alias("_t"), F.lit(1).alias("_o"), F.struct(*width).alias("_l"), F.lit(None).cast(kind).alias("_v"))
    other = right.withColumn("_step", right_step).join(slices, "_step").select(key, "_slice", F.col(right_ts).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    ends = other.groupBy(key, "_slice").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_v"))
    asked = left.withColumn("_step", left_step).join(slices, "_step").select(key, "_slice").distinct()
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.join(asked, [key, "_slice"], "full").withColumn("_v", F.last("_v", ignorenulls=True).over(before)).filter(F.col("_v").isNotNull())
    carried = carry.select(key, "_slice", F.lit(None).cast(tagged.schema["_t"].dataType).alias("_t"), F.lit(-1).alias("_o"), F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), "_v")
    w = Window.partitionBy(key, "_slice").orderBy("_t", "_o", "_v").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_t").isNotNull() & F.col(key).isNotNull(), F.last("_v", ignorenulls=True).over(w))
    return tagged.unionByName(other).unionByName(carried).withColumn("_v", known).filter("_o = 1").select(key, "_l.*", F.col("_v").alias(f"asof_{value}"))


def surging(snapshots: DataFrame, now: Column, hours: int = 24, limit: int = 20, min_heat: int = 0) -> DataFrame:
    """Largest rise of heat over the window; items without a snapshot before it are left out."""
    current = asof_latest(snapshots, now).select("article_id", F.col("heat_value").alias("heat")).filter(F.col("heat") >= min_heat)
    base = asof_latest(snapshots, now - F.make_dt_interval(hours=F.lit(hours))).select("article_id", F.col("heat_value").alias("base"))
    rise = current.join(base, "article_id").filter("heat > base").withColumn("delta", F.col("heat") - F.col("base"))
    return rise.orderBy(F.desc("delta"), "article_id").limit(limit)


def window_deltas(current: DataFrame, snapshots: DataFrame, start: Column) -> DataFrame:
    """delta and is_new of each article since the start of a window (current: article_id, heat_value)."""
    base = asof_latest(snapshots, start).select("article_id", F.col("heat_value").alias("_b"))
    return current.join(base, "article_id", "left").select("article_id", "heat_value", (F.col("heat_value") - F.coalesce("_b", F.lit(0))).alias("delta"), F.col("_b").isNull().alias("is_new"))


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is on a list (ids: id), each once, however often the list has it."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def heat_history(snapshots: DataFrame, article_id: int, limit: int = 48) -> DataFrame:
    return snapshots.filter(F.col("article_id") == article_id).orderBy(F.desc("captured_at")).limit(clamp(limit, 48, 500)).orderBy("captured_at")


def distinct_on(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def hotlist(state: DataFrame, top: int = 15) -> DataFrame:
    """Per source: rank, change of rank and is_new of the leading items of the latest batch.

    The latest batch is what was fetched in the minute of the source's last fetch or later. Equal titles count once;
    the previous rank is the place by previous heat among the 2 * top leading items."""
    top = clamp(top, 15, 50)
    latest = state.groupBy("source_key").agg(F.date_trunc("minute", F.max("fetched_at")).cast("timestamp_ntz").alias("cutoff"))
    batch = state.join(latest, "source_key").filter((F.col("heat_value") > 0) & (F.col("fetched_at") >= F.col("cutoff")) & F.col("source_rank").isNotNull())
    one = distinct_on(batch, ["source_key", "title"], ["source_rank", "id"])
    by_rank = Window.partitionBy("source_key").orderBy("source_rank", "id")
    sample = one.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= 2 * top)
    before = Window.partitionBy("source_key").orderBy(F.desc("prev_heat_value"), "rank")
    ranked = sample.withColumn("_p", F.row_number().over(before)).filter(F.col("rank") <= top)
    new = (F.col("prev_heat_value") == 0) | (F.col("_p") > top)
    return ranked.select("source_key", "id", "title", "heat_value", "rank", F.when(new, 0).otherwise(F.col("_p") - F.col("rank")).alias("rank_change"), new.alias("is_new"))


def today_stats(state: DataFrame, now: Column) -> DataFrame:
    """Per source: rows fetched on the day of ``now``, and title and heat of the best rank in the latest minute."""
    today = state.filter(F.col("fetched_at") >= F.date_trunc("day", now).cast("timestamp_ntz"))
    counted = today.groupBy("source_key").agg(F.count("*").alias("n"), F.date_trunc("minute", F.max("fetched_at")).cast("timestamp_ntz").alias("cutoff"))
    lead = today.filter("source_rank is not null").join(counted.select("source_key", "cutoff"), "source_key").filter("fetched_at >= cutoff")
    best = lead.groupBy("source_key").agg(F.min_by(F.struct("title", "heat_value"), F.struct("source_rank", "id")).alias("m"))
    return counted.join(best, "source_key", "left").select("source_key", "n", F.col("m.title").alias("top_title"), F.col("m.heat_value").alias("top_heat"))


def entity_counts(entities: DataFrame, article_entities: DataFrame, article_events: DataFrame, task_rows: int = LINK_ROWS) -> DataFrame:
    """entity_id with its articles and its events. Each side is aggregated before it is joined: no fan-out.

    Links are dealt by article, and the pairs that come of them by pair, over tasks of about ``task_rows`` links, so that what
    a task holds does not grow with the input; compressed sizes, by which Spark would deal them, are far below what tables of distinct rows take."""
    tasks = max((article_entities.count() + article_events.count()) // task_rows, entities.sparkSession.sparkContext.defaultParallelism)
    ae = article_entities.select("article_id", "entity_id").repartition(tasks, "article_id").distinct()
    n_articles = ae.groupBy("entity_id").agg(F.count("*").alias("article_count"))
    av = article_events.select("article_id", "event_id").repartition(tasks, "article_id").distinct()
    pairs = ae.join(av, "article_id").select("entity_id", "event_id").repartition(tasks, "entity_id", "event_id").distinct()
    n_events = pairs.groupBy("entity_id").agg(F.count("*").alias("event_count"))
    out = entities.join(n_articles, "entity_id", "left").join(n_events, "entity_id", "left")
    return out.withColumn("article_count", F.coalesce("article_count", F.lit(0))).withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def entity_articles(articles: DataFrame, article_entities: DataFrame, entity_id: int, limit: int = 20, offset: int = 0) -> DataFrame:
    own = article_entities.filter(F.col("entity_id") == entity_id).select(F.col("article_id").alias("id")).distinct()
    return articles.join(own, "id", "left_semi").orderBy(F.desc("published_at"), F.desc("id")).offset(offset).limit(clamp(limit, 20, 100))


def _pieces(text: Column, sizes: list[int]) -> Column:
    """Distinct pieces of a text of the given lengths (at most 3)."""
    n = F.length(text)

    def of(chars: Column, k: int) -> Column:
        if k == 0:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
        return F.when(n >= k, F.transform(starts, lambda i: F.concat(*(F.get(chars, i + j) for j in range(k))))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(F.concat(*(of(chars, k) for k in sizes)))), F.lit(0))


def keyword_hits(articles: DataFrame, subscriptions: DataFrame, notified: DataFrame | None = None, few: int = FEW_KEYWORDS) -> DataFrame:
    """(subscription_id, keyword, id) where title or content has the keyword and nobody was told yet.

    A few keywords are looked for in every row, broadcast after their number was counted. More of them meet the rows by
    equality: the first three characters of a keyword are among the pieces of a text that has it; only then is it looked for."""
    subs = subscriptions.select(F.col("id").alias("subscription_id"), "keyword", F.lower("keyword").alias("_k")).filter("keyword is not null")
    text = articles.select("id", F.lower("title").alias("_t"), F.lower("content").alias("_c"))
    hit = F.contains("_t", F.col("_k")) | F.contains("_c", F.col("_k"))
    if subs.limit(few + 1).count() <= few:
        found = text.join(F.broadcast(subs), hit)
    else:
        keyed = subs.withColumn("_p", F.substring("_k", 1, 3))
        sizes = sorted(r[0] for r in keyed.select(F.length("_p")).distinct().collect())  # 0 to 3
        both = F.array_union(*(F.coalesce(_pieces(F.col(c), sizes), F.array().cast("array<string>")) for c in ("_t", "_c")))
        maybe = text.select("id", F.explode(both).alias("_p")).join(keyed, "_p").select("id", "subscription_id", "keyword", "_k")
        found = maybe.join(text, "id").filter(hit).distinct()
    found = found.select("subscription_id", "keyword", "id")
    if notified is not None:
        found = found.join(notified.select("subscription_id", F.col("article_id").alias("id")), ["subscription_id", "id"], "left_anti")
    return found


def hits_by_keyword(hits: DataFrame) -> DataFrame:
    return hits.groupBy("keyword").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def places(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 within each value of ``by``, however many rows one value has.

    Rows are range-partitioned by group and order, so that a large group takes many partitions; their numbers there are shifted by
    the counts of the partitions before, of which there is a row for each group and partition."""
    ordered = checkpoint(rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)).withColumn("_m", F.monotonically_increasing_id())
    counted = ordered.withColumn("_part", F.shiftright("_m", 33)).groupBy(by, "_part").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counted.select(F.col(by).alias("_by"), "_part", (before + 1 - F.col("_first")).alias("_shift"))
    numbered = ordered.join(shift, F.col(by).eqNullSafe(F.col("_by")) & (F.shiftright("_m", 33) == F.col("_part")))
    return numbered.withColumn(name, (F.col("_m") + F.col("_shift")).cast("int")).drop("_m", "_by", "_part", "_shift")


def top_badges(articles: DataFrame, top: int = 10) -> DataFrame:
    """Rank by heat within the source, for the leading rows; with the surging flag: new leaders, and rises of a tenth.

    Only the leading rows of each source are ranked, which a limit by source cuts out before the shuffle."""
    w = Window.partitionBy("source_key").orderBy(F.desc("heat_value"), "id")
    lead = articles.select("source_key", "heat_value", "id").withColumn("badge", F.row_number().over(w)).filter(F.col("badge") <= top).select(F.col("id").alias("_id"), F.col("source_key").alias("_s"), "badge")
    ranked = articles.join(lead, (F.col("id") == F.col("_id")) & F.col("source_key").eqNullSafe(F.col("_s")), "left").drop("_id", "_s")
    grown = F.when(F.col("prev_heat_value") <= 0, F.col("badge").isNotNull()).otherwise((F.col("heat_value") - F.col("prev_heat_value")) * 10 >= F.col("prev_heat_value"))
    return ranked.withColumn("surging", grown)


def heat_trend(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy("article_id").orderBy("captured_at", "heat_value")
    before = F.lag("heat_value").over(w)
    return snapshots.withColumn("prev", before).withColumn("trend", F.when(F.col("prev").isNull() | (F.col("prev") == F.col("heat_value")), "flat").when(F.col("heat_value") > F.col("prev"), "up").otherwise("down"))


def time_buckets(articles: DataFrame, now: Column) -> DataFrame:
    """today / yesterday / week / older, and the place by heat within the bucket."""
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    p = F.col("published_at")
    bucket = F.when(p >= day, "today").when(p >= day - F.make_dt_interval(F.lit(1)), "yesterday").when(p >= day - F.make_dt_interval(F.lit(7)), "week").otherwise("older")
    return places(articles.withColumn("bucket", bucket), "bucket", [F.desc("heat_value"), F.asc("id")], "place")


def sparklines(snapshots: DataFrame) -> DataFrame:
    order = F.struct("captured_at", "heat_value")
    first, last = F.min_by("heat_value", order), F.max_by("heat_value", order)
    return snapshots.groupBy("article_id").agg(F.min("heat_value").alias("low"), F.max("heat_value").alias("high"), F.min_by("captured_at", F.struct("heat_value", "captured_at")).alias("low_at"), first.alias("first"), last.alias("last"), F.when(last > first, "up").when(last < first, "down").otherwise("flat").alias("trend"))


def digest(articles: DataFrame, pool: int = 50, top: int = 10, width: int = 80) -> DataFrame:
    """The hottest of the newest, with a shortened text."""
    newest = articles.orderBy(F.desc("published_at"), F.desc("id")).limit(pool)
    hot = newest.orderBy(F.desc("heat_value"), F.desc("published_at"), F.desc("id")).limit(top)
    return hot.withColumn("excerpt", F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("…"))).otherwise(F.col("content")))


def ungrouped(articles: DataFrame, grouped: DataFrame, hours: int, excluded_source: str | None = None) -> DataFrame:
    """Articles within a window before the newest one that belong to no group (grouped: id)."""
    pool = articles if excluded_source is None else articles.filter(F.col("source_key") != excluded_source)
    newest = pool.agg(F.max("published_at").alias("_m"))
    return pool.join(F.broadcast(newest), F.col("published_at") >= F.col("_m") - F.make_dt_interval(hours=F.lit(hours))).drop("_m").join(grouped.select("id"), "id", "left_anti")


def near_words(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, x, y): distinct words x of the left and y of the right (keys, w) that are equal, one within the other, or one edit apart.

    Words meet by equality only. A word that lies within another begins with its head, as long as the largest power of two that fits
    into it; the other's pieces of such lengths meet the heads. Words one edit apart share a key among
    themselves and their forms with one character deleted."""
    on = list(keys)
    size = F.length("w")
    a, b = (d.select(*on, "w").filter(size > 0).distinct() for d in (left, right))
    power = F.pow(F.lit(2), F.floor(F.log2(size))).cast("int")
    lengths = F.transform(F.sequence(F.lit(0), F.floor(F.log2(size)).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("w", i, n))))
    forms = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, size)))

    def within(long: DataFrame, short: DataFrame, names: tuple[str, str]) -> DataFrame:
        heads = short.select(*on, F.col("w").alias(names[1]), F.substring("w", F.lit(1), power).alias("_key"))
        return long.select(*on, F.col("w").alias(names[0]), F.explode(F.array_distinct(pieces)).alias("_key")).join(heads, [*on, "_key"]).filter(F.contains(names[0], names[1])).select(*on, "x", "y")

    edits = lambda d, name: d.select(*on, F.col("w").alias(name), F.explode(F.array_distinct(F.concat(F.array("w"), forms))).alias("_key"))
    edited = edits(a, "x").join(edits(b, "y"), [*on, "_key"]).select(*on, "x", "y")
    return within(a, b, ("x", "y")).union(within(b, a, ("y", "x"))).union(edited).distinct().filter(nearly_equal(F.col("x"), F.col("y")))


def near_equal_links(words: DataFrame) -> DataFrame:
    """(k, w, links): each row of (k, w) with the number of other rows whose word is nearly equal to its own; rows that share a
    word are counted, never paired."""
    counts = words.filter(F.length("w") > 0).groupBy("w").agg(F.count("*").alias("n"))
    links = near_words(words, words).join(counts.select(F.col("w").alias("y"), "n"), "y").groupBy(F.col("x").alias("w")).agg((F.sum("n") - 1).alias("links"))
    return words.select("k", "w").join(links, "w", "left").select("k", "w", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_equal_pairs(words: DataFrame, block_rows: int = BLOCK_ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b), a < b: pairs of rows (k, w) whose words are equal, one within the other, or one edit apart.

    No all-pairs join: the pieces of a word meet the words by equality, and words one edit apart share a key among
    themselves and their forms with one character deleted. Distinct words are compared, then their rows meet in slices of about
    the square root of ``task_pairs`` keys of a word. Couples of slices are numbered from the largest down and dealt evenly over tasks of
    about ``task_pairs`` rows; each slice is shuffled once for a couple. Within a task they meet by blocks of ``block_rows`` keys, and one couple of blocks is written out at a
    time. The result itself grows with the square of rows that share a word; ``near_equal_links`` counts instead."""
    w = words.select("k", "w").filter(F.length("w") > 0)
    counts = w.groupBy("w").agg(F.count("*").alias("n"))
    distinct = counts.select("w")
    size = F.length("w")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("w", i, n))))
    within = distinct.select(F.col("w").alias("x"), F.explode(F.array_distinct(pieces)).alias("y")).join(distinct.select(F.col("w").alias("y")), "y", "left_semi").select("x", "y")
    forms = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, size)))
    keys = distinct.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), forms))).alias("key"))
    edited = keys.select(F.col("w").alias("x"), "key").join(keys.select(F.col("w").alias("y"), "key"), "key").filter("x < y").select("x", "y")
    near = within.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).union(edited).distinct().filter(nearly_equal(F.col("x"), F.col("y")))
    slice_rows = max(1, math.isqrt(task_pairs))
    slices_of = F.ceil(F.col("n") / slice_rows).cast("int")
    n_of = lambda side: counts.select(F.col("w").alias(side), F.col("n").cast("double").alias(f"n_{side}"), slices_of.alias(f"s_{side}"))
    near = checkpoint(near.join(n_of("x"), "x").join(n_of("y"), "y"))
    total = near.agg(F.sum(F.col("n_x") * F.col("n_y"))).first()[0] or 0
    tasks = max(int(total / task_pairs) + 1, w.sparkSession.sparkContext.defaultParallelism)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    couples = near.repartition(w.sparkSession.sparkContext.defaultParallelism).withColumn("i", each("s_x")).withColumn("j", each("s_y")).filter("x <> y or i <= j")
    couples = checkpoint(couples.orderBy(F.desc(F.col("n_x") * F.col("n_y") / (F.col("s_x") * F.col("s_y")))).select("x", "i", "y", "j"))
    couples = couples.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    starts = couples.groupBy("_part").agg(F.count("*").alias("n")).select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    couples = couples.join(F.broadcast(starts), "_part").withColumn("couple", F.col("_start") + F.col("_row")).withColumn("task", F.pmod("couple", F.lit(tasks)).cast("int"))
    slices = w.join(counts, "w").groupBy("w", F.pmod(F.xxhash64("k"), slices_of).alias("slice")).agg(F.collect_list("k").alias("ks"))
    of = lambda x, i, name: couples.withColumnsRenamed({x: "w", i: "slice"}).join(slices, ["w", "slice"]).withColumnRenamed("ks", name).repartitionById(tasks, F.col("task"))
    # A key is in one slice of a word: only within that slice may a couple hold a row twice.
    met = of("x", "i", "ps").select("task", "couple", "ps", ((F.col("w") == F.col("y")) & (F.col("slice") == F.col("j"))).alias("same")).join(of("y", "j", "qs").select("task", "couple", "qs"), ["task", "couple"])
    # Functions with lambdas are not compiled into one loop with what follows, so that Spark holds one couple of blocks only.
    blocks = lambda ks: F.explode(F.transform(F.sequence(F.lit(1), F.size(ks), F.lit(block_rows)), lambda at: F.slice(ks, at, block_rows)))
    met = met.filter((F.size("ps") > 0) & (F.size("qs") > 0)).select("same", "qs", blocks("ps").alias("ps")).select("same", "ps", blocks("qs").alias("qs"))
    pairs = met.select("same", "qs", F.explode("ps").alias("p")).select("same", "p", F.explode("qs").alias("q"))
    return pairs.filter(~F.col("same") & (F.col("p") != F.col("q")) | (F.col("p") < F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
