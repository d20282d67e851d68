"""Folding observations into current state, and the other keyed writes, as batch recomputation.

Every write of the engine is an idempotent fold over an append-only input: the state is what the fold gives, so a lost
executor or a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What ranks observations of a key: time first, then everything else, so that no order is left to chance.
_RANK = ("observed_at", "id", "source_key", "title", "heat_value", "source_rank")


def _state(rows: DataFrame, key: str) -> DataFrame:
    """Columns of the state from ``last`` and ``previous`` observation, first publication and count of each key."""
    last = {c: F.col(f"last.{c}") for c in _RANK}
    return rows.select(
        last["id"].alias("id"), key, last["source_key"].alias("source_key"), last["title"].alias("title"),
        last["heat_value"].alias("heat_value"), F.coalesce("previous.heat_value", F.lit(0)).alias("prev_heat_value"), last["source_rank"].alias("source_rank"),
        "published_at", last["observed_at"].alias("fetched_at"), "n_observations", (F.col("n_observations") == 1).alias("is_new"), "previous",
    )


def fold_observations(obs: DataFrame, key: str = "url") -> DataFrame:
    """Upsert by key: last values, heat before the last, first publication, number of observations, is_new, and the
    observation before the last as ``previous``, which later merges need.

    Observations of one time rank by id, source, title, heat and rank. First publication and count are partial
    aggregates; the two latest observations pass a limit by key before the shuffle, so that a hot key sends two rows a task."""
    row = F.struct(*_RANK)
    counted = obs.groupBy(key).agg(F.min("observed_at").alias("published_at"), F.count("*").alias("n_observations"))
    ranked = obs.select(key, row.alias("_o")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_o")))).filter("_n <= 2")
    two = ranked.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col("_o"))).alias("last"), F.max(F.when(F.col("_n") == 2, F.col("_o"))).alias("previous"))
    return _state(counted.join(two, key), key)


def merge_folded(state: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """One state of two: what ``fold_observations`` gives for all observations of both, in whatever order they came."""

    def side(name: str) -> Column:
        last = F.struct(*(F.col(f"{name}.{'fetched_at' if c == 'observed_at' else c}").alias(c) for c in _RANK))
        return F.array(F.when(F.col(f"{name}.n_observations").isNotNull(), last), F.col(f"{name}.previous"))

    joined = state.alias("s").join(new.alias("b"), F.col(f"s.{key}") == F.col(f"b.{key}"), "full")
    latest = F.sort_array(F.array_compact(F.concat(side("s"), side("b"))), asc=False)
    rows = joined.select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key), F.get(latest, F.lit(0)).alias("last"), F.get(latest, F.lit(1)).alias("previous"),
        F.least("s.published_at", "b.published_at").alias("published_at"), (F.coalesce("s.n_observations", F.lit(0)) + F.coalesce("b.n_observations", F.lit(0))).alias("n_observations"),
    )
    return _state(rows, key)


def merge_state(state: DataFrame, batch: DataFrame, key: str = "url") -> DataFrame:
    """State after one more batch of observations, which may come late: what one fold of everything gives."""
    return merge_folded(state, fold_observations(batch, key), key)


def append_snapshots(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append, keeping the row that was there on a conflict of (article_id, captured_at)."""
    ranked = existing.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return ranked.groupBy("article_id", "captured_at").agg(F.min(F.struct("_o", "heat_value")).alias("m")).select("article_id", F.col("m.heat_value").alias("heat_value"), "captured_at")


def retained(articles: DataFrame, now: Column, days: int = 90, ts: str = "fetched_at") -> DataFrame:
    """Articles that retention keeps."""
    return articles.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children of surviving parents."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def upsert_entities(extracted: DataFrame) -> DataFrame:
    """Distinct (name, type) with a stable number by order of first appearance (columns name, type, seen_at)."""
    first = extracted.groupBy("name", "type").agg(F.min("seen_at").alias("created_at"))
    return first.withColumn("entity_key", F.sha2(F.concat_ws("\0", "type", "name"), 256))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which existing rows win; repeated new rows are one."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def touch_events(links: DataFrame) -> DataFrame:
    """Event rollup by fingerprint: first title, first and last sighting, distinct articles (columns fingerprint, id, title, published_at)."""
    return links.groupBy("fingerprint").agg(
        F.min_by("title", F.struct("published_at", "id")).alias("title"), F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"), F.count_distinct("id").alias("article_count")
    )


def pick_pending(articles: DataFrame, limit: int, max_attempts: int = 3) -> DataFrame:
    """Rows not yet extracted and tried fewer than ``max_attempts`` times, newest first."""
    return articles.filter(F.col("extracted_at").isNull() & (F.col("extract_attempts") < max_attempts)).orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def mark_extracted(articles: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """State after an extraction round (outcome: id, ok): success stamps the row, failure counts an attempt."""
    j = articles.join(outcome, "id", "left")
    return j.withColumn("extracted_at", F.when(F.col("ok"), now).otherwise(F.col("extracted_at"))).withColumn("extract_attempts", F.col("extract_attempts") + F.when(~F.col("ok"), 1).otherwise(0)).drop("ok")


def candidate_streaks(hits: DataFrame, gap_hours: int = 36) -> DataFrame:
    """Candidate words from hits (word, hits, hit_at): total hits, last hit, and hit_days = length of the streak that
    the last hit ends, a gap of more than ``gap_hours`` beginning anew."""
    w = Window.partitionBy("word").orderBy("hit_at")
    broken = F.coalesce(F.col("hit_at") - F.lag("hit_at").over(w) > F.make_dt_interval(hours=F.lit(gap_hours)), F.lit(False)).cast("int")
    streak = hits.withColumn("_s", broken).withColumn("streak", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = streak.groupBy("word", "streak").agg(F.count("*").alias("hit_days"), F.sum("hits").alias("n"), F.max("hit_at").alias("last_hit_at"))
    return per.groupBy("word").agg(F.max_by("hit_days", "streak").alias("hit_days"), F.sum("n").alias("total_hits"), F.max("last_hit_at").alias("last_hit_at"))


def promote_candidates(candidates: DataFrame, blacklist: DataFrame, min_days: int = 2, min_hits: int = 5) -> DataFrame:
    """Words whose streak and hits suffice and that nobody has blacklisted."""
    return candidates.filter((F.col("hit_days") >= min_days) & (F.col("total_hits") >= min_hits)).join(blacklist.select("word").distinct(), "word", "left_anti")


def blacklist_word(candidates: DataFrame, blacklist: DataFrame, word: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with the word no longer promoted, and the blacklist with it."""
    added = blacklist.select("word").union(blacklist.sparkSession.createDataFrame([(word,)], "word string")).distinct()
    return candidates.withColumn("promoted_at", F.when(F.col("word") == word, F.lit(None)).otherwise(F.col("promoted_at"))), added


def replace_quote(announcements: DataFrame, quote: DataFrame) -> DataFrame:
    """Announcements after a new quote: earlier active quotes are switched off."""
    off = announcements.withColumn("is_active", F.when(F.col("level") == "quote", F.lit(False)).otherwise(F.col("is_active")))
    return off.unionByName(quote, allowMissingColumns=True)


def add_subscription(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Subscriptions with the wanted keywords that differ in more than case; blank ones are refused."""
    clean = wanted.withColumn("keyword", F.trim("keyword")).filter("keyword <> ''").withColumn("_k", F.lower("keyword")).dropDuplicates(["_k"])
    fresh = clean.join(subscriptions.select(F.lower("keyword").alias("_k")), "_k", "left_anti").drop("_k")
    return subscriptions.unionByName(fresh, allowMissingColumns=True)


def drop_subscription(subscriptions: DataFrame, ids: DataFrame) -> DataFrame:
    return subscriptions.join(ids, "id", "left_anti")


_METRICS = "struct<variant: string, found: bigint, blacklisted: bigint, precision: double, score: double>"


def evaluation_report(grid: DataFrame, suggestion: DataFrame, articles: DataFrame, blacklist: DataFrame, evaluated_at: Column, window_hours: int) -> DataFrame:
    """One row of an evaluation of parameters: the baseline, all variants in order of score, the best and the suggested one.

    grid: variant, found, blacklisted, precision, score, baseline (a row for each variant); suggestion: best, suggested."""
    metrics = F.struct("variant", "found", "blacklisted", "precision", "score").cast(_METRICS)
    rows = grid.agg(
        F.max(F.when(F.col("baseline"), metrics)).alias("baseline"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("k"), F.col("variant").alias("v"), metrics.alias("m")))), lambda x: x["m"]).alias("candidates"),
    )
    counts = articles.agg(F.count("*").alias("articles_count")).crossJoin(blacklist.agg(F.count("*").alias("blacklist_count")))
    one = rows.crossJoin(counts).crossJoin(suggestion.select(F.col("best").alias("best_variant"), F.col("suggested").alias("suggestion")))  # each a single row
    return one.select(evaluated_at.alias("evaluated_at"), F.lit(window_hours).alias("window_hours"), "articles_count", "blacklist_count", "baseline", "candidates", "best_variant", "suggestion")


def encode_report(report: DataFrame) -> DataFrame:
    """Evaluation reports with their nested columns as JSON text."""
    return report.withColumn("baseline", F.to_json("baseline")).withColumn("candidates", F.to_json("candidates"))


def decode_report(stored: DataFrame) -> DataFrame:
    """Stored reports with their nested columns again; what is no JSON becomes null."""
    return stored.withColumn("baseline", F.from_json("baseline", _METRICS)).withColumn("candidates", F.from_json("candidates", f"array<{_METRICS}>"))


def latest_reports(stored: DataFrame, limit: int = 50) -> DataFrame:
    """The newest stored reports, decoded; limits outside 1 to 200 become 50."""
    return decode_report(stored.orderBy(F.desc("evaluated_at")).limit(limit if 0 < limit <= 200 else 50))
