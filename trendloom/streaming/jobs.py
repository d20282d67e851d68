"""The same folds over landed observation files with Structured Streaming, and the polling policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trendloom.operators.ingest import fold_observations, merge_folded
from trendloom.streaming.keyed_state import PAUSES, PLAIN_FROM, PLAIN_MOST, PLAIN_SECONDS, spread_column


def file_stream(spark: SparkSession, path: str, schema, event_time: str, delay: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """Landed parquet files as a stream whose event time is a timestamp with a watermark."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str | None, str]]:
    """(version, bucket, folder) of the state, from the names of the folders."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for v in fs.globStatus(glob) or []:
        version = int(v.getPath().getName().split("=")[1])
        buckets = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "bucket=*")) or []
        found += [(version, b.getPath().getName().split("=")[1], b.getPath().toString()) for b in buckets]
        if not buckets and fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "*.parquet")):  # a version whose buckets are all replaced is empty
            found.append((version, None, v.getPath().toString()))
    return found


def _newest(folders: list[tuple[int, str | None, str]], before: int | None) -> dict[str | None, tuple[int, str]]:
    newest: dict[str | None, tuple[int, str]] = {}
    for version, bucket, folder in folders:
        if (before is None or version < before) and version > newest.get(bucket, (-1, ""))[0]:
            newest[bucket] = version, folder
    return newest


def read_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame:
    """The state that ``fold_stream`` has written: of each bucket the newest version (of those before a number); no other file is read."""
    newest = _newest(_folders(spark, state_path), before)
    return spark.read.option("basePath", state_path).parquet(*(folder for _, folder in newest.values()))


def fold_stream(
    observations: DataFrame, state_path: str, checkpoint: str, key: str = "url", after: Callable[[DataFrame, int], None] | None = None, buckets: int | None = None, every: str | None = None
) -> StreamingQuery:
    """Each micro-batch is merged into the state table; a version per batch makes repeats harmless.

    With ``buckets`` the state lies in so many buckets of the key's hash, and batch n rewrites those that it touches, as
    version n beside the older ones; without, it writes the whole state as version n. Either depends on versions
    before n and the batch alone, so that a batch that is run again after a failure writes the same once more. Versions
    that newer ones before n replace are deleted first, so that the state holds two versions of a bucket at most.
    ``after`` sees the batch's fold, e.g. to raise alerts. ``every`` is the time between batches; without it the stream
    ends when it has read what there is."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets or 1)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and _exists(spark, state_path):
            drop_old_versions(spark, state_path, number)  # batch n needs the newest versions before n, also when it is run again
        new = fold_observations(batch, key).persist()
        state = read_state(spark, state_path, number).drop("version") if number and _exists(spark, state_path) else None
        if buckets is None:
            merged = new if state is None else merge_folded(state, new, key)
            merged.write.mode("overwrite").parquet(f"{state_path}/version={number}")
        elif touched := [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]:  # at most ``buckets``
            merged = new if state is None else merge_folded(state.filter(F.col("bucket").isin(touched)).drop("bucket"), new, key)
            merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/version={number}")
        if after is not None:
            after(new, number)
        new.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_old_versions(spark: SparkSession, state_path: str, before: int) -> int:
    """Deletes the buckets' versions before a number that a newer one before it replaces; how many it deleted."""
    folders = _folders(spark, state_path)
    newest = _newest(folders, before)
    old = [(b, f) for v, b, f in folders if v < before and v < newest[b][0]]
    for _, folder in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)


def trailing_windows(stream: DataFrame, ts: str, size: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Observations, heat and items by source in sliding windows."""
    return stream.groupBy(F.window(ts, size, slide).alias("w"), "source_key").agg(F.count("*").alias("n"), F.sum("heat_value").alias("heat")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source_key", "n", "heat")


def streak_sessions(hits: DataFrame, ts: str = "hit_at", gap: str = "36 hours") -> DataFrame:
    """Streaks of words as session windows."""
    return hits.groupBy(F.session_window(ts, gap).alias("s"), "word").agg(F.count("*").alias("hit_days"), F.sum("hits").alias("total_hits")).select("word", F.col("s.start").alias("first_hit_at"), "hit_days", "total_hits")


def polls_now(ts: Column) -> Column:
    """Polls run every quarter hour from nine o'clock; before that, only in every other quarter."""
    minute = F.minute(ts)
    return (F.hour(ts) >= 9) | (minute < 15) | ((minute >= 30) & (minute < 45))


def poll_minutes(index: Column, every: int = 15, offset: int = 3) -> Column:
    """The minutes of the hour at which the source with a number is polled: each quarter, later sources some minutes after."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(60 - every), F.lit(every)), lambda m: F.pmod(m + index * offset, F.lit(60))))


def jitter(key: Column, ts: Column, low: int = 1, high: int = 60) -> Column:
    """Seconds of delay, the same whenever the same poll is planned again."""
    return spread_column(key, F.unix_micros(ts.cast("timestamp")), low, high + 1).cast("int")


def backoff_until(key: Column, error: Column, ts: Column, failures: Column) -> Column:
    """When a source may be polled again after an error, its failures in a row counted; null where it need not pause."""
    out = F.when(error.isNotNull() & (failures >= PLAIN_FROM), PLAIN_SECONDS * F.least(failures, F.lit(PLAIN_MOST)))
    for name, (low, high) in PAUSES.items():
        out = F.when(error == name, spread_column(key, F.unix_micros(ts.cast("timestamp")), low, high)).otherwise(out)
    return ts + F.make_dt_interval(secs=out)


def source_health(polls: DataFrame) -> DataFrame:
    """Per source: polls, failures, failures in a row at the end, last success (source_key, polled_at, error)."""
    last = polls.groupBy("source_key").agg(F.max(F.when(F.col("error").isNull(), F.col("polled_at"))).alias("last_success"))
    j = polls.join(last, "source_key")
    tail = F.col("error").isNotNull() & (F.col("last_success").isNull() | (F.col("polled_at") > F.col("last_success")))
    return j.groupBy("source_key").agg(F.count("*").alias("polls"), F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("failures"), F.sum(F.when(tail, 1).otherwise(0)).alias("in_a_row"), F.first("last_success").alias("last_success"))


def alert_sink(path: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that tells every (subscription_id, id) once: batches overwrite their own folder and skip
    what earlier batches told. What was told lies in buckets of a hash, of which a batch reads those its hits fall into.
    A bucket of a batch is one file, however many tasks the batch has."""

    def write(hits: DataFrame, number: int) -> None:
        spark = hits.sparkSession
        fresh = hits.select("subscription_id", "id").dropDuplicates().withColumn("bucket", F.pmod(F.xxhash64("subscription_id", "id"), F.lit(buckets)).cast("int")).persist()
        new = fresh
        if number and _exists(spark, path):
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
            told = spark.read.schema("subscription_id bigint, id bigint, batch int, bucket int").parquet(path).filter((F.col("batch") < number) & F.col("bucket").isin(touched))
            new = fresh.join(told.select("bucket", "subscription_id", "id"), ["bucket", "subscription_id", "id"], "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        fresh.unpersist()

    return write
