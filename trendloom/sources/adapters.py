"""The logical relations of the engine on the supplied tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp_ntz")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, heat_value, captured_at: the heat time series."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("article_id"), F.floor(F.col("value") * 10000).cast("bigint").alias("heat_value"), F.col("ts").alias("captured_at"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each poll of an item: url, source_key, title, heat_value, source_rank, observed_at."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u/"), F.col("user_id")).alias("url"),
        F.concat(F.lit("src"), F.col("user_id") % 4).alias("source_key"),
        F.concat(F.lit("item "), F.col("user_id") % 40, F.lit(" "), F.col("event_type")).alias("title"),
        F.floor(F.col("value") * 10000).cast("bigint").alias("heat_value"),
        F.when(F.col("user_id") % 5 > 0, (F.col("user_id") % 50 + 1).cast("int")).alias("source_rank"),
        F.col("ts").alias("observed_at"),
        F.col("user_id").alias("id"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: id, source_key, title, content, heat_value, prev_heat_value, published_at."""
    d = table(spark, sf_dir, "documents")
    heat = F.col("n_chars") * 100
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_key"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("title"),
        F.col("text").alias("content"),
        heat.alias("heat_value"),
        F.expr("(n_chars * 100 * (doc_id % 7)) div 5").alias("prev_heat_value"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((doc_id * 7919) % 43200 as int))").alias("published_at"),
    )


#: The same relations for DuckDB, as common table expressions.
SNAPSHOTS = "sn as (select user_id article_id, cast(floor(value*10000) as bigint) heat_value, ts captured_at from events)"
OBSERVATIONS = (
    "ob as (select 'u/'||user_id url, 'src'||(user_id%4) source_key, 'item '||(user_id%40)||' '||event_type title, cast(floor(value*10000) as bigint) heat_value, "
    "case when user_id%5>0 then cast(user_id%50+1 as int) end source_rank, ts observed_at, user_id id from events)"
)
ARTICLES = (
    "ar as (select doc_id id, source source_key, substr(split_part(text,chr(10),1),1,60) title, text as content, n_chars*100 heat_value, (n_chars*100*(doc_id%7))//5 prev_heat_value, "
    "timestamp '2024-01-01' + to_minutes((doc_id*7919)%43200) published_at from documents)"
)
