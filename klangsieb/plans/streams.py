"""Queries that run a stream to its present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.operators.metrics import first_terminal
from klangsieb.plans.catalog import query, table
from klangsieb.streaming import streams


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return streams.stream_of(spark, f"{folder}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_unseen_only", "select distinct idx from texts")
def stream_unseen_only(spark: SparkSession, folder: str) -> DataFrame:
    return streams.drain(streams.unseen(streams.stream_of(spark, f"{folder}/texts.parquet").select("idx"), "idx"))


@query("stream_windowed_counts", "select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Beyond the reference: windows on event time with a watermark."""
    out = streams.drain(streams.windowed(_events(spark, folder), "at", "1 day", "1 hour", ["event_type"], F.count("*").alias("n")), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


_ERR = "(select user_id, min(event_id) as stop from events where event_type = 'error' group by user_id)"


@query(
    "stream_lifecycle",
    f"select e.user_id as key, count(*) filter (stop is null or event_id < stop) as steps, any_value(stop is not null) as closed, count(*) filter (event_id > stop) as dropped from events e left join {_ERR} s on s.user_id = e.user_id group by e.user_id",
)
def stream_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.drain(streams.lifecycle(_events(spark, folder), "user_id", "event_id", "event_type", "error"), "update")
    return streams.latest(out, "key", ["steps", "closed", "dropped"])


@query("stream_tail_chunk", "select user_id as key, (count(*) // 16)::bigint as chunks, (count(*) % 16)::bigint as tail from events group by user_id")
def stream_tail_chunk(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.drain(streams.chunked(_events(spark, folder), "user_id", "event_id", "value", 16), "update")
    last = out.where("tail").groupBy("key").agg(F.max_by(F.struct("chunk", "values"), "batch").alias("s"))
    return last.select("key", F.col("s.chunk").alias("chunks"), F.size("s.values").cast("bigint").alias("tail"))


@query("stream_bounded_cache")
def stream_bounded_cache(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.drain(streams.bounded_cache(_events(spark, folder), F.col("user_id") % 4, "user_id", "event_id", 8), "update")
    return streams.latest(out, "grp", ["hits", "misses", "evicted", "held"])


@query("stream_static_join", "select c_mktsegment, count(*) as n from events join customer on c_custkey = user_id group by 1")
def stream_static_join(spark: SparkSession, folder: str) -> DataFrame:
    static = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = streams.drain(_events(spark, folder).select("user_id").join(static, "user_id"))
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("stream_dedup_watermark", "select distinct event_id from events")
def stream_dedup_watermark(spark: SparkSession, folder: str) -> DataFrame:
    return streams.drain(streams.unseen_within(_events(spark, folder).select("event_id", "at"), "event_id", "at", "1 hour")).select("event_id")


@query("stop_prefix", f"select e.event_id, e.user_id from events e left join {_ERR} s on s.user_id = e.user_id where stop is null or event_id < stop")
def stop_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Events before each user's first error."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return first_terminal(e, "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("left_context", "select event_id, coalesce(list(event_id) over (partition by user_id order by event_id rows between 3 preceding and 1 preceding), []) as context from events")
def left_context(spark: SparkSession, folder: str) -> DataFrame:
    return streams.left_context(table(spark, folder, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id", 3).select("event_id", "context")
