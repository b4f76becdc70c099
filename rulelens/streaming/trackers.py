"""Ordered keyed state as streams: entities carried from turn to turn, and event-time windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACK = "user_id long, n_events long, n_types long, last_type string, total double"


def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts, distinct types and the latest type of one key; state is a few numbers however many rows it has seen."""
    n, total, last, types = state.get if state.exists else (0, 0.0, (0, -1, ""), "")
    for f in frames:
        n, total = n + len(f), total + float(f["value"].sum())
        top = f.sort_values(["at", "event_id"]).iloc[-1]
        last = max(last, (int(top["at"]), int(top["event_id"]), str(top["event_type"])))
        types = "|".join(sorted({*filter(None, types.split("|")), *f["event_type"]}))
    state.update((n, total, last, types))
    yield pd.DataFrame([(key[0], n, len(types.split("|")), last[2], total)], columns=["user_id", "n_events", "n_types", "last_type", "total"])


def tracked(events: DataFrame) -> DataFrame:
    """Per-user state over a stream of events; a row per user and micro-batch that touched it."""
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    state = "n long, total double, last struct<at: long, id: long, type: string>, types string"
    return rows.groupBy("user_id").applyInPandasWithState(track, TRACK, state, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling event-time windows; rows later than ``late`` are dropped by the stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def s_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch run of the windowed stream: one definition serves both."""
    return windowed(events_table(spark, sf_dir))


S_WINDOWS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def s_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events that are less than an hour apart."""
    timed = events_table(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    s = timed.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


S_SESSIONS = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session"


def s_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's final state, by grouping: what the stream holds once all rows have come."""
    e = events_table(spark, sf_dir)
    return e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_type"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


S_TRACKER = "SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY user_id"

QUERIES = {"s_windows": s_windows, "s_sessions": s_sessions, "s_tracker": s_tracker}
ORACLE = {"s_windows": S_WINDOWS, "s_sessions": S_SESSIONS, "s_tracker": S_TRACKER}
