"""Streams run to their present end: windows, exactly-once rows, rates; archives and snapshots written and read again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import shared_folder, table
from palimpsest.sources import io
from palimpsest.streaming import events as ev


def finished(stream: DataFrame) -> DataFrame:
    """What a stream has put out when its source is used up, as a table."""
    folder = shared_folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream(s, d, name):
    # as a pattern, the table may be a file or a folder
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _windows(s, d):
    w = finished(ev.windowed_counts(_stream(s, d, "events"), "ts", ["event_type"], "1 hour", "24 hours"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def _rates(s, d):
    r = finished(ev.rate_windows(_stream(s, d, "events"), "ts", "user_id", 21_600, 2, "24 hours"))
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n", F.col("refused").cast("bigint").alias("refused"))


def _changes(s, d):
    keyed = _stream(s, d, "memory_events").where("idempotency_key is not null").select("scope_key", "idempotency_key", "created_at")
    return finished(ev.distinct_changes(keyed, "created_at", ["scope_key", "idempotency_key"], "100000 hours")).select("scope_key", "idempotency_key")


def _archive(s, d):
    folder = shared_folder(s, "archive")
    for _ in range(2):  # a retry replaces its batch
        io.append_days(table(s, d, "events").select("event_id", "event_type", "ts"), folder, "ts", "first")
    back = s.read.schema("event_id bigint, event_type string, day date").json(folder)
    return back.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _snapshots(s, d):
    shots, at = io.Snapshots(s, shared_folder(s, "snapshots")), datetime(2020, 1, 1)
    c = table(s, d, "customer")
    one = shots.create(c, at)
    two = shots.create(c.where("c_nationkey <> 3").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 5, -F.col("c_acctbal")).otherwise(F.col("c_acctbal"))), at)
    return shots.changes(one, two, "c_custkey")


QUERIES = {
    "stream_windowed_counts": _windows,
    "stream_rate_windows": _rates,
    "stream_distinct_changes": _changes,
    "source_day_archive": _archive,
    "source_snapshot_changes": _snapshots,
}

SQL = {
    "stream_windowed_counts": """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL
GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
""",
    "stream_rate_windows": """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, user_id, count(*) AS n, greatest(0, count(*) - 2)::BIGINT AS refused FROM events WHERE ts IS NOT NULL
GROUP BY 1, 2 HAVING window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
""",
    "stream_distinct_changes": "SELECT DISTINCT scope_key, idempotency_key FROM memory_events WHERE idempotency_key IS NOT NULL",
    "source_day_archive": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "source_snapshot_changes": "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'deleted' ELSE 'updated' END AS change FROM customer WHERE c_nationkey = 3 OR (c_nationkey = 5 AND c_acctbal <> 0)",
}
