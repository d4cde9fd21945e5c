"""Per-period counts by event time, corrected as late records arrive, with a cut-off for lateness (lambda views).

Two layers answer together. The fast layer only increments: a change that arrives adds one to the provisional count of
its period. The batch layer recomputes every open period from the full log, replaces the provisional figure, and
freezes a period once its cut-off has passed; arrivals after that count nowhere. The pieces of both layers are here;
:mod:`palimpsest.streaming.lambda_store` keeps them as tables and runs them.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.changes import first_deliveries

PUBLISH_AFTER = timedelta(hours=1)
CUT_OFF = timedelta(hours=72)


def day_end(day: Column) -> Column:
    return F.date_add(day, 1).cast("timestamp_ntz")


def first_open_day(as_of: datetime, cut_off: timedelta = CUT_OFF) -> date:
    """The earliest day whose cut-off lies after ``as_of``."""
    return (as_of - timedelta(days=1) - cut_off).date() + timedelta(days=1)


def dated_changes(log: DataFrame) -> DataFrame:
    """``tenant_id``, ``day``, ``arrival`` and ``change`` of every change; one without a time belongs to no period."""
    first = first_deliveries(log, "tenant_id", "occurred_at", key="change").where(F.col("occurred_at").isNotNull())
    return first.select("tenant_id", F.to_date("occurred_at").alias("day"), "arrival", "change")


def fast_increments(changes: DataFrame, cut_off: timedelta = CUT_OFF) -> DataFrame:
    """(tenant_id, day, arrival_hour, n): what arriving changes add to their periods.

    Changes past the cut-off add nothing, but leave a row, so their period is known.
    """
    counts = F.col("arrival") < day_end(F.col("day")) + F.lit(cut_off)
    return changes.groupBy("tenant_id", "day", F.date_trunc("hour", "arrival").alias("arrival_hour")).agg(F.count_if(counts).alias("n"))


def published(increments: DataFrame, publish_after: timedelta = PUBLISH_AFTER) -> DataFrame:
    """(tenant_id, day, n): the provisional counts of the fast layer at the hour a period was published."""
    seen = F.col("arrival_hour") < day_end(F.col("day")) + F.lit(publish_after)
    return increments.groupBy("tenant_id", "day").agg(F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n"))


def recomputed(changes: DataFrame, as_of: datetime, cut_off: timedelta = CUT_OFF) -> DataFrame:
    """(tenant_id, day, n, closed): the batch layer's counts of the periods of ``changes`` as of an instant."""
    end = day_end(F.col("day")) + F.lit(cut_off)
    counts = changes.where(F.col("arrival") < F.lit(as_of).cast("timestamp_ntz")).groupBy("tenant_id", "day").agg(F.count_if(F.col("arrival") < end).alias("n"))
    return counts.withColumn("closed", end <= F.lit(as_of).cast("timestamp_ntz"))
