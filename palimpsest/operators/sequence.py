"""Operators over ordered rows: windows where SQL windows suffice, ordered folds where the next step depends on a decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, column: str, out: str, outputs: list[str]) -> DataFrame:
    """Rows with ``outputs`` of an ordered fold per key.

    ``step(state, value of column)`` gives the next state and the outputs; ``start()`` the first state. Rows are sorted by
    key and order within partitions and stream through in batches, so only the state of one key is held, however many rows
    the key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            made = []
            for k, v in zip(batch[key], batch[column]):
                k = None if k is None or k != k else k
                if k != last:
                    last, state = k, start()
                state, values = step(state, v)
                made.append(values)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(made, columns=outputs)], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def anchored_clusters(events: DataFrame, key: str, at: str, hours: float) -> DataFrame:
    """(key, at, cluster): a cluster spans ``hours`` from its first row; the first row after that opens the next.

    Rows without a time are left out.
    """
    kind, ts, span = events.schema[key].dataType.simpleString(), events.schema[at].dataType.simpleString(), pd.Timedelta(hours=hours)

    def step(state: tuple, t: pd.Timestamp) -> tuple:
        first, no = state
        if first is None or t - first > span:
            first, no = t, no + 1
        return (first, no), (no,)

    return folded(events.where(F.col(at).isNotNull()).select(key, at), key, [at], lambda: (None, -1), step, at, f"{key} {kind}, {at} {ts}, cluster bigint", ["cluster"])


def cluster_summary(clusters: DataFrame, key: str, at: str, least: int = 3) -> DataFrame:
    """(key, cluster, n, first_at, last_at) of clusters with at least so many rows."""
    return clusters.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).where(F.col("n") >= least)


def linked(events: DataFrame, key: str, order: list[str], node: str) -> DataFrame:
    """Rows with the ids before and after them in their chain."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("previous_id", F.lag(node).over(w)).withColumn("next_id", F.lead(node).over(w))


def broken_links(chain: DataFrame, node: str) -> DataFrame:
    """(node, previous_id): rows whose previous id is missing from the chain."""
    known = chain.select(F.col(node).alias("previous_id")).distinct()
    return chain.where("previous_id is not null").join(known, "previous_id", "left_anti").select(node, "previous_id")


def keep_best(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key in an order; the limit also applies before the shuffle."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= most)


def fixed_window_limit(events: DataFrame, key: str, at: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """(.., window_start, seq, allowed): a request is allowed while its fixed window hasn't had ``limit`` before it."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000 / seconds) * seconds).cast("timestamp_ntz")
    seq = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(at, tie))
    return events.withColumn("window_start", start).withColumn("seq", seq).withColumn("allowed", F.col("seq") <= limit)


def greedy_fill(items: DataFrame, key: str, order: list[str], size: str, budget: int, item: str) -> DataFrame:
    """(key, item, kept, used): items in order fill a budget; one that doesn't fit is skipped and the next is tried.

    Zero-sized and null-sized items always fit. The running total depends on what was
    skipped, so each key is folded in order.
    """
    slim = items.select(key, item, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), *[c for c in order if c not in (key, item, size)])

    def step(used: int, n: int) -> tuple:
        fits = used + n <= budget
        used += n if fits else 0
        return used, (fits, used)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return folded(slim, key, order, lambda: 0, step, "size", f"{out}, kept boolean, used bigint", ["kept", "used"]).select(key, item, "kept", "used")


def heatmap(events: DataFrame, at: str) -> DataFrame:
    """(weekday, hour, n): the whole 7 by 24 grid, zeros included; Monday is 0."""
    spark = events.sparkSession
    grid = spark.range(7 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = events.groupBy(F.weekday(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(F.broadcast(counts), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Left rows with the last right ``value`` at or before their time, by one union and a window instead of a range join."""
    a = left.withColumn("_at", F.col(left_at)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(F.col(key), F.col(right_at).alias("_at"), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = b.unionByName(a, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side", F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_at", "_v", "_side")
