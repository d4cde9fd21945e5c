"""Bitemporal views derived from the change log and the projection of memories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpoint


def within(instant: Column, start: Column, end: Column) -> Column:
    """Half-open interval; a null end is open."""
    return (start.isNull() | (start <= instant)) & (end.isNull() | (instant < end))


def instant(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def lifecycle(changes: DataFrame) -> DataFrame:
    """(memory_id, status, known_from, known_to, event_id): what status each memory had when, by effective changes.

    ``changes`` as made by ``replay.memory_changes``. A change that confirms the status it meets opens no new interval.
    """
    order = Window.partitionBy("memory_id").orderBy("occurred_at", "arrival", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("kind") == "remembered").over(before), F.lit(False))
    life = (F.col("kind") == "remembered") | ((F.col("kind") == "restored") & F.col("known"))
    step = changes.withColumn("known", known).withColumn("life", life)
    alive = F.coalesce(F.last(F.when(F.col("life"), True).when(F.col("kind") == "forgotten", False), ignorenulls=True).over(before), F.lit(False))
    step = step.withColumn("alive", alive)
    status = F.when(F.col("life"), "active").when(F.col("alive") & F.col("kind").isin("superseded", "contradicted", "forgotten"), F.col("kind"))
    step = step.withColumn("status", status).where("status is not null")
    changed = step.withColumn("last", F.lag("status").over(order)).where("last is null or last <> status")
    return changed.select("memory_id", "status", F.col("occurred_at").alias("known_from"), F.lead("occurred_at").over(order).alias("known_to"), F.col("id").alias("event_id"))


def known_at(intervals: DataFrame, at: datetime) -> DataFrame:
    """Status of every memory as it was known at an instant."""
    return intervals.where(within(instant(at), F.col("known_from"), F.col("known_to"))).select("memory_id", "status", "event_id")


def valid_at(memories: DataFrame, at: datetime) -> DataFrame:
    """Memories valid at an instant; without bounds they always are."""
    return memories.where(within(instant(at), F.col("valid_from"), F.col("valid_to")))


def scope_listing(memories: DataFrame, status: str, limit: int, kind: str | None = None) -> DataFrame:
    """The newest ``limit`` memories of each scope; ties by id, descending."""
    chosen = memories.where((F.col("status") == status) & (F.lit(True) if kind is None else F.col("kind") == kind))
    rank = F.row_number().over(Window.partitionBy("scope_key").orderBy(F.desc("created_at"), F.desc("id")))
    return chosen.withColumn("pos", rank).where(F.col("pos") <= limit)


def scope_key(*parts: Column) -> Column:
    """Compact JSON list of the scope fields; null and empty differ."""
    return F.to_json(F.array(*parts))


def search_scopes(scopes: DataFrame) -> DataFrame:
    """(scope_key, search_key): a scope is searched in itself and, if it has a session, in its project's scope."""
    own = scopes.select("scope_key", F.col("scope_key").alias("search_key"))
    parent = scopes.where("session_id is not null").select(
        "scope_key", scope_key("tenant_id", "user_id", "agent_id", "project_id", F.lit(None).cast("string")).alias("search_key")
    )
    return own.unionByName(parent).distinct()


def stale_projection(memories: DataFrame, current: DataFrame) -> DataFrame:
    """(memory_id, projected, replayed): rows of the projection that the replayed log contradicts."""
    joined = memories.select(F.col("id").alias("memory_id"), F.col("status").alias("projected")).join(current.select("memory_id", F.col("status").alias("replayed")), "memory_id", "left")
    return joined.where(F.coalesce("replayed", F.lit("forgotten")) != F.col("projected")).select("memory_id", "projected", F.coalesce("replayed", F.lit("forgotten")).alias("replayed"))


def orphans(edges: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Edges whose end is missing."""
    return edges.join(table.select(F.col(key).alias(column)), column, "left_anti")


def lineage(evidence: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """(memory_id, source_memory_id, depth): every direct and indirect source at its shortest distance.

    Breadth first, one join a level; only new pairs go on, so cycles end and come out once (a memory may be its own source).
    Sources farther than ``max_depth`` raise an error.
    """
    edges = evidence.select("memory_id", "source_memory_id").where("memory_id is not null and source_memory_id is not null").distinct()
    reached = checkpoint(edges.withColumn("depth", F.lit(1)))
    front = reached
    for depth in range(2, max_depth + 2):
        onward = front.select("memory_id", F.col("source_memory_id").alias("via")).join(edges.toDF("via", "source_memory_id"), "via")
        new = onward.select("memory_id", "source_memory_id").distinct().join(reached, ["memory_id", "source_memory_id"], "left_anti")
        front = checkpoint(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"lineage deeper than {max_depth}")
        reached = reached.unionByName(front)
    return reached


def merge_import(existing: DataFrame, incoming: DataFrame, key: str, order: list[str], mode: str = "skip") -> DataFrame:
    """Existing rows with incoming ones: the first by ``order`` of each key; an existing key is kept, overwritten or, with
    ``merge``, filled where it is null. Rows without a key are refused."""
    row = F.struct(*incoming.columns)
    # the minimum is pre-aggregated, so a key that comes a million times costs one row a task
    fresh = incoming.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    if mode == "skip":
        return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"))
    if mode == "overwrite":
        return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    others = [c for c in existing.columns if c != key]
    both = existing.alias("e").join(fresh.alias("n"), key, "full")
    return both.select(key, *[F.coalesce(f"e.{c}", f"n.{c}").alias(c) for c in others])


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last writer wins: of each key the row that comes last by ``order`` (nulls first).

    The maximum is pre-aggregated before the shuffle, so a key with a third of all rows costs one row a task.
    """
    row = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(key, "_row.*")
