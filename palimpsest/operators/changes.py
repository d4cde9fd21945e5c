"""Changes behind a log of deliveries: every change may be delivered again, late and under another id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_key() -> Column:
    """Identity of a change: (scope, idempotency key), else the row id.

    A row that has neither is identified by its scope, memory and time, so redeliveries of it still fall together.
    """
    keyed = F.col("idempotency_key").isNotNull()
    bare = ~keyed & F.col("id").isNull()
    return F.struct(
        F.when(keyed | bare, F.col("scope_key")).alias("scope_key"),
        F.when(keyed, F.col("idempotency_key")).alias("idempotency_key"),
        F.when(~keyed, F.col("id")).alias("id"),
        F.when(bare, F.col("memory_id")).alias("memory_id"),
        F.when(bare, F.col("occurred_at")).alias("occurred_at"),
    )


def first_deliveries(log: DataFrame, *carried: str, key: str | None = None) -> DataFrame:
    """One row per change: ``arrival``, ``id`` and the carried columns of the delivery that arrived first.

    ``key`` names a column for the change's identity, a digest of :func:`change_key`.

    Equal arrivals are ordered by row id. Deliveries without ``created_at`` never arrived and are left out. The minimum
    is pre-aggregated before the shuffle, so a change delivered a million times costs one row a map task.
    """
    rest = [c for c in carried if c not in ("id", "created_at")]
    picked = F.min(F.struct(F.col("created_at").alias("arrival"), "id", *rest)).alias("first")
    first = log.where(F.col("created_at").isNotNull()).groupBy(change_key().alias("change")).agg(picked)
    return first.select("first.*", *([F.unhex(F.sha2(F.to_json("change"), 256)).alias(key)] if key else []))
