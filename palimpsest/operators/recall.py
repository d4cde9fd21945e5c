"""Composite retrieval: candidates, several signals, one ranking; token-budgeted context."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.functions.text import ASCII_WORD, coverage, token_estimate, tokens
from palimpsest.operators import lifecycle as lc
from palimpsest.operators import sequence


def recall(memories: DataFrame, query: str, limit: int, *, scopes: list[str] | None = None, kinds: list[str] | None = None, valid_at: datetime | None = None) -> DataFrame:
    """(id, scope_key, lexical, score, rank): the ``limit`` best active memories for a query, 1 / rank as score.

    Scope, kind and validity are filters on the scan; the ranking is by covered query words, newest first, then by id.
    A query without words finds nothing.
    """
    words = sorted(set(re.findall(ASCII_WORD, query.lower())))
    chosen = memories.where("status = 'active'")
    chosen = chosen if scopes is None else chosen.where(F.col("scope_key").isin(scopes))
    chosen = chosen if kinds is None else chosen.where(F.col("kind").isin(kinds))
    chosen = chosen if valid_at is None else lc.valid_at(chosen, valid_at)
    wanted = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    hits = chosen.select("id", "scope_key", "created_at", coverage(wanted, tokens(F.col("content"))).alias("lexical")).where("lexical > 0")
    order = [F.desc("lexical"), F.desc("created_at"), F.col("id")]
    top = hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.select("id", "scope_key", "lexical", (1 / F.col("rank")).alias("score"), "rank")


def signals(hits: DataFrame, use: DataFrame, now: datetime, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> DataFrame:
    """(id, score): hits re-ranked by their text score, the recency of use and stated worth; ``use`` (id, last_at, worth)."""
    hours = sc.seconds_between(F.lit(now).cast("timestamp_ntz"), F.col("last_at")) / 3600
    joined = hits.join(use, "id", "left")
    parts = (F.col("lexical"), F.coalesce(sc.recency_half_life(hours, 24 * 14), F.lit(0.1)), F.coalesce("worth", F.lit(0.5)))
    return joined.select("id", sum((w * p for w, p in zip(weights, parts)), F.lit(0.0)).alias("score"))


def neighbours_in_time(memories: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(id, near_id, step): the memories just before and after each hit in its scope.

    Only scopes with a hit are sorted, and of them only ids and times.
    """
    hit = hits.select("id")
    scopes = memories.join(hit, "id", "left_semi").select(F.col("scope_key").alias("_scope")).distinct()
    memories = memories.select("id", "scope_key", "created_at").join(scopes, F.col("scope_key").eqNullSafe(F.col("_scope")), "left_semi")
    w = Window.partitionBy("scope_key").orderBy("created_at", "id")
    steps = [F.struct(F.lit(-k).alias("step"), F.lag("id", k).over(w).alias("near_id")) for k in range(1, before + 1)]
    steps += [F.struct(F.lit(k).alias("step"), F.lead("id", k).over(w).alias("near_id")) for k in range(1, after + 1)]
    chained = memories.select("id", F.array(*steps).alias("steps")).join(hit, "id", "left_semi")
    return chained.select("id", F.explode("steps").alias("s")).select("id", "s.near_id", "s.step").where("near_id is not null")


def context(ranked: DataFrame, memories: DataFrame, budget: int, key: str = "scope_key") -> DataFrame:
    """(key, id, kept, used): ranked memories put into a token budget per key, best first, skipping what doesn't fit."""
    sized = ranked.join(memories.select("id", token_estimate(F.col("content")).alias("tokens")), "id")
    return sequence.greedy_fill(sized.select(key, "id", "rank", "tokens"), key, ["rank", "id"], "tokens", budget, "id")


def explain(memory_ids: DataFrame, memories: DataFrame, changes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, status, kind, n_changes, first_at, last_at, sources): a receipt for each id, also of ids without a projection."""
    log = changes.join(memory_ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("n_changes"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )
    sources = evidence.distinct().groupBy("memory_id").agg(F.count_distinct("source_memory_id").alias("sources"))
    out = memory_ids.select("id").distinct().join(memories.select("id", "status", "kind"), "id", "left")
    out = out.join(log.withColumnRenamed("memory_id", "id"), "id", "left").join(sources.withColumnRenamed("memory_id", "id"), "id", "left")
    return out.select("id", "status", "kind", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "first_at", "last_at", F.coalesce("sources", F.lit(0)).alias("sources"))
