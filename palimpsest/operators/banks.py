"""Banks of strategies, procedures, episodes, predictions, gaps, goals and scenarios as tables with their updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scoring import half_life
from palimpsest.session import checkpoint

# --- judged strategies ----------------------------------------------------------------------------------------------


def completeness(text: Column) -> Column:
    """By length: fragments little, from 200 characters on growing to 1 at a thousand."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 10, 0.1).when(n < 50, 0.4).when(n < 200, 0.7).otherwise(F.least(F.lit(1.0), 0.7 + 0.3 * (n / 1000)))


def actionability(used: Column, outcome: Column) -> Column:
    return F.when(~F.coalesce(used, F.lit(False)), 0.2).when(outcome == "success", 1.0).when(outcome == "partial", 0.6).when(outcome == "failure", 0.1).otherwise(0.5)


def space_words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f]+"), lambda w: w != ""))


def relevance(query: Column, text: Column, score: Column) -> Column:
    """Share of the query's words that occur and a retrieval score, mixed 6 to 4; the score alone for an empty query."""
    q = space_words(query)
    overlap = F.size(F.array_intersect(q, space_words(text))) / F.size(q)
    return F.when(F.size(q) == 0, score).otherwise(0.6 * overlap + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def quality(relevance: Column, completeness: Column, freshness: Column, actionability: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * relevance + 0.25 * completeness + 0.15 * freshness + 0.2 * actionability))


def posterior(judged: DataFrame, key: str, success: str, strength: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(key, alpha, beta, mean, sd, n): Beta posteriors after weighted successes and failures.

    Weights are summed to six decimals exactly, so the sums don't depend on the order of rows.
    """
    weight = F.col(strength).cast("decimal(18,6)")
    total = lambda hit: F.coalesce(F.sum(F.when(hit, weight)), F.lit(0)).cast("double")
    hit = F.coalesce(F.col(success), F.lit(False))
    g = judged.groupBy(key).agg(
        (F.lit(alpha) + total(hit)).alias("alpha"),
        (F.lit(beta) + total(~hit)).alias("beta"),
        F.count(F.lit(1)).alias("n"),
    )
    return with_moments(g)


def with_moments(bank: DataFrame) -> DataFrame:
    a, b = F.col("alpha"), F.col("beta")
    return bank.withColumn("mean", a / (a + b)).withColumn("sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def decayed_bank(bank: DataFrame, rate: float = 0.01) -> DataFrame:
    """Every strategy a little less sure: the failures' side grows by ``rate``."""
    return with_moments(bank.withColumn("beta", F.col("beta") + rate))


def pruned(bank: DataFrame, least: float, observations: float = 5, sd: float = 0.15) -> DataFrame:
    """The bank without strategies that are surely unreliable: a low mean, enough evidence and a small deviation."""
    evidence = F.col("alpha") + F.col("beta") - 2
    return bank.where(~((F.col("mean") < least) & (evidence > observations) & (F.col("sd") < sd)))


def balance(bank: DataFrame, negative: Column, target: float = 0.4) -> DataFrame:
    """One row: (total, positive, negative, ratio, balanced)."""
    g = bank.agg(F.count(F.lit(1)).alias("total"), F.count_if(negative).alias("negative"))
    ratio = F.when(F.col("total") > 0, F.col("negative") / F.col("total")).otherwise(0.0)
    return g.select("total", (F.col("total") - F.col("negative")).alias("positive"), "negative", ratio.alias("ratio"), (F.abs(ratio - target) < 0.1).alias("balanced"))


# --- procedures -----------------------------------------------------------------------------------------------------


def clamped_sums(steps: DataFrame, key: str, order: list[str], step: str, low: float = 0.0, high: float = 1.0, start: float = 0.5, parts: int = 1) -> DataFrame:
    """(key, value, ups, downs): a value that takes every step in order and never leaves ``low`` .. ``high``.

    A run of clamped steps is itself a clamped step, so runs are composed: each partition of the sorted rows is folded to
    one clamped step a key, and those few are folded in order. A key with a third of all rows is spread over partitions by
    the range of its order, and no list of a key's rows is made.
    """
    import pandas as pd

    kind = steps.schema[key].dataType.simpleString()
    tasks = max(parts, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = steps.where(F.col(step).isNotNull() & F.col(key).isNotNull()).select(key, *[c for c in order if c != key], step)
    laid = laid.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id()).select(key, "part", step)

    def run(batches):
        held: list = []  # one open key: key, part, shift, low, high, ups, downs
        done: list = []
        for batch in batches:
            for k, p, s in zip(batch[key], batch["part"], batch[step]):
                if held and held[0] != k:
                    done.append(tuple(held))
                    held = []
                held = held or [k, p, 0.0, float("-inf"), float("inf"), 0, 0]
                held[2] += s
                held[3], held[4] = (min(high, max(low, x + s)) for x in held[3:5])
                held[5 if s >= 0 else 6] += 1
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=[key, "part", "shift", "lo", "hi", "ups", "downs"])
                done = []
        done += [tuple(held)] if held else []
        yield pd.DataFrame(done, columns=[key, "part", "shift", "lo", "hi", "ups", "downs"])

    runs = laid.mapInPandas(run, f"{key} {kind}, part int, shift double, lo double, hi double, ups bigint, downs bigint")
    ordered = F.array_sort(F.collect_list(F.struct("part", "shift", "lo", "hi")))  # at most one a partition
    value = F.aggregate(ordered, F.lit(float(start)), lambda x, r: F.greatest(r["lo"], F.least(r["hi"], x + r["shift"])))
    return runs.groupBy(key).agg(value.alias("value"), F.sum("ups").alias("ups"), F.sum("downs").alias("downs"))


# --- episodes, predictions, gaps ------------------------------------------------------------------------------------


def episode_strength(outcome: Column, events: Column, reward: Column) -> Column:
    """Lasting strength of a finished episode by its outcome, its events and its reward, at most 1."""
    base = F.when(outcome == "success", 0.3).when(outcome == "partial", 0.15).when(outcome == "failure", 0.1).when(outcome == "in_progress", 0.0).otherwise(0.05)
    return F.least(F.lit(1.0), 0.3 + base + F.least(F.lit(0.2), events * 0.02) + F.when(reward > 0, F.least(F.lit(0.2), reward * 0.1)).otherwise(0.0))


def gap_registry(queries: DataFrame, gap: Column, at: str, confidence: str) -> DataFrame:
    """(gap_id, seen, first_at, last_at, confidence): queries that found too little, one row a gap at its least confidence."""
    g = queries.withColumn("gap_id", gap).where("gap_id is not null").groupBy("gap_id")
    return g.agg(F.count(F.lit(1)).alias("seen"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(confidence).alias("confidence"))


def live_gaps(gaps: DataFrame, now: Column, ttl_seconds: float, filled: Column) -> DataFrame:
    """Gaps that aren't stale: filled ones live for ``ttl_seconds`` after they were last seen, open ones twice as long."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))
    return gaps.where(~((filled & (idle > ttl_seconds * 1e6)) | (idle >= ttl_seconds * 2e6)))


def surprise(expected: Column, actual: Column) -> Column:
    """One less the similarity of the sets of words; 0 for equal texts, 1 if either has no words."""
    a, b = space_words(expected), space_words(actual)
    union = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(expected == actual, 0.0).when(empty, 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def scenario_confidence(confidence: Column, hours: Column, half_life_hours: float) -> Column:
    return half_life(confidence, hours, half_life_hours)


def boosted(hits: DataFrame, scenarios: DataFrame, key: str = "id", factor: float = 0.3) -> DataFrame:
    """(key, score): hits raised by the live scenarios they are sources of; ``scenarios`` (key, confidence), a row a source."""
    boost = scenarios.groupBy(key).agg(F.least(F.lit(1.0), F.sum(F.col("confidence") * 0.5)).alias("boost"))
    return hits.join(boost, key, "left").select(key, (F.col("score") * (1 + F.coalesce("boost", F.lit(0.0)) * factor)).alias("score"))


# --- goals ----------------------------------------------------------------------------------------------------------


def tree(nodes: DataFrame, key: str, parent: str, max_depth: int = 1_000) -> DataFrame:
    """(key, root, depth): the place of every node under a root, a node without a parent; what hangs on a cycle has none.

    One join a level. Trees deeper than ``max_depth`` raise an error.
    """
    links = nodes.where(F.col(key).isNotNull()).select(key, parent)
    front = checkpoint(links.where(F.col(parent).isNull()).select(key, F.col(key).alias("root"), F.lit(0).alias("depth")).distinct())
    reached = front
    for depth in range(1, max_depth + 2):
        front = checkpoint(links.join(front.select(F.col(key).alias(parent), "root"), parent).select(key, "root", F.lit(depth).alias("depth")).distinct())
        if front.isEmpty():
            return reached
        if depth > max_depth:
            raise ValueError(f"tree deeper than {max_depth}")
        reached = reached.unionByName(front)
    return reached


def next_actions(nodes: DataFrame, key: str, parent: str, active: Column, priority: str, limit: int) -> DataFrame:
    """The active leaves of highest priority, then by key."""
    parents = nodes.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct()
    return nodes.where(active).join(parents, key, "left_anti").orderBy(F.desc(priority), key).limit(limit)
