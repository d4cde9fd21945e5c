"""Consolidation of memories: clusters, patterns, context selection, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.graph import connected_components
from palimpsest.operators.replay import numbered


def merge_clusters(nodes: DataFrame, cluster: str, strength: str = "ltp", accesses: str = "accesses", key: str = "id") -> DataFrame:
    """(cluster, representative, members, accesses, strength): the strongest member stands for all; strength grows by a
    twentieth a member, at most to 1."""
    best = F.max(F.struct(F.col(strength), F.col(key)))
    grouped = nodes.groupBy(cluster).agg(best.alias("b"), F.count(F.lit(1)).alias("members"), F.sum(accesses).alias("accesses"))
    grown = F.least(F.lit(1.0), F.col(f"b.{strength}") + 0.05 * F.col("members"))
    return grouped.select(cluster, F.col(f"b.{key}").alias("representative"), "members", "accesses", grown.alias("strength"))


def graph_clusters(edges: DataFrame, a: str, b: str, weight: str, least: float = 0.2, size: int = 3) -> DataFrame:
    """(component, n) of components over edges of at least so much weight, with at least so many nodes."""
    parts = connected_components(edges.where(F.col(weight) >= least), a, b)
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)


def keyword_patterns(texts: DataFrame, key: str, text: str, least: int, top: int = 20, longer_than: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """(term, n): longer words by the number of texts they occur in."""
    words = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    counts = words.where((F.length("term") > longer_than) & ~F.col("term").isin(*stop)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(top)


def json_tag_patterns(texts: DataFrame, column: str, path: str, least: int) -> DataFrame:
    """(tag, n): values of a list inside JSON text by the rows that hold them."""
    tags = F.try_variant_get(F.try_parse_json(column), path, "array<string>")
    return texts.select(F.explode(F.array_distinct(tags)).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def busiest_hour(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, hour, n): the hour of most events of each key, the earliest on ties."""
    counts = events.groupBy(key, F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("b"))
    return best.select(key, (-F.col("b.h")).alias("hour"), F.col("b.n").alias("n"))


def anomalies(metrics: DataFrame, key: str, order: list[str], value: str, last: int = 50, z: float = 3.0, cell: int = 100_000) -> DataFrame:
    """Rows that lie ``z`` sample deviations off the mean of the ``last`` rows before them in their series.

    ``order`` must be total within a series. Rows are numbered over ranges and cut into cells of ``cell``, each with the
    ``last`` rows before it, so a series of any length is spread over tasks.
    """
    laid = numbered(metrics, [key, *order], "_n")
    own = F.floor(F.col("_n") / cell)
    cells = F.when(F.pmod("_n", F.lit(cell)) >= cell - last, F.array(own, own + 1)).otherwise(F.array(own))
    cut = laid.withColumn("_own", own).withColumn("_cell", F.explode(cells))
    w = Window.partitionBy(key, "_cell").orderBy("_n").rowsBetween(-last, -1)
    marked = cut.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w)).where("_own = _cell")
    return marked.where((F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > z * F.col("sd"))).drop("_n", "_own", "_cell")


def z_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows with the z-score of their value within the group, by one pre-aggregated pass and a join."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return rows.join(stats, group).withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0))


def access_levels(permissions: DataFrame, order: dict[str, int], now: Column) -> DataFrame:
    """(agent, item, level): the highest level of the permissions that haven't expired."""
    rank = F.coalesce(*[F.when(F.col("level") == name, n) for name, n in order.items()])
    alive = permissions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return alive.groupBy("agent", "item").agg(F.max(rank).alias("level"))


def schema_errors(events: DataFrame, payload: str, required: dict[str, str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Events with ``errors``: missing fields, fields of another type, values outside an enumeration, broken JSON."""
    v = F.try_parse_json(payload)
    problems = [F.when(F.col(payload).isNotNull() & v.isNull(), F.lit("broken"))]
    for name, kind in required.items():
        raw = F.try_variant_get(v, f"$.{name}", "variant")
        problems.append(F.when(v.isNotNull() & (raw.isNull() | F.is_variant_null(raw)), F.lit(f"{name} is missing")))
        problems.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & F.try_variant_get(v, f"$.{name}", kind).isNull(), F.lit(f"{name} is no {kind}")))
    for name, values in (allowed or {}).items():
        got = F.try_variant_get(v, f"$.{name}", "string")
        problems.append(F.when(got.isNotNull() & ~got.isin(*values), F.lit(f"{name} is unknown")))
    return events.withColumn("errors", F.array_compact(F.array(*problems)))


def pattern_matches(events: DataFrame, patterns: DataFrame, kind: str) -> DataFrame:
    """(pattern, kind, n): events per subscription pattern, ``*`` and ``?`` as in file names; patterns are a small table.

    Event kinds are counted first, so the patterns meet the few kinds and not the events.
    """
    counts = events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    literal = F.regexp_replace("pattern", r"[.+^$(){}|\[\]\\]", r"\\$0")
    as_regex = F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    wanted = patterns.select("pattern", as_regex.alias("_re"))
    return counts.join(F.broadcast(wanted), F.expr(f"{kind} rlike _re")).select("pattern", kind, "n")


def query_parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, part): a query and its parts between conjunctions and question marks, each once."""
    whole = F.trim(F.col(text))
    parts = F.filter(F.transform(F.split(F.lower(whole), r"\s+(?:and|or|but|then)\s+|[?;]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    return texts.select(key, F.posexplode(F.array_distinct(F.concat(F.array(F.lower(whole)), parts))).alias("no", "part")).where("part is not null")


def merged_hits(hits: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """(key, score, hits): the best score of a result over several queries, raised with the number of queries that found it."""
    g = hits.groupBy(key).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("hits"))
    return g.select(key, (F.col("best") * (1 + 0.15 * F.log1p(F.col("hits") - 1))).alias("score"), "hits")


def tier_merge(hot: DataFrame, warm: DataFrame, cold: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """(key, score, tier): one row a result over the tiers. Hot counts a tenth more, cold a tenth less, at most 1."""
    parts = [df.select(key, F.least(F.lit(1.0), F.col(score) * w).alias(score), F.lit(t).alias("tier"), F.lit(p).alias("p")) for df, w, t, p in ((hot, 1.1, "hot", 2), (warm, 1.0, "warm", 1), (cold, 0.9, "cold", 0))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = every.groupBy(key).agg(F.max(F.struct(score, "p", "tier")).alias("b"))
    return best.select(key, F.col(f"b.{score}").alias(score), F.col("b.tier").alias("tier"))


def goal_progress(goals: DataFrame, key: str, parent: str, progress: str) -> DataFrame:
    """Goals with the mean progress of their children where they have any; one level."""
    means = goals.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.avg(progress).alias("rolled"), F.count(F.lit(1)).alias("children"))
    return goals.join(means, key, "left").select(*goals.columns, F.coalesce("rolled", progress).alias("rolled"), F.coalesce("children", F.lit(0)).alias("children"))


def expire(rows: DataFrame, at: str, now: Column, days: float, key: list[str], most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows no older than ``days``, and of those the first ``most`` of each key in an order."""
    young = rows.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(0), hours=F.lit(int(days * 24))))
    if most is None:
        return young
    return young.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
