"""Scores, lifecycle and maintenance of memories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.functions import text as tx
from palimpsest.operators import lifecycle as lc
from palimpsest.operators import replay, sequence
from palimpsest.plans.problems import _FIRST
from palimpsest.session import table

NOW = datetime(2018, 3, 1)
PROBE = datetime(2018, 1, 20, 12)


def nodes(s, d):
    """Memories with their use: accesses, last access, worth (e: confidence, p: stated importance) and ages."""
    log = table(s, d, "memory_events").where("memory_id is not null")
    use = log.groupBy("memory_id").agg(F.count_if(F.lower(F.trim("event_type")) == "reinforced").alias("accesses"), F.max("occurred_at").alias("last_at"))
    m = table(s, d, "memories").select("id", "scope_key", "tenant_id", "agent_id", "kind", "status", "confidence", "content", "metadata_json", "created_at")
    level = F.try_variant_get(F.try_parse_json("metadata_json"), "$.importance", "string")
    joined = m.join(use, m["id"] == use["memory_id"], "left").drop("memory_id")
    now = F.lit(NOW).cast("timestamp_ntz")
    return (
        joined.withColumn("accesses", F.coalesce("accesses", F.lit(0)))
        .withColumn("last_at", F.coalesce("last_at", "created_at"))
        .withColumn("e", F.coalesce("confidence", F.lit(0.5)))
        .withColumn("p", F.when(level == "low", 0.3).when(level == "high", 0.8).otherwise(0.5))
        .withColumn("age_s", sc.seconds_between(now, F.col("created_at")))
        .withColumn("idle_s", sc.seconds_between(now, F.col("last_at")))
    )


_N = """
WITH use AS (
  SELECT memory_id, count(*) FILTER (WHERE lower(trim(event_type)) = 'reinforced') AS accesses, max(occurred_at) AS last_at
  FROM memory_events WHERE memory_id IS NOT NULL GROUP BY 1),
nodes AS (
  SELECT id, scope_key, tenant_id, agent_id, kind, status, content, created_at, coalesce(accesses, 0) AS accesses, coalesce(last_at, created_at) AS last_at,
    coalesce(confidence, 0.5) AS e,
    CASE CASE WHEN json_valid(metadata_json) THEN metadata_json->>'$.importance' END WHEN 'low' THEN 0.3 WHEN 'high' THEN 0.8 ELSE 0.5 END AS p,
    (epoch_us(TIMESTAMP '2018-03-01') - epoch_us(created_at)) / 1e6 AS age_s,
    (epoch_us(TIMESTAMP '2018-03-01') - epoch_us(coalesce(last_at, created_at))) / 1e6 AS idle_s
  FROM memories LEFT JOIN use ON id = memory_id),
scored AS (
  SELECT *, greatest(0.0, (e + p) / 2) * ln(1 + accesses) * exp(-0.01 * age_s / 86400) AS ltp,
    0.7 * greatest(0.0, 1 - idle_s / 3600 / 168) + 0.3 * greatest(0.0, 1 - age_s / 3600 / 720) AS recency,
    1 + 0.5 * ln(1 + accesses) AS stability,
    least(1.0, (e + p) / 2 + least(0.3, 0.1 * ln(1 + accesses)) + least(0.2, 0.1 * (0.5 * ln(1 + accesses)))) AS importance
  FROM nodes),
full_scores AS (
  SELECT *, 0.6 * ltp + 0.25 * recency + 0.15 * importance AS tier_score, exp(-idle_s / 86400 / greatest(stability * 20, 0.01)) AS kept FROM scored)
"""


def scored(s, d):
    n = nodes(s, d)
    acc = F.col("accesses")
    n = n.withColumn("ltp", sc.ltp(F.col("e"), F.col("p"), acc, F.col("age_s") / 86400)).withColumn("recency", sc.recency(F.col("idle_s") / 3600, F.col("age_s") / 3600))
    n = n.withColumn("stability", sc.stability(acc)).withColumn("importance", sc.importance(F.col("e"), F.col("p"), acc, F.col("stability")))
    return n.withColumn("tier_score", sc.tier_score(F.col("ltp"), F.col("recency"), F.col("importance"))).withColumn("kept", sc.retention(F.col("idle_s") / 86400, F.col("stability") * 20))


def r(column: str, alias: str | None = None):
    return F.round(column, 6).alias(alias or column)


def _scores(s, d):
    return scored(s, d).select("id", r("ltp"), r("recency"), r("importance"), r("tier_score"), r("stability"), r("kept"))


def _bayes(s, d):
    log = table(s, d, "memory_events").where("memory_id is not null").withColumn("k", F.lower(F.trim("event_type")))
    n = log.groupBy("memory_id").agg((F.count_if(F.col("k") == "reinforced") + 1.0).alias("a"), (F.count_if(F.col("k").isin("contradicted", "forgotten")) + 1.0).alias("b"))
    return n.select("memory_id", F.round(sc.beta_mean(F.col("a"), F.col("b")), 6).alias("mean"), F.round(sc.beta_std(F.col("a"), F.col("b")), 6).alias("std"), F.round(sc.beta_ucb(F.col("a"), F.col("b")), 6).alias("ucb"))


def _decays(s, d):
    n = nodes(s, d)
    hours, days = F.col("idle_s") / 3600, F.col("idle_s") / 86400
    return n.select(
        "id", F.round(sc.half_life(F.col("e"), days, 30), 6).alias("half_life"), F.round(sc.recency_half_life(hours, 24 * 14), 6).alias("recency_half_life"),
        F.round(sc.freshness(hours), 6).alias("freshness"), F.round(sc.chrono_weight(F.col("e"), F.col("age_s")), 6).alias("chrono"),
        F.round(sc.synaptic_boost(F.col("accesses")), 6).alias("boost"), F.round(sc.gap_priority(F.col("p"), F.col("e"), F.col("e")), 6).alias("gap_priority"),
        F.round(sc.health(F.col("p"), F.col("e"), F.col("p")), 6).alias("health"), F.round(sc.backoff(F.col("accesses") + 1), 6).alias("backoff"),
        F.round(sc.days_until(0.4, sc.stability(F.col("accesses"))), 6).alias("review_in"), F.round(sc.salience(F.col("e") * 2 - 1, F.col("p")), 6).alias("salience"),
    )


def _review(s, d):
    n = scored(s, d)
    return n.select("id", sc.review_action(F.col("kept"), F.col("p")).alias("action"), sc.tier_of(F.col("tier_score")).alias("tier"), r("kept"))


def _sm2(s, d):
    n = nodes(s, d).withColumn("q", F.round(F.col("e") * 5).cast("int"))
    ef = sc.sm2_easiness(F.lit(2.5), F.col("q"))
    return n.select("id", F.round(ef, 6).alias("easiness"), sc.sm2_interval(F.col("accesses"), F.col("accesses") * 6, ef, F.col("q")).cast("bigint").alias("interval_days"))


def _agents(s, d):
    n = scored(s, d)
    return n.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("kept"), 4).alias("avg_kept"), F.round(F.avg("ltp"), 4).alias("avg_ltp"),
        F.count_if(F.col("kept") <= 0.4).alias("due"), F.sum("accesses").alias("accesses"),
    )


def _curve(s, d):
    n = scored(s, d).withColumn("bucket", F.floor(F.col("age_s") / 864000).cast("bigint"))
    return n.groupBy("bucket").agg(F.round(F.avg("kept"), 5).alias("mean_kept"), F.count(F.lit(1)).alias("n"))


def _tier_stats(s, d):
    n = scored(s, d).withColumn("tier", sc.tier_of(F.col("tier_score")))
    return n.groupBy("tier", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ltp"), 5).alias("avg_ltp"), F.round(F.sum("tier_score"), 3).alias("total"))


def _proximity(s, d):
    n = nodes(s, d)
    w = Window.partitionBy("scope_key").orderBy("created_at", "id")
    chained = n.withColumn("before", F.lag("created_at").over(w))
    near = sc.temporal_proximity(sc.seconds_between(F.col("created_at"), F.col("before")))
    return chained.groupBy("scope_key").agg(F.round(F.avg(near), 6).alias("continuity"), F.count(F.lit(1)).alias("n"))


def _wm(s, d):
    n = nodes(s, d)
    return sequence.keep_best(n.where(F.col("idle_s") <= 40 * 86400), "scope_key", [F.desc("p"), F.desc("created_at"), F.col("id")], 8).select("scope_key", "id", F.col("pos").cast("bigint").alias("pos"))


def _top(order, limit):
    return lambda s, d: scored(s, d).orderBy(*order()).limit(limit).select("id", r("ltp"), r("kept"))


def _changes(s, d):
    return replay.memory_changes(table(s, d, "memory_events"))


def _lineage(s, d):
    return lc.lineage(table(s, d, "memory_evidence"))


def _import(s, d):
    m = table(s, d, "memories").select("id", "kind", "status", "confidence")
    existing = m.where("kind <> 'fact'")
    incoming = m.where("kind in ('fact', 'decision')").withColumn("confidence", F.col("confidence") / 2)
    return lc.merge_import(existing, incoming, "id", ["id"], "overwrite")


QUERIES = {
    "memory_scores": _scores,
    "memory_reliability": _bayes,
    "memory_decays": _decays,
    "memory_review_actions": _review,
    "memory_sm2": _sm2,
    "memory_promote_top": _top(lambda: (F.desc(F.round("ltp", 6)), F.col("id")), 50),
    "memory_evict_top": _top(lambda: (F.asc(F.round("kept", 6)), F.col("id")), 50),
    "memory_agent_analytics": _agents,
    "memory_retention_curve": _curve,
    "memory_tier_stats": _tier_stats,
    "memory_chain_continuity": _proximity,
    "memory_working_set": _wm,
    "memory_lifecycle": lambda s, d: lc.lifecycle(_changes(s, d)),
    "memory_known_at": lambda s, d: lc.known_at(lc.lifecycle(_changes(s, d)), PROBE),
    "memory_valid_at": lambda s, d: lc.valid_at(table(s, d, "memories"), PROBE).select("id", "kind", "status"),
    "memory_scope_listing": lambda s, d: lc.scope_listing(table(s, d, "memories"), "active", 20).select("scope_key", "id", F.col("pos").cast("bigint").alias("pos")),
    "memory_stale_projection": lambda s, d: lc.stale_projection(table(s, d, "memories"), replay.current_memories(table(s, d, "memory_events"))),
    "memory_evidence_orphans": lambda s, d: lc.orphans(table(s, d, "memory_evidence"), "event_id", table(s, d, "memory_events"), "id").select("memory_id", "event_id"),
    "memory_lineage": _lineage,
    "memory_search_scopes": lambda s, d: lc.search_scopes(table(s, d, "memories")),
    "memory_import_overwrite": _import,
    "memory_event_latest": lambda s, d: lc.latest(table(s, d, "memory_events").where("memory_id is not null").select("memory_id", "id", "event_type", "occurred_at", "created_at"), "memory_id", ["occurred_at", "created_at", "id"]).select("memory_id", "id", F.lower(F.trim("event_type")).alias("kind")),
    "memory_event_kinds": lambda s, d: table(s, d, "memory_events").groupBy(F.lower(F.trim("event_type")).alias("kind"), "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("memory_id").alias("memories")),
    "memory_history": lambda s, d: sequence.linked(_changes(s, d), "memory_id", ["occurred_at", "arrival", "id"], "id").select("memory_id", "id", "kind", "previous_id", "next_id"),
    "memory_status_balance": lambda s, d: table(s, d, "memories").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("status").isin("contradicted", "forgotten")) / F.count(F.lit(1)), 6).alias("negative_share")),
    "memory_token_estimate": lambda s, d: table(s, d, "memories").select("id", tx.token_estimate(F.col("content")).cast("bigint").alias("tokens"), F.length(tx.squeeze_space(F.col("content"))).cast("bigint").alias("chars")),
    "memory_checksum": lambda s, d: table(s, d, "memories").select("id", tx.checksum(F.col("tenant_id"), F.col("id"), F.col("kind")).alias("checksum")),
}

_CH = f"""
{_FIRST},
ch AS (
  SELECT id, occurred_at, created_at, lower(trim(event_type)) AS kind,
    coalesce(memory_id, payload_json->>'$.memory_id') AS memory_id
  FROM (SELECT * FROM first_rows WHERE json_valid(payload_json))),
a AS (
  SELECT *, coalesce(max(CASE WHEN kind = 'remembered' THEN 1 ELSE 0 END) OVER w, 0) AS known FROM ch
  WHERE memory_id IS NOT NULL AND kind IN ('remembered', 'reinforced', 'superseded', 'contradicted', 'forgotten', 'restored')
  WINDOW w AS (PARTITION BY memory_id ORDER BY occurred_at, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, kind = 'remembered' OR (kind = 'restored' AND known = 1) AS life FROM a),
c AS (SELECT *, coalesce(last_value(CASE WHEN life THEN 1 WHEN kind = 'forgotten' THEN 0 END IGNORE NULLS) OVER
  (PARTITION BY memory_id ORDER BY occurred_at, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alive FROM b),
st AS (SELECT *, CASE WHEN life THEN 'active' WHEN alive = 1 AND kind IN ('superseded', 'contradicted', 'forgotten') THEN kind END AS status FROM c),
st2 AS (SELECT *, lag(status) OVER (PARTITION BY memory_id ORDER BY occurred_at, created_at, id) AS last FROM st WHERE status IS NOT NULL),
life AS (SELECT memory_id, status, occurred_at AS known_from,
  lead(occurred_at) OVER (PARTITION BY memory_id ORDER BY occurred_at, created_at, id) AS known_to, id AS event_id
  FROM st2 WHERE last IS NULL OR last <> status)
"""
_P = "TIMESTAMP '2018-01-20 12:00:00'"
from palimpsest.plans.problems import SQL as _PROBLEM_SQL  # noqa: E402

SQL = {
    "memory_scores": _N + "SELECT id, round(ltp, 6) AS ltp, round(recency, 6) AS recency, round(importance, 6) AS importance, round(tier_score, 6) AS tier_score, round(stability, 6) AS stability, round(kept, 6) AS kept FROM full_scores",
    "memory_reliability": """
WITH n AS (SELECT memory_id, count(*) FILTER (WHERE lower(trim(event_type)) = 'reinforced') + 1.0::DOUBLE AS a,
  count(*) FILTER (WHERE lower(trim(event_type)) IN ('contradicted', 'forgotten')) + 1.0::DOUBLE AS b FROM memory_events WHERE memory_id IS NOT NULL GROUP BY 1)
SELECT memory_id, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS std,
  round(least(1.0, a / (a + b) + 1.65 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS ucb FROM n""",
    "memory_decays": _N + """
SELECT id, round(e * pow(2.0, -(idle_s / 86400) / 30), 6) AS half_life, round(greatest(0.1, pow(2.0, -(idle_s / 3600) / 336)), 6) AS recency_half_life,
  round(exp(-0.693 * (idle_s / 3600) / 168), 6) AS freshness, round(e / (1 + 1e-6 * age_s), 6) AS chrono, round(1 + least(ln(1 + accesses), 9.0), 6) AS boost,
  round(0.5 * p + 0.3 * e + 0.2 * (1 - e), 6) AS gap_priority, round(0.35 * p + 0.35 * e + 0.30 * p, 6) AS health, round(least(3600.0, pow(2.0, accesses)), 6) AS backoff,
  round(-(1 + 0.5 * ln(1 + accesses)) * ln(0.4), 6) AS review_in, round(abs(e * 2 - 1) * p, 6) AS salience FROM nodes""",
    "memory_review_actions": _N + """
SELECT id, CASE WHEN kept <= 0.10 THEN 'evict' WHEN kept <= 0.40 AND p >= 0.5 THEN 'boost' WHEN kept <= 0.40 THEN 'review' ELSE 'consolidate' END AS action,
  CASE WHEN tier_score >= 0.7 THEN 'hot' WHEN tier_score >= 0.35 THEN 'warm' ELSE 'cold' END AS tier, round(kept, 6) AS kept FROM full_scores""",
    "memory_sm2": _N + """
, q AS (SELECT id, accesses, CAST(round(e * 5) AS INT) AS q FROM nodes),
ef AS (SELECT *, greatest(1.3, 2.5 + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)) AS ef FROM q)
SELECT id, round(ef, 6) AS easiness, CAST(CASE WHEN q < 3 THEN 1 WHEN accesses <= 0 THEN 1 WHEN accesses = 1 THEN 6 ELSE round(accesses * 6 * ef) END AS BIGINT) AS interval_days FROM ef""",
    "memory_promote_top": _N + "SELECT id, round(ltp, 6) AS ltp, round(kept, 6) AS kept FROM full_scores ORDER BY round(ltp, 6) DESC, id LIMIT 50",
    "memory_evict_top": _N + "SELECT id, round(ltp, 6) AS ltp, round(kept, 6) AS kept FROM full_scores ORDER BY round(kept, 6), id LIMIT 50",
    "memory_agent_analytics": _N + "SELECT agent_id, count(*) AS n, round(avg(kept), 4) AS avg_kept, round(avg(ltp), 4) AS avg_ltp, count(*) FILTER (WHERE kept <= 0.4) AS due, CAST(sum(accesses) AS BIGINT) AS accesses FROM full_scores GROUP BY 1",
    "memory_retention_curve": _N + "SELECT CAST(floor(age_s / 864000) AS BIGINT) AS bucket, round(avg(kept), 5) AS mean_kept, count(*) AS n FROM full_scores GROUP BY 1",
    "memory_tier_stats": _N + "SELECT CASE WHEN tier_score >= 0.7 THEN 'hot' WHEN tier_score >= 0.35 THEN 'warm' ELSE 'cold' END AS tier, kind, count(*) AS n, round(avg(ltp), 5) AS avg_ltp, round(sum(tier_score), 3) AS total FROM full_scores GROUP BY 1, 2",
    "memory_chain_continuity": _N + """
, c AS (SELECT *, lag(created_at) OVER (PARTITION BY scope_key ORDER BY created_at, id) AS before FROM nodes)
SELECT scope_key, round(avg(greatest(0.0, 1 - abs((epoch_us(created_at) - epoch_us(before)) / 1e6) / 86400)) FILTER (WHERE before IS NOT NULL), 6) AS continuity, count(*) AS n FROM c GROUP BY 1""",
    "memory_working_set": _N + """
SELECT scope_key, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY p DESC, created_at DESC, id) AS pos FROM nodes WHERE idle_s <= 40 * 86400) WHERE pos <= 8""",
    "memory_lifecycle": f"WITH {_CH} SELECT * FROM life",
    "memory_known_at": f"WITH {_CH} SELECT memory_id, status, event_id FROM life WHERE known_from <= {_P} AND (known_to IS NULL OR {_P} < known_to)",
    "memory_valid_at": f"SELECT id, kind, status FROM memories WHERE (valid_from IS NULL OR valid_from <= {_P}) AND (valid_to IS NULL OR {_P} < valid_to)",
    "memory_scope_listing": "SELECT scope_key, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, id DESC) AS pos FROM memories WHERE status = 'active') WHERE pos <= 20",
    "memory_stale_projection": f"""
WITH cur AS ({_PROBLEM_SQL['p4_found']})
SELECT m.id AS memory_id, m.status AS projected, coalesce(cur.status, 'forgotten') AS replayed FROM memories m LEFT JOIN cur ON cur.memory_id = m.id
WHERE coalesce(cur.status, 'forgotten') <> m.status""",
    "memory_evidence_orphans": "SELECT memory_id, event_id FROM memory_evidence WHERE event_id NOT IN (SELECT id FROM memory_events WHERE id IS NOT NULL)",
    "memory_lineage": """
WITH RECURSIVE e AS (SELECT DISTINCT memory_id, source_memory_id FROM memory_evidence WHERE memory_id IS NOT NULL AND source_memory_id IS NOT NULL),
r AS (SELECT memory_id, source_memory_id, 1 AS depth FROM e
  UNION SELECT r.memory_id, e.source_memory_id, r.depth + 1 FROM r JOIN e ON e.memory_id = r.source_memory_id WHERE r.depth < 16)
SELECT memory_id, source_memory_id, min(depth) AS depth FROM r GROUP BY 1, 2""",
    "memory_search_scopes": """
SELECT DISTINCT scope_key, scope_key AS search_key FROM memories
UNION SELECT scope_key, CAST(to_json([tenant_id, user_id, agent_id, project_id, NULL]) AS VARCHAR) FROM memories WHERE session_id IS NOT NULL""",
    "memory_import_overwrite": """
SELECT id, kind, status, confidence FROM memories WHERE kind NOT IN ('fact', 'decision')
UNION ALL SELECT id, kind, status, confidence / 2 FROM memories WHERE kind IN ('fact', 'decision')""",
    "memory_event_latest": "SELECT memory_id, id, kind FROM (SELECT memory_id, id, lower(trim(event_type)) AS kind, row_number() OVER (PARTITION BY memory_id ORDER BY occurred_at DESC, created_at DESC, id DESC) AS r FROM memory_events WHERE memory_id IS NOT NULL) WHERE r = 1",
    "memory_event_kinds": "SELECT lower(trim(event_type)) AS kind, tenant_id, count(*) AS n, count(DISTINCT memory_id) AS memories FROM memory_events GROUP BY 1, 2",
    "memory_history": f"WITH {_CH} SELECT memory_id, id, kind, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM a WINDOW w AS (PARTITION BY memory_id ORDER BY occurred_at, created_at, id)",
    "memory_status_balance": "SELECT tenant_id, count(*) AS n, round(count(*) FILTER (WHERE status IN ('contradicted', 'forgotten')) / count(*), 6) AS negative_share FROM memories GROUP BY 1",
    "memory_token_estimate": "SELECT id, CAST(greatest(1, ceil(length(coalesce(content, '')) / 4)) AS BIGINT) AS tokens, length(trim(regexp_replace(content, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))) AS chars FROM memories",
    "memory_checksum": "SELECT id, sha256(concat_ws(':', tenant_id, id, kind)) AS checksum FROM memories",
}
