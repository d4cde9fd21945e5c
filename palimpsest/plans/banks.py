"""Banks of strategies, procedures, episodes, gaps, scenarios and goals; review statistics and context ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.functions import text as tx
from palimpsest.operators import banks, replay
from palimpsest.plans.memory import _N, NOW, nodes
from palimpsest.plans.problems import _FIRST
from palimpsest.session import table

QUERY = "retrieval budget of the audit trail"


def _judged(s, d):
    n = nodes(s, d)
    outcome = F.when(F.col("status") == "active", "success").when(F.col("status") == "superseded", "partial").when(F.col("status") == "contradicted", "failure")
    parts = n.select("id", "scope_key", "kind", banks.relevance(F.lit(QUERY), F.col("content"), F.col("e")).alias("r"), banks.completeness(F.col("content")).alias("c"), sc.freshness(F.col("age_s") / 3600).alias("f"), banks.actionability(F.col("accesses") > 0, outcome).alias("a"))
    return parts.select("id", "scope_key", "kind", F.round(banks.quality(F.col("r"), F.col("c"), F.col("f"), F.col("a")), 6).alias("quality"))


def _bank(s, d):
    j = _judged(s, d).withColumn("ok", F.col("quality") >= 0.5)
    return banks.posterior(j, "scope_key", "ok", "quality")


def _rounded_bank(bank):
    return bank.select("scope_key", "n", *[F.round(c, n).alias(c) for c, n in (("alpha", 6), ("beta", 6), ("mean", 5), ("sd", 5))])


def _steps(s, d):
    up = F.when(F.col("kind").isin("reinforced", "restored"), 0.05).when(F.col("kind") == "contradicted", -0.10)
    return replay.memory_changes(table(s, d, "memory_events")).select("memory_id", "occurred_at", "arrival", "id", up.alias("step"))


def _procedures(s, d):
    v = banks.clamped_sums(_steps(s, d), "memory_id", ["occurred_at", "arrival", "id"], "step")
    return v.select("memory_id", F.round("value", 6).alias("reliability"), F.col("ups").alias("successes"), F.col("downs").alias("failures"))


def _procedure_stats(s, d):
    p = _procedures(s, d)
    return p.agg(F.count(F.lit(1)).alias("procedures"), F.sum("successes").alias("successes"), F.sum("failures").alias("failures"), F.round(F.avg("reliability"), 5).alias("mean_reliability"))


def _episodes(s, d):
    e = table(s, d, "memory_events").where("session_id <> ''").withColumn("kind", F.lower(F.trim("event_type")))
    g = e.groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"), F.max_by("kind", F.struct("occurred_at", "created_at", "id")).alias("last"), F.count_if(F.col("kind") == "reinforced").alias("reward"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"))
    outcome = F.when(F.col("last").isin("reinforced", "restored"), "success").when(F.col("last") == "remembered", "partial").when(F.col("last").isin("contradicted", "forgotten"), "failure").otherwise("unknown")
    return g.select("scope_key", "n", outcome.alias("outcome"), "started_at", "ended_at", F.round(banks.episode_strength(outcome, F.col("n"), F.col("reward")), 6).alias("strength"))


def _episode_stats(s, d):
    return _episodes(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("events"), F.round(F.avg("strength"), 5).alias("mean_strength"))


def _gaps(s, d):
    q = table(s, d, "documents").select("title", "created_at", (F.pmod("n_chars", F.lit(100)) / 100).alias("confidence"))
    return banks.gap_registry(q, tx.query_id(F.col("title")), "created_at", "confidence")


def _live_gaps(s, d):
    g = banks.live_gaps(_gaps(s, d), F.lit(NOW), 86400 * 200, F.coalesce(F.col("confidence") >= 0.2, F.lit(False)))
    return g.select("gap_id", "seen", F.col("last_at"), F.round("confidence", 6).alias("confidence"))


def _surprise(s, d):
    m = table(s, d, "memories").select("id", "content")
    e = table(s, d, "memory_evidence").select("memory_id", "source_memory_id").distinct()
    both = e.join(m.toDF("memory_id", "a"), "memory_id").join(m.toDF("source_memory_id", "b"), "source_memory_id")
    return both.select("memory_id", "source_memory_id", F.round(banks.surprise(F.col("b"), F.col("a")), 6).alias("surprise"))


def _boosted(s, d):
    hits = table(s, d, "memories").select("id", F.coalesce("confidence", F.lit(0.5)).alias("score"))
    e = table(s, d, "memory_evidence").groupBy("memory_id", "source_memory_id").agg(F.max("created_at").alias("at"))
    hours = sc.seconds_between(F.lit(NOW).cast("timestamp_ntz"), F.col("at")) / 3600
    live = e.select(F.col("source_memory_id").alias("id"), banks.scenario_confidence(F.lit(1.0), hours, 480.0).alias("confidence")).where("confidence >= 0.1")
    return banks.boosted(hits, live).select("id", F.round("score", 6).alias("score"))


def _goals(s, d):
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("priority"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit(1.0).alias("priority"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_acctbal").alias("priority"))
    return r.unionByName(n).unionByName(c)


def _tree(s, d):
    return banks.tree(_goals(s, d), "id", "parent_id").select("id", "root", F.col("depth").cast("bigint").alias("depth"))


def _next(s, d):
    return banks.next_actions(_goals(s, d), "id", "parent_id", F.col("priority") > 0, "priority", 5).select("id", "parent_id", F.round("priority", 4).alias("priority"))


def _reviews(s, d):
    n = nodes(s, d)
    stability = 1 + 0.5 * F.log1p(F.col("accesses").cast("double"))
    kept = F.exp(-F.col("idle_s") / 86400 / F.greatest(stability * 20, F.lit(0.01)))
    q = F.when(F.col("e") >= 0.95, 5).when(F.col("e") >= 0.8, 4).when(F.col("e") >= 0.6, 3).when(F.col("e") >= 0.4, 2).when(F.col("e") >= 0.2, 1).otherwise(0)
    return n.select("id", "tenant_id", "agent_id", kept.alias("kept"), stability.alias("stability"), q.alias("quality"), "idle_s", "accesses")


def _review_summary(s, d):
    g = _reviews(s, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("scheduled"), F.avg("kept").alias("kept"), F.avg("stability").alias("stability"), F.count_if(F.col("kept") < 0.5).alias("overdue"), F.avg("quality").alias("quality"), F.avg(F.when(F.col("quality") >= 3, 1.0).otherwise(0.0)).alias("success_rate"))
    return g.select("tenant_id", "scheduled", "overdue", *[F.round(c, 5).alias(c) for c in ("kept", "stability", "quality", "success_rate")])


def _review_urgency(s, d):
    # days until retention falls to a half
    days = F.col("stability") * 20 * 0.6931471805599453 - F.col("idle_s") / 86400
    bin_ = F.when(days <= 0, "immediate").when(days <= 1, "today").when(days <= 7, "week").when(days <= 30, "month").otherwise("later")
    return _reviews(s, d).groupBy("agent_id", bin_.alias("urgency")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(s, d):
    n = nodes(s, d)
    score = tx.context_score(tx.keyword_relevance("audit trail checks", F.col("content")), F.col("age_s") / 3600, F.col("e"), tx.token_estimate(F.col("content")), 720.0)
    return n.select("id", "scope_key", F.round(score, 7).alias("score"), F.round(tx.keyword_relevance("audit trail checks", F.col("content")), 6).alias("relevance"))


def _coverage(s, d):
    r = _ranked(s, d).groupBy("scope_key").agg(F.count_if(F.col("relevance") > 0.1).alias("selected"), F.count(F.lit(1)).alias("total"), F.avg(F.when(F.col("relevance") > 0.1, F.col("relevance"))).alias("mean"))
    return r.select("scope_key", "selected", "total", F.round(F.col("selected") / F.col("total"), 6).alias("coverage"), F.round(F.coalesce("mean", F.lit(0.0)), 5).alias("mean_relevance"))


def _chunk_sizes(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    kinds = {"paragraph": tx.paragraph_chunks(F.col("text"), 120, 16), "sentence": tx.sentence_chunks(F.col("text"), 120), "token": tx.token_chunks(F.col("text"), 120, 16)}
    parts = [t.select("doc_id", F.lit(k).alias("way"), F.posexplode(c).alias("no", "chunk")) for k, c in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "bank_judged": lambda s, d: _judged(s, d),
    "bank_posteriors": lambda s, d: _rounded_bank(_bank(s, d)),
    "bank_decayed": lambda s, d: _rounded_bank(banks.decayed_bank(_bank(s, d))),
    "bank_pruned": lambda s, d: _rounded_bank(banks.pruned(_bank(s, d), 0.62)),
    "bank_balance": lambda s, d: banks.balance(_bank(s, d), F.round("mean", 6) < 0.6).select("total", "positive", "negative", F.round("ratio", 6).alias("ratio"), "balanced"),
    "bank_procedures": _procedures,
    "bank_procedure_stats": _procedure_stats,
    "bank_episodes": _episodes,
    "bank_episode_stats": _episode_stats,
    "bank_gaps": lambda s, d: _gaps(s, d).select("gap_id", "seen", "first_at", "last_at", F.round("confidence", 6).alias("confidence")),
    "bank_live_gaps": _live_gaps,
    "bank_surprise": _surprise,
    "bank_boosted": _boosted,
    "bank_goal_tree": _tree,
    "bank_goal_actions": _next,
    "review_summary": _review_summary,
    "review_urgency": _review_urgency,
    "context_ranked": _ranked,
    "context_coverage": _coverage,
    "context_complexity": lambda s, d: table(s, d, "memories").select("id", tx.complexity(F.col("content")).alias("complexity")),
    "context_chunks": _chunk_sizes,
}

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
_Q = "['retrieval', 'budget', 'of', 'the', 'audit', 'trail']"
_JUDGED = (
    _N
    + f""", j0 AS (
  SELECT id, scope_key, kind,
    0.6 * len(list_intersect({_Q}, {_WORDS.format(x="content")})) / 6 + 0.4 * least(1.0, greatest(0.0, e)) AS r,
    CASE WHEN length(coalesce(content, '')) < 10 THEN 0.1 WHEN length(content) < 50 THEN 0.4 WHEN length(content) < 200 THEN 0.7 ELSE least(1.0, 0.7 + 0.3 * (length(content) / 1000)) END AS c,
    exp(-0.693 * age_s / 3600 / 168) AS f,
    CASE WHEN accesses = 0 THEN 0.2 WHEN status = 'active' THEN 1.0 WHEN status = 'superseded' THEN 0.6 WHEN status = 'contradicted' THEN 0.1 ELSE 0.5 END AS a FROM nodes),
judged AS (SELECT id, scope_key, kind, round(greatest(0.0, least(1.0, 0.4::DOUBLE * r + 0.25::DOUBLE * c + 0.15::DOUBLE * f + 0.2::DOUBLE * a)), 6) AS quality FROM j0),
bank0 AS (SELECT scope_key, count(*) AS n, 1 + sum(CASE WHEN quality >= 0.5 THEN quality::DECIMAL(18, 6) ELSE 0 END)::DOUBLE AS alpha, 1 + sum(CASE WHEN quality >= 0.5 THEN 0 ELSE quality::DECIMAL(18, 6) END)::DOUBLE AS beta FROM judged GROUP BY 1),
bank AS (SELECT *, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS sd FROM bank0)
"""
)
_ROUND = "scope_key, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(mean, 5) AS mean, round(sd, 5) AS sd"
_PROC = f"""
WITH {_FIRST},
ch AS (SELECT id, occurred_at, created_at, lower(trim(event_type)) AS kind, coalesce(memory_id, payload_json->>'$.memory_id') AS memory_id FROM first_rows WHERE json_valid(payload_json)),
st AS (SELECT *, CASE WHEN kind IN ('reinforced', 'restored') THEN 0.05::DOUBLE WHEN kind = 'contradicted' THEN -0.10::DOUBLE END AS step FROM ch WHERE memory_id IS NOT NULL),
proc AS (SELECT memory_id, round(list_reduce(list_prepend(0.5::DOUBLE, list(step ORDER BY occurred_at, created_at, id)), lambda x, y: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x + y))), 6) AS reliability,
  count(*) FILTER (WHERE step > 0) AS successes, count(*) FILTER (WHERE step < 0) AS failures FROM st WHERE step IS NOT NULL GROUP BY 1)
"""
_EPIS = """
WITH ev AS (SELECT *, lower(trim(event_type)) AS kind FROM memory_events WHERE session_id <> ''),
g AS (SELECT scope_key, count(*) AS n, arg_max(kind, row(occurred_at, created_at, id)) AS last, count(*) FILTER (WHERE kind = 'reinforced') AS reward, min(occurred_at) AS started_at, max(occurred_at) AS ended_at FROM ev GROUP BY 1),
o AS (SELECT *, CASE WHEN last IN ('reinforced', 'restored') THEN 'success' WHEN last = 'remembered' THEN 'partial' WHEN last IN ('contradicted', 'forgotten') THEN 'failure' ELSE 'unknown' END AS outcome FROM g),
ep AS (SELECT scope_key, n, outcome, started_at, ended_at, round(least(1.0, 0.3::DOUBLE + CASE outcome WHEN 'success' THEN 0.3 WHEN 'partial' THEN 0.15 WHEN 'failure' THEN 0.1 ELSE 0.05 END
  + least(0.2, n * 0.02) + CASE WHEN reward > 0 THEN least(0.2, reward * 0.1) ELSE 0 END), 6) AS strength FROM o)
"""
_GAPS = """
WITH q AS (SELECT substring(sha256(lower(trim(title))), 1, 16) AS gap_id, created_at, (n_chars % 100) / 100 AS confidence FROM documents WHERE title IS NOT NULL),
gaps AS (SELECT gap_id, count(*) AS seen, min(created_at) AS first_at, max(created_at) AS last_at, min(confidence) AS confidence FROM q GROUP BY 1)
"""
_GOALS = """
WITH RECURSIVE g AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, 0.0::DOUBLE AS priority FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer)
"""
_REV = (
    _N
    + """, rv AS (SELECT tenant_id, agent_id, exp(-idle_s / 86400 / greatest((1 + 0.5 * ln(1 + accesses)) * 20, 0.01)) AS kept, 1 + 0.5 * ln(1 + accesses) AS stability, idle_s,
  CASE WHEN e >= 0.95 THEN 5 WHEN e >= 0.8 THEN 4 WHEN e >= 0.6 THEN 3 WHEN e >= 0.4 THEN 2 WHEN e >= 0.2 THEN 1 ELSE 0 END AS quality
  FROM (SELECT n.*, m.agent_id FROM (SELECT * EXCLUDE (agent_id) FROM nodes) n JOIN memories m USING (id)))
"""
)
_RANK = (
    _N
    + """, rl AS (SELECT *, len(list_intersect(regexp_split_to_array(lower(coalesce(content, '')), '[ \\t\\n\\r\\f]+'), ['audit', 'checks', 'trail'])) AS hit FROM nodes),
rk0 AS (SELECT *, CASE WHEN contains(lower(coalesce(content, '')), 'audit trail checks') THEN 1.0::DOUBLE WHEN hit > 0 THEN least(1.0, hit / 3 + 0.3) ELSE 0.1 END AS rel FROM rl),
rk AS (SELECT id, scope_key, round(rel * pow(greatest(0.1, pow(2.0, -(age_s / 3600) / 720)), 0.5) * pow(least(1.0, e), 0.7) * pow(1 / (1 + greatest(1, ceil(length(coalesce(content, '')) / 4)) / 1000), 0.3), 7) AS score, round(rel, 6) AS relevance FROM rk0)
"""
)

SQL = {
    "bank_judged": _JUDGED + "SELECT * FROM judged",
    "bank_posteriors": _JUDGED + f"SELECT {_ROUND} FROM bank",
    "bank_decayed": _JUDGED
    + f", b1 AS (SELECT scope_key, n, alpha, beta + 0.01 AS beta FROM bank0), b2 AS (SELECT *, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS sd FROM b1) SELECT {_ROUND} FROM b2",
    "bank_pruned": _JUDGED + f"SELECT {_ROUND} FROM bank WHERE NOT (mean < 0.62 AND alpha + beta - 2 > 5 AND sd < 0.15)",
    "bank_balance": _JUDGED
    + ", x AS (SELECT count(*) AS total, count(*) FILTER (WHERE round(mean, 6) < 0.6) AS negative FROM bank) SELECT total, total - negative AS positive, negative, round(negative / total, 6) AS ratio, abs(negative / total - 0.4) < 0.1 AS balanced FROM x",
    "bank_procedures": _PROC + "SELECT * FROM proc",
    "bank_procedure_stats": _PROC + "SELECT count(*) AS procedures, sum(successes)::BIGINT AS successes, sum(failures)::BIGINT AS failures, round(avg(reliability), 5) AS mean_reliability FROM proc",
    "bank_episodes": _EPIS + "SELECT * FROM ep",
    "bank_episode_stats": _EPIS + "SELECT outcome, count(*) AS episodes, sum(n)::BIGINT AS events, round(avg(strength), 5) AS mean_strength FROM ep GROUP BY 1",
    "bank_gaps": _GAPS + "SELECT gap_id, seen, first_at, last_at, round(confidence, 6) AS confidence FROM gaps",
    "bank_live_gaps": _GAPS
    + ", i AS (SELECT *, (epoch_us(TIMESTAMP '2018-03-01') - epoch_us(last_at)) / 1e6 AS idle FROM gaps) SELECT gap_id, seen, last_at, round(confidence, 6) AS confidence FROM i WHERE NOT ((coalesce(confidence >= 0.2, false) AND idle > 17280000) OR idle >= 34560000)",
    "bank_surprise": f"""
WITH ev AS (SELECT DISTINCT memory_id, source_memory_id FROM memory_evidence),
t AS (SELECT memory_id, source_memory_id, y.content AS ex, x.content AS ac, {_WORDS.format(x="y.content")} AS a, {_WORDS.format(x="x.content")} AS b FROM ev JOIN memories x ON x.id = memory_id JOIN memories y ON y.id = source_memory_id)
SELECT memory_id, source_memory_id, round(CASE WHEN ex = ac THEN 0.0 WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 ELSE 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS surprise FROM t
""",
    "bank_boosted": """
WITH ev AS (SELECT memory_id, source_memory_id, pow(2.0, -((epoch_us(TIMESTAMP '2018-03-01') - epoch_us(max(created_at))) / 1e6 / 3600) / 480.0) AS c0 FROM memory_evidence GROUP BY 1, 2),
b AS (SELECT id, least(1.0, sum(c * 0.5)) AS boost FROM (SELECT source_memory_id AS id, c0 AS c FROM ev) WHERE c >= 0.1 GROUP BY 1)
SELECT m.id, round(coalesce(confidence, 0.5) * (1 + coalesce(boost, 0) * 0.3::DOUBLE), 6) AS score FROM memories m LEFT JOIN b USING (id)
""",
    "bank_goal_tree": _GOALS + ", t(id, root, depth) AS (SELECT id, id, 0 FROM g WHERE parent_id IS NULL UNION ALL SELECT g.id, root, depth + 1 FROM t JOIN g ON g.parent_id = t.id) SELECT id, root, depth::BIGINT AS depth FROM t",
    "bank_goal_actions": _GOALS + "SELECT id, parent_id, round(priority, 4) AS priority FROM g WHERE priority > 0 AND id NOT IN (SELECT parent_id FROM g WHERE parent_id IS NOT NULL) ORDER BY priority DESC, id LIMIT 5",
    "review_summary": _REV
    + "SELECT tenant_id, count(*) AS scheduled, count(*) FILTER (WHERE kept < 0.5) AS overdue, round(avg(kept), 5) AS kept, round(avg(stability), 5) AS stability, round(avg(quality), 5) AS quality, round(avg(CASE WHEN quality >= 3 THEN 1.0 ELSE 0.0 END), 5) AS success_rate FROM rv GROUP BY 1",
    "review_urgency": _REV
    + """, dd AS (SELECT agent_id, stability * 20 * 0.6931471805599453 - idle_s / 86400 AS days FROM rv)
SELECT agent_id, CASE WHEN days <= 0 THEN 'immediate' WHEN days <= 1 THEN 'today' WHEN days <= 7 THEN 'week' WHEN days <= 30 THEN 'month' ELSE 'later' END AS urgency, count(*) AS n FROM dd GROUP BY 1, 2""",
    "context_ranked": _RANK + "SELECT * FROM rk",
    "context_coverage": _RANK
    + "SELECT scope_key, count(*) FILTER (WHERE relevance > 0.1) AS selected, count(*) AS total, round(count(*) FILTER (WHERE relevance > 0.1) / count(*), 6) AS coverage, round(coalesce(avg(relevance) FILTER (WHERE relevance > 0.1), 0.0), 5) AS mean_relevance FROM rk GROUP BY 1",
    "context_complexity": """
SELECT id, round(CASE WHEN len(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) > 20 THEN 0.3 ELSE 0 END
  + CASE WHEN regexp_matches(lower(content), 'analyze|compare|why|how|plan|design|evaluate') THEN 0.4 ELSE 0 END
  + CASE WHEN regexp_matches(lower(content), 'maybe|unsure|unknown|complex') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS complexity FROM memories
""",
}
