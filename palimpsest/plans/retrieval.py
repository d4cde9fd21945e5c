"""Composite retrieval queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.operators import recall, replay
from palimpsest.plans import memory
from palimpsest.plans.memory import _CH, _N, NOW
from palimpsest.session import table

QUERY = "retrieval budget of the audit trail"
AT = datetime(2018, 1, 20, 12)


def _m(s, d):
    return table(s, d, "memories")


def _recalled(s, d):
    return recall.recall(_m(s, d), QUERY, 100, kinds=["fact", "observation"], valid_at=AT)


def _reranked(s, d):
    use = memory.nodes(s, d).select("id", "last_at", F.col("p").alias("worth"))
    return recall.signals(_recalled(s, d), use, NOW).select("id", F.round("score", 6).alias("score"))


def _explained(s, d):
    changes = replay.memory_changes(table(s, d, "memory_events"))
    return recall.explain(_recalled(s, d), _m(s, d), changes, table(s, d, "memory_evidence"))


QUERIES = {
    "recall_lexical": lambda s, d: _recalled(s, d).select("id", "scope_key", F.round("lexical", 6).alias("lexical"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")),
    "recall_reranked": _reranked,
    "recall_neighbours": lambda s, d: recall.neighbours_in_time(_m(s, d), _recalled(s, d)).select("id", "near_id", F.col("step").cast("bigint").alias("step")),
    "recall_context": lambda s, d: recall.context(_recalled(s, d).withColumn("scope_key", F.lit("all")), _m(s, d), 2_000).select("id", "kept", "used"),
    "recall_explain": _explained,
}

_WORDS = sorted(set(QUERY.split()))
_R = f"""
hits AS (
  SELECT id, scope_key, created_at, len(list_intersect([{", ".join(f"'{w}'" for w in _WORDS)}], coalesce(regexp_extract_all(lower(content), '[a-z0-9_]+'), []))) / {len(_WORDS)}::DOUBLE AS lexical
  FROM memories WHERE status = 'active' AND kind IN ('fact', 'observation')
    AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2018-01-20 12:00:00') AND (valid_to IS NULL OR TIMESTAMP '2018-01-20 12:00:00' < valid_to)),
top AS (SELECT id, scope_key, lexical, row_number() OVER (ORDER BY lexical DESC, created_at DESC, id) AS rank FROM hits WHERE lexical > 0 QUALIFY rank <= 100)
"""
SQL = {
    "recall_lexical": f"WITH {_R} SELECT id, scope_key, round(lexical, 6) AS lexical, round(1 / rank::DOUBLE, 6) AS score, rank FROM top",
    "recall_reranked": _N + f", {_R} SELECT t.id, round(0.6::DOUBLE * lexical + 0.25::DOUBLE * greatest(0.1, pow(2.0, -(idle_s / 3600) / 336)) + 0.15::DOUBLE * p, 6) AS score FROM top t JOIN nodes USING (id)",
    "recall_neighbours": f"WITH {_R}, n AS (SELECT id, lag(id) OVER w AS b, lead(id) OVER w AS a FROM memories WINDOW w AS (PARTITION BY scope_key ORDER BY created_at, id)), x AS (SELECT id, b AS near_id, CAST(-1 AS BIGINT) AS step FROM n UNION ALL SELECT id, a, 1 FROM n) SELECT * FROM x WHERE near_id IS NOT NULL AND id IN (SELECT id FROM top)",
    "recall_explain": f"""
WITH {_CH}, {_R},
log AS (SELECT memory_id, count(*) AS n, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM a GROUP BY 1),
src AS (SELECT memory_id, count(DISTINCT source_memory_id) AS n FROM memory_evidence GROUP BY 1)
SELECT t.id, m.status, m.kind, coalesce(log.n, 0) AS n_changes, first_at, last_at, coalesce(src.n, 0) AS sources
FROM top t LEFT JOIN memories m USING (id) LEFT JOIN log ON log.memory_id = t.id LEFT JOIN src ON src.memory_id = t.id""",
    "recall_context": f"""
WITH RECURSIVE {_R},
o AS (SELECT t.id, greatest(1, ceil(length(coalesce(content, '')) / 4))::BIGINT AS size, row_number() OVER (ORDER BY rank, t.id) AS r FROM top t JOIN memories USING (id)),
g(id, r, kept, used) AS (SELECT id, r, size <= 2000, CASE WHEN size <= 2000 THEN size ELSE 0 END FROM o WHERE r = 1
  UNION ALL SELECT o.id, o.r, g.used + size <= 2000, CASE WHEN g.used + size <= 2000 THEN g.used + size ELSE g.used END FROM g JOIN o ON o.r = g.r + 1)
SELECT id, kept, used FROM g""",
}
