"""Lookups, log scans and canonical forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.operators import access
from palimpsest.plans.corpus import SQL as CORPUS
from palimpsest.plans.corpus import _coverage
from palimpsest.session import table

CUT = datetime(2018, 1, 15)


def _asked(s, d):
    e = table(s, d, "memory_evidence")
    return e.select(F.concat_ws("/", "memory_id", "event_id").alias("position"), F.when(F.col("relation") != "", F.col("source_memory_id")).alias("id")).distinct()


def _got(s, d):
    m = table(s, d, "memories").select("id", "status", "kind", "created_at")
    return access.batch_get(m, _asked(s, d), "id")


def _pages(s, d):
    m = table(s, d, "memories").select("created_at", "id")
    first = access.page(m, ["created_at", "id"], None, 50).orderBy(F.desc("created_at"), F.desc("id")).first()
    return access.page(m, ["created_at", "id"], tuple(first), 50)


def _truncated(s, d):
    log = table(s, d, "memory_events").where("memory_id is not null").select("memory_id", "created_at", "id")
    return access.truncated(log, "created_at", CUT, "memory_id")


def _recent(s, d):
    e = table(s, d, "memory_events").select("agent_id", "occurred_at", "id", "created_at")
    return access.best_of_each(e, ["agent_id"], ["occurred_at", "created_at", "id"], 5).select("agent_id", F.col("position").cast("bigint").alias("position"), "occurred_at", "id")


def _times(s, d):
    m = table(s, d, "memories").select("id", access.canonical_time(F.col("created_at")).alias("text"))
    offset = F.concat(F.substring("text", 1, 23), F.when(F.col("id") < "8", "+02:30").otherwise("-01:00"))
    return m.select("id", "text", access.parsed_time(F.col("text")).alias("back"), access.parsed_time(offset).alias("shifted"), access.parsed_time(F.substring("text", 1, 19)).isNull().alias("refused"))


def _modes(s, d):
    c = _coverage(s, d)
    dense, sparse = (c.where(f"{n} > 0").select("id", F.col(n).alias("score")) for n in ("coverage", "jaccard"))
    parts = [access.dispatched(m, dense, sparse, "id").select(F.lit(m).alias("mode"), "id", F.round("score", 6).alias("score")) for m in ("dense", "sparse", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "access_batch_get": _got,
    "access_next_page": _pages,
    "access_log_since": lambda s, d: access.since(table(s, d, "memory_events"), "created_at", CUT, datetime(2018, 1, 16)).select("id", "created_at"),
    "access_log_truncated": _truncated,
    "access_recent_of_agents": _recent,
    "access_times": _times,
    "access_identifiers": lambda s, d: table(s, d, "memory_events").select("id", "created_at", access.identifier(F.col("session_id")).alias("session"), access.identifier(F.col("event_type")).alias("kind")),
    "access_search_modes": _modes,
}

SQL = {
    "access_batch_get": """
WITH a AS (SELECT DISTINCT memory_id || '/' || event_id AS position, CASE WHEN relation <> '' THEN source_memory_id END AS id FROM memory_evidence)
SELECT position, a.id, m.id IS NOT NULL AS found, status, kind, created_at FROM a LEFT JOIN memories m ON m.id = a.id
""",
    "access_next_page": "SELECT created_at, id FROM memories ORDER BY created_at, id LIMIT 50 OFFSET 50",
    "access_log_since": "SELECT id, created_at FROM memory_events WHERE created_at >= TIMESTAMP '2018-01-15' AND created_at < TIMESTAMP '2018-01-16'",
    "access_log_truncated": """
SELECT memory_id, created_at, id FROM memory_events WHERE memory_id IS NOT NULL AND created_at > TIMESTAMP '2018-01-15'
UNION ALL SELECT memory_id, created_at, id FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS r FROM memory_events WHERE memory_id IS NOT NULL AND created_at <= TIMESTAMP '2018-01-15') WHERE r = 1
""",
    "access_recent_of_agents": "SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY occurred_at DESC, created_at DESC, id DESC) - 1 AS position, occurred_at, id FROM memory_events QUALIFY position < 5",
    "access_times": """
SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, created_at AS back,
  date_trunc('milliseconds', created_at) - to_minutes(CASE WHEN id < '8' THEN 150 ELSE -60 END) AS shifted, true AS refused FROM memories
""",
    "access_identifiers": "SELECT id, created_at, nullif(regexp_replace(session_id, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '') AS session, nullif(regexp_replace(event_type, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '') AS kind FROM memory_events",
    "access_search_modes": f"""
SELECT 'dense' AS mode, id, coverage AS score FROM ({CORPUS["corpus_coverage"]}) WHERE coverage > 0
UNION ALL SELECT 'sparse', id, jaccard FROM ({CORPUS["corpus_coverage"]}) WHERE jaccard > 0
UNION ALL SELECT 'hybrid', id, blend FROM ({CORPUS["corpus_alpha_blend"]})
""",
}
