"""Consolidation, patterns, validation and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import consolidate as co
from palimpsest.plans import memory, relations
from palimpsest.plans.memory import _N, NOW
from palimpsest.session import table

_STOP = ("with", "from", "that", "this", "after", "before")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _merged(s, d):
    n = memory.scored(s, d).select("id", "scope_key", "kind", F.round("ltp", 6).alias("ltp"), "accesses")
    return co.merge_clusters(n.withColumn("c", F.concat_ws("|", "scope_key", "kind")), "c").select("c", "representative", "members", "accesses", F.round("strength", 6).alias("strength"))


def _z(s, d):
    m = table(s, d, "memories").select("id", "kind", "confidence").where("confidence is not null")
    return co.z_scores(m, "kind", "confidence").select("id", F.round("z", 5).alias("z"))


def _anomalies(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "value", "ts")
    return co.anomalies(e, "event_type", ["ts", "event_id"], "value", 50, 2.5).select("event_id")


def _schema(s, d):
    e = table(s, d, "memory_events").select("id", "created_at", "payload_json")
    out = co.schema_errors(e, "payload_json", {"memory_id": "string", "confidence": "double"}, {"kind": ["fact", "observation"]})
    return out.select("id", F.size("errors").cast("bigint").alias("n_errors"), F.concat_ws(",", "errors").alias("errors"))


def _patterns(s, d):
    p = s.createDataFrame([("re*",), ("*ed",), ("for?otten",), ("*",), ("x.y",)], "pattern string")
    e = table(s, d, "memory_events").select(F.lower(F.trim("event_type")).alias("kind"))
    return co.pattern_matches(e, p, "kind")


def _hits(s, d):
    m = table(s, d, "memories").select("id", tx.tokens(F.col("content")).alias("w"))
    parts = [["retrieval", "budget"], ["audit", "trail"], ["memory", "shard"]]
    hits = [m.select("id", tx.coverage(F.array(*[F.lit(x) for x in q]), F.col("w")).alias("score")).where("score > 0") for q in parts]
    return hits


def _merged_hits(s, d):
    a, b, c = _hits(s, d)
    return co.merged_hits(a.unionByName(b).unionByName(c)).select("id", F.round("score", 6).alias("score"), "hits")


def _tiers(s, d):
    return co.tier_merge(*_hits(s, d)).select("id", F.round("score", 6).alias("score"), "tier")


def _goals(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("goal"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), (F.col("n_nationkey") / 25.0).alias("progress"))
    r = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("goal"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("progress"))
    return co.goal_progress(n.unionByName(r), "goal", "parent", "progress").select("goal", F.round("rolled", 6).alias("rolled"), "children")


def _levels(s, d):
    m = table(s, d, "memories").select(F.col("agent_id").alias("agent"), F.col("kind").alias("item"), F.when(F.col("confidence") > 0.8, "full").when(F.col("confidence") > 0.5, "annotate").otherwise("read").alias("level"), F.col("valid_to").alias("expires_at"))
    return co.access_levels(m, {"read": 1, "annotate": 2, "full": 3}, _now()).select("agent", "item", F.col("level").cast("bigint").alias("level"))


QUERIES = {
    "upkeep_merge_clusters": _merged,
    "upkeep_graph_clusters": lambda s, d: co.graph_clusters(relations._edges(s, d).withColumn("w", F.lit(0.5)), "memory_id", "source_memory_id", "w"),
    "upkeep_keyword_patterns": lambda s, d: co.keyword_patterns(table(s, d, "memories"), "id", "content", 3, 20, 3, _STOP),
    "upkeep_tag_patterns": lambda s, d: co.json_tag_patterns(table(s, d, "memories"), "metadata_json", "$.tags", 2),
    "upkeep_busiest_hour": lambda s, d: co.busiest_hour(table(s, d, "memory_events"), "tenant_id", "occurred_at").select("tenant_id", F.col("hour").cast("bigint").alias("hour"), "n"),
    "upkeep_anomalies": _anomalies,
    "upkeep_z_scores": _z,
    "upkeep_schema_errors": _schema,
    "upkeep_pattern_matches": _patterns,
    "upkeep_merged_hits": _merged_hits,
    "upkeep_tier_merge": _tiers,
    "upkeep_goal_progress": _goals,
    "upkeep_access_levels": _levels,
    "upkeep_query_parts": lambda s, d: co.query_parts(table(s, d, "documents").select("doc_id", "title"), "doc_id", "title").select("doc_id", F.col("no").cast("bigint").alias("no"), "part"),
    "upkeep_expired": lambda s, d: co.expire(table(s, d, "memories"), "created_at", _now(), 45, ["scope_key"], 10, [F.desc("created_at"), F.col("id")]).select("scope_key", "id"),
}

_T = "coalesce(regexp_extract_all(lower(content), '[a-z0-9_]+'), [])"
_H = f"""
WITH m AS (SELECT id, {_T} AS w FROM memories),
h AS (
  SELECT 1 AS q, id, len(list_intersect(['retrieval', 'budget'], w)) / 2::DOUBLE AS score FROM m
  UNION ALL SELECT 2, id, len(list_intersect(['audit', 'trail'], w)) / 2::DOUBLE FROM m
  UNION ALL SELECT 3, id, len(list_intersect(['memory', 'shard'], w)) / 2::DOUBLE FROM m),
hits AS (SELECT * FROM h WHERE score > 0)
"""

SQL = {
    "upkeep_merge_clusters": _N + """
, c AS (SELECT concat_ws('|', scope_key, kind) AS c, id, round(ltp, 6) AS ltp, accesses FROM full_scores)
SELECT c, arg_max(id, struct_pack(a := ltp, b := id)) AS representative, count(*) AS members, CAST(sum(accesses) AS BIGINT) AS accesses, round(least(1.0, max(ltp) + 0.05 * count(*)), 6) AS strength FROM c GROUP BY 1""",
    "upkeep_graph_clusters": relations._E + ", c AS (SELECT u AS node, u AS component FROM w UNION SELECT w.v, c.component FROM c JOIN w ON w.u = c.node), p AS (SELECT node, min(component) AS component FROM c GROUP BY 1) SELECT component, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3",
    "upkeep_keyword_patterns": f"WITH w AS (SELECT id, unnest(list_distinct({_T})) AS term FROM memories) SELECT term, count(*) AS n FROM w WHERE length(term) > 3 AND term NOT IN {_STOP} GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 20",
    "upkeep_tag_patterns": "WITH t AS (SELECT unnest(list_distinct(CAST(metadata_json->'$.tags' AS VARCHAR[]))) AS tag FROM (SELECT metadata_json FROM memories WHERE json_valid(metadata_json))) SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "upkeep_busiest_hour": "WITH c AS (SELECT tenant_id, hour(occurred_at) AS hour, count(*) AS n FROM memory_events GROUP BY 1, 2) SELECT tenant_id, hour, n FROM c QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, hour) = 1",
    "upkeep_anomalies": "WITH w AS (SELECT event_id, value, avg(value) OVER x AS mean, stddev_samp(value) OVER x AS sd FROM events WINDOW x AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) SELECT event_id FROM w WHERE sd > 0 AND abs(value - mean) > 2.5 * sd",
    "upkeep_z_scores": "WITH m AS (SELECT id, confidence, avg(confidence) OVER (PARTITION BY kind) AS mean, stddev_samp(confidence) OVER (PARTITION BY kind) AS sd FROM memories WHERE confidence IS NOT NULL) SELECT id, round(CASE WHEN sd > 0 THEN (confidence - mean) / sd ELSE 0 END, 5) AS z FROM m",
    "upkeep_schema_errors": """
WITH e AS (SELECT id, payload_json AS p, json_valid(payload_json) AS ok, CASE WHEN json_valid(payload_json) THEN payload_json->'$.memory_id' END AS m,
  CASE WHEN json_valid(payload_json) THEN payload_json->'$.confidence' END AS c, CASE WHEN json_valid(payload_json) THEN payload_json->>'$.kind' END AS k FROM memory_events),
x AS (SELECT id, list_filter([CASE WHEN p IS NOT NULL AND NOT ok THEN 'broken' END, CASE WHEN ok AND (m IS NULL OR json_type(m) = 'NULL') THEN 'memory_id is missing' END,
  CASE WHEN ok AND (c IS NULL OR json_type(c) = 'NULL') THEN 'confidence is missing' END, CASE WHEN k IS NOT NULL AND k NOT IN ('fact', 'observation') THEN 'kind is unknown' END], lambda v: v IS NOT NULL) AS errors FROM e)
SELECT id, len(errors) AS n_errors, coalesce(array_to_string(errors, ','), '') AS errors FROM x""",
    "upkeep_pattern_matches": "WITH k AS (SELECT lower(trim(event_type)) AS kind, count(*) AS n FROM memory_events GROUP BY 1), p AS (SELECT unnest(['re*', '*ed', 'for?otten', '*', 'x.y']) AS pattern) SELECT pattern, kind, n FROM k JOIN p ON kind GLOB pattern",
    "upkeep_merged_hits": _H + "SELECT id, round(max(score) * (1 + 0.15::DOUBLE * ln(count(*))), 6) AS score, count(*) AS hits FROM hits GROUP BY 1",
    "upkeep_tier_merge": _H + ", t AS (SELECT id, least(1.0, score * CASE q WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 ELSE 0.9 END) AS score, CASE q WHEN 1 THEN 'hot' WHEN 2 THEN 'warm' ELSE 'cold' END AS tier, q FROM hits) SELECT id, round(score, 6) AS score, tier FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, q) = 1",
    "upkeep_goal_progress": "WITH c AS (SELECT n_regionkey AS k, avg(n_nationkey / 25::DOUBLE) AS rolled, count(*) AS n FROM nation GROUP BY 1) SELECT 'n' || n_nationkey AS goal, round(n_nationkey / 25::DOUBLE, 6) AS rolled, CAST(0 AS BIGINT) AS children FROM nation UNION ALL SELECT 'r' || r_regionkey, round(coalesce(rolled, 0.0), 6), coalesce(n, 0) FROM region LEFT JOIN c ON k = r_regionkey",
    "upkeep_access_levels": "SELECT agent_id AS agent, kind AS item, CAST(max(CASE WHEN confidence > 0.8 THEN 3 WHEN confidence > 0.5 THEN 2 ELSE 1 END) AS BIGINT) AS level FROM memories WHERE valid_to IS NULL OR valid_to > TIMESTAMP '2018-03-01' GROUP BY 1, 2",
    "upkeep_expired": "SELECT scope_key, id FROM memories WHERE created_at >= TIMESTAMP '2018-03-01' - INTERVAL 1080 HOUR QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, id) <= 10",
    "upkeep_query_parts": """
WITH t AS (SELECT doc_id, lower(trim(title)) AS whole FROM documents WHERE title IS NOT NULL),
p AS (SELECT doc_id, 0 AS pos, whole AS part FROM t
  UNION ALL SELECT doc_id, i, trim(x[i]) FROM (SELECT doc_id, regexp_split_to_array(whole, '[ \\t\\n\\r\\f\\v]+(?:and|or|but|then)[ \\t\\n\\r\\f\\v]+|[?;][ \\t\\n\\r\\f\\v]*') AS x FROM t), unnest(range(1, len(x) + 1)) AS u(i) WHERE length(trim(x[i])) >= 3),
f AS (SELECT doc_id, part, min(pos) AS pos FROM p GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS no, part FROM f
""",
}
