"""Association networks and erasure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.functions import text as tx
from palimpsest.operators import erasure, graph, network, replay
from palimpsest.plans import problems
from palimpsest.plans.memory import _N, NOW, nodes
from palimpsest.session import table

WALK = 4


def _edges(s, d):
    one = table(s, d, "memory_evidence").where("memory_id <> source_memory_id").groupBy("memory_id", "source_memory_id")
    weighed = one.agg(F.max(0.3 + 0.05 * (F.coalesce(F.length("relation"), F.lit(0)) % 5)).alias("weight"))
    return graph.undirected(weighed, "memory_id", "source_memory_id", "weight").groupBy("u", "v").agg(F.max("weight").alias("weight"))


def _sources(s, d):
    return _edges(s, d).select(F.col("u").alias("source")).distinct()


def _hops(s, d):
    return network.shortest_paths(_edges(s, d), _sources(s, d)).select("source", "target", F.col("hops").cast("bigint").alias("hops"))


def _paths(s, d):
    p = network.simple_paths(_edges(s, d), _sources(s, d), 3, 0.25)
    return p.select("source", "target", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"), F.round("strength", 8).alias("strength"))


def _walks(s, d):
    return network.random_walks(_edges(s, d), _sources(s, d), WALK).select("source", F.array_join("path", ">").alias("path"))


def _firings(s, d):
    e = table(s, d, "memory_evidence").select(F.col("memory_id").alias("a"), F.col("source_memory_id").alias("b"))
    n = nodes(s, d).select("id", "created_at", "accesses")
    both = e.join(n.toDF("a", "ta", "na"), "a").join(n.toDF("b", "tb", "nb"), "b")
    return both.select("a", "b", network.strengthen_amount(F.lit(0.0), sc.seconds_between(F.col("ta"), F.col("tb")), (F.col("na") + F.col("nb")) / 2).alias("amount"))


def _reinforced(s, d):
    return network.reinforced(_firings(s, d)).select("a", "b", F.round("strength", 8).alias("strength"), "fired")


def _compacted(s, d):
    e = table(s, d, "memory_evidence").groupBy("memory_id", "source_memory_id").agg(F.max("created_at").alias("at"))
    days = sc.seconds_between(F.lit(NOW).cast("timestamp_ntz"), F.col("at")) / 86400
    return network.compacted(e, sc.half_life(F.lit(0.5), days, 14.0), 0.06).select("memory_id", "source_memory_id", F.round("strength", 8).alias("strength"))


def _without_inactive(s, d):
    gone = table(s, d, "memories").where("status <> 'active'").select(F.col("id").alias("node"))
    return network.without_nodes(_edges(s, d), gone).select("u", "v", F.round("weight", 6).alias("weight"))


def _healthy(s, d):
    n = nodes(s, d)
    return n.select("id", F.round(network.health(F.col("age_s") / 86400, F.col("idle_s") / 3600, F.col("accesses")), 6).alias("health"))


def _over(s, d):
    h = _healthy(s, d)
    return network.over_capacity(h, "id", "health", h.count() * 9 // 10)


def _redundant(s, d):
    m = table(s, d, "memories").select("id", "created_at", tx.tokens(F.col("content")).alias("w"))
    return network.redundant_nodes(m, "id", "w", "created_at", 0.8).select("keep_id", "remove_id", F.round("jaccard", 8).alias("jaccard"))


def _cross(s, d):
    return network.cross_domain_pairs(table(s, d, "memories"), "id", "scope_key", "kind", "created_at", 600)


def _labels(s, d):
    ends = _edges(s, d).select(F.col("u").alias("node")).distinct()
    return ends.join(table(s, d, "memories").select(F.col("id").alias("node"), F.substring("content", 1, 60).alias("label")), "node", "left")


def _communities(s, d):
    return graph.label_communities(_edges(s, d), 2)


def _erasure(s, d):
    m = table(s, d, "memories")
    asked = m.where("status = 'contradicted'").select("scope_key", "id")
    return erasure.Erasure(m, table(s, d, "memory_events"), table(s, d, "memory_evidence"), asked, cascade=True)


QUERIES = {
    "network_hops": _hops,
    "network_simple_paths": _paths,
    "network_walks": _walks,
    "network_reinforced": _reinforced,
    "network_compacted": _compacted,
    "network_without_inactive": _without_inactive,
    "network_health": _healthy,
    "network_over_capacity": _over,
    "network_redundant": _redundant,
    "network_cross_domain": _cross,
    "network_communities": _communities,
    "network_decayed": lambda s, d: graph.decayed(table(s, d, "memory_evidence").distinct().select("memory_id", "source_memory_id", "event_id", "relation", "created_at", F.lit(1.0).alias("weight")), datetime(2018, 2, 1), "created_at", 10.0, 0.3).select("memory_id", "source_memory_id", "event_id", "relation", "created_at", F.round("weight", 8).alias("weight")),
    "network_graphml": lambda s, d: network.graphml_lines(_labels(s, d), _edges(s, d).where("u < v")),
    "network_gexf": lambda s, d: network.gexf_lines(_labels(s, d), _edges(s, d).where("u < v")),
    "memory_rebuilt": lambda s, d: replay.rebuilt_memories(table(s, d, "memory_events")),
    "memory_supersessions": lambda s, d: erasure.supersession_links(table(s, d, "memory_events")),
    "erasure_memories": lambda s, d: _erasure(s, d).memories.select("id"),
    "erasure_events": lambda s, d: _erasure(s, d).events.select("id", "created_at"),
    "erasure_evidence": lambda s, d: _erasure(s, d).evidence.select("memory_id", "source_memory_id", "event_id", "relation"),
}

_E = """
e1 AS (SELECT memory_id AS u, source_memory_id AS v, max(0.3::DOUBLE + 0.05::DOUBLE * (coalesce(length(relation), 0) % 5)) AS weight
  FROM memory_evidence WHERE memory_id <> source_memory_id GROUP BY 1, 2),
e AS (SELECT u, v, max(weight) AS weight FROM (SELECT u, v, weight FROM e1 UNION ALL SELECT v, u, weight FROM e1) GROUP BY 1, 2)
"""
_STEPS = "".join(
    f""",
w{i} AS (SELECT source, CASE WHEN v IS NULL THEN path ELSE list_append(path, v) END AS path FROM w{i - 1} LEFT JOIN (
  SELECT source, arg_min(v, md5(concat_ws('|', 'walk', '{i}', source, v))) AS v FROM w{i - 1} JOIN e ON e.u = path[-1] WHERE len(path) = {i} GROUP BY 1) USING (source))"""
    for i in range(1, WALK + 1)
)
_VOTES = "".join(
    f""",
c{i} AS (SELECT u AS node, arg_max(label, rank) AS label FROM (
  SELECT u, label, row_number() OVER (PARTITION BY u ORDER BY w, label DESC) AS rank FROM (
    SELECT e.u, c.label, sum(round(e.weight, 6)::DECIMAL(18, 6)) AS w FROM e JOIN c{i - 1} c ON c.node = e.v GROUP BY 1, 2)) GROUP BY 1)"""
    for i in (1, 2)
)


def _xml(x: str) -> str:
    return f"""replace(replace(replace(replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


_ERASED = """
WITH RECURSIVE named AS (
  SELECT *, coalesce(memory_id, CASE WHEN json_valid(payload_json) THEN payload_json->>'$.memory_id' END) AS m,
    CASE WHEN json_valid(payload_json) THEN payload_json->>'$.replacement_memory_id' END AS r FROM memory_events),
links AS (SELECT DISTINCT m AS a, r AS b FROM named
  JOIN memories x ON x.id = m AND x.scope_key = named.scope_key JOIN memories y ON y.id = r AND y.scope_key = named.scope_key
  WHERE lower(trim(event_type)) = 'superseded' AND m <> r),
hit(id) AS (SELECT id FROM memories WHERE status = 'contradicted'
  UNION SELECT CASE WHEN l.a = hit.id THEN l.b ELSE l.a END FROM hit JOIN links l ON l.a = hit.id OR l.b = hit.id),
gone AS (SELECT DISTINCT id FROM named WHERE m IN (SELECT id FROM hit) AND id IS NOT NULL)
"""

SQL = {
    "network_hops": f"""
WITH RECURSIVE {_E},
r(source, target, hops) AS (SELECT DISTINCT u, v, 1 FROM e UNION SELECT source, e.v, hops + 1 FROM r JOIN e ON e.u = target WHERE e.v <> source AND hops < 24)
SELECT source, target, min(hops)::BIGINT AS hops FROM r WHERE source <> target GROUP BY 1, 2
""",
    "network_simple_paths": f"""
WITH {_E}, l AS (SELECT * FROM e WHERE weight >= 0.25),
a AS (SELECT u AS source, v AS target, 1 AS hops, [u, v] AS path, weight AS strength FROM l),
b AS (SELECT source, v, 2, list_append(path, v), strength * weight FROM a JOIN l ON l.u = target WHERE NOT list_contains(path, v)),
c AS (SELECT source, l.v, 3, list_append(q.path, l.v), q.strength * weight FROM b q(source, target, hops, path, strength) JOIN l ON l.u = q.target WHERE NOT list_contains(q.path, l.v))
SELECT source, target, hops::BIGINT AS hops, array_to_string(path, '>') AS path, round(strength, 8) AS strength
FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
""",
    "network_walks": f"WITH {_E}, w0 AS (SELECT DISTINCT u AS source, [u] AS path FROM e){_STEPS}\nSELECT source, array_to_string(path, '>') AS path FROM w{WALK}",
    "network_reinforced": _N
    + """, f AS (
  SELECT least(v.memory_id, v.source_memory_id) AS a, greatest(v.memory_id, v.source_memory_id) AS b,
    least(1.0, 0.115::DOUBLE * CASE WHEN abs(epoch_us(x.created_at) - epoch_us(y.created_at)) / 1e6 < 3600 THEN 1.2 WHEN abs(epoch_us(x.created_at) - epoch_us(y.created_at)) / 1e6 < 86400 THEN 1.1 ELSE 1.0 END
      * CASE WHEN (x.accesses + y.accesses) / 2.0 > 10 THEN 1.1 ELSE 1.0 END) AS amount
  FROM memory_evidence v JOIN nodes x ON x.id = v.memory_id JOIN nodes y ON y.id = v.source_memory_id WHERE v.memory_id <> v.source_memory_id)
SELECT a, b, round(1 - 0.99::DOUBLE * exp(sum(ln(1 - amount))), 8) AS strength, count(*) AS fired FROM f GROUP BY 1, 2
""",
    "network_compacted": """
SELECT memory_id, source_memory_id, round(s, 8) AS strength FROM (
  SELECT memory_id, source_memory_id, 0.5 * pow(2.0, -((epoch_us(TIMESTAMP '2018-03-01') - epoch_us(max(created_at))) / 1e6 / 86400) / 14.0) AS s
  FROM memory_evidence GROUP BY 1, 2) WHERE s >= 0.06
""",
    "network_without_inactive": f"""
WITH {_E}, gone AS (SELECT id FROM memories WHERE status <> 'active')
SELECT u, v, round(weight, 6) AS weight FROM e WHERE u NOT IN (SELECT id FROM gone) AND v NOT IN (SELECT id FROM gone)
""",
    "network_health": _N
    + """, h AS (SELECT id, round(greatest(0.0, least(1.0, 0.4 * exp(-0.693 * greatest(idle_s / 3600, 0.001) / 48) + 0.35 * least(1.0, ln(1 + accesses) / 5)
  + 0.25 * CASE WHEN accesses > 2 THEN least(1.0, ln(1 + greatest(age_s / 86400, 0.001)) / 4) ELSE 0.0 END)), 6) AS health FROM nodes)
SELECT id, health FROM h
""",
    "network_over_capacity": _N
    + """, h AS (SELECT id, round(greatest(0.0, least(1.0, 0.4 * exp(-0.693 * greatest(idle_s / 3600, 0.001) / 48) + 0.35 * least(1.0, ln(1 + accesses) / 5)
  + 0.25 * CASE WHEN accesses > 2 THEN least(1.0, ln(1 + greatest(age_s / 86400, 0.001)) / 4) ELSE 0.0 END)), 6) AS health FROM nodes)
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY health, id) AS r, count(*) OVER () AS n FROM h) WHERE r <= n - n * 9 // 10
""",
    "network_redundant": """
WITH w AS (SELECT DISTINCT id, created_at, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS x FROM memories),
n AS (SELECT id, created_at, count(*) AS n FROM w GROUP BY 1, 2),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
j AS (SELECT a, b, x.created_at AS ta, y.created_at AS tb, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b)
SELECT CASE WHEN coalesce(ta <= tb, true) THEN a ELSE b END AS keep_id, CASE WHEN coalesce(ta <= tb, true) THEN b ELSE a END AS remove_id, round(jaccard, 8) AS jaccard FROM j WHERE jaccard >= 0.8
""",
    "network_cross_domain": """
SELECT a.scope_key, a.id AS a, b.id AS b FROM memories a JOIN memories b ON a.scope_key = b.scope_key AND a.kind <> b.kind
  AND epoch_us(a.created_at) - epoch_us(b.created_at) BETWEEN 0 AND 600000000 AND (b.created_at < a.created_at OR b.id < a.id)
""",
    "network_communities": f"WITH {_E}, c0 AS (SELECT DISTINCT u AS node, u AS label FROM e){_VOTES}\nSELECT node, label FROM c2",
    "network_decayed": """
SELECT memory_id, source_memory_id, event_id, relation, created_at, round(w, 8) AS weight FROM (
  SELECT DISTINCT memory_id, source_memory_id, event_id, scope_key, relation, created_at, pow(2.0, -((epoch_us(TIMESTAMP '2018-02-01') - epoch_us(created_at)) / 1e6 / 86400) / 10.0) AS w FROM memory_evidence) WHERE w >= 0.3
""",
    "network_graphml": f"""
WITH {_E}, n AS (SELECT DISTINCT u AS node FROM e)
SELECT 'node' AS part, '<node id="' || {_xml("node")} || '"><data key="label">' || {_xml("substring(content, 1, 60)")} || '</data></node>' AS line FROM n LEFT JOIN memories ON id = node
UNION ALL SELECT 'edge', '<edge source="' || {_xml("u")} || '" target="' || {_xml("v")} || '"><data key="weight">' || printf('%.6f', weight) || '</data></edge>' FROM e WHERE u < v
""",
    "network_gexf": f"""
WITH {_E}, n AS (SELECT DISTINCT u AS node FROM e)
SELECT 'node' AS part, '<node id="' || {_xml("node")} || '" label="' || {_xml("substring(content, 1, 60)")} || '"/>' AS line FROM n LEFT JOIN memories ON id = node
UNION ALL SELECT 'edge', '<edge id="' || {_xml("u")} || '--' || {_xml("v")} || '" source="' || {_xml("u")} || '" target="' || {_xml("v")} || '" weight="' || printf('%.6f', weight) || '"/>' FROM e WHERE u < v
""",
    "memory_rebuilt": f"""
WITH now AS ({problems.SQL["p4_found"]}),
r AS (SELECT id, arg_min(occurred_at, created_at) AS at, arg_min(payload_json, created_at) AS payload FROM memory_events WHERE created_at IS NOT NULL GROUP BY 1)
SELECT memory_id, status, c.payload->>'$.content' AS content, c.payload->>'$.kind' AS kind, c.at AS content_at, l.at AS updated_at
FROM now LEFT JOIN r c ON c.id = content_event_id LEFT JOIN r l ON l.id = last_event_id
""",
    "memory_supersessions": """
WITH n AS (SELECT scope_key, coalesce(memory_id, CASE WHEN json_valid(payload_json) THEN payload_json->>'$.memory_id' END) AS a,
  CASE WHEN json_valid(payload_json) THEN payload_json->>'$.replacement_memory_id' END AS b FROM memory_events WHERE lower(trim(event_type)) = 'superseded')
SELECT DISTINCT scope_key, a, b FROM n WHERE a <> b
""",
    "erasure_memories": _ERASED + "SELECT id FROM memories WHERE id NOT IN (SELECT id FROM hit)",
    "erasure_events": _ERASED + "SELECT id, created_at FROM named WHERE m IS NULL OR m NOT IN (SELECT id FROM hit)",
    "erasure_evidence": _ERASED
    + """SELECT memory_id, source_memory_id, event_id, relation FROM memory_evidence
WHERE memory_id NOT IN (SELECT id FROM hit) AND source_memory_id NOT IN (SELECT id FROM hit) AND event_id NOT IN (SELECT id FROM gone)""",
}
