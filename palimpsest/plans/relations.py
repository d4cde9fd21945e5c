"""Graphs, ordered rows, event windows and the relational surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph, lambda_view, sequence
from palimpsest.session import table


def _edges(s, d):
    return table(s, d, "memory_evidence").select("memory_id", "source_memory_id").where("memory_id <> source_memory_id").distinct()


def _two_way(s, d):
    one = _edges(s, d).withColumn("weight", F.lit(0.5))
    return graph.undirected(one, "memory_id", "source_memory_id", "weight").distinct()


def _seeds(s, d):
    return _two_way(s, d).select(F.col("u").alias("seed")).where("substring(seed, 1, 1) = '0'").distinct()


def _all_seeds(s, d):
    return _two_way(s, d).select(F.col("u").alias("seed")).distinct()


def _events(s, d):
    return table(s, d, "events")


def _chain(s, d):
    return sequence.linked(_events(s, d), "user_id", ["ts", "event_id"], "event_id")


def _limit(s, d):
    return sequence.fixed_window_limit(_events(s, d), "user_id", "ts", 6 * 3600, 2, "event_id").select("event_id", "window_start", F.col("seq").cast("bigint").alias("seq"), "allowed")


def _sessions(s, d):
    e = _events(s, d).select("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w"), "value")
    return e.groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def _fill(s, d):
    m = table(s, d, "memories").select("scope_key", "id", "created_at", F.length("content").alias("size"))
    return sequence.greedy_fill(m, "scope_key", ["created_at", "id"], "size", 4000, "id")


def _anchored(s, d):
    c = sequence.anchored_clusters(_events(s, d).select("user_id", "ts").distinct(), "user_id", "ts", 24)
    return sequence.cluster_summary(c, "user_id", "ts", 1).select("user_id", "first_at", "n")


def _as_of(s, d):
    e = _events(s, d)
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return sequence.as_of_join(buys, clicks, "user_id", "ts", "ts", "last_value").select("event_id", F.round("last_value", 6).alias("last_value"))


def _q1(s, d):
    l = table(s, d, "lineitem").where("l_shipdate <= '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def _q3(s, d):
    c = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.round(F.sum("rev"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def _hierarchy(s, d):
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _parts(s, d):
    p = table(s, d, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.select("p_partkey", "p_brand", F.rank().over(w).cast("bigint").alias("rnk"), F.ntile(4).over(w).cast("bigint").alias("quartile"), F.round(F.col("p_retailprice") - F.lag("p_retailprice").over(w), 4).alias("step"))


QUERIES = {
    "graph_components": lambda s, d: graph.connected_components(_edges(s, d), "memory_id", "source_memory_id"),
    "graph_two_hops": lambda s, d: graph.neighbours(_two_way(s, d), _seeds(s, d), 2).select("seed", "node", F.col("hop").cast("bigint").alias("hop")),
    "graph_two_hops_whole": lambda s, d: graph.neighbours(_two_way(s, d), _all_seeds(s, d), 2).select("seed", "node", F.col("hop").cast("bigint").alias("hop")),
    "graph_spread": lambda s, d: graph.spread(_two_way(s, d), _seeds(s, d).select(F.col("seed").alias("node"), F.lit(1.0).alias("energy"))).select("node", F.round("energy", 6).alias("energy")),
    "graph_degrees": lambda s, d: graph.degrees(_two_way(s, d)).select("node", "degree", F.round("strength", 6).alias("strength")),
    "graph_triangles": lambda s, d: graph.triangles(_two_way(s, d)),
    "graph_stats": lambda s, d: graph.degrees(_two_way(s, d)).agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("ends"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree")),
    "events_chain": lambda s, d: _chain(s, d).select("event_id", "previous_id", "next_id"),
    "events_broken_links": lambda s, d: sequence.broken_links(_chain(s, d).where("event_type <> 'purchase'"), "event_id"),
    "events_rate_limit": _limit,
    "events_tumbling": lambda s, d: _events(s, d).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")),
    "events_sessions": _sessions,
    "events_heatmap": lambda s, d: sequence.heatmap(_events(s, d), "ts").select(F.col("weekday").cast("bigint").alias("weekday"), F.col("hour").cast("bigint").alias("hour"), "n"),
    "events_as_of": _as_of,
    "events_anchored_clusters": _anchored,
    "events_glob": lambda s, d: _events(s, d).where(tx.glob(F.col("event_type"), "*[ck]")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "events_running": lambda s, d: _events(s, d).select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)), 4).alias("last_three")),
    "memory_greedy_fill": _fill,
    "rel_pricing_summary": _q1,
    "rel_top_orders": _q3,
    "rel_region_cube": _hierarchy,
    "rel_part_windows": _parts,
    "rel_customers_without_orders": lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "rel_keys_in_both": lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))),
    "rel_keys_in_one": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(s, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()),
    "rel_grouping_sets": lambda s, d: s.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id() AS level FROM {o} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", o=table(s, d, "orders")).withColumn("level", F.col("level").cast("bigint")),
    "rel_value_percentiles": lambda s, d: _events(s, d).groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 5).alias("median"), F.round(F.expr("percentile(value, 0.95)"), 5).alias("p95"), F.round(F.stddev_samp("value"), 5).alias("sd")),
    "rel_unpivot": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal"), F.col("s_nationkey").cast("double").alias("s_nationkey")).unpivot("s_suppkey", ["s_acctbal", "s_nationkey"], "field", "amount"),
    "rel_order_gaps": lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_diff("o_orderdate", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).cast("bigint").alias("days")),
    "rel_top_parts_by_region": lambda s, d: sequence.keep_best(
        table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty")),
        "s_nationkey", [F.desc("qty"), F.col("l_partkey")], 3).withColumn("pos", F.col("pos").cast("bigint")),
    "rel_status_pivot": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"}),
}

_E = "WITH RECURSIVE e AS (SELECT DISTINCT memory_id AS a, source_memory_id AS b FROM memory_evidence WHERE memory_id <> source_memory_id), w AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e)"

SQL = {
    "graph_components": _E + ", c AS (SELECT u AS node, u AS component FROM w UNION SELECT w.v, c.component FROM c JOIN w ON w.u = c.node) SELECT node, min(component) AS component FROM c GROUP BY 1",
    "graph_two_hops": _E + ", h AS (SELECT DISTINCT u AS seed, u AS node, 0 AS hop FROM w WHERE substring(u, 1, 1) = '0' UNION SELECT h.seed, w.v, h.hop + 1 FROM h JOIN w ON w.u = h.node WHERE h.hop < 2) SELECT seed, node, CAST(min(hop) AS BIGINT) AS hop FROM h GROUP BY 1, 2",
    "graph_two_hops_whole": _E + ", h AS (SELECT u AS seed, u AS node, 0 AS hop FROM w UNION SELECT u, v, 1 FROM w UNION SELECT x.u, y.v, 2 FROM w x JOIN w y ON x.v = y.u) SELECT seed, node, CAST(min(hop) AS BIGINT) AS hop FROM h GROUP BY 1, 2",
    "graph_spread": _E + ", h AS (SELECT DISTINCT u AS node, 1.0::DOUBLE AS energy, 0 AS hop FROM w WHERE substring(u, 1, 1) = '0' UNION SELECT w.v, h.energy * 0.35::DOUBLE, h.hop + 1 FROM h JOIN w ON w.u = h.node WHERE h.hop < 2) SELECT node, round(max(energy), 6) AS energy FROM h WHERE energy >= 0.01 GROUP BY 1",
    "graph_degrees": _E + " SELECT u AS node, count(*) AS degree, round(count(*) * 0.5::DOUBLE, 6) AS strength FROM w GROUP BY 1",
    "graph_triangles": _E + ", t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM w x JOIN w y ON x.v = y.u JOIN w z ON z.u = y.v AND z.v = x.u WHERE x.u < x.v AND x.v < y.v) SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1",
    "graph_stats": _E + ", g AS (SELECT u, count(*) AS degree FROM w GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS ends, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree FROM g",
    "events_chain": "SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "events_broken_links": "WITH c AS (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events), k AS (SELECT * FROM c WHERE event_type <> 'purchase') SELECT event_id, previous_id FROM k WHERE previous_id IS NOT NULL AND previous_id NOT IN (SELECT event_id FROM k)",
    "events_rate_limit": "WITH w AS (SELECT *, make_timestamp(CAST(floor(epoch_us(ts) / 1000000 / 21600) AS BIGINT) * 21600 * 1000000) AS window_start FROM events) SELECT event_id, window_start, row_number() OVER x AS seq, row_number() OVER x <= 2 AS allowed FROM w WINDOW x AS (PARTITION BY user_id, window_start ORDER BY ts, event_id)",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, no",
    "events_heatmap": "WITH g AS (SELECT CAST(i // 24 AS BIGINT) AS weekday, CAST(i % 24 AS BIGINT) AS hour FROM range(168) t(i)), c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.weekday, g.hour, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.weekday = g.weekday AND c.hour = g.hour",
    "events_as_of": "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) SELECT event_id, round(v, 6) AS last_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "events_glob": "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^.*[ck]$') GROUP BY 1",
    "events_running": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three FROM events",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rel_top_orders": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "rel_region_cube": "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)",
    "rel_part_windows": "SELECT p_partkey, p_brand, rank() OVER w AS rnk, ntile(4) OVER w AS quartile, round(p_retailprice - lag(p_retailprice) OVER w, 4) AS step FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)",
    "rel_customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "rel_keys_in_both": "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier",
    "rel_keys_in_one": "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem",
    "rel_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rel_value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.95), 5) AS p95, round(stddev_samp(value), 5) AS sd FROM events GROUP BY 1",
    "rel_unpivot": "SELECT s_suppkey, 's_acctbal' AS field, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier",
    "rel_order_gaps": "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rel_top_parts_by_region": "WITH q AS (SELECT s_nationkey, l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY qty DESC, l_partkey) AS pos FROM q QUALIFY pos <= 3",
    "rel_status_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "memory_greedy_fill": """
WITH RECURSIVE o AS (SELECT scope_key, id, length(coalesce(content, '')) AS size, row_number() OVER (PARTITION BY scope_key ORDER BY created_at, id) AS r FROM memories),
g(scope_key, id, r, kept, used) AS (
  SELECT scope_key, id, r, size <= 4000, CASE WHEN size <= 4000 THEN size ELSE 0 END FROM o WHERE r = 1
  UNION ALL SELECT o.scope_key, o.id, o.r, g.used + o.size <= 4000, CASE WHEN g.used + o.size <= 4000 THEN g.used + o.size ELSE g.used END FROM g JOIN o ON o.scope_key IS NOT DISTINCT FROM g.scope_key AND o.r = g.r + 1)
SELECT scope_key, id, kept, used::BIGINT AS used FROM g
""",
    "events_anchored_clusters": """
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL)),
c(user_id, ts, r, first_at) AS (
  SELECT user_id, ts, r, ts FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.ts, o.r, CASE WHEN o.ts - c.first_at > INTERVAL 24 HOUR THEN o.ts ELSE c.first_at END FROM c JOIN o ON o.user_id IS NOT DISTINCT FROM c.user_id AND o.r = c.r + 1)
SELECT user_id, first_at, count(*) AS n FROM c GROUP BY 1, 2
""",
}
