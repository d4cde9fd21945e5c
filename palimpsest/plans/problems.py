"""Queries of the general data problems: late events and change feeds."""

from __future__ import annotations

from palimpsest.operators import lambda_view, replay
from palimpsest.session import shared_folder, table
from palimpsest.streaming.lambda_store import LambdaStore, corrected_periods, played

_FIRST = """
first_rows AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY CASE WHEN idempotency_key IS NOT NULL THEN scope_key END, idempotency_key,
                   CASE WHEN idempotency_key IS NULL THEN id END
      ORDER BY created_at, id) AS rn
    FROM memory_events WHERE created_at IS NOT NULL) WHERE rn = 1)
"""

_COUNTS = f"""
WITH {_FIRST},
counts AS (
  SELECT tenant_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_day,
    count(*) FILTER (WHERE created_at < CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) + INTERVAL 25 HOUR) AS n_first,
    count(*) FILTER (WHERE created_at < CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) + INTERVAL 96 HOUR) AS n_final
  FROM first_rows WHERE occurred_at IS NOT NULL GROUP BY 1, 2)
"""


def _layers(s, d, view):
    return view(table(s, d, "memory_events"), LambdaStore(s, shared_folder(s, "lambda")))


QUERIES = {
    "p2_found": lambda s, d: _layers(s, d, corrected_periods),
    "p2_serving": lambda s, d: _layers(s, d, played),
    "p2_fast_layer": lambda s, d: lambda_view.fast_increments(lambda_view.dated_changes(table(s, d, "memory_events"))),
    "p4_found": lambda s, d: replay.current_memories(table(s, d, "memory_events")),
    "p4_committed": lambda s, d: replay.committed_changes(_order_parts(s, d)).select("tx_id", "part_no"),
    "p4_committed_whole": lambda s, d: replay.committed_changes(_whole_order_parts(s, d), block=1 << 12).select("tx_id", "part_no"),
}


def _order_parts(spark, sf_dir):
    """Order lines as transaction parts; parts with the largest discount got lost, so some orders leave a gap."""
    from pyspark.sql import functions as F

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").cast("long").alias("part_no"), "l_discount")
    numbered = lines.withColumn("commit_seq", F.col("tx_id"))
    sizes = numbered.groupBy("tx_id").agg(F.count_distinct("part_no").alias("tx_size"))
    return numbered.join(sizes, "tx_id").where(~((F.col("l_discount") >= 0.1) & (F.col("tx_id") > 500)))


def _whole_order_parts(spark, sf_dir, block: int = 1 << 16):
    """Order lines as transaction parts in a sequence without gaps of its own; parts got lost in the last tenth only."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").cast("long").alias("part_no"), "l_discount")
    sizes = lines.groupBy("tx_id").agg(F.count_distinct("part_no").alias("tx_size")).withColumn("b", F.floor(F.col("tx_id") / block))
    # orders are numbered within blocks of keys; only the blocks' counts are summed in one task
    before = F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("before", before)
    place = F.row_number().over(Window.partitionBy("b").orderBy("tx_id"))
    numbered = sizes.withColumn("n", place).join(starts, "b").select("tx_id", "tx_size", (F.col("before") + F.col("n")).alias("commit_seq"))
    late = lines.agg((F.max("tx_id") * 0.9).alias("late"))
    kept = lines.crossJoin(F.broadcast(late)).where(~((F.col("l_discount") >= 0.1) & (F.col("tx_id") > F.col("late")))).drop("late")
    return kept.join(numbered, "tx_id")


SQL = {
    "p2_found": _COUNTS + "SELECT * FROM counts WHERE n_first <> n_final",
    "p2_serving": _COUNTS + "SELECT *, true AS frozen FROM counts",
    "p2_fast_layer": f"""
WITH {_FIRST}
SELECT tenant_id, CAST(occurred_at AS DATE) AS day, date_trunc('hour', created_at) AS arrival_hour,
  count(*) FILTER (WHERE created_at < CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) + INTERVAL 96 HOUR) AS n
FROM first_rows WHERE occurred_at IS NOT NULL GROUP BY 1, 2, 3
""",
    "p4_found": f"""
WITH {_FIRST},
ch AS (
  SELECT id, occurred_at, created_at, lower(trim(event_type)) AS kind, json_valid(payload_json) AS ok,
    coalesce(memory_id, CASE WHEN json_valid(payload_json) THEN payload_json->>'$.memory_id' END) AS memory_id,
    CASE WHEN json_valid(payload_json) THEN (payload_json->>'$.content') IS NOT NULL ELSE false END AS has_content
  FROM first_rows),
a AS (
  SELECT *, coalesce(max(CASE WHEN kind = 'remembered' THEN 1 ELSE 0 END)
      OVER (PARTITION BY memory_id ORDER BY occurred_at, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known
  FROM ch WHERE ok AND memory_id IS NOT NULL
    AND kind IN ('remembered', 'reinforced', 'superseded', 'contradicted', 'forgotten', 'restored')),
b AS (SELECT *, kind = 'remembered' OR (kind = 'restored' AND known = 1) AS life FROM a),
c AS (SELECT *, CASE WHEN life THEN 1 WHEN kind = 'forgotten' THEN 0 END AS lived FROM b),
d AS (SELECT *, coalesce(last_value(lived IGNORE NULLS)
      OVER (PARTITION BY memory_id ORDER BY occurred_at, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alive FROM c),
e AS (SELECT *, life OR (alive = 1 AND kind <> 'restored') AS effective FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY occurred_at, created_at, id) AS pos FROM e)
SELECT memory_id,
  arg_max(CASE WHEN life THEN 'active' ELSE kind END, pos) FILTER (WHERE life OR (effective AND kind IN ('superseded', 'contradicted'))) AS status,
  arg_max(id, pos) FILTER (WHERE effective AND kind <> 'forgotten' AND has_content) AS content_event_id,
  arg_max(id, pos) FILTER (WHERE effective) AS last_event_id
FROM f GROUP BY memory_id HAVING arg_max(lived, pos) FILTER (WHERE lived IS NOT NULL) = 1
""",
    "p4_committed": """
WITH parts AS (SELECT l_orderkey AS tx_id, CAST(l_linenumber AS BIGINT) AS part_no, l_discount FROM lineitem),
sizes AS (SELECT tx_id, count(DISTINCT part_no) AS n FROM parts GROUP BY 1),
kept AS (SELECT * FROM parts WHERE NOT (l_discount >= 0.1 AND tx_id > 500)),
done AS (SELECT tx_id FROM kept JOIN sizes USING (tx_id) GROUP BY tx_id, n HAVING count(DISTINCT part_no) >= n),
run AS (SELECT tx_id, row_number() OVER (ORDER BY tx_id) AS r FROM done WHERE tx_id >= 1)
SELECT DISTINCT tx_id, part_no FROM kept WHERE tx_id IN (SELECT tx_id FROM run WHERE tx_id = r)
""",
    "p4_committed_whole": """
WITH parts AS (SELECT l_orderkey AS tx_id, CAST(l_linenumber AS BIGINT) AS part_no, l_discount FROM lineitem),
sizes AS (SELECT tx_id, count(DISTINCT part_no) AS n, row_number() OVER (ORDER BY tx_id) AS seq FROM parts GROUP BY 1),
kept AS (SELECT * FROM parts WHERE NOT (l_discount >= 0.1 AND tx_id > (SELECT max(tx_id) * 0.9::DOUBLE FROM parts))),
done AS (SELECT tx_id, seq FROM kept JOIN sizes USING (tx_id) GROUP BY tx_id, n, seq HAVING count(DISTINCT part_no) >= n),
run AS (SELECT tx_id, seq, row_number() OVER (ORDER BY seq) AS r FROM done)
SELECT DISTINCT tx_id, part_no FROM kept WHERE tx_id IN (SELECT tx_id FROM run WHERE seq = r)
""",
}
