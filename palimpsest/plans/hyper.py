"""Algebra of binary and float hypervectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import hdv
from palimpsest.operators import dense
from palimpsest.plans.corpus import _codes, _emb
from palimpsest.session import table


def _regions(s, d):
    """One bundle a region, the first hexadecimal digit of a vector: at most 16 rows."""
    return hdv.majority(_codes(s, d).withColumn("region", F.substring(F.hex("vector"), 1, 1)), ["region"])


def _context(s, d):
    return hdv.majority(_codes(s, d), [])


def _attention(s, d):
    probes = _regions(s, d).select("region", F.col("v").alias("q"))
    context = _context(s, d).select(F.col("v").alias("c"))
    both = _codes(s, d).crossJoin(F.broadcast(probes.crossJoin(F.broadcast(context))))  # at most 16 rows
    score = hdv.attention(F.col("q"), F.col("c"), F.col("v"))
    best = both.select("region", "key", F.round(score, 8).alias("score")).groupBy("region").agg(F.max(F.struct("score", "key")).alias("b"), F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return best.select("region", F.col("b.key").alias("key"), F.col("b.score").alias("score"), "n", "mean")


def _gain(s, d):
    both = _codes(s, d).crossJoin(F.broadcast(_context(s, d).select(F.col("v").alias("c"))))  # one row
    return both.select("key", F.round(hdv.hamming(F.col("v"), F.col("c")) / 1024, 8).alias("gain"))


def _analogy(s, d):
    r = _regions(s, d).select("region", "v")
    first = r.where("region = '0'").select(F.col("v").alias("a"))
    second = r.where("region = '1'").select(F.col("v").alias("b"))
    wanted = r.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second)).select(F.col("region").alias("c"), hdv.bind(hdv.bind(F.col("a"), F.col("b")), F.col("v")).alias("w"))
    both = wanted.crossJoin(F.broadcast(r.select(F.col("region").alias("d"), "v")))  # 16 by 16
    return both.select("c", "d", F.round(hdv.similarity(F.col("w"), F.col("v")), 8).alias("similarity"))


def _means(s, d):
    return dense.superposed(_emb(s, d).where("embedding is not null"), ["label"], "embedding").withColumnRenamed("embedding", "total")


def _bound(s, d):
    both = _emb(s, d).where("embedding is not null").join(_means(s, d), "label")
    c = both.select("vec_id", dense.bound(F.col("embedding"), F.col("total")).alias("b"), "embedding")
    return c.select("vec_id", F.posexplode("b").alias("i", "x")).where("i % 16 = 0").select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 4).alias("x"))


def _rolled(s, d):
    r = _emb(s, d).where("embedding is not null").select("vec_id", dense.rolled(F.col("embedding"), 5).alias("r"))
    return r.select("vec_id", F.posexplode("r").alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _quantised(s, d):
    q = lambda c: F.transform(c, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))
    both = _emb(s, d).where("embedding is not null").join(dense.superposed(_emb(s, d).where("embedding is not null"), ["label"], "embedding").withColumnRenamed("embedding", "c"), "label")
    return both.select("vec_id", dense.quantised_distance(q(F.col("embedding")), q(F.col("c"))).alias("distance"))


def _evidence_texts(s, d):
    m = table(s, d, "memories").select("id", "content")
    e = table(s, d, "memory_evidence").select("memory_id", "source_memory_id").distinct()
    return e.join(m.toDF("memory_id", "a"), "memory_id").join(m.toDF("source_memory_id", "b"), "source_memory_id")


def _short(s, d):
    code = hdv.short_codes()
    c = _evidence_texts(s, d).select("memory_id", "source_memory_id", code(F.col("a")).alias("x"), code(F.col("b")).alias("y"))
    differ = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.bit_count(F.conv(F.hex(F.substring("x", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint").bitwiseXOR(F.conv(F.hex(F.substring("y", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")))), F.lit(0), lambda a, b: a + b)
    return c.select("memory_id", "source_memory_id", F.round(1 - differ / 256, 8).alias("similarity"))


def _fingerprints(s, d):
    return _evidence_texts(s, d).select("memory_id", "source_memory_id", F.round(hdv.fingerprint_similarity()(F.col("a"), F.col("b")), 8).alias("similarity"))


QUERIES = {
    "vector_attention": _attention,
    "vector_information_gain": _gain,
    "vector_analogy": _analogy,
    "vector_short_codes": _short,
    "vector_fingerprints": _fingerprints,
    "dense_bound": _bound,
    "dense_rolled": _rolled,
    "dense_superposed": lambda s, d: _means(s, d).select("label", F.posexplode("total").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 4).alias("x")),
    "dense_quantised_distance": _quantised,
}

_V = """
v AS (SELECT DISTINCT key, vector::BIT AS b, substring(hex(vector), 1, 1) AS region FROM vectors WHERE key IS NOT NULL AND dimension = 1024 AND octet_length(vector) = 128),
bits AS (SELECT region, i, get_bit(b, i::INTEGER) AS bit FROM v, unnest(range(0, 1024)) AS u(i)),
rb AS (SELECT region, i, sum(bit) * 2 > count(*) AS one FROM bits GROUP BY 1, 2),
r AS (SELECT region, string_agg(CASE WHEN one THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS b FROM rb GROUP BY 1),
cb AS (SELECT i, sum(bit) * 2 > count(*) AS one FROM bits GROUP BY 1),
c AS (SELECT string_agg(CASE WHEN one THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS b FROM cb)
"""
_T = """
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL),
t AS (SELECT label, i, sum(x) AS t FROM x GROUP BY 1, 2)
"""

SQL = {
    "vector_attention": f"""
WITH {_V},
s AS (SELECT r.region, key, round(0.6::DOUBLE * (1 - bit_count(xor(r.b, v.b)) / 1024) + 0.4::DOUBLE * (1 - bit_count(xor(xor(r.b, c.b), v.b)) / 1024), 8) AS score FROM r, c, v)
SELECT region, arg_max(key, row(score, key)) AS key, max(score) AS score, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY 1
""",
    "vector_information_gain": f"WITH {_V} SELECT key, round(bit_count(xor(v.b, c.b)) / 1024, 8) AS gain FROM v, c",
    "vector_analogy": f"""
WITH {_V}
SELECT p.region AS c, q.region AS d, round(1 - bit_count(xor(xor(xor(a.b, z.b), p.b), q.b)) / 1024, 8) AS similarity FROM r a, r z, r p, r q WHERE a.region = '0' AND z.region = '1'
""",
    "dense_bound": f"""
WITH {_T}, n AS (SELECT vec_id, count(*) AS n FROM x GROUP BY 1)
SELECT x.vec_id, o.i::BIGINT AS i, round(sum(x.x * t.t), 4) AS x FROM x JOIN n USING (vec_id), LATERAL (SELECT unnest(range(0, n.n)) AS i) o JOIN t ON t.label = x.label AND t.i = (o.i - x.i + n.n) % n.n
WHERE o.i % 16 = 0 GROUP BY 1, 2
""",
    "dense_rolled": "SELECT vec_id, ((generate_subscripts(embedding, 1) - 1 + 5) % len(embedding))::BIGINT AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings WHERE embedding IS NOT NULL",
    "dense_superposed": f"WITH {_T} SELECT label, i::BIGINT AS i, round(t, 4) AS x FROM t",
    "dense_quantised_distance": f"""
WITH {_T}, q AS (SELECT vec_id, greatest(0, least(255, floor((x + 1) * 127.5)))::BIGINT AS a, greatest(0, least(255, floor((t + 1) * 127.5)))::BIGINT AS b FROM x JOIN t USING (label, i))
SELECT vec_id, sum((a - b) * (a - b))::BIGINT AS distance FROM q GROUP BY 1
""",
}
