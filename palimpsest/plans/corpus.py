"""Lexical retrieval, text statistics and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import hdv
from palimpsest.functions import text as tx
from palimpsest.operators import dense, lexical
from palimpsest.session import table

QUERY = "retrieval budget of the audit trail and memory shard"
KEYWORDS = {"ranking": ["rank", "score", "query"], "storage": ["shard", "cache", "index"], "planning": ["planner", "goal", "budget"]}


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source", "kind")


def memories(s, d):
    return table(s, d, "memories").select("id", "content")


def _rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _bm25(s, d):
    return lexical.bm25(docs(s, d), QUERY)


def _coverage(s, d):
    q = F.array(*[F.lit(w) for w in sorted(set(QUERY.split()))])
    # two numbers a memory, kept because two rankings read them
    return memories(s, d).select("id", F.round(tx.coverage(q, tx.tokens(F.col("content"))), 6).alias("coverage"), F.round(tx.jaccard(q, tx.tokens(F.col("content"))), 6).alias("jaccard")).persist()


def _fused(s, d):
    c = _coverage(s, d)
    lists = [lexical.ranked(c.withColumnRenamed(name, "score").where("score > 0"), "id", "score", 200) for name in ("coverage", "jaccard")]
    return _rounded(lexical.reciprocal_rank_fusion(lists, "id"), "rrf")


def _fused_whole(s, d):
    c = _coverage(s, d)
    lists = [lexical.ranked(c.withColumnRenamed(name, "score").where("score > 0"), "id", "score") for name in ("coverage", "jaccard")]
    return _rounded(lexical.reciprocal_rank_fusion(lists, "id"), "rrf")


def _blend(s, d):
    c = _coverage(s, d)
    return _rounded(lexical.alpha_blend(c.where("coverage > 0").select("id", F.col("coverage").alias("score")), c.where("jaccard > 0").select("id", F.col("jaccard").alias("score")), "id"), "blend")


def _chunks(s, d):
    return _rounded(lexical.chunk_scores(docs(s, d), QUERY).where("score > 0"), "score").select("doc_id", F.col("no").cast("bigint").alias("no"), F.col("start").cast("bigint").alias("start"), "score")


def _terms(s, d):
    p = lexical.postings(docs(s, d), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _sparse_weights(s, d):
    p = lexical.postings(memories(s, d), "id", "content")
    top = p.groupBy("id").agg(F.max("tf").alias("max_tf"), F.count(F.lit(1)).alias("terms"), F.sum(1 + F.log("tf")).alias("w"))
    return top.select("id", "terms", F.round(F.col("w") / (1 + F.log("max_tf")), 5).alias("weight"))


def _codes(s, d):
    v = table(s, d, "vectors").where(f"key is not null and dimension = 1024 and length(vector) = 128").select("key", "vector").distinct()
    return v.withColumn("v", hdv.limbs_of(F.col("vector")))


def _hamming(s, d):
    v = _codes(s, d)
    probe = v.orderBy("key", "vector").limit(1).select(F.col("v").alias("q"))
    both = v.crossJoin(F.broadcast(probe))  # one row
    return both.select("key", hdv.hamming(F.col("v"), F.col("q")).cast("bigint").alias("distance"), F.round(hdv.similarity(F.col("v"), F.col("q")), 6).alias("similarity"), hdv.ones(hdv.bind(F.col("v"), F.col("q"))).cast("bigint").alias("bound_ones"))


def _emb(s, d):
    return table(s, d, "embeddings")


def _nearest(s, d):
    e = _emb(s, d)
    out = dense.nearest_in_blocks(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _quantised(s, d):
    e = _emb(s, d).select("vec_id", "embedding", F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"))
    q = e.withColumn("q", dense.quantise(F.col("embedding"), F.col("lo"), F.col("hi")))
    back = dense.dequantise(F.col("q"), F.col("lo"), F.col("hi"))
    worst = F.aggregate(F.zip_with("embedding", back, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return q.select("vec_id", total.alias("total"), (worst <= (F.col("hi") - F.col("lo")) / 255 + 1e-9).alias("within_step"))


def _centroids(s, d):
    e = _emb(s, d).select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.count(F.lit(1)).alias("n"))


def _bundle(s, d):
    v = _codes(s, d).withColumn("region", F.substring(F.hex("vector"), 1, 1))
    return hdv.majority(v, ["region"]).select("region", "members", hdv.ones(F.col("v")).cast("bigint").alias("ones"))


def _encoded(s, d):
    m = memories(s, d)
    v = m.select("id", hdv.encoder()(F.col("content")).alias("v"))
    return v.select("id", hdv.ones(F.col("v")).cast("bigint").alias("ones"), F.round(hdv.bit_entropy(F.col("v")), 6).alias("entropy"))


def _pq(s, d):
    e = _emb(s, d).select("vec_id", "embedding")
    parts = 8
    books = dense.train_codebooks(e, "embedding", parts)
    codes = dense.pq_encode(e, "vec_id", "embedding", books)
    probe = e.where("embedding is not null").orderBy("vec_id").limit(1).first()
    return dense.pq_distances(codes, list(probe["embedding"]), books).select("vec_id", "codes", F.round("distance", 5).alias("distance"))


QUERIES = {
    "corpus_bm25": lambda s, d: _rounded(_bm25(s, d), "score"),
    "corpus_bm25_top": lambda s, d: _rounded(lexical.ranked(_rounded(_bm25(s, d), "score"), "doc_id", "score", 20), "score").select("doc_id", "score", F.col("rank").cast("bigint").alias("rank")),
    "corpus_coverage": _coverage,
    "corpus_rrf": _fused,
    "corpus_rrf_whole": _fused_whole,
    "corpus_alpha_blend": _blend,
    "corpus_chunk_scores": _chunks,
    "corpus_terms": _terms,
    "corpus_lengths": lambda s, d: lexical.lengths(docs(s, d), "doc_id", "text").select("doc_id", F.col("dl").cast("bigint").alias("dl")),
    "corpus_sparse_weights": _sparse_weights,
    "corpus_keywords": lambda s, d: _terms(s, d).where("length(term) > 3 and df >= 3").orderBy(F.desc("df"), "term").limit(20),
    "corpus_domain": lambda s, d: docs(s, d).select("doc_id", tx.domain(F.col("text"), KEYWORDS, "operational").alias("domain")),
    "corpus_query_id": lambda s, d: docs(s, d).select("doc_id", tx.query_id(F.coalesce("source", F.lit(""))).alias("query_id")),
    "corpus_source_rollup": lambda s, d: docs(s, d).rollup("kind", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")),
    "vector_hamming": _hamming,
    "vector_bits": lambda s, d: _codes(s, d).select("key", F.hex("vector").alias("code"), hdv.ones(F.col("v")).cast("bigint").alias("ones"), F.round(hdv.bit_entropy(F.col("v")), 6).alias("entropy"), hdv.ones(hdv.invert(F.col("v"))).cast("bigint").alias("zeros"), hdv.hamming(F.col("v"), hdv.permute(hdv.permute(F.col("v"), 77), -77)).cast("bigint").alias("turned_back")),
    "vector_bundles": _bundle,
    "vector_encoded_text": _encoded,
    "vector_compression_stats": lambda s, d: table(s, d, "compressed_vectors").groupBy(F.lower(F.trim("method")).alias("method"), "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("compressed_size_bytes").alias("bytes"), F.round(F.avg("confidence"), 6).alias("confidence")),
    "dense_nearest": _nearest,
    "dense_quantised": _quantised,
    "dense_label_means": _centroids,
    "dense_product_quantised": _pq,
    "dense_medoids": lambda s, d: dense.k_medoids(_emb(s, d), "vec_id", "embedding", 8).select("vec_id", "medoid", F.round("distance", 5).alias("distance")),
    "dense_norms": lambda s, d: _emb(s, d).select("vec_id", F.round(dense.norm(F.col("embedding")), 5).alias("norm")),
}

_W = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_Q = sorted(set(QUERY.split()))
_D = f"WITH d AS (SELECT doc_id, coalesce({_W.format('text')}, []) AS w FROM documents), m AS (SELECT id, coalesce({_W.format('content')}, []) AS w FROM memories)"
_BM = (
    _D
    + ", c AS (SELECT doc_id, len(w) AS dl, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_Q))
    + " FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, "
    + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(_Q)))
    + " FROM c), bm AS (SELECT doc_id, "
    + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0.0::DOUBLE END" for i in range(len(_Q)))
    + " AS score FROM c, s)"
)
_QL = "[" + ", ".join(f"'{t}'" for t in _Q) + "]"
_COV = (
    _D
    + f", cov AS (SELECT id, round(len(list_intersect({_QL}, w)) / {len(_Q)}::DOUBLE, 6) AS coverage, "
    + f"round(len(list_intersect({_QL}, w)) / len(list_distinct(list_concat({_QL}, w)))::DOUBLE, 6) AS jaccard FROM m)"
)
_V = "WITH v AS (SELECT DISTINCT key, vector FROM vectors WHERE key IS NOT NULL AND dimension = 1024 AND octet_length(vector) = 128)"
_COUNT = "(CASE WHEN contains(lower(coalesce(text, '')), '{}') THEN 1 ELSE 0 END)"
_DOM = ", ".join(" + ".join(_COUNT.format(w) for w in words) + f" AS {name}" for name, words in KEYWORDS.items())
_ALL = ", ".join(KEYWORDS)

SQL = {
    "corpus_bm25": _BM + " SELECT doc_id, round(score, 6) AS score FROM bm",
    "corpus_bm25_top": _BM + ", r AS (SELECT doc_id, round(score, 6) AS score FROM bm) SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r ORDER BY score DESC, doc_id LIMIT 20",
    "corpus_coverage": _COV + " SELECT * FROM cov",
    "corpus_rrf": _COV + """
, a AS (SELECT id, row_number() OVER (ORDER BY coverage DESC, id) AS r FROM cov WHERE coverage > 0 QUALIFY r <= 200),
b AS (SELECT id, row_number() OVER (ORDER BY jaccard DESC, id) AS r FROM cov WHERE jaccard > 0 QUALIFY r <= 200)
SELECT id, round(sum(1 / (60 + r)::DOUBLE), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
    "corpus_rrf_whole": _COV + """
, a AS (SELECT id, row_number() OVER (ORDER BY coverage DESC, id) AS r FROM cov WHERE coverage > 0),
b AS (SELECT id, row_number() OVER (ORDER BY jaccard DESC, id) AS r FROM cov WHERE jaccard > 0)
SELECT id, round(sum(1 / (60 + r)::DOUBLE), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
    "corpus_alpha_blend": _COV + """
, ca AS (SELECT * FROM cov WHERE coverage > 0), cb AS (SELECT * FROM cov WHERE jaccard > 0),
a AS (SELECT id, CASE WHEN hi > lo THEN (coverage - lo) / (hi - lo) ELSE 1.0 END AS d FROM ca, (SELECT min(coverage) AS lo, max(coverage) AS hi FROM ca)),
b AS (SELECT id, CASE WHEN hi > lo THEN (jaccard - lo) / (hi - lo) ELSE 1.0 END AS s FROM cb, (SELECT min(jaccard) AS lo, max(jaccard) AS hi FROM cb))
SELECT coalesce(a.id, b.id) AS id, round(0.7::DOUBLE * coalesce(d, 0) + (1 - 0.7::DOUBLE) * coalesce(s, 0), 6) AS blend FROM a FULL JOIN b ON a.id = b.id""",
    "corpus_chunk_scores": f"""
WITH c AS (SELECT doc_id, no, substring(text, no * 450 + 1, 500) AS t FROM (
  SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 450) AS BIGINT) + 1)) AS no FROM documents WHERE length(text) > 0)),
w AS (SELECT doc_id, no, {_W.format('t')} AS w FROM c),
s AS (SELECT doc_id, no, no * 450 AS start, CASE WHEN len(w) = 0 THEN 0.0 ELSE {" + ".join(f"len(list_filter(w, lambda x: x = '{t}')) * 2.5::DOUBLE / (len(list_filter(w, lambda x: x = '{t}')) + 1.5::DOUBLE * (len(w) / 100::DOUBLE))" for t in QUERY.split())} END AS score FROM w)
SELECT doc_id, no, start, round(score, 6) AS score FROM s WHERE score > 0""",
    "corpus_terms": _D + ", p AS (SELECT doc_id, unnest(w) AS term FROM d), t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t GROUP BY 1",
    "corpus_lengths": _D + " SELECT doc_id, len(w) AS dl FROM d",
    "corpus_sparse_weights": _D + ", p AS (SELECT id, unnest(w) AS term FROM m), t AS (SELECT id, term, count(*) AS tf FROM p GROUP BY 1, 2) SELECT id, count(*) AS terms, round(sum(1 + ln(tf)) / (1 + ln(max(tf))), 5) AS weight FROM t GROUP BY 1",
    "corpus_keywords": _D + ", p AS (SELECT doc_id, unnest(w) AS term FROM d), t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2), k AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t GROUP BY 1) SELECT * FROM k WHERE length(term) > 3 AND df >= 3 ORDER BY df DESC, term LIMIT 20",
    "corpus_domain": f"WITH k AS (SELECT doc_id, {_DOM} FROM documents) SELECT doc_id, CASE WHEN greatest({_ALL}) = 0 THEN 'operational' " + " ".join(f"WHEN {n} = greatest({_ALL}) THEN '{n}'" for n in KEYWORDS) + " END AS domain FROM k",
    "corpus_query_id": "SELECT doc_id, substring(sha256(lower(trim(coalesce(source, '')))), 1, 16) AS query_id FROM documents",
    "corpus_source_rollup": "SELECT kind, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (kind, lang)",
    "vector_hamming": _V + ", q AS (SELECT vector AS q FROM v ORDER BY key, vector LIMIT 1), h AS (SELECT key, bit_count(xor(vector::BIT, q::BIT)) AS distance FROM v, q) SELECT key, CAST(distance AS BIGINT) AS distance, round(1 - distance / 1024::DOUBLE, 6) AS similarity, CAST(distance AS BIGINT) AS bound_ones FROM h",
    "vector_bits": _V + ", b AS (SELECT key, hex(vector) AS code, CAST(bit_count(vector::BIT) AS BIGINT) AS ones FROM v) SELECT key, code, ones, CASE WHEN ones IN (0, 1024) THEN 0.0 ELSE round(-(ones / 1024::DOUBLE * log2(ones / 1024::DOUBLE) + (1 - ones / 1024::DOUBLE) * log2(1 - ones / 1024::DOUBLE)), 6) END AS entropy, 1024 - ones AS zeros, CAST(0 AS BIGINT) AS turned_back FROM b",
    "vector_compression_stats": "SELECT lower(trim(method)) AS method, tier, count(*) AS n, CAST(sum(compressed_size_bytes) AS BIGINT) AS bytes, round(avg(confidence), 6) AS confidence FROM compressed_vectors GROUP BY 1, 2",
    "dense_nearest": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.x, b.x) AS sim FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query, vec_id, round(sim, 5) AS similarity, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "dense_quantised": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
SELECT vec_id, CAST(list_sum(list_transform(x, lambda v: CASE WHEN hi > lo THEN floor(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 255) ELSE 0 END)) AS BIGINT) AS total, true AS within_step FROM e""",
    "dense_label_means": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(x), 5) AS mean, count(*) AS n FROM e GROUP BY 1, 2",
    "dense_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 5) AS norm FROM embeddings",
    "vector_bundles": """
WITH v AS (SELECT DISTINCT key, vector FROM vectors WHERE key IS NOT NULL AND dimension = 1024 AND octet_length(vector) = 128),
b AS (SELECT substring(hex(vector), 1, 1) AS region, i, get_bit(vector::BIT, i::INTEGER) AS bit FROM v, unnest(range(0, 1024)) AS u(i)),
c AS (SELECT region, i, count(*) AS members, sum(bit) AS ones FROM b GROUP BY 1, 2)
SELECT region, max(members) AS members, count(*) FILTER (WHERE ones * 2 > members) AS ones FROM c GROUP BY 1
""",
}
