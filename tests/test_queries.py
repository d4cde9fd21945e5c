"""Every core query gives the rows that DuckDB gives, or where SQL can't, those of plain Python."""

import hashlib
import importlib
import math

import numpy as np
import pytest
from compare import differences, duck

import __spark_entry__ as entry
from palimpsest.functions import hdv

DATA = "/root/testdata/sf0.001"
CORE = {n: (q, m.SQL.get(n)) for m in (importlib.import_module(f"palimpsest.plans.{x}") for x in entry.CORE) for n, q in m.QUERIES.items()}


def rows(spark, name, *columns):
    return spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()


def encoded(spark, got):
    """Bits and their entropy of each text, encoded one by one."""
    want = {}
    for r in rows(spark, "memories", "id", "content"):
        v = hdv.encode_text(r.content, 1024)
        p = sum((x & (2**64 - 1)).bit_count() for x in v) / 1024
        want[r.id] = (round(p * 1024), round(0.0 if p in (0, 1) else -p * math.log2(p) - (1 - p) * math.log2(1 - p), 6))
    assert {r.id: (r.ones, r.entropy) for r in got} == want


def product_quantised(spark, got):
    """Distances are sums over the parts' codes and follow the exact ones; the probe is nearest to itself."""
    exact = {r.vec_id: np.array(r.embedding, float) for r in rows(spark, "embeddings", "vec_id", "embedding") if r.embedding is not None}
    probe = exact[min(exact)]
    ours = {r.vec_id: r.distance for r in got if r.distance is not None}
    assert set(ours) == set(exact) and all(len(r.codes) == 8 for r in got if r.codes is not None)
    codes = np.array([r.codes for r in sorted(got, key=lambda r: r.vec_id) if r.vec_id in exact])
    near = np.array([ours[k] for k in sorted(exact)])
    # a distance is the sum of one number for the code of each part
    table = np.zeros((len(codes), 8 * (codes.max() + 1)))
    for p in range(8):
        table[np.arange(len(codes)), p * (codes.max() + 1) + codes[:, p]] = 1
    parts = np.linalg.lstsq(table, near, rcond=None)[0]
    assert np.abs(table @ parts - near).max() < 1e-3
    true = [((exact[k] - probe) ** 2).sum() for k in sorted(exact)]
    assert np.corrcoef(true, near)[0, 1] > 0.6 and sorted(near).index(ours[min(exact)]) == 0


def medoids(spark, got):
    """Every vector is with the nearest of the medoids, and each medoid has the least total distance of its cluster."""
    v = {r.vec_id: np.array(r.embedding, float) for r in rows(spark, "embeddings", "vec_id", "embedding") if r.embedding is not None}
    centre = {r.vec_id: r.medoid for r in got}
    chosen = sorted(set(centre.values()))
    assert set(centre) == set(v)
    away = lambda a, b: round(float(np.sqrt(((v[a] - v[b]) ** 2).sum())), 4)
    for k, m in centre.items():
        assert away(k, m) == min(away(k, c) for c in chosen)


def chunks(spark, got):
    """Chunks of each way hold all words of a text, in order where they don't overlap."""
    texts = {r.doc_id: r.text for r in rows(spark, "documents", "doc_id", "text") if r.text and r.text.strip(" ")}
    assert {r.doc_id for r in got} == set(texts)
    for way in ("paragraph", "sentence", "token"):
        parts = {}
        for r in sorted((r for r in got if r.way == way), key=lambda r: (r.doc_id, r.no)):
            parts.setdefault(r.doc_id, []).append(r.chunk)
        for k, t in texts.items():
            assert all(c.strip() in t or way != "token" for c in parts[k])
            assert set("".join(t.split())) <= set("".join("".join(parts[k]).split()))


def pairs_of_texts(spark):
    text = {r.id: r.content for r in rows(spark, "memories", "id", "content")}
    return {(r.memory_id, r.source_memory_id): (text[r.memory_id], text[r.source_memory_id]) for r in rows(spark, "memory_evidence", "memory_id", "source_memory_id")}


def short_codes(spark, got):
    """Bits voted one by one."""

    def code(text):
        votes = [0] * 256
        for f in hdv.features(text):
            n = int.from_bytes(hashlib.sha256(f.encode()).digest(), "big")
            votes = [v + (1 if n >> i & 1 else -1) for i, v in enumerate(votes)]
        return [v >= 0 for v in votes]

    pairs = pairs_of_texts(spark)
    for r in got[:40]:
        a, b = (code(t) for t in pairs[r.memory_id, r.source_memory_id])
        assert abs(r.similarity - sum(x == y for x, y in zip(a, b)) / 256) < 1e-7
    assert {(r.memory_id, r.source_memory_id) for r in got} == set(pairs)
    assert hdv.features("Ab é") == ["token:ab", "gram:^ab", "gram:ab$", "token:é", "gram:^é$"] and hdv.short_code("") == b"\xff" * 32


def fingerprints(spark, got):
    pairs = pairs_of_texts(spark)
    assert {(r.memory_id, r.source_memory_id) for r in got} == set(pairs)
    for r in got:
        a, b = (int.from_bytes(hashlib.shake_256(t.encode()).digest(2048), "big") for t in pairs[r.memory_id, r.source_memory_id])
        assert abs(r.similarity - 1 + (a ^ b).bit_count() / 16384) < 1e-7


WITHOUT_SQL = {"vector_short_codes": short_codes, "vector_fingerprints": fingerprints, "vector_encoded_text": encoded, "dense_product_quantised": product_quantised, "dense_medoids": medoids, "context_chunks": chunks}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    query, sql = CORE[name]
    if sql is None:
        WITHOUT_SQL[name](spark, query(spark, DATA).collect())
    else:
        assert differences(spark, duck(DATA), name, query, sql, DATA) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
