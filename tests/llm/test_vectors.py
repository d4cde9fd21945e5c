import numpy as np
from compare import ROOT  # noqa: F401

from palimpsest.llm import queries, vectors


def made(seed, clusters, size):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        center = rng.integers(0, 2, 1024, dtype=np.uint8)
        for k in range(size):
            rows.append((f"k{c:03}-{k:02}", np.packbits(center ^ (rng.random(1024) < rng.choice([0.02, 0.08, 0.1]))).tobytes()))
    return rows


def brute(rows, k=5, radius=256):
    rows = sorted(set(rows))
    x = np.frombuffer(b"".join(v for _, v in rows), np.uint64).reshape(-1, 16)
    out = set()
    for i, (key, _) in enumerate(rows):
        d = np.bitwise_count(x ^ x[i]).sum(1, dtype=np.int64)
        near = sorted((int(d[j]), rows[j][0]) for j in range(len(rows)) if d[j] <= radius and rows[j][0] != key)
        out |= {(min(key, o), max(key, o)) for _, o in near[:k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, bytearray(v), "x") for k, v in rows], "key string, code binary, bucket string").select("key", "code", "bucket")


def test_recall(spark):
    rows = made(1, 150, 8)
    got = {tuple(r) for r in vectors.nearest_pairs(frame(spark, rows + rows[:50]), list_size=50).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_graph_over_thousands_of_lists(spark):
    rows = made(7, 2000, 8)
    graph = vectors.fit(frame(spark, rows), len(rows), list_size=5)
    assert len(graph.centroids) >= 3000 and len(graph.entries) < len(graph.centroids)
    x = np.frombuffer(b"".join(v for _, v in rows[:4000]), np.uint64).reshape(-1, 16)
    ids, found = graph.search(x, 2)
    exact = np.sort(vectors.distances(x, vectors.signs(graph.centroids).T), 1)[:, :2]
    assert (found == exact).mean(0).min() > 0.95 and (np.bitwise_count(graph.centroids[ids] ^ x[:, None]).sum(2) == found).all()


def test_every_centroid_can_be_reached():
    rng = np.random.default_rng(2)
    graph = vectors.Graph(rng.integers(0, 1 << 63, (500, 16), dtype=np.uint64), rng)
    reached = set(graph.entries.tolist()) | set(graph.links[graph.entries].ravel().tolist())
    assert reached == set(range(500)) and len(graph.entries) < 500


def test_exact_with_one_list_and_copies(spark):
    rows = made(2, 6, 4)
    copies = [(f"c{i:03}", rows[0][1]) for i in range(40)]  # one vector many times
    every = rows + copies
    got = {tuple(r) for r in vectors.nearest_pairs(frame(spark, every + every), list_size=10_000).collect()}
    want = brute(every)
    missing = {p for p in want - got}
    assert not missing and not got - want
    ranks = vectors.nearest(frame(spark, every), list_size=10_000).where("key = 'c039'").collect()
    assert [r.neighbour for r in sorted(ranks, key=lambda r: r["rank"])] == ["c000", "c001", "c002", "c003", "c004"]
    assert vectors.nearest(frame(spark, rows).limit(0)).count() == 0


def test_boundary_vectors_stand_in_both_lists():
    bits = np.zeros((3, 1024), np.uint8)
    bits[1, :204] = bits[2, :100] = 1
    first, second, code = (np.packbits(b[None], axis=1).view(np.uint64) for b in bits)
    graph = vectors.Graph(np.concatenate([first, second]), np.random.default_rng(0))
    assert np.bitwise_count(graph.centroids ^ code).sum(1).tolist() == [100, 104]
    assert graph.assign(code, replicas=2).tolist() == [[0, 1]]


def test_divided_lists_and_matrix_path(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 1024)
    v = np.packbits(base ^ (rng.random((700, 1024)) < 0.12), axis=1).view(np.uint64)
    close = vectors._Close(256)
    i, j, d = close.pairs(v)
    full = np.bitwise_count(v[:, None] ^ v[None]).sum(2, dtype=np.int64)
    want = {(a, b) for a in range(700) for b in range(a + 1, 700) if full[a, b] <= 256}
    assert {(int(a), int(b)) for a, b in zip(i, j)} <= want and len(i) >= 0.999 * len(want)
    assert all(full[a, b] == x for a, b, x in zip(i[:500], j[:500], d[:500]))
    monkeypatch.setattr(vectors, "MAX_LIST", 300)
    a, b, _ = vectors._list_pairs(v, close)
    assert {(int(x), int(y)) for x, y in zip(a, b)} <= want


def test_recall_of_nested_lists(spark, monkeypatch):
    """Close pairs aren't parted by thousands of lists: with more than FLAT_LISTS of them few long ones are divided again."""
    rows = made(11, 3000, 4)
    monkeypatch.setattr(vectors, "FLAT_LISTS", 500)
    monkeypatch.setattr(vectors, "OUTER_SIZE", 400)
    assert vectors.nested(len(rows), 10) and len(vectors.fit(frame(spark, rows), len(rows), 10, outer=True).centroids) == 30
    got = {tuple(r) for r in vectors.nearest_pairs(frame(spark, rows), list_size=10).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_outer_lists_are_divided(monkeypatch):
    v = np.concatenate([np.frombuffer(x, np.uint64)[None] for _, x in made(12, 400, 5)])
    close = vectors._Close(256)
    want = {(int(a), int(b)): int(d) for a, b, d in zip(*close.pairs(v))}
    monkeypatch.setattr(vectors, "OUTER_LONGEST", 500)
    got = list(zip(*vectors._list_pairs(v, close, outer=True)))
    assert len(got) == len(set(got)) >= 0.97 * len(want) and all(want[int(a), int(b)] == d for a, b, d in got)


def test_decoding_and_unusable_records(spark):
    v = np.random.default_rng(7).integers(0, 256, 128).astype(np.uint8)
    bits = np.unpackbits(v)
    spread = (bits.reshape(256, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)
    book = np.random.default_rng(8).integers(0, 2, (32, 256, 32)).astype(np.uint8)
    codes = np.arange(32, dtype=np.uint8)
    plain = np.packbits(book[np.arange(32), codes].ravel())
    schema = "vector_id string, method string, compressed_data binary, pq_codebook_id string, key string"
    rows = [
        ("a", " None", bytearray(v), None, "x"), ("b", "INT8", bytearray(spread), None, None), ("c", "pq ", bytearray(codes), "B", None),
        ("d", "pq", bytearray(codes), "missing", None), ("e", "pq", bytearray(codes[:9]), "B", None), ("f", "zip", bytearray(v), None, None),
        (None, "none", bytearray(v), None, None), ("g", None, bytearray(v), None, None), ("h", "none", None, None, None), ("i", "pq", bytearray(codes), None, None),
    ]
    books = spark.createDataFrame([("B", 1024, 32, 8, bytearray(book.tobytes())), ("C", 512, 32, 8, bytearray(9))], "codebook_id string, dimension int, n_subvectors int, n_bits int, codebook_data binary")
    got = {r.key: bytes(r.code) for r in vectors.decoded_vectors(spark.createDataFrame(rows, schema), books).collect()}
    assert got == {"a": v.tobytes(), "b": v.tobytes(), "c": plain.tobytes()}
    table = spark.createDataFrame([("a", bytearray(v), 1024), ("z", bytearray(128), 1024), ("s", bytearray(v[:100]), 1024), ("o", bytearray(v), 512), ("n", bytearray(v), None), (None, bytearray(v), 1024), ("q", None, 1024)], "key string, vector binary, dimension int")
    assert [r.key for r in vectors.binary_vectors(table).collect()] == ["a"]


def test_squeezed_keys(spark):
    keys = ["0123456789abcdef0123456789abcdef", "arc:0123456789abcdef0123456789abcdef", "é0123456789abcdef0123456789abcdef", "", "short", "0123456789ABCDEF0123456789abcdef"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(vectors.unsqueezed(vectors.squeezed(F.col("key")))).collect()] == keys


def test_tables(spark):
    got = queries.QUERIES["p5_found"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["table_name", "key_a", "key_b"] and got.where("key_a >= key_b").count() == 0
