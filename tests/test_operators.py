from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hdv, text
from palimpsest.operators import consolidate, graph, lifecycle, sequence
from palimpsest.sources import io
from palimpsest.streaming import events as ev

T0 = datetime(2020, 1, 1)


def test_anchored_clusters_and_greedy_fill(spark):
    hours = [0, 10, 23, 24, 25, 40, 60, 200]
    rows = [(k, T0 + timedelta(hours=h), f"{k}{h}", h % 7 + 1) for k in ("a", "b", None) for h in hours] + [("a", None, "x", None)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id string, n int")
    for k in ("a", "b", None):
        got = [r.cluster for r in sorted(sequence.anchored_clusters(df, "k", "at", 24).where(F.col("k").eqNullSafe(k)).collect(), key=lambda r: r["at"])]
        assert got == [0, 0, 0, 0, 1, 1, 2, 3]
    kept, used = {}, 0
    for _, _, i, n in sorted((r for r in rows if r[0] == "b"), key=lambda r: r[1]):
        kept[i] = used + n <= 12
        used += n * kept[i]
    got = {r.id: r.kept for r in sequence.greedy_fill(df, "k", ["at", "id"], "n", 12, "id").where("k = 'b'").collect()}
    assert got == kept and not all(kept.values())
    assert sequence.greedy_fill(df.limit(0), "k", ["at", "id"], "n", 12, "id").count() == 0


def test_hypervectors(spark):
    vectors = [hdv.encode_text(t, 128) for t in ("a b c", "a b d", "", None, "one")]
    assert vectors[2] == vectors[3] == [0, 0]
    df = spark.createDataFrame([("g", v) for v in vectors[:2] + [vectors[4]]] + [("n", None)], "g string, v array<bigint>")
    bits = lambda v: [(x >> (63 - i)) & 1 for x in v for i in range(64)]
    want = [int(sum(col) * 2 > 3) for col in zip(*(bits(v) for v in vectors[:2] + [vectors[4]]))]
    got = {r.g: r for r in hdv.majority(df, ["g"], "v", 128).collect()}
    assert bits(got["g"].v) == want and got["g"].members == 3 and got["n"].members == 0
    one = df.limit(1).select(hdv.permute(F.col("v"), 5, 128).alias("p"), "v").first()
    b = bits(one.v)
    assert bits(one.p) == b[-5:] + b[:-5]


def test_graph_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"), (None, "a"), ("b", "a"), ("a", "b")], "s string, t string")
    got = {r.node: r.component for r in graph.connected_components(edges, "s", "t").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.connected_components(edges.limit(0), "s", "t").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "s int, t int")
    assert {r.component for r in graph.connected_components(chain, "s", "t").collect()} == {0}
    two = graph.undirected(edges.where("s <> t").withColumn("w", F.lit(1.0)), "s", "t", "w").distinct()
    labels = {r.node: r.label for r in graph.label_communities(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (8, 9, 1.0), (9, 8, 1.0)], "u int, v int, weight double")).collect()}
    assert labels[1] in (1, 2) and labels[8] in (8, 9)
    assert two.count() == 6
    old = spark.createDataFrame([("a", "b", 1.0, T0), ("a", "c", 0.1, T0)], "u string, v string, weight double, last_fired timestamp_ntz")
    assert [round(r.weight, 3) for r in graph.decayed(old, T0 + timedelta(days=30), floor=0.2).collect()] == [0.5]


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None)], "memory_id string, source_memory_id string")
    got = {(r.memory_id, r.source_memory_id): r.depth for r in lifecycle.lineage(e).collect()}
    assert got[("a", "a")] == 3 and got[("a", "c")] == 2 and len(got) == 9


@pytest.mark.parametrize(("mode", "want"), [("skip", {"a": 1, "b": None, "c": 3}), ("overwrite", {"a": 9, "b": 8, "c": 3}), ("merge", {"a": 1, "b": 8, "c": 3})])
def test_merge_import(spark, mode, want):
    schema = "id string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", None)], schema), spark.createDataFrame([("a", 9), ("b", 8), ("c", 3), ("c", 4), (None, 5)], schema)
    assert {r.id: r.v for r in lifecycle.merge_import(old, new, "id", ["v"], mode).collect()} == want


def test_files_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, T0), ("b", 2, T0 + timedelta(days=1)), ("c", None, T0)], "id string, v int, at timestamp_ntz")
    for kind in ("parquet", "jsonl"):
        io.export(df, str(tmp_path / f"out.{kind}"), kind, F.col("id") != "b", max_records=1)
        assert io.read_records(spark, str(tmp_path / f"out.{kind}")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"a","v":1}\n{"id":"b","v":\n{"v":3}\n')
    rows = io.read_records(spark, str(tmp_path / "bad.jsonl"), "id string, v int, _corrupt_record string").cache()
    good, bad = io.split_valid(rows, ["id"], {"v is small": F.col("v") < 2})
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        io.format_of("x.csv")
    io.append_days(df, str(tmp_path / "cold"), "at")
    io.append_days(df, str(tmp_path / "cold"), "at")
    assert spark.read.json(str(tmp_path / "cold")).where("day = '2020-01-01'").count() == 4
    snaps = io.Snapshots(spark, str(tmp_path / "snaps"))
    for i in range(4):
        snaps.create(df.withColumn("v", F.col("v") + F.when(F.col("id") == "a", i).otherwise(0)).where(f"id <> 'c' or {i} < 2"), T0 + timedelta(days=i))
    assert {(r.id, r.change) for r in snaps.changes(1, 4, "id").collect()} == {("a", "updated"), ("c", "deleted")}
    assert snaps.expire(T0 + timedelta(days=4), keep=3, days=2) == [2, 1]
    assert sorted(r.version for r in snaps.catalog().collect()) == [3, 4] and snaps.read(4).count() == 2
    df.write.mode("overwrite").parquet(str(tmp_path / "snaps/version=4"))
    with pytest.raises(ValueError):
        snaps.read(4)


def test_streams(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(minutes=5)), ("b", T0 + timedelta(hours=2)), ("a", T0 + timedelta(hours=200)), ("c", T0 + timedelta(hours=1))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = lambda: spark.readStream.schema("k string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    counts = {(r.window_start, r.k): r.n for r in run(ev.windowed_counts(stream(), "at", ["k"]), "counts", "update")}
    assert counts[(T0, "a")] >= 1
    assert {r.k for r in run(ev.distinct_changes(stream(), "at", ["k"]), "once", "append")} >= {"a", "b"}
    assert all(r.refused == max(0, r.n - 1) for r in run(ev.rate_windows(stream(), "at", "k", 3600, 1), "rates", "update"))
    held = run(ev.working_memory(stream(), "k", "at", 3600), "held", "update")
    assert any(r.expired for r in held) and any(not r.expired for r in held)


def test_validation_and_levels(spark):
    e = spark.createDataFrame([("1", '{"a":"x","b":1.5}'), ("2", '{"a":null,"b":"no"}'), ("3", '{"a":'), ("4", None)], "id string, p string")
    got = {r.id: r.errors for r in consolidate.schema_errors(e, "p", {"a": "string", "b": "double"}).collect()}
    assert got == {"1": [], "2": ["a is missing", "b is no double"], "3": ["broken"], "4": []}
    p = spark.createDataFrame([("x", "i", "read", None), ("x", "i", "full", T0), ("y", "i", "full", T0 + timedelta(days=9))], "agent string, item string, level string, expires_at timestamp_ntz")
    now = F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")
    assert {r.agent: r.level for r in consolidate.access_levels(p, {"read": 1, "full": 2}, now).collect()} == {"x": 1, "y": 2}


def test_quantised_vectors_and_medoids(spark):
    import numpy as np

    from palimpsest.operators import dense

    rng = np.random.default_rng(0)
    centres = rng.normal(0, 5, (4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.1, 8)).tolist(), "x") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "x")], "id int, v array<double>, codes string")
    books = dense.train_codebooks(df, "v", 2, 4)
    codes = dense.pq_encode(df, "id", "v", books)
    got = {r.id: r.distance for r in dense.pq_distances(codes, rows[0][1], books).collect()}
    assert got[900] is None and max(got[i] for i in range(0, 200, 4)) < min(got[i] for i in range(1, 200, 4))
    out = dense.k_medoids(df, "id", "v", 4).collect()
    at = {r[0]: np.array(r[1]) for r in rows}
    chosen = {r.medoid for r in out}
    assert len(out) == 200 and len(chosen) == 4
    for r in out:
        away = {m: np.linalg.norm(at[r.id] - at[m]) for m in chosen}
        assert abs(r.distance - min(away.values())) < 1e-9 and abs(away[r.medoid] - r.distance) < 1e-9
    assert dense.k_medoids(df.limit(0), "id", "v", 4).count() == 0
    exact = {(r.query, r.id) for r in dense.nearest_in_blocks(df.where("id < 9"), df, "id", "v", 3, query_rows=4, base_rows=50).collect()}
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:9] @ x.T
    s[np.arange(9), np.arange(9)] = -9
    assert exact == {(q, int(i)) for q in range(9) for i in np.argsort(-s[q], kind="stable")[:3]}


def test_two_hops_from_every_node(spark):
    from palimpsest.plans import relations

    data = "/root/testdata/sf0.001"
    edges = relations._two_way(spark, data).collect()
    out = {}
    for e in edges:
        out.setdefault(e.u, set()).add(e.v)
    want = {(u, u): 0 for u in out}
    for u in out:
        for v in out[u]:
            want[u, v] = 1
    for u in out:
        for v in out[u]:
            for w in out[v]:
                want.setdefault((u, w), 2)
    assert {(r.seed, r.node): r.hop for r in relations.QUERIES["graph_two_hops_whole"](spark, data).collect()} == want


def test_lineage_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"m{i:02}", f"m{i + 1:02}") for i in range(18)], "memory_id string, source_memory_id string")
    got = {(r.memory_id, r.source_memory_id): r.depth for r in lifecycle.lineage(e).collect()}
    assert got["m00", "m18"] == 18 and len(got) == 18 * 19 // 2
    with pytest.raises(ValueError, match="deeper"):
        lifecycle.lineage(e, max_depth=3)


def test_fusion_keeps_every_match(spark):
    from palimpsest.plans import corpus

    data = "/root/testdata/sf0.01"
    matches = corpus._coverage(spark, data).where("coverage > 0 or jaccard > 0").count()
    assert matches > 400 and corpus.QUERIES["corpus_rrf_whole"](spark, data).count() == matches


def test_medoids_of_all_rows(spark):
    import numpy as np

    from palimpsest.operators import dense

    x = np.random.default_rng(1).normal(size=(5_000, 2))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>")
    out = {r.id: r.medoid for r in dense.k_medoids(df, "id", "v", 3, rounds=40).collect()}
    assert len(out) == len(x)
    for m in set(out.values()):
        members = x[[i for i, at in out.items() if at == m]]
        costs = np.sqrt(((members[:, None] - members) ** 2).sum(2)).sum(1)
        assert np.sqrt(((members - x[m]) ** 2).sum(1)).sum() <= costs.min() + 1e-5


def test_float_algebra(spark):
    from palimpsest.operators import dense

    r = np.random.default_rng(1)
    a, b = (r.normal(size=8) for _ in range(2))
    df = spark.createDataFrame([(1, a.tolist(), b.tolist()), (2, None, b.tolist()), (3, [1.0], b.tolist()), (4, [], [])], "id int, a array<double>, b array<double>")
    got = {x.id: x for x in df.select("id", dense.bound(F.col("a"), F.col("b")).alias("c"), dense.unbound(dense.bound(F.col("a"), F.col("b")), F.col("b")).alias("u"), dense.rolled(F.col("a"), -3).alias("r")).collect()}
    want = [sum(a[j] * b[(i - j) % 8] for j in range(8)) for i in range(8)]
    assert np.allclose(got[1].c, want) and np.allclose(got[1].r, np.roll(a, -3))
    inverse = np.r_[b[0], b[:0:-1]]
    back = np.array([sum(want[j] * inverse[(i - j) % 8] for j in range(8)) for i in range(8)])
    assert np.allclose(got[1].u, back / np.linalg.norm(back))
    assert got[2].c is got[3].c is got[4].c is got[2].r is None and got[4].r == []


def test_globs(spark):
    import fnmatch

    names = ["memory.added", "memory.gone", "memoryXadded", "a[b]", "", "x\ny", "[", "b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for pattern in ("memory.*", "*", "?", "a[[]b]", "*.[ag]*", "[!a]*", "[", "x?y"):
        got = {r.n for r in df.where(text.glob(F.col("n"), pattern)).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}, pattern


def test_anomalies_over_cells(spark):
    r = np.random.default_rng(3)
    rows = [(f"k{i % 2}", i, float(r.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, v double")
    one = {x.at for x in consolidate.anomalies(df, "k", ["at"], "v", 20, 2.0).collect()}
    assert one == {x.at for x in consolidate.anomalies(df, "k", ["at"], "v", 20, 2.0, cell=100).collect()} and len(one) > 20


def test_archive_batches_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1))], "id int, at timestamp_ntz")
    for _ in range(2):
        io.append_days(df, str(tmp_path / "a"), "at", "b1")
    io.append_days(df, str(tmp_path / "a"), "at", "b2")
    assert spark.read.json(str(tmp_path / "a")).count() == 4


def test_catalog_survives_a_crash_between_renames(spark, tmp_path):
    shots = io.Snapshots(spark, str(tmp_path / "s"))
    for i in range(3):
        shots.create(spark.range(i + 1), T0 + timedelta(days=i))
    (tmp_path / "s" / "catalog").rename(tmp_path / "s" / "catalog.old")
    assert shots.catalog().count() == 3
    assert shots.expire(T0 + timedelta(days=3), 1, 100) and shots.catalog().count() == 1 and not (tmp_path / "s" / "catalog.old").exists()
