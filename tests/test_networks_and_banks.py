"""Operators of networks, erasure, banks and chunks against plain Python, and their edge cases."""

import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import banks, erasure, graph, network


def two_way(pairs):
    return [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]


def some_edges(seed=3, nodes=30, n=34):
    r = random.Random(seed)
    return sorted({(*sorted(r.sample([f"n{i:02}" for i in range(nodes)], 2)), 0.5) for _ in range(n)})


def test_shortest_paths(spark):
    edges = two_way(some_edges())
    around = defaultdict(set)
    for a, b, _ in edges:
        around[a].add(b)
    df = spark.createDataFrame(edges + [("n00", "n00", 0.1), (None, "n01", 0.5)], "u string, v string, weight double")
    sources = spark.createDataFrame([("n00",), ("n05",), ("n05",), (None,), ("none",)], "source string")
    want = {}
    for s in ("n00", "n05"):
        best = {s: [s]}
        front = {s: [s]}
        while front:
            nxt = {}
            for node, path in front.items():
                for x in around[node]:
                    if x not in best and (x not in nxt or path + [x] < nxt[x]):
                        nxt[x] = path + [x]
            best |= nxt
            front = nxt
        want |= {(s, t, len(p) - 1, tuple(p)) for t, p in best.items() if t != s} and {(s, t): p for t, p in best.items() if t != s}
    got = {(r.source, r.target): r.path for r in network.shortest_paths(df, sources).collect()}
    assert got == want
    with pytest.raises(ValueError):
        network.shortest_paths(df, sources, 1).count()
    assert network.shortest_paths(df.limit(0), sources).count() == 0


def test_walks_follow_edges_and_repeat(spark):
    edges = two_way(some_edges())
    df = spark.createDataFrame(edges, "u string, v string, weight double")
    sources = df.select(F.col("u").alias("source")).distinct().union(spark.createDataFrame([("lonely",)], "source string"))
    a = {r.source: r.path for r in network.random_walks(df, sources, 5).collect()}
    assert a == {r.source: r.path for r in network.random_walks(df.repartition(3), sources, 5).collect()}
    links = {(x, y) for x, y, _ in edges}
    assert a["lonely"] == ["lonely"]
    assert all(len(p) == 6 and all(e in links for e in zip(p, p[1:])) for s, p in a.items() if s != "lonely")


def test_reinforced(spark):
    pairs = [("a", "b", 0.1), ("b", "a", 0.2), ("a", "a", 0.5), ("c", "d", 1.0), ("c", "d", 0.1), (None, "d", 0.1)]
    known = spark.createDataFrame([("b", "a", 0.4), ("x", "y", 0.7)], "a string, b string, strength double")
    df = spark.createDataFrame(pairs, "a string, b string, amount double")
    got = {(r.a, r.b): (round(r.strength, 9), r.fired) for r in network.reinforced(df, known=known).collect()}
    assert got == {("a", "b"): (round(1 - 0.6 * 0.9 * 0.8, 9), 2), ("c", "d"): (1.0, 2), ("x", "y"): (0.7, 0)}
    assert network.reinforced(df.limit(0)).count() == 0


def test_redundant_and_similar_sets(spark):
    r = random.Random(2)
    rows = [(f"m{i:03}", [f"w{r.randrange(25)}" for _ in range(r.randint(1, 12))], i) for i in range(150)] + [("e", [], 1), ("z", None, 2), (None, ["w1"], 3)]
    df = spark.createDataFrame(rows, "id string, w array<string>, at int")
    sets = {k: set(w) for k, w, _ in rows if k and w}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(x.a, x.b) for x in network.similar_word_sets(df, "id", "w", 0.6).collect()} == want and want
    assert {(x.keep_id, x.remove_id) for x in network.redundant_nodes(df, "id", "w", "at", 0.6).collect()} == want  # older ids come first


def test_postings_of_a_word_are_compared_in_place():
    """Sets that share a word but little else leave no pairs to be joined: the pairs are those alike, and few more."""
    r = random.Random(4)
    sets = [sorted({f"w{r.randrange(200)}" for _ in range(40)}) for _ in range(600)]
    sets += [s[:-1] + ["new"] for s in sets[:30]]
    batch = pa.RecordBatch.from_pydict({"h": list(range(630)), "w": sets}, pa.schema([("h", pa.int64()), ("w", pa.list_(pa.string()))]))
    rank = {f"w{i}": -i for i in range(1, 100)}
    posted = pa.Table.from_batches(network._word_postings(iter([batch]), rank, 0.8, 1))
    got = network._alike_in_bucket(posted, 0.8).to_pylist()
    want = {(a, b) for a in range(630) for b in range(a + 1, 630) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert want <= {(x["ha"], x["hb"]) for x in got} and len(want) >= 30 and len(got) <= 2 * len(want)


def test_cross_domain_pairs(spark):
    r = random.Random(5)
    rows = [(f"r{i:03}", r.choice("xy"), r.choice(["a", "b", "c"]), 1_500_000_000 + r.randrange(3000)) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, s string, d string, t long").withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    want = {(s, i, j) for i, s, d, t in rows for j, s2, d2, t2 in rows if s == s2 and d != d2 and t2 <= t and t - t2 <= 100 and (t2 < t or j < i)}
    got = network.cross_domain_pairs(df.unionByName(df.limit(1).withColumn("at", F.lit(None).cast("timestamp_ntz"))), "id", "s", "d", "at", 100).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_documents(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([("a<1>", 'q"&\x01'), ("b", None)], "node string, label string")
    edges = spark.createDataFrame([("a<1>", "b", 0.25)], "u string, v string, weight double")
    for kind, lines in (("graphml", network.graphml_lines(nodes, edges)), ("gexf", network.gexf_lines(nodes, edges))):
        network.write_document(lines, str(tmp_path / kind), kind)
        whole = "\n".join(p.read_text() for part in range(5) if (tmp_path / kind / str(part)).exists() for p in sorted((tmp_path / kind / str(part)).glob("part-*")))
        tags = [e.tag.split("}")[1] for e in ET.fromstring(whole.encode()).iter()]
        assert tags.count("node") == 2 and tags.count("edge") == 1


def test_components_that_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    with pytest.raises(ValueError):
        graph.connected_components(chain, "a", "b", max_rounds=1)
    assert {r.component for r in graph.connected_components(chain, "a", "b").collect()} == {0}


def test_erasure(spark):
    m = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "d")], "scope_key string, id string")
    log = spark.createDataFrame(
        [("1", "s", "a", "remembered", "{}"), ("2", "s", None, " Superseded", '{"memory_id":"a","replacement_memory_id":"b"}'), ("3", "s", "c", "remembered", "{broken"), ("4", "t", "d", "remembered", None), (None, "s", "a", "reinforced", "{}")],
        "id string, scope_key string, memory_id string, event_type string, payload_json string",
    )
    ev = spark.createDataFrame([("c", "a", "9"), ("c", "d", "1"), ("c", "d", "3"), (None, None, None)], "memory_id string, source_memory_id string, event_id string")
    ask = lambda *rows: spark.createDataFrame(list(rows), "scope_key string, id string")
    done = erasure.Erasure(m, log, ev, ask(("s", "a")), cascade=True)
    assert {r.id for r in done.memories.collect()} == {"c", "d"}
    assert {r.id for r in done.events.collect()} == {"3", "4"}
    assert {tuple(r) for r in done.evidence.collect()} == {("c", "d", "3"), (None, None, None)}
    with pytest.raises(ValueError):
        erasure.Erasure(m, log, ev, ask(("s", "a")))
    with pytest.raises(LookupError):
        erasure.Erasure(m, log, ev, ask(("t", "a")), cascade=True)
    assert erasure.Erasure(m, log, ev, ask(("s", "c"))).memories.count() == 3
    assert erasure.Erasure(m, log, ev, ask().limit(0)).events.count() == 5


def test_clamped_sums(spark):
    r = random.Random(9)
    rows = [(r.choice("abbbbbbb"), i, r.choice([0.3, -0.4, 0.05, None])) for i in range(900)]
    want = {}
    for k in "ab":
        x = 0.5
        for _, _, s in (row for row in rows if row[0] == k):
            x = x if s is None else min(1.0, max(0.0, x + s))
        want[k] = round(x, 9)
    df = spark.createDataFrame(rows + [(None, 1, 0.1)], "k string, i int, step double").repartition(5)
    for parts in (1, 9):
        assert {x.k: round(x.value, 9) for x in banks.clamped_sums(df, "k", ["i"], "step", parts=parts).collect()} == want


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None, 1.0), ("a", "r", 5.0), ("b", "a", 3.0), ("x", "y", 9.0), ("y", "x", 8.0), (None, "r", 1.0)], "id string, p string, w double")
    assert {tuple(t) for t in banks.tree(nodes, "id", "p").collect()} == {("r", "r", 0), ("a", "r", 1), ("b", "r", 2)}
    with pytest.raises(ValueError):
        banks.tree(nodes, "id", "p", 1).count()
    assert [t.id for t in banks.next_actions(nodes, "id", "p", F.col("w") < 9, "w", 3).collect()] == ["b", None]


def tokens_of(text):
    return max(1, math.ceil(len(text) / 4))


def grouped(pieces, joint, most, overlap=0):
    done, held = [], ""
    for p in pieces:
        if not p.strip(" "):
            continue
        whole = p if not held else held + joint + p
        size = tokens_of(whole) if not overlap else (tokens_of(p) if not held else tokens_of(held) + tokens_of(p) - tokens_of(held[-overlap:]))
        if size <= most:
            held = whole
        else:
            done += [held] if held else []
            held = p
    return done + ([held] if held else [])


def test_chunks(spark):
    import re

    r = random.Random(4)
    sentence = lambda: " ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 14))) + r.choice(".!?")
    texts = ["\n\n".join(" ".join(sentence() for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 9))) for _ in range(20)] + ["", None, "   ", "x" * 700, "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", tx.paragraph_chunks(F.col("t"), 60, 16).alias("p"), tx.sentence_chunks(F.col("t"), 40).alias("s"), tx.token_chunks(F.col("t"), 40, 8).alias("k")).collect():
        t = texts[row.i] or ""
        assert row.p == grouped(re.split(r"\n\n+", t.strip(" ")), "\n\n", 60, 16)
        assert row.s == grouped(re.split(r"(?<=[.!?])\s+", t.strip(" ")), " ", 40)
        at, want = 0, []
        while at < len(t):
            cut = t[at : at + 160]
            space = cut.rfind(" ") + 1
            size = space if at + 160 < len(t) and space > 80 else 160
            want += [cut[:size].strip(" ")] if cut[:size].strip(" ") else []
            if at + size >= len(t):
                break
            at += size - 32
        assert row.k == want


def test_relevance_and_complexity(spark):
    df = spark.createDataFrame([("Why plan? maybe",), ("",), (None,), ("the audit trail",), ("trail " * 30,)], "t string")
    got = [(round(r.r, 6), r.c) for r in df.select(tx.keyword_relevance("Audit trail", F.col("t")).alias("r"), tx.complexity(F.col("t")).alias("c")).collect()]
    assert got == [(0.1, 0.6), (0.1, 0.0), (0.1, 0.0), (1.0, 0.0), (0.8, 0.3)]
    assert df.select(tx.keyword_relevance(" ", F.col("t")).alias("r")).first().r == 0.5


def test_lookups(spark):
    from datetime import datetime as T

    from palimpsest.operators import access

    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "id string, v int")
    asked = spark.createDataFrame([(0, "b"), (1, "b"), (2, "x"), (3, None)], "position int, id string")
    assert sorted(tuple(r) for r in access.batch_get(t, asked, "id").collect()) == [(0, "b", True, 2), (1, "b", True, 2), (2, "x", False, None), (3, None, False, None)]
    rows = spark.createDataFrame([(i // 3, f"k{i}") for i in range(10)], "n int, k string")
    got, after = [], None
    while part := [tuple(r) for r in access.page(rows, ["n", "k"], after, 4).collect()]:
        got, after = got + part, part[-1]
    assert got == sorted(tuple(r) for r in rows.collect())
    log = spark.createDataFrame([("a", T(2020, 1, 1), 1), ("a", T(2020, 1, 2), 2), ("a", T(2020, 1, 5), 3), ("b", T(2020, 1, 1), 4), ("c", None, 5)], "k string, at timestamp_ntz, v int")
    assert {r.v for r in access.truncated(log, "at", T(2020, 1, 3)).collect()} == {3, 5}
    assert {r.v for r in access.truncated(log, "at", T(2020, 1, 3), "k").collect()} == {2, 3, 4, 5}
    assert {r.v for r in access.since(log, "at", T(2020, 1, 2), T(2020, 1, 5)).collect()} == {2}
    best = access.best_of_each(log, ["k"], ["at", "v"], 2)
    assert sorted((r.k, r.position, r.v) for r in best.collect()) == [("a", 0, 3), ("a", 1, 2), ("b", 0, 4), ("c", 0, 5)]
    assert access.batch_get(t.limit(0), asked, "id").where("found").count() == 0


def test_times_and_identifiers(spark):
    from datetime import datetime as T

    from palimpsest.operators import access

    texts = {
        "2020-02-03T04:05:06Z": T(2020, 2, 3, 4, 5, 6), "2020-02-03T04:05:06.123456789+01:30": T(2020, 2, 3, 2, 35, 6, 123456), "2020-02-03T04:05:06.5-00:45": T(2020, 2, 3, 4, 50, 6, 500000),
        "2020-02-03T04:05:06": None, "2020-02-30T04:05:06Z": None, "": None, None: None, "x": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.p for r in df.select("t", access.parsed_time(F.col("t")).alias("p")).collect()} == texts
    ids = spark.createDataFrame([(" a b\n",), ("",), ("\t ",), (None,)], "t string")
    assert [r.i for r in ids.select(access.identifier(F.col("t")).alias("i")).collect()] == ["a b", None, None, None]
    with pytest.raises(ValueError):
        access.dispatched("other", df, df, "t")


def test_simple_paths(spark):
    edges = two_way([("a", "b", 0.5), ("b", "c", 0.4), ("a", "c", 0.9), ("c", "d", 0.05), ("d", "e", 0.5)])
    df = spark.createDataFrame(edges + [("a", "a", 1.0), (None, "b", 1.0)], "u string, v string, weight double")
    got = {(tuple(r.path), r.hops, round(r.strength, 9)) for r in network.simple_paths(df, spark.createDataFrame([("a",), ("a",), (None,)], "source string"), 3, 0.1).collect()}
    assert got == {(("a", "b"), 1, 0.5), (("a", "c"), 1, 0.9), (("a", "b", "c"), 2, 0.2), (("a", "c", "b"), 2, 0.36)}
    assert network.simple_paths(df.limit(0), spark.createDataFrame([("a",)], "source string")).count() == 0
