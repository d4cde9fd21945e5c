import random
from datetime import datetime, timedelta

from palimpsest.operators import replay

T0 = datetime(2020, 1, 1)
SCHEMA = "memory_id string, kind string, has_content boolean, occurred_at timestamp_ntz, arrival timestamp_ntz, id string"


def one_pass(rows):
    """State by state, in plain Python."""
    out = {}
    low = datetime(1, 1, 1)
    for m in {r[0] for r in rows}:
        alive = known = False
        status = content = last = None
        for _, kind, has, at, arr, i in sorted((r for r in rows if r[0] == m), key=lambda r: (r[3] or low, r[4], r[5])):
            life = kind == "remembered" or (kind == "restored" and known)
            if not life and (not alive or kind == "restored"):
                continue
            known |= kind == "remembered"
            alive = kind != "forgotten"
            last = i
            if life:
                status = "active"
            elif kind in ("superseded", "contradicted"):
                status = kind
            if has and kind != "forgotten":
                content = i
        if alive:
            out[m] = (status, content, last)
    return out


def test_like_one_pass_and_in_stretches(spark):
    r = random.Random(4)
    kinds = ["remembered", "reinforced", "superseded", "contradicted", "forgotten", "restored"]
    rows = [(f"m{r.randint(0, 6)}", r.choice(kinds), r.random() < 0.5, None if r.random() < 0.03 else T0 + timedelta(hours=r.randint(0, 40)), T0 + timedelta(days=r.randint(3, 4)), f"e{i:04}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = one_pass(rows)
    for stretch in (10_000, 20):
        got = {x[0]: tuple(x[1:]) for x in replay.replay(df, stretch).collect()}
        assert got == want
    assert replay.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deliveries(spark):
    schema = "id string, memory_id string, scope_key string, event_type string, payload_json string, idempotency_key string, occurred_at timestamp_ntz, created_at timestamp_ntz, kind string"
    t = lambda h: T0 + timedelta(hours=h)
    rows = [
        ("1", None, "s", " Remembered", '{"memory_id":"m","content":"x"}', "k", t(1), t(2), "clash"),
        ("2", None, "s", "remembered", '{"memory_id":"m","content":"x"}', "k", t(1), t(5), None),
        ("3", "m", "s", "REINFORCED", '{"memory_id":"m"', None, t(2), t(2), None),  # broken
        ("4", "m", "s", "superseded", '{"content":null}', None, t(3), t(3), None),
        ("5", None, "s", "reinforced", "{}", None, t(4), t(4), None),  # names none
        ("6", "n", "s", "reinforced", '{"content":"y"}', None, t(4), t(4), None),  # was never there
        ("7", "m", "s", None, "{}", None, t(9), t(9), None),
    ]
    got = [tuple(r) for r in replay.current_memories(spark.createDataFrame(rows + rows, schema)).collect()]
    assert got == [("m", "superseded", "1", "4")]
    assert replay.current_memories(spark.createDataFrame([], schema)).count() == 0


def test_a_gap_holds_what_comes_after_it(spark):
    schema = "id string, memory_id string, scope_key string, event_type string, payload_json string, idempotency_key string, occurred_at timestamp_ntz, created_at timestamp_ntz, tx_id string, part_no int, tx_size int, commit_seq long"
    t = lambda h: T0 + timedelta(hours=h)
    row = lambda i, m, kind, h, tx, part, size, seq, payload="{}": (i, m, "s", kind, payload, None, t(h), t(h), tx, part, size, seq)
    rows = [
        row("1", "m", "remembered", 1, "a", 1, 2, 1), row("2", "n", "remembered", 1, "a", 2, 2, 1), row("2", "n", "remembered", 1, "a", 2, 2, 1),
        row("3", "m", "superseded", 2, "b", 1, 1, 2), row("4", "m", "reinforced", 3, "c", 1, 2, 3),  # half of it
        row("6", "n", "contradicted", 9, "d", 1, 1, 4), row("7", "o", "remembered", 9, "e", 1, 1, 6),
    ]
    state = lambda r: {tuple(x) for x in replay.current_memories(spark.createDataFrame(r, schema)).collect()}
    assert state(rows) == {("m", "superseded", None, "3"), ("n", "active", None, "2")}
    whole = rows + [row("5", "n", "reinforced", 3, "c", 2, 2, 3, "{broken")]  # a part of no effect completes its transaction
    assert state(whole) == {("m", "superseded", None, "4"), ("n", "contradicted", None, "6")}
    assert state(whole + [row("8", "o", "forgotten", 1, "f", 1, 1, 5)]) == {("m", "superseded", None, "4"), ("n", "contradicted", None, "6"), ("o", "active", None, "7")}
    assert state(rows[4:]) == set()  # nothing from the first number on


def test_numbers_are_dense_and_follow_the_order(spark):
    rows = [(i % 7 if i % 5 else None, i) for i in range(500)]
    got = replay.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).orderBy("commit_seq").collect()
    assert [r.commit_seq for r in got] == list(range(1, 501))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))


def test_one_instant_is_spread_over_stretches(spark):
    rows = [("m", "remembered" if i == 0 else "reinforced", False, T0, T0, f"e{i:05}") for i in range(3000)]
    assert [tuple(r) for r in replay.replay(spark.createDataFrame(rows, SCHEMA), 100).collect()] == [("m", "active", None, "e02999")]


def test_many_rows_that_name_no_memory(spark):
    schema = "id string, memory_id string, scope_key string, event_type string, payload_json string, idempotency_key string, occurred_at timestamp_ntz, created_at timestamp_ntz"
    t = lambda h: T0 + timedelta(hours=h)
    nameless = [(f"x{i:02}", None, "s", "remembered", "{}", None, t(i), t(i)) for i in range(30)]
    calm = [("a", "calm", "s", "remembered", '{"content":"x"}', None, t(1), t(1))]
    busy = [(f"b{i:02}", "busy", "s", "remembered" if i == 0 else "reinforced", "{}", None, t(i), t(i)) for i in range(12)]
    for rows in (nameless + calm, nameless + calm + busy):
        log = spark.createDataFrame(rows, schema)
        want = {tuple(r) for r in replay.current_memories(log).collect()}
        assert {r[0] for r in want} == {r[1] for r in rows if r[1]}
        assert {tuple(r) for r in replay.current_memories(log, stretch=5).collect()} == want


def test_watermark_holds_gaps(spark):
    parts = [(tx, n, tx, 2) for tx in (1, 2, 4, 5) for n in (1, 2)] + [(3, 1, 3, 2), (3, 1, 3, 2), (6, 1, None, 1)]
    df = spark.createDataFrame(parts, "tx_id int, part_no int, commit_seq int, tx_size int")
    assert replay.committed_watermark(replay.complete_transactions(df)).first()[0] == 2
    assert {r.tx_id for r in replay.committed_changes(df).collect()} == {1, 2}
    healed = df.union(spark.createDataFrame([(3, 2, 3, 2)], df.schema))
    for block in (1 << 20, 2):
        assert replay.committed_watermark(replay.complete_transactions(healed), block=block).first()[0] == 5
    assert replay.committed_watermark(replay.complete_transactions(df.limit(0))).first()[0] == 0


def test_committed_over_several_blocks(spark):
    from palimpsest.plans import problems

    parts = spark.createDataFrame([(tx, n, tx, 2) for tx in range(1, 10) for n in (1, 2) if (tx, n) != (8, 2)], "tx_id int, part_no int, commit_seq int, tx_size int")
    assert {r.tx_id for r in replay.committed_changes(parts, block=2).collect()} == set(range(1, 8))
    data = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").distinct().count()
    # lost parts lie in the last tenth of the orders
    assert 0.8 * orders < problems.QUERIES["p4_committed_whole"](spark, data).select("tx_id").distinct().count() < orders
