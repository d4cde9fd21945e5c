from datetime import datetime as T

import pytest

from palimpsest.streaming import lambda_store
from palimpsest.streaming.lambda_store import LambdaStore

SCHEMA = "id string, scope_key string, tenant_id string, memory_id string, idempotency_key string, occurred_at timestamp_ntz, created_at timestamp_ntz"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    ("a", "s", "t", "m", "k1", T(2020, 1, 1, 10), T(2020, 1, 1, 11)),
    ("b", "s", "t", "m", "k1", T(2020, 1, 1, 10), T(2020, 1, 3, 11)),  # redelivered under a new id
    ("c", "s", "t", "m", None, T(2020, 1, 1, 23), T(2020, 1, 2, 1)),  # on the limit: not in the first count
    ("d", "z", "t", "m", "k1", T(2020, 1, 1, 9), T(2020, 1, 4, 23, 59)),  # same key in another scope, just in time
    ("e", "s", "t", "m", None, T(2020, 1, 1, 9), T(2020, 1, 5)),  # past the cut-off
    ("f", "s", None, None, None, T(2020, 1, 2, 9), T(2020, 1, 2, 9)),
    ("g", None, "t", "m", None, None, T(2020, 1, 2, 9)),  # no time: no period
    (None, None, None, None, None, None, None),
]


def served(store):
    return {(r.tenant_id, str(r.day), r.n, r.state) for r in store.serve().collect()}


def layers(spark, folder, rows, **how):
    return {tuple(r) for r in lambda_store.played(log(spark, rows), LambdaStore(spark, str(folder)), **how).collect()}


def test_played(spark, tmp_path):
    want = {("t", "2020-01-01", 1, 3, True), (None, "2020-01-02", 1, 1, True)}
    for batches in (1, 3, 7):  # cuts between a change and its redelivery make no difference
        assert layers(spark, tmp_path / f"a{batches}", ROWS + ROWS, batches=batches) == want
    assert [tuple(r) for r in lambda_store.corrected_periods(log(spark, ROWS), LambdaStore(spark, str(tmp_path / "b"))).collect()] == [("t", "2020-01-01", 1, 3)]
    assert layers(spark, tmp_path / "c", []) == set()
    assert layers(spark, tmp_path / "d", ROWS[-1:]) == set()
    # a period of late arrivals only is known, with nothing in it
    assert layers(spark, tmp_path / "e", ROWS[4:5]) == {("t", "2020-01-01", 0, 0, True)}


def test_store_follows_the_batch_view(spark, tmp_path):
    store = LambdaStore(spark, str(tmp_path / "store"))
    assert served(store) == set()
    rows = sorted((r for r in ROWS if r[6]), key=lambda r: r[6])
    for i, r in enumerate(rows[:4]):
        store.ingest(log(spark, [r]), i)
        store.ingest(log(spark, [r]), i)  # a repeated batch replaces itself
    assert served(store) == {("t", "2020-01-01", 2, "open"), (None, "2020-01-02", 1, "open")}
    store.run_batch(1, T(2020, 1, 3, 12))
    assert served(store) == {("t", "2020-01-01", 2, "open"), (None, "2020-01-02", 1, "open")}
    for i, r in enumerate(rows[4:], 4):
        store.ingest(log(spark, [r]), i)
    assert ("t", "2020-01-01", 3, "open") in served(store)
    store.run_batch(2, T(2020, 1, 6, 12))
    final = {("t", "2020-01-01", 3, "frozen"), (None, "2020-01-02", 1, "frozen")}
    assert served(store) == final
    store.ingest(log(spark, [("z", "s", "t", "m", "k9", T(2020, 1, 1, 1), T(2020, 1, 9))]), 9)
    assert served(store) == final
    store.run_batch(3, T(2020, 1, 10))
    assert served(store) == final


def test_runs_repeated_and_cut_off(spark, tmp_path):
    store = LambdaStore(spark, str(tmp_path / "store"))
    store.ingest(log(spark, ROWS[:5]), 0)
    store.run_batch(1, T(2020, 1, 6))
    final = served(store)
    assert final == {("t", "2020-01-01", 3, "frozen")}
    store.run_batch(1, T(2020, 1, 6))  # the frozen period stays frozen
    assert served(store) == final
    # a run that ended before its last write counts for nothing, and can be done again
    store.ingest(log(spark, [("y", "s", "t", "m", None, T(2020, 1, 8, 1), T(2020, 1, 8, 2))]), 1)
    marker = tmp_path / "store" / "runs" / "run=2"
    store.run_batch(2, T(2020, 1, 9))
    before = served(store)
    for f in marker.iterdir():
        f.unlink()
    marker.rmdir()
    assert served(store) == before == final | {("t", "2020-01-08", 1, "open")}
    store.run_batch(2, T(2020, 1, 9))
    assert served(store) == before
    with pytest.raises(ValueError):
        store.run_batch(3, T(2020, 1, 8))


def test_rows_after_the_instant_of_a_run_are_served(spark, tmp_path):
    store = LambdaStore(spark, str(tmp_path / "store"))
    day = T(2020, 1, 1)
    rows = [(f"r{h}", "s", "t", "m", None, day, T(2020, 1, 1, h)) for h in (2, 3, 9, 10, 11)]
    store.ingest(log(spark, rows), 0)
    store.run_batch(1, T(2020, 1, 1, 9))
    assert served(store) == {("t", "2020-01-01", 5, "open")}


def test_redelivered_with_nulls(spark, tmp_path):
    store = LambdaStore(spark, str(tmp_path / "store"))
    for i, r in enumerate([("a", None, "t", "m", "k", T(2020, 1, 1), T(2020, 1, 1, 1)), ("b", None, "t", "m", "k", T(2020, 1, 1), T(2020, 1, 1, 2)), (None, None, "t", "m", None, T(2020, 1, 1), T(2020, 1, 1, 3)), (None, None, "t", "m", None, T(2020, 1, 1), T(2020, 1, 1, 4))]):
        store.ingest(log(spark, [r]), i)
    assert served(store) == {("t", "2020-01-01", 2, "open")}


def test_store_from_a_stream(spark, tmp_path):
    log(spark, [r for r in ROWS if r[6]]).write.parquet(str(tmp_path / "in"))
    store = LambdaStore(spark, str(tmp_path / "store"))
    store.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    store.run_batch(1, T(2021, 1, 1))
    assert {(r.tenant_id, str(r.day), r.n) for r in store.serve().collect()} == {("t", "2020-01-01", 3), (None, "2020-01-02", 1)}
