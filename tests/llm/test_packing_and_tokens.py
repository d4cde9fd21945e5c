import random

import numpy as np
import pytest
from compare import differences, duck

from palimpsest.llm import packing, queries, tokenizers

DATA = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "   ", "naïve 🙂 <|endoftext|> x", "日本語 テキスト\n\n  \t end ", "word " * 40_000, "é" * 300, "‍​\x00", "a", "don't stop 123456 ½"]
SCHEMA = "doc_id bigint, text string, key string, ids string"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "k", "clash") for i, t in enumerate(TEXTS)] + [(None, "null key", None, None), (2, "a", "k", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_encoding_round_trip(documents):
    got = tokenizers.encode(documents)
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids[0] == [] and ids[1] == [] and len(got.collect()) == len(TEXTS) + 2
    back = {r.doc_id: r.text for r in tokenizers.decode(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert tokenizers.encode(documents.limit(0)).count() == 0


def test_ids_are_those_of_the_library(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(tokenizers.vocabulary(tokenizers.BYTE_BPE)))
    t.encode_special_tokens = True
    for r in tokenizers.encode(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids


def test_offsets(documents):
    for r in tokenizers.token_offsets(documents.where("doc_id is not null")).collect():
        text = TEXTS[r.doc_id] or ""
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)
        covered = {i for s in r.spans for i in range(s.start, s.end)}
        assert covered == set(range(len(text)))


def test_counts_equal_full_encodings():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS] + ["trailing ", " lead", "a  b\n\n c", "ÀÉ Straße ﬁ"]
    names = ("byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k", "word_bpe_49k")
    got = dict(zip(names, tokenizers.counter(names).counts(texts)))
    piece = sentencepiece.SentencePieceProcessor(model_file=str(tokenizers.vocabulary("piece_bpe_32k")))
    assert got["piece_bpe_32k"] == [len(x) for x in piece.encode(texts)]
    for name in ("byte_bpe_50k", "word_bpe_49k"):
        t = Tokenizer.from_file(str(tokenizers.vocabulary(name)))
        t.encode_special_tokens = True
        assert got[name] == [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole_and_tight(spark, documents):
    windows = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "word_bpe_49k", 1000), (3, "piece_bpe_32k", 1)], "window_id bigint, tokenizer string, capacity_tokens bigint")
    packed = packing.pack(documents, windows).collect()
    for w, name, capacity in [(1, "byte_bpe_50k", 64), (2, "word_bpe_49k", 1000), (3, "piece_bpe_32k", 1)]:
        mine = [r for r in packed if r.window_id == w]
        load: dict = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.token_end - r.token_start
        assert max(load.values()) <= capacity
        sizes = dict(enumerate(tokenizers.counter((name,)).counts([t or "" for t in TEXTS])[0]))
        for i, t in enumerate(TEXTS):
            parts = sorted((r.token_start, r.token_end) for r in mine if r.doc_id == i)
            if not t:
                assert not parts
                continue
            copies = 2 if i == 2 else 1
            assert sum(b - a for a, b in parts) == sizes[i] * copies
            assert len(parts) == copies * max(1, -(-sizes[i] // capacity))
        assert any(r.doc_id is None for r in mine)
    assert packing.pack(documents, windows.limit(0)).count() == 0
    assert packing.pack(documents.limit(0), windows).count() == 0


def test_tiers_leave_little_room():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(5, 1, 20_000).astype(np.int64) + 1, 2048)
    made = packing.pack_window(np.arange(len(sizes)), sizes, 2048)
    assert sizes.sum() / (made.container.nunique() * 2048) > 0.99
    cost = (made.token_end - made.token_start).pow(2).groupby(made.step_group).sum()
    full = made.groupby("step_group").container.nunique() == packing.STEP
    assert cost[full].max() / cost[full].mean() < 1.1


def test_tiers_differ_from_best_fit_decreasing():
    sizes = np.random.default_rng(3).integers(20, 700, 400)
    where, tiers = packing.pack_tiers(sizes, 1024)
    assert sizes[tiers == 0].min() > 256 >= sizes[tiers == 1].max() and sizes[tiers == 1].min() > 64 >= sizes[tiers == 2].max()
    load = np.bincount(where, sizes)
    assert load.max() <= 1024 and load.sum() == sizes.sum() and load.sum() / (len(load) * 1024) > 0.98
    room, plain = packing.Room(), []
    order = np.argsort(-sizes, kind="stable")
    for n in sizes[order]:
        at = room.take(int(n))
        if at is None:
            at = len(set(plain))
            room.add(at, 1024 - int(n))
        plain.append(at)
    filled = lambda sizes, where: sorted(sorted(sizes[where == c].tolist()) for c in set(where.tolist()))
    assert filled(sizes, where) != filled(sizes[order], np.array(plain))


def test_windows_of_a_tier_are_stacked():
    where, _ = packing.pack_tiers(np.array([128, 128] * 6 + [200, 190]), 1024)
    assert len(set(where[:8])) == 1 and len(set(where[8:])) == 1  # the loose 200 and 190 fill what is left


def test_repeated_ids_are_spread(spark):
    windows = spark.createDataFrame([(1, "byte_bpe_50k", 64)], "window_id bigint, tokenizer string, capacity_tokens bigint")
    rows = spark.createDataFrame([(None if i % 2 else 7, "some words " * (1 + i % 9)) for i in range(400)], "doc_id bigint, text string")
    packed = packing.pack(rows, windows, group_texts=100).collect()
    assert len(packed) == 400 and len({r.container_id >> 32 for r in packed}) == 4


def test_step_groups_are_even():
    r = random.Random(1)
    costs = np.array([r.random() for _ in range(640)])
    g = packing.step_groups(costs, 64)
    assert np.bincount(g).tolist() == [64] * 10 and np.ptp(np.bincount(g, costs)) < 1.0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert differences(spark, duck(DATA), name, queries.QUERIES[name], queries.SQL[name], DATA) is None
