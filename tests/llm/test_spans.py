import random

import numpy as np

from palimpsest.llm import exchange, spans


def brute(docs, n):
    owner: dict = {}
    for d, t in docs:
        for i in range(len(t) - n + 1):
            owner.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in docs:
        run = None
        for i in range(len(t) - n + 1):
            if len(owner[t[i : i + n]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + n
                else:
                    if run:
                        out.add((d, *run))
                    run = [i, i + n]
        if run:
            out.add((d, *run))
    return out


def made(seed, n_docs, shared, length):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé日🙂 \n") for _ in range(n))
    passages = [word(length) for _ in range(shared)]
    docs = []
    for i in range(n_docs):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 30)
            t += word(r.randint(0, 60)) + p[a : len(p) - r.randint(0, 30)]
        docs.append((i, t))
    return docs


def check(spark, docs, n):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, anchor int, hits string")
    got = {tuple(r) for r in spans.shared_spans(df, n).collect()}
    assert got == brute([(d, t) for d, t in docs if t and d is not None], n)


def test_like_brute_force(spark):
    for seed in range(3):
        check(spark, made(seed, 60, 4, 140), 50)


def test_limits_of_length(spark):
    base = "".join(random.Random(9).choice("abcdefgh") for _ in range(400))
    docs = [(1, "x" + base[:200] + "y"), (2, "zz" + base[:200]), (3, base[1:200] + "!"), (4, None), (5, ""), (6, base[100:360]), (7, "q" * 13 + base[90:310])]
    check(spark, docs, 200)


def test_copies_and_repeats(spark):
    t = "".join(random.Random(2).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id bigint, text string")
    assert spans.shared_spans(df).count() == 0
    many = spark.createDataFrame([(i, chr(0x4E00 + i) + t) for i in range(40)], "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_spans(many).collect()} == {(i, 1, 301) for i in range(40)}
    share = {r.doc_id: r.share for r in spans.shared_share(many).collect()}
    assert share[0] == 300 / 301
    assert spans.shared_spans(many.limit(0)).count() == 0


def test_large_groups_both_ways(spark, monkeypatch):
    docs = made(5, 80, 2, 120)
    monkeypatch.setattr(spans, "FEW", 2)
    check(spark, docs, 50)
    monkeypatch.setattr(spans, "MANY", 3)
    check(spark, docs, 50)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    r = random.Random(3)
    long = "".join(r.choice("abcdefghij") for _ in range(9000))
    monkeypatch.setattr(spans, "BLOCK", 1000)
    cover = spans.Cover(200)
    codes = spans.code_points(long)
    pieces = []
    for base in range(0, len(codes), cover.step):
        at, _ = cover.anchors(codes[base : base + cover.step + cover.window - 1])
        pieces += (at[at < cover.step] + base).tolist()
    want = [p for p in range(len(long) - cover.window + 1) if p % cover.period in set(cover.residues.tolist())]
    assert pieces == want


def test_cover_and_exchange():
    for q in (2, 3, 5, 11):
        c, p = spans.difference_cover(q), q * q + q + 1
        assert {(a - b) % p for a in c for b in c} == set(range(p))
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    owner, place = np.sort(rng.integers(-5, 40, 500)), rng.integers(0, 1 << 31, 500).astype(np.uint32)
    extra = np.repeat((owner & 255).astype(np.uint8)[:, None], 3, 1)
    h2, index, place2, (owners, more) = exchange.unpack(exchange.pack(h, owner, place, extra), 3)
    assert (h2 == h & exchange.LOW48).all() and (owners[index] == owner).all() and (place2 == place).all() and (more[index] == extra).all()
