import random
from itertools import combinations

import numpy as np
import pytest

from palimpsest.llm import neardup


def shingles(text):
    w = neardup.WORDS.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 5 else None


def brute(rows):
    sets = [(i, s) for i, t in rows if i is not None and (s := shingles(t))]
    return {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets, 2) if a != b and 2 * len(x & y) >= len(x | y)}


def made(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = [r.choice(words) for _ in range(r.randint(20, 60))]
        for k in range(r.randint(1, 4)):
            w = base[:]
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(w))
                r.choice([lambda: w.pop(at), lambda: w.insert(at, "neu"), lambda: w.__setitem__(at, "ander")])()
            rows.append((f"m{g:03}-{k}", " ".join(w) if r.random() < 0.8 else ", ".join(w).upper()))
    return rows


EDGE = [("e1", None), ("e2", ""), ("e3", "one two three four"), (None, "a b c d e f"), ("e4", "a b c d e"), ("e5", "A, b; c d\te!"), ("e5", "A, b; c d\te!"), ("e6", "x " * 50_000)]


def test_every_pair_is_found(spark):
    rows = made(1, 120) + EDGE
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "id string, content string, a int, class string")
    found = [tuple(r) for r in neardup.similar_pairs(df, "id", "content").collect()]
    want = brute(set(rows))
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(want & set(found)) >= 0.99 * len(want) and ("e4", "e5") in found
    assert neardup.similar_pairs(df.limit(0), "id", "content").count() == 0


def test_groups(spark):
    rows = made(2, 30) + EDGE
    df = spark.createDataFrame(rows, "id string, content string")
    got = neardup.groups(df, "id", "content").collect()
    by = {r.id: r for r in got}
    assert len(got) == len({i for i, t in rows if i and shingles(t)})
    for a, b in brute(set(rows)):
        assert by[a].group_id == by[b].group_id


@pytest.mark.parametrize(("radius", "places"), [(1, 3), (2, 6), (2, 7), (3, 9)])
def test_masks_cover_the_radius(radius, places):
    masks = neardup.covering_masks(radius, places)
    for differ in combinations(range(places), radius):
        assert (~masks[:, list(differ)].any(1)).any()


def test_blocks_find_what_single_steps_find(monkeypatch):
    rng = np.random.default_rng(3)
    sketch = neardup.Sketch()
    symbols = rng.integers(0, 1 << 62, (40, sketch.width), dtype=np.uint64)[rng.integers(0, 40, 300)]
    worn = rng.random(symbols.shape) < 0.2
    symbols[worn] = rng.integers(0, 1 << 62, int(worn.sum()), dtype=np.uint64)
    brief, least = sketch.brief(symbols), sketch.least_agreement(0.5)
    h, items = np.zeros(300, np.uint64), np.arange(300)

    def pairs():
        found, hot = neardup._group_pairs(h, items, brief, least)
        return sorted(tuple(sorted(p)) for part in found for p in part.tolist()), hot.tolist()

    monkeypatch.setattr(neardup, "FEW", 1000)
    single = pairs()
    monkeypatch.setattr(neardup, "FEW", 8)
    assert pairs() == single and single[0] and not single[1]
    monkeypatch.setattr(neardup, "HOT", 200)
    assert pairs() == ([], items.tolist())


def openings(n, seed=5):
    """Texts with one opening of a third of their words, a tenth of them edited copies of another."""
    r = random.Random(seed)
    opening = " ".join(f"o{i}" for i in range(14))
    bodies = [[f"b{r.randrange(20_000)}" for _ in range(28)] for _ in range(n)]
    for i in range(0, n - 1, 10):
        bodies[i + 1] = bodies[i][:]
        bodies[i + 1][r.randrange(28)] = "ander"
    return [(f"m{i:06}", f"{opening} {' '.join(b)}") for i, b in enumerate(bodies)]


def test_a_crowd_under_one_key(spark, monkeypatch):
    rows = openings(600)
    df = spark.createDataFrame(rows, "id string, content string")
    monkeypatch.setattr(neardup, "HOT", 50)
    assert not neardup.candidates(df.select(df["content"].alias("text"))).where("hot").isEmpty()
    found = [tuple(r) for r in neardup.similar_pairs(df, "id", "content").collect()]
    assert len(found) == len(set(found)) == len(set(found) & brute(rows)) == len(brute(rows)) >= 60


def test_exact_links(spark):
    r = random.Random(6)
    sets = [(i, sorted({r.choice([r.randrange(12), r.randrange(3000)]) for _ in range(r.randint(1, 14))})) for i in range(250)]
    got = {(x.a, x.b) for x in neardup.exact_links(spark.createDataFrame(sets, "class bigint, shingles array<int>"), 0.5).collect()}
    want = {(a, b) for (a, x), (b, y) in combinations(sets, 2) if 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    assert got == want and want
