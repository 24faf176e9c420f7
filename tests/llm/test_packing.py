"""Containers: every item once, none too full, never worse than best fit."""

import random
from collections import Counter

import pytest

from factweave.llm import packing as B


def used(plan):
    c = Counter()
    for filling, n in plan:
        for s in filling:
            c[s] += n
    return c


@pytest.mark.parametrize("seed", range(8))
def test_plans_hold_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 512])
    counts = Counter(rng.randint(max(1, capacity // 8), capacity if seed % 2 else capacity // 2) for _ in range(120))
    plan, best = B.bin_completion(counts, capacity), B.best_fit(counts, capacity)
    assert used(plan) == used(best) == counts
    assert all(sum(f) <= capacity for f, _ in plan + best)
    n = sum(k for _, k in plan)
    assert -(-sum(s * k for s, k in counts.items()) // capacity) <= n <= sum(k for _, k in best)


def test_search_beats_best_fit():
    # 20 containers are filled exactly, which best fit misses
    counts = Counter({44: 20, 24: 20, 22: 20, 21: 2 * 10, 27: 20, 23: 20, 39: 10})
    rng = random.Random(3)
    gained = 0
    for _ in range(30):
        cut = Counter()
        for _ in range(12):
            a, b = sorted(rng.sample(range(18, 82), 2))
            if b - a >= 10:
                cut.update([a, b - a, 100 - b])
            else:
                cut.update([a, 100 - a])
        plan, best = B.bin_completion(cut, 100), B.best_fit(cut, 100)
        n, m = sum(k for _, k in plan), sum(k for _, k in best)
        assert used(plan) == cut and n <= m
        gained += m - n
    assert gained > 0
    assert used(B.bin_completion(counts, 100)) == counts


def fewest(items, capacity):
    """Containers of the best packing, by trying every place for every item."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_exact_search_finds_the_fewest():
    rng, gained, beaten = random.Random(5), 0, 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(max(1, capacity // 6), capacity * 2 // 3) for _ in range(rng.randint(1, 11))]
        plan = B.bin_completion(Counter(items), capacity, exact=True)
        n = sum(k for _, k in plan)
        assert used(plan) == Counter(items) and all(sum(f) <= capacity for f, _ in plan)
        assert n == fewest(items, capacity), (items, capacity)
        gained += sum(k for _, k in B.best_fit(Counter(items), capacity)) - n
        beaten += sum(k for _, k in B.bin_completion(Counter(items), capacity)) - n
    assert gained > 0 and beaten >= 0


def test_edges():
    assert B.bin_completion({}, 10) == [] and B.bin_completion({5: 0}, 10) == []
    assert B.bin_completion({10: 3}, 10) == [((10,), 3)]
    assert sum(n for _, n in B.bin_completion({1: 1_000_000_000}, 8192)) == -(-1_000_000_000 // 8192)
    with pytest.raises(ValueError):
        B.bin_completion({11: 1}, 10)


def test_spark_pack(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, 0, 3, 3, 9, 10, 11, 37, rng.randint(1, 25)]), "c") for i in range(300)] + [(7, 4, "c")]
    df = spark.createDataFrame(data, "doc_id long, n_tokens int, container_id string")
    got = B.pack(df, "doc_id", "n_tokens", [(1, 10), (2, 25)]).collect()
    for w, cap in ((1, 10), (2, 25)):
        mine = [r for r in got if r.window_id == w]
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        pieces = Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in mine)
        want = Counter((d, i, i * cap, min(cap, n - i * cap)) for d, n, _ in data if n for i in range(-(-n // cap)))
        assert pieces == want
        assert len(fill) <= 1.1 * -(-sum(fill.values()) // cap) + 1
    assert B.pack(df.where("false"), "doc_id", "n_tokens", [(1, 10)]).count() == 0
    assert B.pack(df, "doc_id", "n_tokens", []).count() == 0
