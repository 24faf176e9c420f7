"""The core's operators on keys, snapshots, frequent values and hierarchies: edge cases against brute force."""

import random
from collections import Counter

import pytest

from factweave.operators import frequent, hierarchy, snapshots, treeagg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (7, 2), (23, 3)])
def test_tree_aggregate_equals_group_by(spark, parts, fan_in):
    rng = random.Random(parts)
    data = [(rng.choice(["hot"] * 20 + ["a", "b", None, ""]), rng.choice([None, 1, 5, -2]), "x") for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v int, n string").repartition(parts)
    got = treeagg.tree_aggregate(df, ["k"], {"n": ("count", None), "v": ("count", df.v), "s": ("sum", df.v), "lo": ("min", df.v), "hi": ("max", df.v)}, fan_in)
    want = []
    for k in {d[0] for d in data}:
        v = [d[1] for d in data if d[0] == k and d[1] is not None]
        want.append((k, sum(d[0] == k for d in data), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None)))
    assert rows(got) == sorted(want, key=str)


def test_tree_aggregate_edges(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert rows(treeagg.tree_aggregate(empty, ["k"], {"n": ("count", None)})) == []
    one = spark.createDataFrame([(None, None)], "k string, v int")
    assert rows(treeagg.tree_aggregate(one, ["k"], {"s": ("sum", one.v)})) == [(None, None)]
    with pytest.raises(ValueError):
        treeagg.tree_aggregate(one, ["k"], {"n": ("median", None)})
    with pytest.raises(ValueError):
        treeagg.tree_aggregate(one, ["k"], {"n": ("count", None)}, fan_in=1)
    assert [treeagg.rounds_for(n, 4) for n in (1, 4, 5, 16, 17)] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("buckets", [2, 64])
def test_frequent_values_misses_none(spark, buckets):
    rng = random.Random(buckets)
    data = [(rng.choice(["a"] * 30 + ["b"] * 10 + [f"v{i}" for i in range(60)] + [None, ""]),) for _ in range(2000)]
    df = spark.createDataFrame(data, "c string")
    n = Counter(v for (v,) in data if v)
    total = sum(n.values())
    want = sorted(("c", v, k) for v, k in n.items() if k >= 0.05 * total)
    got = frequent.frequent_values(df, ["c"], 0.05, buckets=buckets).select("field_name", "field_value", "n")
    assert rows(got) == want and len(want) == 2


def test_frequent_values_edges(spark):
    assert rows(frequent.frequent_values(spark.createDataFrame([], "c string"), ["c"], 0.1)) == []
    assert rows(frequent.frequent_values(spark.createDataFrame([(None,), ("",)], "c string"), ["c"], 0.1)) == []
    tie = spark.createDataFrame([("x", "n"), ("y", "n")], "c string, field_name string")
    assert [r[1] for r in rows(frequent.frequent_values(tie, ["c"], 0.5))] == ["x", "y"]
    long = "z" * 100_000
    assert rows(frequent.frequent_values(spark.createDataFrame([(long,)], "c string"), ["c"], 1.0))[0][1] == long


def test_instants(spark):
    texts = ["2031-01-01T00:00:00Z", "2031-01-01T02:00:00.5+02:00", "2030-12-31T23:30:00.123456789-00:30", "2031-01-01T00:00:00.1234567+00:00", "bad", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    base = 1924992000 * 10**9
    got = [r[0] for r in df.select(snapshots.instant_nanos(df.t)).collect()]
    assert got == [base, base + 500_000_000, base + 123_456_789, base + 123_456_700, None, None, None]


RUNS = "id string, created_at_utc_text string, solution_path string, source_project_path string"
FACTS = "run_id string, fact_index int, symbol_id string, body_hash string"


def test_symbol_changes(spark):
    runs = [
        ("r2", "2031-01-01T10:00:00+02:00", "s", None),  # 08:00
        ("r1", "2031-01-01T07:30:00Z", "s", None),
        ("r3", "2031-01-02T00:00:00Z", "s", None),
        ("r3", "2031-01-02T00:00:00Z", "s", None),  # delivered twice
        ("p", "2031-01-01T09:00:00Z", "s", "one.csproj"),  # not a full run
        ("e", "2031-01-01T09:00:00Z", "s", None),  # no symbols
        (None, None, None, None),
    ]
    facts = [
        ("r1", 0, "A", "aa"), ("r1", 1, "B", "b1"), ("r1", 2, "C", None), ("r1", 3, "D", "d1"), ("r1", 4, "E", "e1"),
        ("r2", 0, "A", "AA"), ("r2", 1, "B", "b2"), ("r2", 2, "C", "c2"), ("r2", 9, "D", "d1"), ("r2", 5, "D", "dx"),
        ("r3", 0, "A", ""), ("r3", 1, "E", "e2"), ("r3", 1, "E", "e2"), ("r3", 4, "C", "c3"), ("p", 0, "Z", "z"),
        (None, 0, "A", "x"), ("r1", 7, None, "x"),
    ]
    got = snapshots.symbol_changes(spark.createDataFrame(runs, RUNS), spark.createDataFrame(facts, FACTS))
    assert rows(got) == sorted([
        ("r2", "B", "changed"), ("r2", "E", "removed"), ("r3", "E", "added"), ("r3", "B", "removed"), ("r3", "D", "removed"), ("r3", "C", "changed"),
    ], key=str)
    none = spark.createDataFrame([], RUNS)
    assert rows(snapshots.symbol_changes(none, spark.createDataFrame(facts, FACTS))) == []
    assert rows(snapshots.symbol_changes(none, spark.createDataFrame([], FACTS))) == []


def brute_tree(data):
    out = {}
    parents = {(g, n): p for g, n, p in data}
    for (g, n), _ in parents.items():
        path, at, seen = [n], n, {n}
        status = "tree"
        while (p := parents.get((g, at))) is not None and (g, p) in parents:
            if p in seen:
                status = "cycle" if p == n else "below_cycle"
                break
            path.append(p)
            seen.add(p)
            at = p
        if status == "below_cycle" and any(n == x for x in walk_cycle(parents, g, n)):
            status = "cycle"
        out[g, n] = (status, path[::-1] if status == "tree" else None)
    return out


def walk_cycle(parents, g, n):
    seen, at = [], n
    while at not in seen:
        seen.append(at)
        at = parents[g, at]
    return seen[seen.index(at):]


@pytest.mark.parametrize("seed,block", [(1, 3), (2, 7), (3, 50_000)])
def test_hierarchies_against_brute_force(spark, seed, block):
    rng = random.Random(seed)
    data = []
    for g in ("g1", "g2"):
        names = [f"n{i:02d}" for i in range(40)]
        for i, n in enumerate(names):
            kind = rng.random()
            p = None if kind < 0.1 else "absent" if kind < 0.15 else rng.choice(names) if kind < 0.25 else names[max(0, i - rng.randint(1, 3))]
            data.append((g, n, p))
    df = spark.createDataFrame(data, "grp0 string, node0 string, parent0 string")
    got = {(r.grp0, r.node0): r for r in hierarchy.hierarchies(df, "grp0", "node0", "parent0", block).collect()}
    want = brute_tree(data)
    assert set(got) == set(want)
    for key, (status, path) in want.items():
        r = got[key]
        assert r.status == status, key
        if status == "tree":
            assert r.path.split(hierarchy.PATH_SEPARATOR) == path and r.depth == len(path) - 1 and r.root == path[0]
            below = [k for k, (s, p) in want.items() if s == "tree" and k[0] == key[0] and key[1] in p[:-1]]
            assert r.n_below == len(below)
            for k in below:
                assert r.entry < got[k].entry and got[k].exit < r.exit
    tree = hierarchy.hierarchies(df, "grp0", "node0", "parent0", block)
    pairs = {(r.grp0, r.node0, r.below, r.distance) for r in hierarchy.below(tree, "grp0", "node0").collect()}
    assert pairs == {(g, a, n, len(p) - 1 - i) for (g, n), (s, p) in want.items() if s == "tree" for i, a in enumerate(p[:-1])}
    cyc = {(r[0], r[1]) for r in hierarchy.cyclic_nodes(df, "grp0", "node0", "parent0").collect()}
    assert cyc == {k for k, (s, _) in want.items() if s == "cycle"}


def test_hierarchies_edges(spark):
    schema = "g string, n string, p string"
    assert rows(hierarchy.hierarchies(spark.createDataFrame([], schema), "g", "n", "p")) == []
    assert rows(hierarchy.cyclic_nodes(spark.createDataFrame([("g", "a", "a"), ("g", "b", "a")], schema), "g", "n", "p")) == [("g", "a")]
    chain = spark.createDataFrame([("g", f"{i:03d}", f"{i - 1:03d}" if i else None) for i in range(150)], schema)
    deep = {r.n: r for r in hierarchy.hierarchies(chain, "g", "n", "p", 10).collect()}
    assert deep["149"].depth == 149 and deep["000"].n_below == 149 and deep["149"].root == "000"
    facts = spark.createDataFrame([("r", 1, "A", ""), ("r", 2, "A", "B"), ("r", 0, "B", None), (None, 1, "X", "Y")], "run_id string, fact_index int, symbol_id string, containing_symbol_id string")
    assert rows(hierarchy.symbol_parents(facts)) == [("r", "A", "B"), ("r", "B", None)]


def test_clashing_columns_are_ignored(spark):
    schema = "g string, n string, p string, id long, status string, path string, depth int"
    df = spark.createDataFrame([("g", "a", None, 1, "x", "y", 9), ("g", "b", "a", 1, "x", "y", 9)], schema)
    got = hierarchy.hierarchies(df, "g", "n", "p").select("n", "status", "depth")
    assert rows(got) == [("a", "tree", 0), ("b", "tree", 1)]
    runs = spark.createDataFrame([("r1", "2031-01-01T00:00:00Z", "s", None, 5, 5), ("r2", "2031-01-02T00:00:00Z", "s", None, 5, 5)], RUNS + ", seq int, run_id int")
    facts = spark.createDataFrame([("r1", 0, "A", "1", 7, "q"), ("r2", 0, "A", "2", 7, "q")], FACTS + ", seq int, change_type string")
    assert rows(snapshots.symbol_changes(runs, facts)) == [("r2", "A", "changed")]
