"""Registered queries that have to do the whole job, on made tables against brute force."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from factweave.operators import dispatch as D
from factweave.operators import generics as N
from factweave.operators import graph as G
from factweave.sources.tables import SCHEMAS


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def put(spark, folder, name, facts):
    """Write facts (dicts) as a table; columns that aren't given are null."""
    cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    spark.createDataFrame([tuple(f.get(c) for c in cols) for f in facts], SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")


def run(spark, name, folder):
    return entry.queries()[name](spark, str(folder))


def brute_reach(edges, starts):
    depth, level, k = {s: 0 for s in starts}, set(starts), 0
    while level:
        k += 1
        level = {b for a, b in edges if a in level} - set(depth)
        depth.update({x: k for x in level})
    return depth


def test_project_closure_follows_rare_references(spark, tmp_path):
    # one use each: a chain, a cycle back and a branch
    edges = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "B"), ("A", "E")]
    put(spark, tmp_path, "symbol_facts", [{"symbol_id": f"M:{x}", "kind": "method", "defining_assembly": x} for x in "ABCDE"])
    put(spark, tmp_path, "reference_facts", [{"enclosing_symbol_id": f"M:{a}", "target_symbol_id": f"M:{b}", "target_assembly": b, "ref_kind": "invocation"} for a, b in edges])
    want = sorted((s, n) for s in "ABCD" for n in brute_reach(edges, [s]))
    assert rows(run(spark, "e14_project_closure", tmp_path), "seed", "node") == want


def test_adjacency_places_every_edge(spark, tmp_path):
    edges = [("a", f"c{(7 * i) % 40:02d}", i % 5, "invocation", r) for i in range(40) for r in (None, "T:X")] + [("b", "a", 3, "ctor", None), ("b", "a", 3, "ctor", None)]
    put(spark, tmp_path, "call_edges", [{"from_sym": f, "to_sym": t, "line": n, "kind": k, "receiver_type": r} for f, t, n, k, r in edges])
    want = []
    for caller in "ab":
        own = sorted({(n, t, k, r or "") for f, t, n, k, r in edges if f == caller})
        want += [(caller, t, k, n, i) for i, (n, t, k, _) in enumerate(own, 1)]
    assert rows(run(spark, "f25_adjacency_order", tmp_path), "from_sym", "to_sym", "kind", "line", "place") == sorted(want, key=str)


def test_generic_instances_beyond_the_caps(spark, tmp_path):
    # more types than the reference allows in all reach one method, which forwards them
    n, go, then = 100_001, "M:N.Box`1.Go", "M:N.Box`1.Then"
    calls = spark.range(n).selectExpr("concat('M:N.T', id, '.Run') as from_sym", f"'{go}' as to_sym")
    calls.unionAll(spark.createDataFrame([(go, then)], "from_sym string, to_sym string")).write.parquet(f"{tmp_path}/call_edges.parquet")
    found = run(spark, "e15_generic_instances", tmp_path)
    assert rows(found.groupBy("method").count(), "method", "count") == [(go, n), (then, n)]
    edges = run(spark, "e16_monomorphized_edges", tmp_path)
    assert edges.count() == 2 * n + 1 and edges.where("from_sym = 'M:N.Box`1.Go~mono⟨T7⟩'").first().to_sym == "M:N.Box`1.Then~mono⟨T7⟩"


def test_reach_goes_to_the_end(spark, tmp_path):
    # ten calls deep either way, with a cycle at the end
    down = [("M:Controller.Render", "M:d1")] + [(f"M:d{i}", f"M:d{i + 1}") for i in range(1, 10)] + [("M:d10", "M:d8")]
    up = [(f"M:u{i + 1}", f"M:u{i}") for i in range(1, 10)] + [("M:u1", "M:Store.Save"), ("M:u1", "M:Store.Read")]
    put(spark, tmp_path, "call_edges", [{"from_sym": a, "to_sym": b, "kind": "invocation", "line": 1, "non_virtual": False} for a, b in down + up])
    put(spark, tmp_path, "reference_facts", [{"target_symbol_id": "M:Corvane.Mail.Box.Export", "ref_kind": "invocation", "enclosing_symbol_id": "M:d9", "target_in_source": False, "file_path": "f", "line": 1}])
    want = sorted(brute_reach(down, ["M:Controller.Render"]).items())
    assert rows(run(spark, "e2_reach_depth", tmp_path), "node", "depth") == want
    assert rows(run(spark, "e5_reach_payload", tmp_path), "node", "depth") == want
    back = [(b, a) for a, b in up]
    assert rows(run(spark, "e9_reverse_depth", tmp_path), "node", "depth") == sorted(brute_reach(back, ["M:Store.Save"]).items())
    assert rows(run(spark, "j19_callers", tmp_path), "node", "depth") == sorted(brute_reach(back, ["M:Store.Read"]).items())
    assert rows(run(spark, "j17_reaches", tmp_path), "provider", "operation", "nearest", "sites") == [("mail", "send", 9, 1)]


def test_dispatch_through_interfaces(spark, tmp_path):
    # by the projection: B derives from A, A and B implement I, I derives from A
    kinds = {"A": "class", "B": "class", "I": "interface"}
    put(spark, tmp_path, "symbol_facts", [{"symbol_id": f"T:{x}", "kind": "type", "type_kind": k, "modifiers": ""} for x, k in kinds.items()] + [{"symbol_id": f"M:{x}.Go", "kind": "method", "containing_symbol_id": f"T:{x}", "modifiers": "", "is_override": False} for x in kinds])
    put(spark, tmp_path, "reference_facts", [])
    put(spark, tmp_path, "call_edges", [{"from_sym": f"M:x{i}", "to_sym": "M:I.Go", "kind": "invocation", "line": i, "non_virtual": False} for i in range(3)])
    assert rows(run(spark, "f22_reverse_dispatch", tmp_path), "node", "hubs") == [("M:A.Go", 1), ("M:B.Go", 2), ("M:I.Go", 1)]
    hops = rows(run(spark, "f19_one_hop", tmp_path), "src", "dst", "via")
    assert len(hops) == 9 and ("M:x0", "M:A.Go", "M:I.Go") in hops and ("M:x0", "M:B.Go", "M:I.Go") in hops
    assert rows(run(spark, "e18_dispatch_fans", tmp_path), "hub", "fan", "edges", "weight") == [("M:I.Go", 2, 3, 6)]
    fans = rows(run(spark, "f14_narrowed_fans", tmp_path), "hub", "receiver", "dst")
    assert [x for x in fans if x[:2] == ("M:I.Go", "T:B")] == [("M:I.Go", "T:B", "M:B.Go")]


def test_nearest_ancestor_is_a_base(spark):
    rel = spark.createDataFrame([("T:Base", "T:Root", "base"), ("T:Mid", "T:Base", "base"), ("T:C", "T:Mid", "base"), ("T:J", "T:Root", "base"), ("T:C", "T:J", "interface")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    fans = spark.createDataFrame([("M:Root.Go", "M:Base.Go"), ("M:Root.Go", "M:J.Go")], "hub string, dst string")
    calls = spark.createDataFrame([("M:Root.Go", "T:C")], "hub string, receiver string")
    bases = D.type_descendants(rel, ["base"])
    got = D.narrow_by_receiver(calls, fans, D.receiver_types(rel, bases), bases)
    assert rows(got, "dst") == [("M:Base.Go",)]


def test_delegate_field_edges_are_all_there_once(spark, tmp_path, monkeypatch):
    # only references are read; hot fields, fields beyond those with a bit, an escaped one, ends that share several
    rng = random.Random(4)
    fields = [f"F:C.f{i}" for i in range(6)]
    facts = [(f, k, f"M:{k}{rng.randrange(9)}") for f in fields for k in ("write", "read") for _ in range(rng.choice([3, 40]))]
    refs = [{"target_symbol_id": f, "ref_kind": k, "enclosing_symbol_id": m, "enclosing_loop_kind": "for" if k == "read" else None} for f, k, m in [*facts, *facts[:9]]]
    refs.append({"target_symbol_id": fields[2], "ref_kind": "read", "enclosing_symbol_id": "M:other", "enclosing_guards": "x"})
    put(spark, tmp_path, "reference_facts", refs)
    want = sorted({(a, b) for f, k, a in facts for g, o, b in facts if f == g != fields[2] and (k, o) == ("read", "write")})
    for cell, told in ((1024, 63), (2, 2), (4, 0)):
        monkeypatch.setattr(G, "CELL", cell, raising=False)
        monkeypatch.setattr(G, "TOLD", told, raising=False)
        assert rows(run(spark, "f4_delegate_field_edges", tmp_path), "from_sym", "to_sym") == want


def test_shaped_graph_has_every_part_once(spark, tmp_path):
    # only references are read; a queued, an event's and a plain method group, copies, a delivery, a field's edge
    ref = lambda m, t, kind, line=1, **more: {"enclosing_symbol_id": m, "target_symbol_id": t, "ref_kind": kind, "file_path": "f", "line": line, "target_in_source": True, **more}
    refs = [
        ref("M:a", "M:b", "invocation"), ref("M:a", "M:b", "invocation", receiver_type="T:X"), ref("M:a", "M:h", "methodGroup", 2), ref("M:a", "M:Corvane.Messaging.Q.Put", "invocation", 2, target_in_source=False),
        ref("M:a", "M:h", "methodGroup", 3), ref("M:a", "E:C.Done", "read", 3), ref("M:a", "M:h", "methodGroup", 4), ref("M:s", "M:net.Send", "invocation", 5, target_in_source=False, first_argument_template="/x"),
        ref("M:r", "M:h", "invocation", 6, first_argument_template="/x"), ref("M:w", "F:C.f", "write", 7, target_in_source=False), ref("M:i", "F:C.f", "read", 8, enclosing_loop_kind="for"),
    ]
    put(spark, tmp_path, "reference_facts", [*refs, *refs])
    assert rows(run(spark, "f10_shaped_graph", tmp_path), "from_sym", "to_sym", "kind", "file_path", "line", "handoff_dispatcher", "delivery_precision") == sorted([
        ("M:a", "M:b", "invocation", "f", 1, None, None), ("M:a", "M:h", "handoff", "f", 2, "queued", None), ("M:a", "M:h", "handoff", "f", 3, "event", None), ("M:a", "M:h", "methodGroup", "f", 4, None, None),
        ("M:r", "M:h", "invocation", "f", 6, None, None), ("M:s", "M:h", "handoff", "f", 5, "http", "exact"), ("M:i", "M:w", "delegate-field", "", 0, None, None),
    ], key=str)


def brute_collapsed(edges, seeds):
    """Edges (from, to, token), the token a type, True for the caller's binding or None."""
    held = {(b, t) for _, b, t in edges if t not in (None, True)}
    while more := {(b, x) for a, b, t in edges if t is True for m, x in held if m == a} - held:
        held |= more
    to = lambda b, x: (b, x) if (b, x) in held else (b, None)
    made = [((a, None), to(b, None if t is True else t)) for a, b, t in edges]
    made += [((a, x), to(b, x if t is True else t)) for a, b, t in edges for m, x in held if m == a.split("~λ")[0]]
    out = {}
    for (node, _), k in brute_reach(made, [(s, None) for s in seeds]).items():
        out[node] = min(k, out.get(node, k))
    return sorted(out.items())


@pytest.mark.parametrize("seed", range(3))
def test_collapsed_reach_makes_no_instances(spark, monkeypatch, seed):
    rng = random.Random(seed)
    make = N.monomorphize
    for k in range(40):
        # sparse random calls among plain methods, generic ones and their lambdas
        names = [f"M:N.P{i}.Go" for i in range(5)] + [f"M:N.G{i}`1.Go{part}" for i in range(6) for part in ("", "~λ0", "~λ0~λ1")]
        edges = set()
        for _ in range(rng.choice([15, 30, 60])):
            a, b = rng.choice(names), rng.choice(names)
            edges.add((a, b, None if "`1" not in b or rng.random() < 0.1 else True if "`1" in a else a[4:6]))
        edges, starts = sorted(edges, key=str), [names[0], names[6]]
        want = brute_collapsed(edges, starts)
        if k < 39:  # the search itself
            ids = sorted({x for e in edges for x in e[:2]} | set(starts))
            types = sorted({t for *_, t in edges if isinstance(t, str)})
            outer = [N.PLAIN if "~λ" not in x else ids.index(x.split("~λ")[0]) if x.split("~λ")[0] in ids else N.NOWHERE for x in ids]
            token = [N.PLAIN if t is None else N.FORWARDS if t is True else types.index(t) for *_, t in edges]
            a, b, t, o, s = (np.array(x, dtype=np.int64) for x in ([ids.index(e[0]) for e in edges], [ids.index(e[1]) for e in edges], token, outer, [ids.index(x) for x in starts]))
            depth = N._collapsed(o, a, b, t, s)
            assert [(x, int(d)) for x, d in zip(ids, depth, strict=True) if d >= 0] == want
            continue
        bound = [(a, b, None if t is None else '["T:0"]' if t is True else f'["C:{t}"]') for a, b, t in edges]
        df = spark.createDataFrame(bound, "from_sym string, to_sym string, binding string")
        seeds = spark.createDataFrame([(x,) for x in starts], "node string")
        monkeypatch.setattr(N, "monomorphize", None)
        assert rows(N.collapsed_reach(df, seeds), "node", "depth") == want
        monkeypatch.setattr(N, "monomorphize", make)
        monkeypatch.setattr(N, "MOST_BITS", -1)
        assert rows(N.collapsed_reach(df, seeds), "node", "depth") == want


def test_narrowing_meets_the_smaller_side(spark, monkeypatch):
    # a hot hub: all of a tree's types are targets and receivers, which never meet all in all
    n = 400
    rel = spark.createDataFrame([(f"T:N.t{i}", f"T:N.t{i // 4}", "base") for i in range(1, n)], "type_symbol_id string, related_symbol_id string, relation_kind string")
    fans = spark.createDataFrame([("M:N.t0.Go", f"M:N.t{i}.Go") for i in range(1, n) if i % 5] + [("M:N.t1.Go", "M:N.t4.Go")], "hub string, dst string")
    calls = spark.createDataFrame([(h, f"T:N.t{i}") for h in ("M:N.t0.Go", "M:N.t1.Go") for i in range(n)] + [("M:N.t0.Go", None)], "hub string, receiver string")
    up = lambda i: [i, *(up(i // 4) if i else [])]
    want = set()
    for hub, own, targets in (("M:N.t0.Go", 0, [i for i in range(1, n) if i % 5]), ("M:N.t1.Go", 1, [4])):
        for r in [None, *range(n)] if own == 0 else range(n):
            inside = targets if r is None or r == own or own not in up(r) else [x for x in targets if r in up(x)] or next(([a] for a in up(r) if a in targets), [])
            want |= {(hub, None if r is None else f"T:N.t{r}", f"M:N.t{x}.Go") for x in inside}
    bases = D.type_descendants(rel, ["base"])
    kept, written = D.materialize, {}
    monkeypatch.setattr(D, "materialize", lambda df, tag: written.setdefault(tag, kept(df, tag)))
    got = D.narrow_by_receiver(calls, fans, D.receiver_types(rel, bases), bases)
    assert rows(got, "hub", "receiver", "dst") == sorted(want, key=str)
    assert written["sized"].where("hub = 'M:N.t0.Go' and few").count() <= 1
