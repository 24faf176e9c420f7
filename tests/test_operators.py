"""Graph, rule and change operators on small hand-made facts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factweave.functions import decode, docid
from factweave.operators import closure as C
from factweave.operators import dispatch as D
from factweave.operators import effects as X
from factweave.operators import entrypoints as EP
from factweave.operators import generics as N
from factweave.operators import graph as G
from factweave.operators import hazards as H
from factweave.operators import impact as I
from factweave.operators import relational as R
from factweave.operators import search as S
from factweave.operators import tree as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column).first()[0]


@pytest.mark.parametrize("symbol,type_id,name,arity", [
    ("M:A.B.C", "T:A.B", "C", 0),
    ("M:A.B`1.C``2(System.Int32,System.Collections.Generic.Dictionary{System.String,System.Int32})", "T:A.B`1", "C``2", 2),
    ("M:A.B.#ctor(System.Int32[0:,0:])", "T:A.B", "#ctor", 1),
    ("M:A.B.C((System.Int32,System.String),D)", "T:A.B", "C", 2),
    ("T:A.B", None, None, 0),
    ("M:NoDot", None, None, 0),
    (None, None, None, None),
])
def test_method_ids(spark, symbol, type_id, name, arity):
    df = spark.createDataFrame([(symbol,)], "s string")
    got = df.select(docid.method_type("s"), docid.method_name("s"), docid.param_arity("s")).first()
    assert got[0] == type_id and got[1] == name
    assert got[2] == arity or symbol is None


@pytest.mark.parametrize("receiver,want", [("A.B<C<D>,E>", "T:A.B"), ("A.B", "T:A.B"), ("<anonymous>", None), ("A?", None), ("A[]", None), ("A B", None), ("", None), (None, None), ("A`2", "T:A")])
def test_receiver_type(spark, receiver, want):
    assert one(spark, docid.receiver_type_id("c"), receiver) == want


def test_scalar_functions(spark):
    assert one(spark, docid.top_level_split("c"), "A<B,C>, D ,E[F,G]") == ["A<B,C>", "D", "E[F,G]"]
    assert one(spark, docid.nth_type_argument("c", 1), "A<B,C>,D") == "D" and one(spark, docid.nth_type_argument("c", 5), "A") is None
    assert one(spark, docid.nth_json_string("c", 1), '["a", null, "b"]') is None and one(spark, docid.nth_json_string("c", 2), '["a", null, "b"]') == "b"
    assert one(spark, docid.normalize_http("c"), "https://h/x/") == "h/x" and one(spark, docid.normalize_http("c"), "/x/") == "x/"
    assert one(spark, docid.resource_key("c", ["Store", "rStore"]), "A.OrderStore") == "Orde"
    assert one(spark, docid.resource_key("c", ["Repository", "Repo"]), "A.UserRepository`1") == "User"
    assert one(spark, docid.resource_key("c", ["Store"]), "Store") == "Store"
    assert one(spark, docid.first_non_blank("c", F.lit("x")), "  ") == "x"
    assert one(spark, docid.framework_name("c"), "int") == "Int32" and one(spark, docid.framework_name("c"), "Foo") == "Foo"
    assert one(spark, docid.lambda_container("c"), "M:A.B~λ1~λ0") == "M:A.B"
    assert one(spark, docid.short_name("c"), "M:N.A.#ctor(System.Int32)") == "A" and one(spark, docid.short_name("c"), "M:N.A.B~λ1") == "A.B λ"
    assert one(spark, docid.type_route("c", "App.Pages"), "App.Pages.Admin.Users") == "/Admin/Users"
    assert one(spark, docid.matches_head_glob("c", "svc*SAVE"), "M:My.Svc.X.Save(A.B)") is True
    assert one(spark, docid.matches_head_glob("c", "A.B"), "M:My.Svc.Save(A.B)") is False
    for path, hit in (("src/a/b.cs", True), ("b.cs", True), ("src\\x\\b.cs", True), ("b.csx", False)):
        assert one(spark, F.col("c").rlike(docid.file_glob_regex("**/*.cs")), path) is hit


def test_decoders(spark):
    rs, us = "\x1e", "\x1f"
    text = f"x{us}T{us}Run{rs}bad{rs}y{us}U{us}Go"
    assert [tuple(x) for x in one(spark, decode.invocations("c"), text)] == [("x", "T", "Run"), ("y", "U", "Go")]
    assert [tuple(x) for x in one(spark, decode.guards("c"), f"a > 1{us}1{rs}b{us}0")] == [("a > 1", True), ("b", False)]
    assert one(spark, decode.guards("c"), None) == [] and one(spark, decode.scopes("c"), "") == []


def graph(seed, n=14, m=26):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def brute_reach(edges, starts):
    depth, level, k = {s: 0 for s in starts}, set(starts), 0
    while level:
        k += 1
        level = {b for a, b in edges if a in level} - set(depth)
        depth.update({x: k for x in level})
    return depth


@pytest.mark.parametrize("seed", [1, 2])
def test_closures(spark, seed):
    e = graph(seed)
    df = spark.createDataFrame(e, "src string, dst string")
    seeds = spark.createDataFrame([("n00",), ("n01",), ("n00",), (None,), ("lonely",)], "node string")
    want = brute_reach(e, ["n00", "n01", "lonely"])
    assert rows(C.reach(df, seeds)) == sorted(want.items(), key=str)
    assert rows(C.reach(df, seeds, 1)) == sorted(((k, v) for k, v in want.items() if v <= 1), key=str)
    assert rows(C.reach(df, seeds.where("false"))) == []
    each = C.reach_each(df, spark.createDataFrame([("a", "n00"), ("b", "n01")], "seed string, node string"))
    assert rows(each) == sorted([("a", k, v) for k, v in brute_reach(e, ["n00"]).items()] + [("b", k, v) for k, v in brute_reach(e, ["n01"]).items()], key=str)
    # transposed
    back = {s for s in {x for p in e for x in p} if "n03" in brute_reach(e, [s])}
    got = {r.node for r in C.reach(C.reverse(df), spark.createDataFrame([("n03",)], "node string")).collect()}
    assert got - {"n03"} == back - {"n03"}
    # components
    nodes = {x for p in e for x in p}
    r = {n: set(brute_reach(e, [n])) for n in nodes}
    assert rows(C.components(df)) == sorted(((n, min(m for m in nodes if m in r[n] and n in r[m])) for n in nodes), key=str)
    assert rows(C.components(df.where("false"))) == []


def test_shortest_path(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"), ("e", "c"), ("c", "a")], "src string, dst string")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    assert rows(C.shortest_path(df, n("a"), n("c"))) == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(C.shortest_path(df, n("a"), n("a"))) == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]
    assert rows(C.shortest_path(df, n("a"), n("zzz"))) == []


def test_reach_payload(spark):
    schema = "from_sym string, to_sym string, kind string, line int, receiver_type string, loop_kind string, loop_detail string, handoff_dispatcher string, basis string, degree int"
    edges = [
        ("a", "b", "invocation", 5, None, "foreach", "x in xs", None, None, None),
        ("a", "c", "invocation", 1, None, None, None, "queue", None, None),
        ("c", "d", "impl-dispatch", 1, None, None, None, None, "heuristic", 3),
        ("b", "d", "invocation", 2, None, "while", None, None, None, None),
        ("d", "a", "invocation", 1, None, None, None, None, None, None),
    ]
    got = {r.node: r for r in C.reach_with_payload(spark.createDataFrame(edges, schema), spark.createDataFrame([("a",)], "node string")).collect()}
    assert got["b"].loop_nesting == 1 and got["b"].nearest_loop_detail == "x in xs"
    # c comes before b by line, so d is first reached through c
    assert got["d"].parent == "c" and got["d"].dispatch_via == "c" and got["d"].dispatch_degree == 3 and got["d"].heuristic and got["d"].handoff_via == "queue"
    assert got["a"].depth == 0 and len(got) == 4


def test_graph_shaping(spark):
    schema = "from_sym string, to_sym string, kind string, file_path string, line int, handoff_dispatcher string, delivery_precision string"
    e = spark.createDataFrame([("a", "b", "methodGroup", "f", 1, None, None), ("a", "c", "handoff", "f", 2, "q", "fanout"), ("a", "d", "handoff", "f", 3, "q", "exact"), ("a", "e", "invocation", "f", 1, None, None)], schema)
    n = {m: G.gate_handoffs(e, m).count() for m in G.MODES}
    assert n == {"sync_cut": 2, "async_exact": 3, "async_include": 4}
    with pytest.raises(ValueError):
        G.gate_handoffs(e, "x")
    consumers = spark.createDataFrame([("a", "f", 1, "M:Timer.Start"), ("a", "f", 1, "M:Queue`1.Put")], "from_sym string, file_path string, line int, consumer string")
    got = {r.to_sym: (r.kind, r.handoff_dispatcher) for r in G.classify_handoffs(e, consumers, [("queue", "Queue.Put"), ("timer", "Timer")]).collect()}
    assert got["b"] == ("handoff", "queue") and got["e"] == ("invocation", None)
    facts = spark.createDataFrame([("F:x", "m1", "delegate_field_bind"), ("F:y", "m2", "delegate_field_bind"), ("r", "F:x", "delegate_field_invoke"), ("r", "F:y", "delegate_field_invoke"), ("F:y", "", "delegate_field_escape")], "source_member string, target_member string, kind string")
    assert rows(G.delegate_field_edges(facts)) == [("r", "m1", "delegate-field", "", 0)]
    p = spark.createDataFrame([("p", "f", 1, "t", "k"), ("p", "f", 9, "t", "k"), ("p", "f", 2, "t", "solo")], "caller string, file_path string, line int, tag string, token string")
    h = spark.createDataFrame([("h1", "t", "k"), ("h2", "t", "k"), ("h3", "t", "solo")], "handler string, tag string, token string")
    assert [(r.to_sym, r.delivery_precision) for r in G.delivery_edges(p, h).orderBy("to_sym").collect()] == [("h1", "fanout"), ("h2", "fanout"), ("h3", "exact")]
    refs = spark.createDataFrame([("M:Ext.Go(System.Int32)", False), ("M:Own.Go", True)], "target_symbol_id string, target_in_source boolean")
    rules = spark.createDataFrame([("M:Ext.Go", "M:Own.Go")], "method string, redirect_to string")
    assert rows(G.redirect(refs, rules)) == [("M:Own.Go", True), ("M:Own.Go", True)]
    f = spark.createDataFrame([("a", "M:N.Factory.Create(System.Int32)", "A.Job"), ("a", "M:N.Other.Run", "A.Job"), ("a", "M:N.Factory.Create", "A.Gone")], "from_sym string, to_sym string, type_arguments string")
    m = spark.createDataFrame([("M:A.Job.Run(System.Int32)",), ("M:A.Job.Run",)], "symbol_id string")
    assert [r[1] for r in rows(G.factory_rewrite(f, m, "Factory", "type_arguments", "Run"))] == ["M:A.Job.Run(System.Int32)", "M:N.Factory.Create", "M:N.Other.Run"]


def test_dispatch(spark):
    facts = spark.createDataFrame([("a", "b", "override"), ("b", "c", "override"), ("b", "x", "impl"), ("a", "l", "delegate_bind")], "source_member string, target_member string, kind string")
    assert rows(D.mined(facts)) == [("a", "b", "override-dispatch"), ("a", "c", "override-dispatch"), ("a", "l", "delegate-dispatch"), ("b", "c", "override-dispatch"), ("b", "x", "impl-dispatch")]
    rel = spark.createDataFrame([("T:B", "T:A", "base"), ("T:C`1", "T:B", "base"), ("T:D", "T:A", "base"), ("T:B", "T:I", "interface")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    assert rows(D.type_closure(rel, ["T:B"])) == [("T:B",), ("T:C",)] and rows(D.type_closure(rel, ["T:B"], strict=True)) == [("T:C",)]
    methods = spark.createDataFrame([("M:A.Go", False, False), ("M:B.Go", True, False), ("M:C`1.Go", True, False), ("M:D.Go(System.Int32)", True, False), ("M:I.Go", False, False)], "symbol_id string, is_override boolean, is_static boolean")
    none = spark.createDataFrame([], "src string")
    assert rows(D.hierarchy_fallback(methods, rel, none)) == sorted([("M:A.Go", "M:B.Go", "override-dispatch"), ("M:A.Go", "M:C`1.Go", "override-dispatch"), ("M:B.Go", "M:C`1.Go", "override-dispatch"), ("M:I.Go", "M:B.Go", "impl-dispatch")], key=str)
    fans = spark.createDataFrame([("M:A.Go", "M:B.Go"), ("M:A.Go", "M:C`1.Go"), ("M:A.Go", "M:D.Go")], "hub string, dst string")
    below = D.type_descendants(rel, ["base"])
    calls = lambda r: spark.createDataFrame([("M:A.Go", r)], "hub string, receiver string")
    narrowed = lambda r: [x.dst for x in D.narrow_by_receiver(calls(r), fans, below).orderBy("dst").collect()]
    assert narrowed("T:B") == ["M:B.Go", "M:C`1.Go"] and narrowed("T:C") == ["M:C`1.Go"] and narrowed("T:D") == ["M:D.Go"]
    assert len(narrowed(None)) == len(narrowed("T:A")) == len(narrowed("T:Unrelated")) == 3
    assert rows(D.narrow_or_keep(fans, fans.where("false"), ["hub"])) == rows(fans)
    real = spark.createDataFrame([("x", "a", False), ("y", "a", True)], "from_sym string, to_sym string, non_virtual boolean")
    assert ("y", "b", "a") not in rows(D.one_hop(real, D.mined(facts))) and ("x", "c", "a") in rows(D.one_hop(real, D.mined(facts)))
    broken = spark.createDataFrame([("!:IFoo.Go(System.Int32)",)], "to_sym string")
    m2 = spark.createDataFrame([("M:N.IFoo.Go(System.String)",), ("M:N.IFoo.Go",)], "symbol_id string")
    assert rows(D.error_type_recovery(broken, m2)) == [("!:IFoo.Go(System.Int32)", "M:N.IFoo.Go(System.String)", "impl-dispatch")]


REF = "target_symbol_id string, ref_kind string, enclosing_symbol_id string, file_path string, line int, receiver_type string, first_argument_template string, enclosing_loop_kind string, enclosing_loop_detail string, type_arguments string, enclosing_invocations string, enclosing_catch_types string, enclosing_scopes string"


def ref(target, kind="invocation", enclosing="M:App.S.Run", line=1, receiver=None, template=None, loop=None, detail=None, types=None, inv=None, catch=None, scopes=None):
    return (target, kind, enclosing, "f.cs", line, receiver, template, loop, detail, types, inv, catch, scopes)


def test_effects_first_resolving_rule_wins(spark):
    refs = spark.createDataFrame([
        ref("M:Net.Http.Client.Send(System.String)", template="https://h/a/"), ref("M:Net.Http.Client.Send", receiver="Net.Http.Client"), ref("M:Net.Httpish.Send", line=3),
        ref("M:Db.Set`1.Add", line=4, receiver="Db.Set<App.Order>"), ref("M:Net.Http.Client.Send", enclosing=None, line=5), ref(None), ref("M:Net.Http.Client.#ctor(System.Int32)", kind="ctor", line=6), ref("T:My.Error", kind="throw", line=7),
    ], REF)
    rules = [X.EffectRule("skip", "x", ("Send",), dispatch=True), X.EffectRule("http", "send", ("Send",), ("Net.Http",), resource="string_argument"), X.EffectRule("http", "any", ("Send",), ("Net.Http",), resource="receiver_type"), X.EffectRule("db", "write", ("Add",), ("Db",), resource="ef_dbset_receiver")]
    got = {(r.line, r.provider, r.operation, r.resource) for r in X.invocation_effects(refs, rules).collect()}
    assert got == {(1, "http", "send", "https://h/a/"), (1, "http", "any", "Net.Http.Client"), (4, "db", "write", "App.Order")}
    derived = spark.createDataFrame([("T:Net.Http.Client",)], "type string")
    assert X.invocation_effects(refs, [X.EffectRule("http", "based", ("Send",), base_types=("T:Base",), resource="declaring_type")], derived).count() == 3
    assert rows(X.constructor_effects(refs, [X.EffectRule("c", "new", declaring=("Net",), min_arguments=1)]).select("resource")) == [("Net.Http.Client",)]
    assert X.constructor_effects(refs, [X.EffectRule("c", "new", declaring=("Net",), min_arguments=2)]).count() == 0
    assert rows(X.throw_effects(refs, [X.EffectRule("throw", "raise", declaring=("My",))]).select("resource")) == [("My.Error",)]
    gated = X.EffectRule("http", "g", ("Send",), ("Net.Http",), containing_namespaces=("App",), containing_types=("S",), containing_methods=("Run",), resource="declaring_type")
    assert X.invocation_effects(refs, [gated]).count() == 2
    assert X.invocation_effects(refs.where("false"), rules).count() == 0
    w = spark.createDataFrame([ref("M:Net.Raw", enclosing="M:App.Wrap.Get"), ref("M:App.Wrap.Get", enclosing="M:App.S.Run", line=9)], REF)
    assert rows(X.wrapper_effects(w, [X.EffectRule("http", "w", calls="Net.Raw", resource="declaring_type")]).select("enclosing_symbol_id", "resource")) == [("M:App.S.Run", "App.Wrap")]
    assert X.unknown_tokens(rules, ["HTTP", "http:send", "nope"]) == ["nope"]


def test_observations(spark):
    rs, us = "\x1e", "\x1f"
    e = spark.createDataFrame([
        ref("M:Db.Ctx.SaveChanges", loop="foreach", detail="order in orders", template="/x/order", inv=f"p{us}Tasks.Parallel{us}ForEach{rs}q{us}My.Retry{us}Execute", catch="Db.ConcurrencyException", scopes=f"lock{us}System.Object{rs}using{us}Db.Transaction", types="System.IntPtr"),
        ref("M:Db.Ctx.Get", loop="foreach", detail="o in orders", template="/x/order"),
    ], REF).withColumn("provider", F.lit("db"))
    o = X.observations(e, fanout=[("Tasks.Parallel", "ForEach")], retry=[("Execute", "Retry")], commits=["SaveChanges"], spans=[{"type": "lock_held", "kind": "lock", "text": "Object"}, {"type": "tx", "kind": "using", "text": "Transaction", "deny": ["db"]}], payload=["IntPtr"])
    got = {r.target_symbol_id: {x.type for x in r.observations} for r in o.collect()}
    assert got["M:Db.Ctx.SaveChanges"] == {"looped_effect", "parallel_fanout", "resilience_retry", "concurrency_handled", "lock_held", "unserializable_payload", "n_plus_1"}
    assert got["M:Db.Ctx.Get"] == {"looped_effect"}
    assert {r.hazard for r in X.flatten_hazards(o).collect()} == {"n_plus_1", "unserializable_payload"}


def test_allocations(spark):
    a = spark.createDataFrame([("new", "A", "M:x", "f", 1, "for", None, None, None, "cached_first_use", 24, "high", "size"), ("new", "B", "M:x", "f", 2, "for", None, None, None, None, None, None, None)], "operation string, resource_type string, enclosing_symbol_id string, file_path string, line int, loop_kind string, loop_detail string, guards string, mechanism string, cardinality string, shallow_size_bytes long, size_confidence string, size_basis string")
    assert [(r.resource, r.enclosing_loop_kind) for r in X.allocation_effects(a).orderBy("line").collect()] == [("A", None), ("B", "for")]


def test_hazards(spark):
    cells = "enclosing_symbol_id string, cell string, line int"
    reads = spark.createDataFrame([("M:A.Go", "F:A.x", 3), ("M:A.Go", "F:A.x", 1), ("M:A.#cctor", "F:A.x", 1), ("M:A.get_Loaded", "F:A.y", 1)], cells)
    writes = spark.createDataFrame([("M:A.Go", "F:A.x", 3), ("M:A.Go", "F:A.x", 1), ("M:A.#cctor", "F:A.x", 2), ("M:A.get_Loaded", "F:A.y", 4)], cells)
    races = H.race_windows(reads, writes)
    assert rows(races) == [("M:A.Go", "F:A.x", 3, 1, "high"), ("M:A.get_Loaded", "F:A.y", 4, 1, "high")]
    tx = spark.createDataFrame([("M:A.Go", 1), ("M:A.Go", 3)], "enclosing_symbol_id string, line int")
    assert {r.enclosing_symbol_id: r.confidence for r in H.race_windows(reads, writes, tx).collect()} == {"M:A.get_Loaded": "high", "M:A.Go": "medium"}
    lock = spark.createDataFrame([("M:A.get_Loaded", 4)], "enclosing_symbol_id string, line int")
    cell = lambda *x: spark.createDataFrame([(i,) for i in x], "cell string")
    got = {r.cell: (r.hazard, r.tier) for r in H.lazy_init_races(races, writes, lock, cell(), cell("F:A.x")).collect()}
    assert got == {"F:A.x": ("thread_local_context", "open"), "F:A.y": ("lazy_init_race", "locked")}
    assert "F:A.y" not in {r.cell for r in H.lazy_init_races(races, writes, lock, cell("F:A.y"), cell()).collect()}
    # every branch of what looks like initialisation
    init = [("M:A.#ctor(System.Int32)", "F:A.p"), ("M:A.ReInitAll", "F:A.p"), ("M:A.LoadAll", "F:A.__Instance"), ("M:A.BuildAll", "F:A.instances"), ("M:A.TwiceAll", "F:A.initialized")]
    r2 = spark.createDataFrame([(m, c, 1) for m, c in init], cells)
    w2 = spark.createDataFrame([(m, c, 2) for m, c in init] + [("M:A.TwiceAll", "F:A.initialized", 3)], cells)
    none = lock.where("false")
    got = {(r.enclosing_symbol_id, r.write_line): (r.hazard, r.tier, r.confidence) for r in H.lazy_init_races(H.race_windows(r2, w2), w2, none, cell(), cell()).collect()}
    lazy, race = ("lazy_init_race", "open", "low"), ("race_window", "open", "high")
    assert got == {("M:A.#ctor(System.Int32)", 2): lazy, ("M:A.ReInitAll", 2): lazy, ("M:A.LoadAll", 2): lazy, ("M:A.BuildAll", 2): race, ("M:A.TwiceAll", 2): race, ("M:A.TwiceAll", 3): race}
    # a locked line after the publishing write keeps the finding, and so does a cell that isn't volatile
    later = lock.unionAll(spark.createDataFrame([("M:A.get_Loaded", 9)], lock.schema))
    assert "F:A.y" in {r.cell for r in H.lazy_init_races(races, writes, later, cell("F:A.y"), cell()).collect()}
    shape = "provider string, operation string, enclosing_symbol_id string, file_path string, line int"
    eff = spark.createDataFrame([("efcore", "commit", "M:a", "f", 1), ("queue", "publish", "M:a", "f", 5), ("smtp", "send", "M:a", "f", 5), ("http", "GET", "M:b", "f", 1), ("efcore", "commit", "M:b", "f", 1), ("redis", "read", "M:b", "f", 2), ("redis", "write", None, "f", 1), ("efcore", "commit", "M:c", "f", 1), ("yessql", "write", "M:c", "f", 2)], shape)
    assert rows(H.dual_writes(eff)) == [("M:a", "db+email+queue", 3, 5, "queue")]
    assert rows(H.dual_write_sites(eff).select("enclosing_symbol_id", "system", "line")) == [("M:a", "db", 1), ("M:a", "email", 5), ("M:a", "queue", 5)]
    e2 = spark.createDataFrame([("db", "write", "k", "a"), ("cache", "evict", "k", "c"), ("db", "write", "z", "a")], "provider string, operation string, resource string, enclosing_symbol_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(H.missing_companions(e2, edges, "db:write", "cache:evict")) == [("a", "z", "high")]


def test_changes(spark):
    s = "k string, v string"
    a, b = spark.createDataFrame([("x", None), ("y", "1"), ("y", "1")], s), spark.createDataFrame([("x", None), ("z", "1")], s)
    assert rows(I.set_diff(a, b, ["k", "v"])) == [("y", "1", "removed"), ("z", "1", "added")]
    h = "symbol_id string, body_hash string"
    assert rows(I.body_changes(spark.createDataFrame([("a", "AB"), ("b", "1"), ("c", "")], h), spark.createDataFrame([("a", "ab"), ("b", "2"), ("c", "3")], h))) == [("b",), ("c",)]
    assert rows(I.body_changes(spark.createDataFrame([("a", None)], h), spark.createDataFrame([("a", "1")], h))) == []
    edges = spark.createDataFrame([("e", "M:N.A.f"), ("M:N.A.f", "M:N.A.g(System.Int32)")], "src string, dst string")
    eff = spark.createDataFrame([("db", "write", "r", "M:N.A.f", None), ("db", "write", "r", "M:N.A.f", "for"), ("lock", "acquire", "l", "M:N.A.g(System.Int32)", None)], "provider string, operation string, resource string, enclosing_symbol_id string, enclosing_loop_kind string")
    entry = spark.createDataFrame([("e", "e")], "entry string, node string")
    f = I.footprints(edges, entry, eff)
    assert rows(f) == [("e", "db", "write", "r", "N.A.f", 1, True), ("e", "lock", "acquire", "l", "N.A.g", 1, False)]
    calm = f.withColumn("in_loop", F.lit(False)).where("provider = 'db'")
    assert rows(I.footprint_diff(calm, f).select("provider", "change")) == [("db", "amplified"), ("lock", "added")]
    base = spark.createDataFrame([("e", "M:N.A.f(System.Int32)"), ("e", "M:N.B.g")], "entry string, node string")
    head = spark.createDataFrame([("e", "M:N.A.f(System.String)"), ("e", "M:N.C.h")], "entry string, node string")
    assert rows(I.reach_diff(base, head)) == [("e", "N.A.f", "signature"), ("e", "N.B.g", "removed"), ("e", "N.C.h", "added")]


def test_entry_points(spark):
    t = "symbol_id string, modifiers string, file_path string, line int"
    types = spark.createDataFrame([("T:App.P.Home", "public", "h.cs", 1), ("T:App.P.Base", "public abstract", "b.cs", 1), ("T:Other.X", "public", "x.cs", 1)], t)
    ctors = spark.createDataFrame([("M:App.P.Home.#ctor", "T:App.P.Home", "h.cs", 5)], "symbol_id string, type string, file_path string, line int")
    below = spark.createDataFrame([("T:App.P.Home",), ("T:App.P.Base",), ("T:Other.X",)], "type string")
    assert rows(EP.pages(types, ctors, below, "App")) == [("page", "M:App.P.Home.#ctor", "/P/Home", "h.cs", 5)]
    e = spark.createDataFrame([("a", "t", "handoff", "f", 1, "q"), ("a", "t", "methodGroup", "f", 1, None)], "from_sym string, to_sym string, kind string, file_path string, line int, handoff_dispatcher string")
    assert rows(EP.handoffs(e)) == [("t", "a", "f", 1, "q")]
    ep = spark.createDataFrame([("m", ["db"]), ("n", []), ("o", None), ("p", ["gpu"])], "method string, requires array<string>")
    services = spark.createDataFrame([("api", ["db"]), ("job", ["queue"])], "service string, provides array<string>")
    assert rows(EP.active_in(ep, services)) == [("m", "api"), ("n", "api"), ("n", "job"), ("o", "api"), ("o", "job")]


def test_tree(spark):
    e = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("a", "b", 9), ("c", "b", 1), ("b", "d", 1), ("d", "a", 1)], "from_sym string, to_sym string, line int")
    got = [(r.depth, r.node, r.call_sites, r.truncated) for r in V.call_tree(e, "a").orderBy("ord").collect()]
    assert got == [(0, "a", 1, None), (1, "c", 1, None), (2, "b", 1, None), (3, "d", 1, None), (4, "a", 1, "already_expanded"), (1, "b", 2, "already_expanded")]
    assert [r.truncated for r in V.call_tree(e, "a", max_depth=1).orderBy("ord").collect()] == [None, "depth_capped", "depth_capped"]
    assert V.call_tree(e, "a", budget=2).count() <= 2 and V.call_tree(e, "zzz").count() == 1
    g = spark.createDataFrame([("m", "lock", "acquire", "l"), ("m", "lock", "release", "l"), ("m", "db", "write", "t"), ("m", "db", "write", "t")], "enclosing_symbol_id string, provider string, operation string, resource string")
    assert [r[1] for r in rows(V.effect_groups(g))] == ["db:write:t ×2", "lock:held:l"]


def test_generics(spark):
    e = spark.createDataFrame([("main", "M:G.Map``1", '["C:int"]'), ("M:G.Map``1", "M:G.Each``1", '["M:0"]'), ("M:G.Each``1", "M:G.Open``1", '["?"]'), ("M:G.Each``1", "x", None)], "from_sym string, to_sym string, binding string")
    inv = N.instances(e)
    assert rows(inv) == [("M:G.Each``1", ["int"]), ("M:G.Map``1", ["int"])]
    m = {(r.from_sym, r.to_sym) for r in N.monomorphize(e, inv).collect()}
    assert ("main", "M:G.Map``1~mono⟨int⟩") in m and ("M:G.Map``1~mono⟨int⟩", "M:G.Each``1~mono⟨int⟩") in m and ("M:G.Each``1~mono⟨int⟩", "x") in m and ("M:G.Map``1", "M:G.Each``1") in m
    many = spark.createDataFrame([("main", "g", f'["C:t{i}"]') for i in range(4)], "from_sym string, to_sym string, binding string")
    assert rows(N.instances(many, per_method=3)) == [] and len(rows(N.instances(many, per_method=4))) == 4
    assert rows(N.collapse(spark.createDataFrame([("a~mono⟨x⟩", 2), ("a", 3)], "node string, depth int"))) == [("a", 2)]


def test_search_and_listing(spark):
    s = spark.createDataFrame([("M:A.Save", "Save", "method"), ("T:A", "A", "type"), ("M:A.Re%d", "Re%d", "method"), ("M:A.Save~λ1", "λ", "method")], "symbol_id string, name string, kind string")
    assert [r[0] for r in rows(S.search_symbols(s, "%"))] == ["M:A.Re%d"]
    assert rows(S.search_trigrams(S.trigrams(s, "symbol_id"), "a.SAVE")) == [("M:A.Save",), ("M:A.Save~λ1",)]
    with pytest.raises(ValueError):
        S.search_trigrams(S.trigrams(s, "symbol_id"), "ab")
    nodes = spark.createDataFrame([("M:A.Save(System.Int32)",), ("M:A.SaveAll",)], "n string")
    assert rows(R.match_nodes(nodes, "n", "a.save")) == [("M:A.Save(System.Int32)",)] and len(rows(R.match_nodes(nodes, "n", "sav"))) == 2
    amb = spark.createDataFrame([("M:A.f",), ("M:A.f~λ0",), ("M:B.g~λ0",)], "n string")
    assert rows(R.ambiguous_names(amb, "n")) == [("A.f",), ("B.g~λ0",)]
    files = spark.createDataFrame([("/a/b/c.cs",), ("C:\\x\\y.cs",), (None,), ("solo",)], "p string")
    owners = spark.createDataFrame([("/a",), ("/a/b",), ("C:\\x",), ("/a/bc",)], "o string")
    assert rows(R.owning_folder(files, "p", owners, "o")) == [("/a/b/c.cs", "/a/b"), ("C:\\x\\y.cs", "C:\\x")]


def test_dead_code(spark):
    m = spark.createDataFrame(
        [("M:A.Main", "Main", "public", False, "f", 1), ("M:A.used", "used", "private", False, "f", 2), ("M:A.gone", "gone", "private", False, "f", 3), ("M:A.deep", "deep", "internal", False, "f", 4),
         ("M:A.#ctor", ".ctor", "private", False, "f", 5), ("M:A.virt", "virt", "internal virtual", False, "f", 6), ("M:A.over", "over", "internal", True, "f", 7), ("M:A.get_X", "get_X", "private", False, "f", 8),
         ("M:A.abs", "abs", "internal abstract", False, "f", 9), ("M:A.made", "made", "internal", False, "a.g.cs", 10), ("M:A.pub", "pub", "public static", False, "f", 11), ("M:A.none", "none", None, None, None, None)],
        "symbol_id string, name string, modifiers string, is_override boolean, file_path string, line int",
    )
    e = spark.createDataFrame([("M:A.Main", "M:A.used"), ("M:A.gone", "M:A.deep"), ("M:A.gone", "M:A.deep")], "src string, dst string")
    none = m.where("false").selectExpr("symbol_id as node")
    got = {r.symbol_id: (r.tier, r.reason, r.callers) for r in V.dead_code(e, m, none).collect()}
    assert got == {"M:A.gone": ("high", "uncalled", 0), "M:A.deep": ("medium", "only reached by dead code", 2), "M:A.none": ("medium", "uncalled", 0)}
    main = spark.createDataFrame([("M:A.Main",)], "node string")
    assert {r.symbol_id: r.tier for r in V.dead_code(e, m, main, visible_are_roots=False, dispatch_members=True).collect()} == {
        "M:A.gone": "high", "M:A.deep": "medium", "M:A.pub": "low", "M:A.virt": "medium", "M:A.over": "medium", "M:A.none": "medium"}


def test_structural_causes(spark):
    rows_ = lambda e, *stems: [(e, s, "added") for s in stems]
    d = spark.createDataFrame(
        rows_("ctor", "A.B.#ctor", "A.C.#ctor") + rows_("shape", "R:F:A.x", "A.B.get_Y", "A.B.set_Y", "A.B.#ctor", "A.B.Go") + rows_("other", "A.B.Go", "A.B.get_Y", "A.B.get_Z") + rows_("both", "A.B.Go"),
        "entry string, stem string, kind string",
    )
    edits = spark.createDataFrame([("both",), ("calm",), ("calm",)], "entry string")
    assert rows(I.structural_cause(d, edits)) == [("both", "other", 1), ("calm", "in_place", 0), ("ctor", "constructor", 2), ("other", "other", 3), ("shape", "record_shape", 5)]


def test_carried_types(spark):
    below = spark.createDataFrame([("T:A", "T:A", 0), ("T:A", "T:B", 1)], "ancestor string, type string, depth int")
    steps = spark.createDataFrame([("x", "M:A.f", "T:B", None, False, True), ("x", "M:A.g", "T:Z", None, False, True), ("x", "M:A.h", "T:B", "T:A", True, False), ("x", "M:A.i", "T:B", "T:A", False, False)], "from_sym string, to_sym string, carried string, receiver string, self_call boolean, dispatched boolean")
    assert rows(D.propagate_receiver(steps, below)) == [("x", "M:A.f", "T:B"), ("x", "M:A.g", "T:A"), ("x", "M:A.h", "T:B"), ("x", "M:A.i", "T:A")]
    b = lambda *x: spark.createDataFrame([(n, v) for n, v in x], "node string, bindings array<string>")
    assert rows(N.union_bindings(b(("n", ["a"])), b(("n", ["b", "a"]), ("m", ["c"])))) == [("m", ["c"]), ("n", ["a", "b"])]
    assert rows(N.union_bindings(b(("n", ["a", "c"])), b(("n", ["b"])), cap=2)) == [("n", ["a", "b"])]
    nodes = spark.createDataFrame([("M:A.f%",), ("M:A.fx",)], "n string")
    assert rows(R.like_seeds(nodes, "n", "F%")) == [("M:A.f%",)]


def test_hazards_on_trees(spark):
    f = spark.createDataFrame([("race", "a", "medium"), ("race", "a", "high"), ("race", "z", "high")], "kind string, m string, c string")
    tree = spark.createDataFrame([("a",), ("a",)], "node string")
    assert rows(H.on_tree(f, tree, "kind", "m", "c")) == [("a", "race", "high", 2)]
    assert rows(H.rollup(f, "kind", "m", "c")) == [("race", "a", 2, 1, 1, 0), ("race", "z", 1, 1, 0, 0)]
    assert H.without_namespaces(spark.createDataFrame([("M:Lib.A.f",), ("M:App.f",)], "m string"), "m", ["lib"]).count() == 1


@pytest.mark.parametrize("most", [C.MOST_EDGES, 0])
def test_closures_in_memory_and_by_joins(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MOST_EDGES", most)
    rng = random.Random(most)
    for n in (1, 12) if most else (4,):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(2 * n)]
        e = spark.createDataFrame([*pairs, pairs[0], (None, "n0"), ("n0", None)], "src string, dst string")

        def brute(starts, limit=None, pairs=pairs):
            depth, level, k = dict.fromkeys(starts, 0), set(starts), 0
            while level and (limit is None or k < limit):
                k += 1
                level = {b for a, b in pairs if a in level} - set(depth)
                depth.update(dict.fromkeys(level, k))
            return depth

        starts = ["n0", "n1", "elsewhere"]
        seeds = spark.createDataFrame([(x,) for x in [*starts, "n0", None]], "node string")
        for limit in (None, 0, 2) if most else (None,):
            assert dict(C.reach(e, seeds, limit).collect()) == brute(starts, limit)
        groups = spark.createDataFrame([("a", "n0"), ("a", "elsewhere"), ("b", "n1"), (None, "n0"), ("c", None)], "seed string, node string")
        want = {(s, x, k) for s, g in (("a", ["n0", "elsewhere"]), ("b", ["n1"]), (None, ["n0"])) for x, k in brute(g).items()}
        assert {tuple(r) for r in C.reach_each(e, groups).collect()} == want
        if not most:  # each round of a loop of joins is a job of a second, so the longer loops are left out
            return
        reach = {x: set(brute([x])) for x in {y for p in pairs for y in p}}
        assert dict(C.components(e).collect()) == {x: min(y for y in r if x in reach[y]) for x, r in reach.items()}
        ends = [y for y in brute(["n0"]) if y != "n0"][-1:] or ["zzz"]
        path = [r.node for r in C.shortest_path(e.where("src is not null and dst is not null"), seeds.where("node = 'n0'").distinct(), spark.createDataFrame([(ends[0],)], "node string")).orderBy("step").collect()]
        assert len(path) == (brute(["n0"])[ends[0]] + 1 if ends != ["zzz"] else 0) and all(p in pairs for p in zip(path, path[1:], strict=False))
    none = e.where("false")
    assert C.reach(none, seeds.where("false")).count() == 0 and C.reach_each(none, groups.where("false")).count() == 0 and C.components(none).count() == 0


def test_long_chains(spark):
    e = spark.range(5000).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst")
    assert C.reach(e, spark.createDataFrame([("n0",)], "node string")).agg(F.max("depth")).first()[0] == 5000
    path = C.shortest_path(e.where("length(src) < 4"), spark.createDataFrame([("n0",)], "node string"), spark.createDataFrame([("n60",)], "node string"))
    assert path.count() == 61
