"""Queries over the call graph: closures, components, shaping and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure as C
from factweave.operators import dispatch as D
from factweave.operators import graph as G
from factweave.operators import relational as R
from factweave.plans import projection as P
from factweave.plans._base import Book
from factweave.plans.relational import d18_assembly_usage
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

SEED = "Controller.Render"
_SEEDS = "select distinct from_sym as node from call_edges where contains(lower(from_sym), 'controller.render')"
_E = "edges as (select distinct from_sym as src, to_sym as dst from call_edges)"
_SYNC = "edges as (select distinct from_sym as src, to_sym as dst from call_edges where kind <> 'handoff')"


def _edges(spark, d, mode="async_include"):
    return C.edge_list(G.gate_handoffs(T(spark, d, "call_edges"), mode))


def _seeds(spark, d):
    return R.match_nodes(T(spark, d, "call_edges").select(F.col("from_sym").alias("node")).distinct(), "node", SEED)


def _reach_sql(edges, seeds, extra=""):
    return f"with recursive {edges}, r(node) as ({seeds} union select dst from r join edges on src = node) {extra or 'select node from r'}"


@book.query(_reach_sql(_E, _SEEDS))
def e1_reach(spark, d):
    return C.reach(_edges(spark, d), _seeds(spark, d)).select("node")


@book.query(f"with recursive {_E}, r(node, depth) using key (node) as (select node, 0 from ({_SEEDS}) union select dst, min(depth) + 1 from r join edges on src = node where dst not in (select node from recurring.r) group by dst) select node, depth from r")
def e2_reach_depth(spark, d):
    return C.reach(_edges(spark, d), _seeds(spark, d))


@book.query(
    " union all ".join(
        f"select '{m}' as mode, count(*) as n from ({_reach_sql(f'edges as (select distinct from_sym as src, to_sym as dst from call_edges where {w})', _SEEDS)})"
        for m, w in (("sync_cut", "kind <> 'handoff'"), ("async_exact", "not (kind = 'handoff' and delivery_precision = 'fanout')"), ("async_include", "true"))
    )
)
def f20_reach_by_mode(spark, d):
    out = None
    for mode in G.MODES:
        n = C.reach(_edges(spark, d, mode), _seeds(spark, d)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@book.query(
    f"""with recursive {_E}, r(node) as (select distinct dst from edges where contains(lower(dst), 'store.save') union select src from r join edges on dst = node)
        select node from r where node not in (select dst from edges)"""
)
def e4_entry_roots(spark, d):
    e = _edges(spark, d)
    target = e.where(F.lower("dst").contains("store.save")).select(F.col("dst").alias("node")).distinct()
    back = C.reach(C.reverse(e), target).select("node")
    return back.join(e.select(F.col("dst").alias("node")), "node", "left_anti")


_ROOTS = "select distinct src as seed, src as node from edges where src not in (select dst from edges)"


def _roots(e):
    return e.join(e.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()


@book.query(f"with recursive {_SYNC}, r(seed, node) as ({_ROOTS} union select seed, dst from r join edges on src = node) select seed, count(*) as n from r group by 1")
def e6_reach_per_root(spark, d):
    e = _edges(spark, d, "sync_cut")
    return C.reach_each(e, _roots(e)).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    f"""with recursive {_SYNC}, r(seed, node) as ({_ROOTS} union select seed, dst from r join edges on src = node)
        select seed, bool_or(contains(lower(node), 'writer')) as reaches from r group by 1"""
)
def e7_groups_reach_target(spark, d):
    e = _edges(spark, d, "sync_cut")
    targets = e.select(F.explode(F.array("src", "dst")).alias("node")).where(F.lower("node").contains("writer")).distinct()
    return C.groups_reaching(e, _roots(e), targets)


@book.query(
    f"""with recursive {_E}, r(node, depth) using key (node) as (select distinct dst, 0 from edges where contains(lower(dst), 'store.save') union select src, min(depth) + 1 from r join edges on dst = node where src not in (select node from recurring.r) group by src)
        select node, depth from r"""
)
def e9_reverse_depth(spark, d):
    e = _edges(spark, d)
    target = e.where(F.lower("dst").contains("store.save")).select(F.col("dst").alias("node")).distinct()
    return C.reach(C.reverse(e), target)


@book.query(
    f"""with recursive {_E}, r(node, depth) using key (node) as (select distinct dst, 1 from edges where src in (select node from ({_SEEDS})) union select dst, min(depth) + 1 from r join edges on src = node where dst not in (select node from recurring.r) group by dst)
        select min(depth) as length from r where contains(lower(node), 'mapper') having min(depth) is not null"""
)
def e10_path_length(spark, d):
    return e10_shortest_path(spark, d).agg(F.max("step").alias("length")).where("length is not null")


@book.query()
def e10_shortest_path(spark, d):
    e = _edges(spark, d)
    targets = e.where(F.lower("dst").contains("mapper")).select(F.col("dst").alias("node")).distinct()
    return C.shortest_path(e, _seeds(spark, d), targets)


@book.query(
    f"with recursive {P.SQL_TYPES}, r(type) as (select symbol_id from types where k = 2 union select type_symbol_id from r join relations on related_symbol_id = type where relation_kind = 'base') select distinct split_part(split_part(type, '{{', 1), '`', 1) as type from r"
)
def e12_type_closure(spark, d):
    roots = [r.symbol_id for r in P.types(spark, d).where("k = 2").collect()]
    return D.type_closure(P.type_relations(spark, d), roots)


_PAIRS = f"with recursive {_E}, r(a, b) as (select src, dst from edges union select a, dst from r join edges on src = b)"


@book.query(
    f"{_PAIRS}, n as (select src as node from edges union select dst from edges), m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a union select node, node from n) select a as node, min(b) as component from m group by 1"
)
def e13_components(spark, d):
    return C.components(_edges(spark, d))


@book.query(
    f"""{_PAIRS}, n as (select src as node from edges union select dst from edges), m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a union select node, node from n),
        c as (select a as node, min(b) as component from m group by 1)
        select p.component, count(*) as deliveries, case when bool_or(handoff_dispatcher like '%tell') then 'low' else 'high' end as confidence from
        (select distinct from_sym, to_sym, handoff_dispatcher from call_edges where kind = 'handoff' and (handoff_dispatcher like '%event_raise' or handoff_dispatcher like '%tell')) h
        join c p on p.node = h.from_sym join c q on q.node = h.to_sym where p.component = q.component group by 1"""
)
def e13_event_cycles(spark, d):
    c = C.components(_edges(spark, d))
    tell = F.col("handoff_dispatcher").endswith("tell")
    h = T(spark, d, "call_edges").where((F.col("kind") == "handoff") & (tell | F.col("handoff_dispatcher").endswith("event_raise"))).select("from_sym", "to_sym", "handoff_dispatcher").distinct()
    p = c.select(F.col("node").alias("from_sym"), "component")
    q = c.select(F.col("node").alias("to_sym"), F.col("component").alias("other"))
    return h.join(p, "from_sym").join(q, "to_sym").where("component = other").groupBy("component").agg(
        F.count(F.lit(1)).alias("deliveries"), F.when(F.max(tell), "low").otherwise("high").alias("confidence")
    )


@book.query(
    """with recursive u as (select a.from_assembly as src, r.target_assembly as dst, count(*) as uses from reference_facts r
         join (select symbol_id, min(defining_assembly) as from_assembly from symbol_facts group by 1) a on a.symbol_id = r.enclosing_symbol_id
         where r.target_assembly <> '' and a.from_assembly <> r.target_assembly group by 1, 2),
       r(seed, node) as (select distinct src, src from u union select seed, dst from r join u on src = node) select seed, node from r"""
)
def e14_project_closure(spark, d):
    e = d18_assembly_usage(spark, d).select(F.col("from_assembly").alias("src"), F.col("to_assembly").alias("dst"))
    return C.reach_each(e, e.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()).select("seed", "node")


@book.query()
def e5_reach_payload(spark, d):
    e = G.gate_handoffs(T(spark, d, "call_edges"), "async_exact").withColumn("basis", F.lit(None).cast("string")).withColumn("degree", F.lit(None).cast("int"))
    return C.reach_with_payload(e, _seeds(spark, d), max_depth=None)


@book.query(
    "select target, count(*) as n from (select case when not target_in_source and starts_with(target_symbol_id, 'M:Corvane.Mail.') then 'M:Host.Outbox.Post' else target_symbol_id end as target from reference_facts) where target = 'M:Host.Outbox.Post' group by 1"
)
def f2_redirect(spark, d):
    refs = T(spark, d, "reference_facts")
    rules = refs.where("not target_in_source and target_symbol_id like 'M:Corvane.Mail.%'").select(docid.head("target_symbol_id").alias("method")).distinct().withColumn("redirect_to", F.lit("M:Host.Outbox.Post"))
    return G.redirect(refs, rules).where("target_symbol_id = 'M:Host.Outbox.Post'").groupBy(F.col("target_symbol_id").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@book.query(
    r"""with s as (select enclosing_symbol_id as from_sym, file_path, line, min(case when contains(c, 'Factory') then 0 when contains(c, 'Corvane.Messaging') then 1 when contains(c, 'Corvane') then 2 end) as r
          from (select *, regexp_replace(target_symbol_id, '`+\d*', '', 'g') as c from reference_facts where ref_kind in ('invocation', 'ctor')) group by 1, 2, 3)
        select from_sym, to_sym, line, case when kind = 'methodGroup' and r is not null then 'handoff' else kind end as kind, case when kind = 'methodGroup' and r is not null then ['made', 'queued', 'platform'][r + 1] else handoff_dispatcher end as dispatcher
        from call_edges left join s using (from_sym, file_path, line) where kind in ('methodGroup', 'handoff')"""
)
def f3_classify_handoffs(spark, d):
    consumers = T(spark, d, "reference_facts").where("ref_kind in ('invocation', 'ctor')").select(F.col("enclosing_symbol_id").alias("from_sym"), "file_path", "line", F.col("target_symbol_id").alias("consumer"))
    e = T(spark, d, "call_edges").where("kind in ('methodGroup', 'handoff')")
    out = G.classify_handoffs(e, consumers, [("made", "Factory"), ("queued", "Corvane.Messaging"), ("platform", "Corvane")])
    return out.select("from_sym", "to_sym", "line", "kind", F.col("handoff_dispatcher").alias("dispatcher"))


@book.query(
    """with b as (select distinct target_symbol_id as slot, enclosing_symbol_id as to_sym from reference_facts where ref_kind = 'write' and target_symbol_id like 'F:%' and enclosing_symbol_id is not null),
       i as (select distinct target_symbol_id as slot, enclosing_symbol_id as from_sym from reference_facts where ref_kind = 'read' and enclosing_loop_kind is not null and target_symbol_id like 'F:%' and enclosing_symbol_id is not null),
       x as (select target_symbol_id as slot from reference_facts where ref_kind = 'read' and enclosing_guards is not null and target_symbol_id like 'F:%' and enclosing_symbol_id is not null)
       select distinct from_sym, to_sym, 'delegate-field' as kind, '' as file_path, 0 as line from b join i using (slot) where slot not in (select slot from x)"""
)
def f4_delegate_field_edges(spark, d):
    return G.delegate_field_edges(P.field_facts(spark, d))


@book.query(
    """select count(*) as marked from call_edges e where kind = 'methodGroup' and exists (select 1 from reference_facts r where r.ref_kind = 'read' and r.target_symbol_id like 'E:%' and r.enclosing_symbol_id = e.from_sym and r.file_path = e.file_path and r.line = e.line)"""
)
def f5_event_subscriptions(spark, d):
    return G.mark_event_subscriptions(T(spark, d, "call_edges"), T(spark, d, "reference_facts")).where("handoff_dispatcher = 'event'").agg(F.count(F.lit(1)).alias("marked"))


_DELIVER = """p as (select enclosing_symbol_id as caller, case when starts_with(first_argument_template, '/') then 'http' else 'topic' end as tag, first_argument_template as token, min((file_path, line)) as s
      from reference_facts where first_argument_template is not null and not target_in_source and enclosing_symbol_id is not null group by 1, 2, 3),
    h as (select distinct target_symbol_id as handler, case when starts_with(first_argument_template, '/') then 'http' else 'topic' end as tag, first_argument_template as token from reference_facts
      where first_argument_template is not null and target_in_source and target_symbol_id is not null),
    n as (select tag, token, count(*) as n from h group by 1, 2),
    delivered as (select caller as from_sym, handler as to_sym, tag, 'handoff' as kind, min(s)[1] as file_path, min(s)[2] as line, min(case when n = 1 then 'exact' else 'fanout' end) as delivery_precision
      from p join h using (tag, token) join n using (tag, token) group by 1, 2, 3)"""


def _delivery(spark, d):
    r = T(spark, d, "reference_facts").where("first_argument_template is not null")
    tag = F.when(F.col("first_argument_template").startswith("/"), "http").otherwise("topic").alias("tag")
    token = F.col("first_argument_template").alias("token")
    producers = r.where("not target_in_source and enclosing_symbol_id is not null").select(F.col("enclosing_symbol_id").alias("caller"), "file_path", "line", tag, token)
    handlers = r.where("target_in_source and target_symbol_id is not null").select(F.col("target_symbol_id").alias("handler"), tag, token)
    return producers, handlers


@book.query(f"with {_DELIVER} select from_sym, to_sym, tag, kind, file_path, line, delivery_precision from delivered".replace("min(s)[1]", "struct_extract(min(s), 1)").replace("min(s)[2]", "struct_extract(min(s), 2)"))
def f6_delivery_edges(spark, d):
    return G.delivery_edges(*_delivery(spark, d))


@book.query(
    "select distinct caller, tag, token from (select enclosing_symbol_id as caller, 'event' as tag, target_symbol_id as token from reference_facts where target_symbol_id like 'E:%' and ref_kind = 'read' union all select enclosing_symbol_id, 'arg', first_argument_template from reference_facts where contains(first_argument_template, '.')) where caller is not null"
)
def f7_delivery_sites(spark, d):
    r = T(spark, d, "reference_facts").where("enclosing_symbol_id is not null")
    events = r.where("target_symbol_id like 'E:%' and ref_kind = 'read'").select(F.col("enclosing_symbol_id").alias("caller"), F.lit("event").alias("tag"), F.col("target_symbol_id").alias("token"))
    named = r.where(F.col("first_argument_template").contains(".")).select(F.col("enclosing_symbol_id").alias("caller"), F.lit("arg").alias("tag"), F.col("first_argument_template").alias("token"))
    return events.unionAll(named).distinct()


#: Dispatch of both kinds, each closed by itself.
MINED_SQL = """over_(src, dst) as (select source_member, target_member from dispatch where kind = 'override' union select src, target_member from over_ join dispatch on source_member = dst where kind = 'override'),
        impl_(src, dst) as (select source_member, target_member from dispatch where kind = 'impl' union select src, target_member from impl_ join dispatch on source_member = dst where kind = 'impl'),
        o as (select src, dst from over_ union select src, dst from impl_)"""


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL}
        select src, dst, 'override-dispatch' as kind from over_ where src <> dst union select src, dst, 'impl-dispatch' from impl_ where src <> dst"""
)
def f11_mined_dispatch(spark, d):
    return D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')"))


@book.query(
    r"""with u as (select distinct target_symbol_id as src from reference_facts where target_symbol_id like '!:%'), p as (select src, regexp_extract(regexp_replace(split_part(src, '(', 1), '^.:', ''), '([^.]*)[.][^.]*$', 1) as o,
          regexp_extract(split_part(src, '(', 1), '[^.]*$') as name, case when contains(src, '(') then len(src) - len(replace(src, ',', '')) + 1 else 0 end as arity from u),
        m as (select distinct symbol_id as dst, regexp_extract(split_part(regexp_replace(split_part(symbol_id, '(', 1), '^.:', ''), '~', 1), '[^.]*$') as name0, regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$') as name,
          split_part(regexp_extract(substr(split_part(symbol_id, '(', 1), 3), '([^.]*)[.][^.]*$', 1), '`', 1) as simple, case when contains(symbol_id, '(') then len(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{[^{}]*\}', '', 'g')) - len(replace(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{[^{}]*\}', '', 'g'), ',', '')) + 1 else 0 end as arity from symbol_facts where kind = 'method')
        select src, dst, 'impl-dispatch' as kind from p join m on split_part(p.o, '`', 1) = m.simple and p.name = m.name and p.arity = m.arity"""
)
def f12_error_type_recovery(spark, d):
    edges = T(spark, d, "reference_facts").select(F.col("target_symbol_id").alias("to_sym"))
    return D.error_type_recovery(edges, T(spark, d, "symbol_facts").where("kind = 'method'"))


_ARITY = r"case when not contains(symbol_id, '(') then 0 else len(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{[^{}]*\}', '', 'g')) - len(replace(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{[^{}]*\}', '', 'g'), ',', '')) + 1 end"
_CHA = f"""with recursive {P.SQL_TYPES}, {P.SQL_METHODS}, bare as (select split_part(split_part(related_symbol_id, '{{', 1), '`', 1) as up, split_part(split_part(type_symbol_id, '{{', 1), '`', 1) as down, relation_kind from relations),
        desc_(anc, type) as (select up, down from bare where relation_kind = 'base' union select anc, down from desc_ join bare on up = type where relation_kind = 'base'),
        m as (select distinct symbol_id, is_override, 'T:' || split_part(split_part(regexp_extract(substr(split_part(symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1), '{{', 1), '`', 1) as type, regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$') as name, {_ARITY} as arity from methods where not contains(symbol_id, '#ctor') or contains(symbol_id, '#ctor~')),
        mm as (select * from m where name <> '#ctor'),
        cha as (select distinct a.symbol_id as src, b.symbol_id as dst, 'impl-dispatch' as kind from mm a join bare r on r.up = a.type and r.relation_kind = 'interface' join mm b on b.type = r.down and b.name = a.name and b.arity = a.arity where a.symbol_id <> b.symbol_id
          union select a.symbol_id, b.symbol_id, 'override-dispatch' from mm a join desc_ on anc = a.type join mm b on b.type = desc_.type and b.name = a.name and b.arity = a.arity where b.is_override and a.symbol_id <> b.symbol_id)"""


@book.query(f"{_CHA} select * from cha")
def f13_hierarchy_fallback(spark, d):
    none = T(spark, d, "call_edges").where("false").select(F.col("from_sym").alias("src"))
    return D.hierarchy_fallback(P.methods(spark, d), P.type_relations(spark, d), none)


@book.query(
    "select 'call' as kind, count(*) as n from (select distinct from_sym, to_sym from call_edges where not contains(lower(split_part(from_sym, '(', 1)), 'corvane.platform'))"
)
def f21_traversal_cut(spark, d):
    return G.cut(T(spark, d, "call_edges"), ["Corvane.Platform"]).select("from_sym", "to_sym").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("call").alias("kind"), "n")


@book.query("select sym from (select from_sym as sym from call_edges union select to_sym from call_edges union select symbol_id from symbol_facts where kind = 'method')")
def f24_node_universe(spark, d):
    return R.node_universe([T(spark, d, "call_edges")], T(spark, d, "symbol_facts").where("kind = 'method'"))


@book.query("select from_sym, to_sym, kind, line, row_number() over (partition by from_sym order by line, to_sym, kind, coalesce(receiver_type, '')) as place from (select distinct from_sym, to_sym, kind, line, receiver_type from call_edges)")
def f25_adjacency_order(spark, d):
    return G.adjacency_places(T(spark, d, "call_edges")).drop("receiver_type")


_OWN = "split_part(split_part(regexp_extract(substr(split_part({c}, '(', 1), 3), '^(.*)[.][^.]*$', 1), '{{', 1), '`', 1)"


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL}, bare as (select distinct split_part(split_part(related_symbol_id, '{{', 1), '`', 1) as up, split_part(split_part(type_symbol_id, '{{', 1), '`', 1) as down, relation_kind from relations),
        bd(anc, type, depth) as (select up, up, 0 from bare union select down, down, 0 from bare union select anc, down, depth + 1 from bd join bare on up = type where relation_kind = 'base'),
        rt as (select anc, type from bd union select up, down from bare where relation_kind = 'interface' union select b.up, bd.type from bare b join bd on bd.anc = b.down where b.relation_kind = 'interface'),
        fans as (select distinct src as hub, dst, 'T:' || {_OWN.format(c='dst')} as type from o where src <> dst),
        pairs as (select distinct hub, split_part(split_part(m.type, '{{', 1), '`', 1) as receiver, 'T:' || {_OWN.format(c='hub')} as own from fans join methods m on m.symbol_id = dst),
        useful as (select hub, receiver from pairs where receiver <> own and (own, receiver) in (select anc, type from rt)),
        within_ as (select u.hub, u.receiver, f.dst from useful u join fans f using (hub) where (u.receiver, f.type) in (select anc, type from rt)),
        up_ as (select u.hub, u.receiver, f.dst, bd.depth from useful u join fans f using (hub) join bd on bd.anc = f.type and bd.type = u.receiver where (u.hub, u.receiver) not in (select hub, receiver from within_))
        select p.hub, p.receiver, f.dst from pairs p join fans f using (hub) where (p.hub, p.receiver) not in (select hub, receiver from useful) union select hub, receiver, dst from within_
        union select hub, receiver, dst from up_ x where depth = (select min(depth) from up_ y where y.hub = x.hub and y.receiver = x.receiver)"""
)
def f14_narrowed_fans(spark, d):
    relations = P.type_relations(spark, d)
    fans = D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')")).select(F.col("src").alias("hub"), "dst").distinct()
    bases = D.type_descendants(relations, ["base"])
    calls = fans.join(P.methods(spark, d).select(F.col("symbol_id").alias("dst"), "type"), "dst").select("hub", docid.strip_generic("type").alias("receiver"))
    return D.narrow_by_receiver(calls, fans, D.receiver_types(relations, bases), bases)


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL},
        real_ as (select distinct from_sym, to_sym, non_virtual from call_edges)
        select from_sym as src, to_sym as dst, null as via from real_ union select from_sym, dst, to_sym from real_ join o on src = to_sym where not non_virtual and src <> dst"""
)
def f19_one_hop(spark, d):
    return D.one_hop(T(spark, d, "call_edges"), D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')")))


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL},
        f as (select src as hub, count(distinct dst) as fan from o where src <> dst group by 1 having count(distinct dst) > 1)
        select hub, fan, count(*) as edges, fan * count(*) as weight from f join call_edges on to_sym = hub group by 1, 2"""
)
def e18_dispatch_fans(spark, d):
    fans = D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')")).select(F.col("src").alias("hub"), "dst").distinct()
    calls = T(spark, d, "call_edges").select(F.col("to_sym").alias("hub"), docid.receiver_type_id("receiver_type").alias("receiver"))
    # receivers of these tables lie outside of the hubs' hierarchies, so they narrow nothing
    relations = P.type_relations(spark, d)
    bases = D.type_descendants(relations, ["base"])
    narrowed = D.narrow_by_receiver(calls, fans, D.receiver_types(relations, bases), bases)
    return D.fan_report(calls, fans, narrowed).select("hub", "fan", "edges", "weight")
