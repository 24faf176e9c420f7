"""Queries over bounded subgraphs, composed pipelines and generic instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import bounded as B
from factweave.operators import closure as C
from factweave.operators import dispatch as D
from factweave.operators import entrypoints as EP
from factweave.operators import generics as N
from factweave.operators import graph as G
from factweave.operators import hazards as H
from factweave.operators import impact as I
from factweave.operators import relational as R
from factweave.operators import snapshots as S
from factweave.plans import projection as P
from factweave.plans._base import Book
from factweave.plans.derive import EFFECTS_SQL, effects
from factweave.plans.graphs import _CHA, MINED_SQL, _delivery, _edges, _seeds
from factweave.plans.graphs import SQL as GRAPHS_SQL
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

_REACH = """with recursive edges as (select distinct from_sym as src, to_sym as dst from call_edges), r(node) as (select distinct from_sym from call_edges where contains(lower(from_sym), 'controller.render') union select dst from r join edges on src = node)"""


def _reached(spark, d):
    return C.reach(_edges(spark, d), _seeds(spark, d)).select("node")


@book.query(f"{_REACH} select ref_kind, count(*) as n from reference_facts where enclosing_symbol_id in (select node from r) and ref_kind in ('invocation', 'ctor', 'throw') group by 1")
def d1_facts_within_reach(spark, d):
    return B.facts_within(T(spark, d, "reference_facts"), _reached(spark, d), ["invocation", "ctor", "throw"]).groupBy("ref_kind").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"{_REACH} select 'forward' as side, count(*) as n from call_edges where from_sym in (select node from r) union all select 'backward', count(*) from call_edges where to_sym in (select node from r)")
def d3_edges_within_reach(spark, d):
    e, r = T(spark, d, "call_edges"), _reached(spark, d)
    n = lambda s, b: B.edges_within(e, r, b).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return n("forward", False).unionAll(n("backward", True))


@book.query(f"{_REACH} select distinct symbol_id from symbol_facts where kind = 'method' and symbol_id in (select node from r)")
def d4_methods_within_reach(spark, d):
    return B.methods_within(T(spark, d, "symbol_facts").where("kind = 'method'"), _reached(spark, d)).select("symbol_id").distinct()


@book.query(
    """with f as (select enclosing_symbol_id as from_sym, target_symbol_id as to_sym, line, min(ref_kind) as ref_kind from reference_facts where enclosing_symbol_id is not null and target_symbol_id is not null group by 1, 2, 3)
       select from_sym, to_sym, line, ref_kind from (select distinct from_sym, to_sym, line from call_edges) left join f using (from_sym, to_sym, line)"""
)
def d5_attached_references(spark, d):
    e = T(spark, d, "call_edges").select("from_sym", "to_sym", "line").distinct()
    return B.attach(e, T(spark, d, "reference_facts"), ["ref_kind"])


@book.query("select count(*) as n from (select distinct * from call_edges) e where exists (select 1 from reference_facts r where r.enclosing_symbol_id = e.from_sym and r.file_path = e.file_path and r.line = e.line and r.ref_kind = 'read')")
def d9_co_located_edges(spark, d):
    sites = T(spark, d, "reference_facts").where("ref_kind = 'read'").select(F.col("enclosing_symbol_id").alias("from_sym"), "file_path", "line")
    return G.co_located(T(spark, d, "call_edges").distinct(), sites).agg(F.count(F.lit(1)).alias("n"))


@book.query(
    """with ep as (select distinct from_sym as method, file_path, line from call_edges where kind = 'handoff'), m as (select file_path, line, min(symbol_id) as located from symbol_facts where kind = 'method' group by 1, 2)
       select method, file_path, line, located from ep left join m using (file_path, line)"""
)
def d13_located_entry_points(spark, d):
    ep = T(spark, d, "call_edges").where("kind = 'handoff'").select(F.col("from_sym").alias("method"), "file_path", "line").distinct()
    return EP.locate(ep, T(spark, d, "symbol_facts").where("kind = 'method'"))




@book.query()
def f10_shaped_graph(spark, d):
    """The whole shaping in its order: first-party edges, handoffs, delivery, delegate fields, event marks."""
    refs = T(spark, d, "reference_facts")
    e = R.call_edges_of(refs).select("from_sym", "to_sym", "kind", "file_path", "line").withColumn("handoff_dispatcher", F.lit(None).cast("string")).withColumn("delivery_precision", F.lit(None).cast("string")).distinct()
    consumers = refs.where("ref_kind in ('invocation', 'ctor')").select(F.col("enclosing_symbol_id").alias("from_sym"), "file_path", "line", F.col("target_symbol_id").alias("consumer"))
    e = G.classify_handoffs(e, consumers, [("queued", "Corvane.Messaging"), ("platform", "Corvane")])
    delivered = G.delivery_edges(*_delivery(spark, d)).withColumn("handoff_dispatcher", F.col("tag")).select(*e.columns)
    fields = G.delegate_field_edges(P.field_facts(spark, d)).withColumn("handoff_dispatcher", F.lit(None).cast("string")).withColumn("delivery_precision", F.lit(None).cast("string")).select(*e.columns)
    # only method groups can be event subscriptions, and each part has its edges once, under kinds and dispatchers of
    # its own: neither the delivered edges nor those of fields, which are most of all, are shuffled again
    return G.mark_event_subscriptions(e, refs).unionAll(delivered).unionAll(fields)


@book.query(
    "with f as (select from_sym as hub, to_sym as dst from (select distinct from_sym, to_sym from call_edges)), k as (select * from f where contains(dst, 'Store')) select hub, dst from k union select hub, dst from f where hub not in (select hub from k)"
)
def f15_narrow_or_keep(spark, d):
    fans = T(spark, d, "call_edges").select(F.col("from_sym").alias("hub"), F.col("to_sym").alias("dst")).distinct()
    return D.narrow_or_keep(fans, fans.where(F.col("dst").contains("Store")), ["hub"]).distinct()


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL}
        select dst as node, count(distinct src) as hubs from o where src <> dst group by 1"""
)
def f22_reverse_dispatch(spark, d):
    return D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')")).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("hubs"))


_DISPATCH = P.SQL_DISPATCH.removeprefix(f"{P.SQL_TYPES}, {P.SQL_METHODS},")


@book.query(
    f"""{_CHA}, {_DISPATCH}, {MINED_SQL} select src, dst, 'override-dispatch' as kind from over_ where src <> dst union select src, dst, 'impl-dispatch' from impl_ where src <> dst
        union select src, dst, kind from ({GRAPHS_SQL['f12_error_type_recovery']}) union select src, dst, kind from cha where src not in (select src from o where src <> dst)"""
)
def f23_all_dispatch_edges(spark, d):
    """Mined dispatch, recovery of unresolved types, and the hierarchy for members without either."""
    found = D.mined(P.dispatch_facts(spark, d).where("kind in ('override', 'impl')"))
    broken = D.error_type_recovery(T(spark, d, "reference_facts").select(F.col("target_symbol_id").alias("to_sym")), T(spark, d, "symbol_facts").where("kind = 'method'"))
    return found.unionAll(broken).unionAll(D.hierarchy_fallback(P.methods(spark, d), P.type_relations(spark, d), found.select("src").distinct())).distinct()


@book.query(
    f"""with {EFFECTS_SQL}, s as (select distinct symbol_id from symbol_facts where kind = 'field' and contains(modifiers, 'static')) select provider, resource, enclosing_symbol_id from effects where contains(resource, 'Corvane') and enclosing_symbol_id in (select symbol_id from s)"""
)
def h15_static_init_captures(spark, d):
    return H.static_init_captures(effects(spark, d), T(spark, d, "symbol_facts"), ["Corvane"]).select("provider", "resource", "enclosing_symbol_id")


@book.query(
    """with recursive e as (select distinct from_sym as src, to_sym as dst from call_edges), r(a, b) as (select src, dst from e union select a, dst from r join e on src = b)
       select distinct h.from_sym, h.to_sym, h.handoff_dispatcher as dispatcher from call_edges h where kind = 'handoff' and handoff_dispatcher like '%event_raise' and (h.from_sym = h.to_sym or (h.to_sym, h.from_sym) in (select a, b from r))"""
)
def h13_event_cycle_edges(spark, d):
    c = C.components(_edges(spark, d))
    h = T(spark, d, "call_edges").where("kind = 'handoff' and handoff_dispatcher like '%event_raise'").select("from_sym", "to_sym", F.col("handoff_dispatcher").alias("dispatcher")).distinct()
    return h.join(c.select(F.col("node").alias("from_sym"), "component"), "from_sym").join(c.select(F.col("node").alias("to_sym"), F.col("component").alias("other")), "to_sym").where("component = other").select("from_sym", "to_sym", "dispatcher")


@book.query(
    """with a as (select distinct kind, to_sym as route from call_edges where kind = 'handoff' and delivery_precision = 'exact'), b as (select distinct kind, to_sym as route from call_edges where kind = 'handoff' and delivery_precision = 'fanout')
       select kind, route, 'removed' as change from (select * from a except select * from b) union all select kind, route, 'added' from (select * from b except select * from a)"""
)
def j6_entry_point_diff(spark, d):
    e = T(spark, d, "call_edges").where("kind = 'handoff'").select("kind", F.col("to_sym").alias("route"), "delivery_precision")
    return I.set_diff(e.where("delivery_precision = 'exact'"), e.where("delivery_precision = 'fanout'"), ["kind", "route"])


@book.query(
    """with f as (select id as run_id, any_value(solution_path) as solution_path, any_value(cast(regexp_replace(created_at_utc_text, '[.][0-9]+', '') as timestamptz)) as tm, any_value(rpad(regexp_extract(created_at_utc_text, '[.]([0-9]+)', 1), 9, '0')) as frac from runs where source_project_path is null and id in (select run_id from symbol_facts) group by 1)
       select run_id, solution_path, row_number() over (partition by solution_path order by tm, frac, run_id)::int as seq, count(*) over (partition by solution_path) as n_seq from f"""
)
def j24_snapshot_inventory(spark, d):
    return S.full_runs(T(spark, d, "runs"), T(spark, d, "symbol_facts")).select("run_id", "solution_path", "seq", "n_seq")


def _bindings(spark, d):
    e = T(spark, d, "call_edges").select("from_sym", "to_sym").distinct()
    generic = F.col("to_sym").contains("`1")
    token = F.when(F.col("from_sym").contains("`1"), F.lit('["T:0"]')).otherwise(F.concat(F.lit('["C:'), docid.simple_type_name(docid.method_type("from_sym")), F.lit('"]')))
    return e.withColumn("binding", F.when(generic, token))


_BIND = r"""e as (select distinct from_sym, to_sym from call_edges), g as (select from_sym, to_sym, contains(from_sym, '`1') as forwards,
    split_part(split_part(regexp_extract(regexp_extract(substr(split_part(from_sym, '(', 1), 3), '^(.*)[.][^.]*$', 1), '[^.]*$'), '{', 1), '`', 1) as t from e where contains(to_sym, '`1')),
    i(method, b) as (select to_sym, t from g where not forwards union select g.to_sym, i.b from i join g on g.from_sym = i.method where g.forwards)"""


@book.query(f"with recursive {_BIND} select method, b as binding from i")
def e15_generic_instances(spark, d):
    return N.instances(_bindings(spark, d), per_method=None, in_all=None).select("method", F.element_at("binding", 1).alias("binding"))


_MONO = """known as (select distinct method, b from i), made as (select e.from_sym, e.to_sym, g.forwards, g.t, case when contains(e.from_sym, '~λ') then split_part(e.from_sym, '~λ', 1) else e.from_sym end as owner from e left join g using (from_sym, to_sym)),
    plain as (select from_sym, case when not forwards and (to_sym, t) in (select method, b from known) then to_sym || '~mono⟨' || t || '⟩' else to_sym end as to_sym from made),
    copies as (select from_sym || '~mono⟨' || k.b || '⟩' as from_sym, case when forwards is null then to_sym when (to_sym, case when forwards then k.b else t end) in (select method, b from known) then to_sym || '~mono⟨' || case when forwards then k.b else t end || '⟩' else to_sym end as to_sym
      from made join known k on k.method = owner)"""


@book.query(f"with recursive {_BIND}, {_MONO} select from_sym, to_sym from plain union select from_sym, to_sym from copies")
def e16_monomorphized_edges(spark, d):
    e = _bindings(spark, d)
    return N.monomorphize(e, N.instances(e, per_method=None, in_all=None)).select("from_sym", "to_sym").distinct()
