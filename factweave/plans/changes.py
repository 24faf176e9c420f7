"""Queries that compare two sides of a program, and tree views.

The two sides are the two newest full runs' symbols, or the call graph without and with its handoffs and constructors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import closure as C
from factweave.operators import graph as G
from factweave.operators import impact as I
from factweave.operators import relational as R
from factweave.operators import snapshots as S
from factweave.operators import tree as V
from factweave.plans._base import Book
from factweave.plans.derive import EFFECTS_SQL, effects
from factweave.plans.problems import _FULL, _RECORDS
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


def _sides(spark, d):
    """(base, head): the symbols of the last but one and of the last full run of every solution."""
    symbols, runs = T(spark, d, "symbol_facts"), S.full_runs(T(spark, d, "runs"), T(spark, d, "symbol_facts"))
    records = S.symbol_records(symbols)
    side = lambda k: records.join(runs.where(F.col("seq") == F.col("n_seq") - k).select("run_id", "solution_path"), "run_id")
    return side(1), side(0)


_SIDES = f"""{_RECORDS}, {_FULL}, last as (select solution_path, max(seq) as n from full_runs group by 1),
    base as (select solution_path, symbol_id, h as body_hash from records join full_runs using (run_id) join last using (solution_path) where seq = n - 1),
    head as (select solution_path, symbol_id, h as body_hash from records join full_runs using (run_id) join last using (solution_path) where seq = n)"""


@book.query(
    f"""with {_SIDES}, b as (select distinct solution_path, symbol_id from base), h as (select distinct solution_path, symbol_id from head)
        select solution_path, symbol_id, 'removed' as change from (select * from b except select * from h) union all select solution_path, symbol_id, 'added' from (select * from h except select * from b)"""
)
def i14_set_difference(spark, d):
    base, head = _sides(spark, d)
    return I.set_diff(base, head, ["solution_path", "symbol_id"])


@book.query(
    f"""with {_SIDES}, b as (select solution_path, symbol_id, min(body_hash) as x from base where body_hash is not null group by 1, 2), h as (select solution_path, symbol_id, min(body_hash) as y from head where body_hash is not null group by 1, 2)
        select distinct coalesce(b.symbol_id, h.symbol_id) as symbol_id from b full join h on b.solution_path is not distinct from h.solution_path and b.symbol_id = h.symbol_id where x is distinct from y"""
)
def j10_body_changes(spark, d):
    return I.body_changes(*_sides(spark, d), ["solution_path"])


_E = {"base": "edges as (select distinct from_sym as src, to_sym as dst from call_edges where kind not in ('handoff', 'ctor'))", "head": "edges as (select distinct from_sym as src, to_sym as dst from call_edges)"}
_ROOTS = "roots as (select distinct from_sym as entry from call_edges where contains(lower(from_sym), 'controller.re'))"
_REACH = f"""{_E['base'].replace('edges', 'be')}, {_E['head'].replace('edges', 'he')}, {_ROOTS}, rb(entry, node) as (select entry, entry from roots union select entry, dst from rb join be on src = node),
    rh(entry, node) as (select entry, entry from roots union select entry, dst from rh join he on src = node)""".replace("call_be", "call_edges").replace("call_he", "call_edges")


def _graph_sides(spark, d):
    e = T(spark, d, "call_edges")
    entries = R.match_nodes(e.select(F.col("from_sym").alias("node")).distinct(), "node", "Controller.Re").select(F.col("node").alias("entry"), "node")
    return C.edge_list(G.gate_handoffs(e, "sync_cut").where("kind <> 'ctor'")), C.edge_list(e), entries


def _reach_sides(spark, d):
    be, he, entries = _graph_sides(spark, d)
    seeds = entries.select(F.col("entry").alias("seed"), "node")
    return tuple(C.reach_each(e, seeds).select(F.col("seed").alias("entry"), "node") for e in (be, he))


_FREE = "regexp_replace(split_part({c}, '(', 1), '^.:', '')"


@book.query(
    f"""with recursive {_REACH}, d as (select entry, {_FREE.format(c='node')} as stem, 'a' as c from (select * from rh except select * from rb) union all select entry, {_FREE.format(c='node')}, 'r' from (select * from rb except select * from rh))
        select entry, stem, case when count(distinct c) = 2 then 'signature' when min(c) = 'a' then 'added' else 'removed' end as kind from d group by 1, 2"""
)
def j9_reach_diff(spark, d):
    return I.reach_diff(*_reach_sides(spark, d))


_EDITS = """ch as (select distinct coalesce(b.symbol_id, h.symbol_id) as node from (select solution_path, symbol_id, min(body_hash) as x from base where body_hash is not null group by 1, 2) b
    full join (select solution_path, symbol_id, min(body_hash) as y from head where body_hash is not null group by 1, 2) h on b.solution_path = h.solution_path and b.symbol_id = h.symbol_id where x is distinct from y),
    edited as (select entry, node from rb where (entry, node) in (select entry, node from rh) and node in (select node from ch))"""
_ACCESSED = """ac as (select distinct enclosing_symbol_id as node, 'R:' || target_symbol_id as r from reference_facts where ref_kind in ('read', 'write') and target_in_source and target_symbol_id is not null),
    ab as (select entry, node from rb union select entry, r from rb join ac using (node)), ah as (select entry, node from rh union select entry, r from rh join ac using (node))"""


@book.query(
    f"""with recursive {_REACH}, {_SIDES}, {_EDITS}, {_ACCESSED}, m as (select distinct entry, {_FREE.format(c='node')} as stem from (select * from ah except select * from ab)
          union select distinct entry, {_FREE.format(c='node')} from (select * from ab except select * from ah)),
        g as (select entry, count(*) as stems, count(*) filter (ends_with(stem, '.#ctor')) as c, count(*) filter (starts_with(stem, 'R:') or contains(stem, '.get_') or contains(stem, '.set_') or ends_with(stem, '.#ctor')) as s from m group by 1)
        select entry, case when c = stems then 'constructor' when s >= 0.8 * stems then 'record_shape' else 'other' end as cause, stems from g
        union all select distinct entry, 'in_place', 0 from edited where entry not in (select entry from g)"""
)
def j11_structural_cause(spark, d):
    base, head = _reach_sides(spark, d)
    refs = T(spark, d, "reference_facts")
    diff = I.reach_diff(I.with_field_access(base, refs), I.with_field_access(head, refs))
    return I.structural_cause(diff, I.body_edits_in_reach(base, head, I.body_changes(*_sides(spark, d), ["solution_path"])))


@book.query(f"with recursive {_REACH}, {_SIDES}, {_EDITS} select entry, node from edited")
def i15_edits_in_reach(spark, d):
    return I.body_edits_in_reach(*_reach_sides(spark, d), I.body_changes(*_sides(spark, d), ["solution_path"]))


_FOOT = f"""{EFFECTS_SQL}, ee as (select enclosing_symbol_id as node, provider, operation, resource, bool_or(enclosing_loop_kind is not null) as in_loop from effects group by 1, 2, 3, 4),
    fb as (select entry, provider, operation, resource, {_FREE.format(c='node')} as enclosing, count(distinct node) as n_nodes, bool_or(in_loop) as in_loop from rb join ee using (node) group by 1, 2, 3, 4, 5),
    fh as (select entry, provider, operation, resource, {_FREE.format(c='node')} as enclosing, count(distinct node) as n_nodes, bool_or(in_loop) as in_loop from rh join ee using (node) group by 1, 2, 3, 4, 5)"""


@book.query(f"with recursive {_REACH}, {_FOOT} select * from fb")
def j7_footprints(spark, d):
    be, _, entries = _graph_sides(spark, d)
    return I.footprints(be, entries, effects(spark, d))


_DIFF = """diff as (select entry, provider, operation, resource, enclosing, case when b.n_nodes is null then 'added' when h.n_nodes is null then 'removed' when h.n_nodes > b.n_nodes or (h.in_loop and not b.in_loop) then 'amplified' end as change
    from fb b full join fh h using (entry, provider, operation, resource, enclosing))"""


def _foot_diff(spark, d):
    be, he, entries = _graph_sides(spark, d)
    e = effects(spark, d)
    return I.footprint_diff(I.footprints(be, entries, e), I.footprints(he, entries, e))


@book.query(f"with recursive {_REACH}, {_FOOT}, {_DIFF} select entry, provider, operation, resource, enclosing, change, provider = 'shared_state' and operation = 'mutate' as shared_mutation from diff where change is not null")
def j8_footprint_diff(spark, d):
    return _foot_diff(spark, d)


@book.query(f"with recursive {_REACH}, {_FOOT}, {_DIFF} select count(distinct entry) as entries from diff where change is not null")
def j13_gate_count(spark, d):
    return I.gate_count(_foot_diff(spark, d))


@book.query(f"with recursive {_REACH}, {_FOOT}, {_DIFF} select distinct entry, provider, change from diff where change in ('added', 'removed') and provider = 'cache' and entry in (select entry from fh where provider = 'shared_state')")
def j12_guard_delta(spark, d):
    _, he, entries = _graph_sides(spark, d)
    return I.guard_delta(_foot_diff(spark, d), I.footprints(he, entries, effects(spark, d)), locks=["cache"])


@book.query(
    f"""with recursive {_REACH}, a as (select distinct enclosing_symbol_id as node, 'R:' || target_symbol_id as r from reference_facts where ref_kind in ('read', 'write') and target_in_source and target_symbol_id is not null)
        select entry, count(*) as n from (select entry, node from rb union select entry, r from rb join a using (node)) group by 1"""
)
def j14_field_access_nodes(spark, d):
    base, _ = _reach_sides(spark, d)
    return I.with_field_access(base, T(spark, d, "reference_facts")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    f"""with recursive {_E['base']}, {EFFECTS_SQL}, s(seed, node) as (select distinct 'left_only', from_sym from call_edges where contains(lower(from_sym), 'controller.re') union select distinct 'right_only', from_sym from call_edges where contains(lower(from_sym), 'store.re')),
        r(seed, node) as (select seed, node from s union select seed, dst from r join edges on src = node),
        k as (select distinct enclosing_symbol_id as node, regexp_extract(split_part(split_part(resource, '{{', 1), '`', 1), '[^.]*$') as resource_key, provider || ':' || operation as token from effects)
        select resource_key, min(seed) as direction, array_to_string(list_sort(list_distinct(list(token))), ',') as categories from r join k using (node) group by 1 having count(distinct seed) = 1"""
)
def j15_effect_set_diff(spark, d):
    be, _, entries = _graph_sides(spark, d)
    right = R.match_nodes(T(spark, d, "call_edges").select(F.col("from_sym").alias("node")).distinct(), "node", "Store.Re")
    return I.effect_set_diff(be, effects(spark, d), entries.select("node"), right)


def _root(spark, d):
    return T(spark, d, "call_edges").where(F.lower("from_sym").contains("controller.re")).agg(F.min("from_sym")).first()[0] or ""


@book.query()
def e11_call_tree(spark, d):
    return V.call_tree(T(spark, d, "call_edges").where("kind <> 'handoff'"), _root(spark, d), max_depth=8)


@book.query()
def j18_tree_effects(spark, d):
    return V.effect_view(e11_call_tree(spark, d), effects(spark, d))


@book.query()
def j22_full_leaves(spark, d):
    return V.full_leaves(e11_call_tree(spark, d), effects(spark, d), T(spark, d, "reference_facts"))


@book.query()
def b9_tree_summary(spark, d):
    return V.summary_rows(e11_call_tree(spark, d), effects(spark, d))


@book.query(f"with {EFFECTS_SQL} select enclosing_symbol_id, l || case when n > 1 then ' ×' || n else '' end as label from (select enclosing_symbol_id, provider || ':' || operation || ':' || resource as l, count(*) as n from effects group by 1, 2)")
def i10_effect_groups(spark, d):
    return V.effect_groups(effects(spark, d))


@book.query(
    f"""with recursive {_REACH}, {EFFECTS_SQL} select entry as seed, provider, operation, count(distinct resource) as resources from rb join effects on node = enclosing_symbol_id group by 1, 2, 3"""
)
def i9_seam_resources(spark, d):
    be, _, entries = _graph_sides(spark, d)
    return V.seam_resources(be, entries.select(F.col("entry").alias("seed"), "node"), effects(spark, d))


@book.query(f"with recursive {_REACH}, {EFFECTS_SQL} select provider, operation, count(*) as sites from effects where enclosing_symbol_id in (select node from rb) group by 1, 2")
def j21_effect_summary(spark, d):
    base, _ = _reach_sides(spark, d)
    return effects(spark, d).join(base.select(F.col("node").alias("enclosing_symbol_id")).distinct(), "enclosing_symbol_id", "left_semi").groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("sites"))


_HAS = "list_contains(string_split(coalesce(modifiers, ''), ' '), '{t}')"


@book.query(
    f"""with recursive edges as (select distinct from_sym as src, to_sym as dst from call_edges), ms as (select * from symbol_facts where kind = 'method'),
       m as (select symbol_id, struct_extract(x, 1) as file_path, struct_extract(x, 2) as line, struct_extract(x, 3) as modifiers, struct_extract(x, 4) as name, struct_extract(x, 5) as is_override from (select symbol_id, min((file_path, line, modifiers, name, is_override)) as x from ms group by 1)),
       alive(node) as (select distinct from_sym from call_edges where kind = 'handoff' union select distinct symbol_id from ms where {_HAS.format(t='public')} or {_HAS.format(t='protected')} union select dst from alive join edges on src = node),
       c as (select to_sym, count(*) as callers from call_edges group by 1)
       select symbol_id, case when {_HAS.format(t='private')} then 'high' when {_HAS.format(t='public')} or {_HAS.format(t='protected')} then 'low' else 'medium' end as tier,
         case when coalesce(callers, 0) = 0 then 'uncalled' else 'only reached by dead code' end as reason, coalesce(callers, 0) as callers, file_path, line
       from m left join c on to_sym = symbol_id where symbol_id not in (select node from alive) and name not in ('.ctor', '.cctor', 'Finalize') and not regexp_matches(name, '^(get_|set_|add_|remove_|op_)')
         and not {_HAS.format(t='abstract')} and not {_HAS.format(t='virtual')} and not is_override and not (contains(file_path, '<generated>') or regexp_matches(lower(file_path), '[.](g|g[.]i|designer|generated)[.]cs$'))"""
)
def i12_dead_code(spark, d):
    e = T(spark, d, "call_edges").select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"), "kind").where("src is not null and dst is not null")
    methods = T(spark, d, "symbol_facts").where("kind = 'method'").select("symbol_id", "name", "modifiers", "is_override", "file_path", "line")
    roots = e.where("kind = 'handoff'").select(F.col("src").alias("node")).distinct()
    return V.dead_code(e.select("src", "dst"), methods, roots)


@book.query(
    """with recursive edges as (select distinct from_sym as src, to_sym as dst from call_edges), s(node) as (select distinct dst from edges where contains(lower(dst), 'store.re')), r(node, depth) using key (node) as (select node, 0 from s union select src, min(depth) + 1 from r join edges on dst = node where src not in (select node from recurring.r) group by src)
       select node, depth, depth = 0 as subject from r"""
)
def j19_callers(spark, d):
    e = C.edge_list(T(spark, d, "call_edges"))
    subject = R.match_nodes(e.select(F.col("dst").alias("node")).distinct(), "node", "Store.Re")
    return C.reach(C.reverse(e), subject).withColumn("subject", F.col("depth") == 0).orderBy("depth", "node")


@book.query(
    """with recursive edges as (select distinct from_sym as src, to_sym as dst from call_edges), s(node) as (select distinct dst from edges where contains(lower(dst), 'store.re')), r(node) as (select node from s union select src from r join edges on dst = node)
       select node from r where node not in (select dst from edges)"""
)
def j16_root_callers(spark, d):
    """Roots among the callers, each verified by its own reach forwards."""
    e = C.edge_list(T(spark, d, "call_edges"))
    subject = R.match_nodes(e.select(F.col("dst").alias("node")).distinct(), "node", "Store.Re")
    back = C.reach(C.reverse(e), subject).select("node").join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    ok = C.groups_reaching(e, back.select(F.col("node").alias("seed"), "node"), subject).where("reaches")
    return ok.select(F.col("seed").alias("node"))
